"""Part of loomgrid."""
