"""loomgrid: hierarchical, sheet-shaped and tabular data on Spark DataFrames."""
