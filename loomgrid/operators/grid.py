"""Sheets as relations of full cells (r, c, v), and captures of rectangles in them.

Planning a capture takes a few aggregates over the cells, each of which returns one row to the driver; what is
captured stays a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.refs import MANY, MOVES, Edge, Ref, parse, resolve


class EmptyCapture(ValueError):
    """No full cell where one was looked for."""


def number_rows(df: DataFrame, key: str, to: str = "r", slots: int = 1024) -> DataFrame:
    """0-based place of each row in the order of a whole-number key.

    Rows are numbered inside slots of the key's range, which run in parallel, and shifted by the sizes of the slots before.
    Rows without a key come first.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slots))
    slotted = df.withColumn("_slot", F.coalesce(F.floor((F.col(key) - F.lit(low or 0)) / width).cast("int"), F.lit(-1)))
    before = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    sizes = slotted.groupBy("_slot").agg(F.count("*").alias("_n")).select("_slot", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(key)) - 1 + F.col("_before")
    return slotted.join(F.broadcast(sizes), "_slot").withColumn(to, place.cast("int")).drop("_slot", "_before")


def cells_of(df: DataFrame, row: str, columns: list[str] | None = None, kind: str = "string") -> DataFrame:
    """The full cells of a table whose column `row` numbers its rows; null is empty, '' and NaN are full."""
    columns = columns or [c for c in df.columns if c != row]
    pairs = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast(kind).alias("v")) for i, c in enumerate(columns)))
    return df.select(F.col(row).cast("int").alias("r"), F.inline(pairs)).where("v is not null")


class Sheet:
    """A cells relation with its margins."""

    def __init__(self, cells: DataFrame):
        self.cells = cells.persist()  # every step of planning reads them again

    @cached_property
    def margins(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Top-left and bottom-right full coordinates; zeros for an empty sheet."""
        r1, c1, r2, c2 = self.cells.agg(F.min("r"), F.min("c"), F.max("r"), F.max("c")).first()
        return ((r1, c1), (r2, c2)) if r1 is not None else ((0, 0), (0, 0))

    def is_full(self, at: tuple[int, int]) -> bool:
        return not self.cells.where((F.col("r") == at[0]) & (F.col("c") == at[1])).isEmpty()

    @staticmethod
    def opposite_key(at: tuple[int, int], moves: str) -> tuple[Column, Column]:
        """Which cells lie ahead of a landing, and the order in which moves meet them: the first letter scans, the second steps."""
        scan, step = moves[0], moves[1:] or None
        ahead = F.lit(True)
        for m in moves:
            axis, sign = ("r", MOVES[m][0]) if MOVES[m][0] else ("c", MOVES[m][1])
            edge = at[0 if axis == "r" else 1]
            ahead = ahead & (F.col(axis) * sign >= edge * sign)
        line = "c" if MOVES[scan][0] else "r"
        scanned = F.col("r" if line == "c" else "c") * sum(MOVES[scan])
        if step is None:
            ahead = ahead & (F.col(line) == at[1 if line == "c" else 0])
            return ahead, F.struct(scanned.alias("k"), "r", "c")
        return ahead, F.struct((F.col(line) * sum(MOVES[step])).alias("s"), scanned.alias("k"), "r", "c")

    def opposite(self, at: tuple[int, int], moves: str) -> tuple[int, int]:
        """First full cell from an empty landing. A landing beyond the margins is drawn back to them first."""
        at = tuple(min(max(x, 0), high) for x, high in zip(at, self.margins[1], strict=True))
        ahead, key = self.opposite_key(at, moves)
        best = self.cells.where(ahead).agg(F.min(key).alias("b")).first()["b"]
        if best is None:
            raise EmptyCapture(f"no full cell {moves} of {at}")
        return best["r"], best["c"]

    def same(self, at: tuple[int, int], moves: str) -> tuple[int, int]:
        """Last full cell that joins a full landing without a gap, on its own row and its own column."""
        r, c = at
        for m in moves:
            axis, other = ("r", "c") if MOVES[m][0] else ("c", "r")
            sign, start = sum(MOVES[m]), at[0 if axis == "r" else 1]
            line = self.cells.where((F.col(other) == at[1 if axis == "r" else 0]) & (F.col(axis) * sign >= start * sign))
            gap = F.col(axis) * sign - F.row_number().over(Window.partitionBy(other).orderBy(F.col(axis) * sign))
            end = line.select(axis, gap.alias("g")).where(F.col("g") == start * sign - 1).agg((F.max if sign > 0 else F.min)(axis)).first()[0]
            if end is not None:
                r, c = (end, c) if axis == "r" else (r, end)
        return r, c

    def expand(self, rect: tuple[int, int, int, int], chains: tuple[tuple[str, int], ...]) -> tuple[int, int, int, int]:
        """Grow while the strip beside an edge holds any full cell; a chain repeats until nothing changes or its count is used."""
        r1, c1, r2, c2 = rect
        for letters, times in chains:
            for _ in range(min(times, 1 << 16)):
                before = (r1, c1, r2, c2)
                for m in letters:
                    most = 1 if times < MANY else None
                    r1, c1, r2, c2 = self._grow((r1, c1, r2, c2), m, most)
                if before == (r1, c1, r2, c2):
                    break
        return r1, c1, r2, c2

    def _grow(self, rect: tuple[int, int, int, int], move: str, most: int | None) -> tuple[int, int, int, int]:
        r1, c1, r2, c2 = rect
        axis, sign = ("r", MOVES[move][0]) if MOVES[move][0] else ("c", MOVES[move][1])
        edge = {"L": c1, "R": c2, "U": r1, "D": r2}[move]
        across = F.col("c").between(c1, c2) if axis == "r" else F.col("r").between(r1, r2)
        lines = self.cells.where(across & (F.col(axis) * sign > edge * sign)).select((F.col(axis) * sign).alias("k")).distinct()
        # Only the unbroken run right behind the edge counts: a line whose rank is its distance.
        run = lines.withColumn("n", F.row_number().over(Window.orderBy("k"))).where(F.col("k") == edge * sign + F.col("n"))
        grown = run.agg(F.max("n")).first()[0] or 0
        grown = min(grown, most) if most else grown
        return {"L": (r1, c1 - grown, r2, c2), "R": (r1, c1, r2, c2 + grown), "U": (r1 - grown, c1, r2, c2), "D": (r1, c1, r2 + grown, c2)}[move]

    def locate(self, first: Edge, second: Edge | None, expansions: tuple = (), base: tuple[int, int] | None = None) -> tuple[int, int, int, int] | tuple[int, int]:
        """The rectangle (r1, c1, r2, c2) of two edges, or the cell of one."""
        up, down = self.margins

        def target(edge: Edge, at: tuple[int, int], relative: bool) -> tuple[int, int]:
            if not edge.mov:
                return at
            if not self.is_full(at):
                return self.opposite(at, edge.mov)
            if edge.mod == "+" or (relative and edge.mod != "?"):
                return self.same(at, edge.mov)
            return at

        a = target(first, resolve(first.land, up, down, base), False)
        if second is None:
            if not expansions:
                return a
            b = a
        else:
            relative = second.land.row.endswith(".") and second.land.col.endswith(".")
            b = target(second, resolve(second.land, up, down, a), relative)
        rect = (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1]))
        return self.expand(rect, expansions) if expansions else rect

    def read(self, rect: tuple[int, int, int, int]) -> DataFrame:
        """The dense rows r1..r2 with columns c0.. for c1..c2; holes are null, also beyond the sheet."""
        r1, c1, r2, c2 = rect
        inside = self.cells.where(F.col("r").between(r1, r2) & F.col("c").between(c1, c2))
        wide = inside.groupBy("r").pivot("c", list(range(c1, c2 + 1))).agg(F.first("v"))
        wide = wide.select("r", *(F.col(str(c)).alias(f"c{c - c1}") for c in range(c1, c2 + 1)))
        rows = self.cells.sparkSession.range(r1, r2 + 1).select(F.col("id").cast("int").alias("r"))
        return rows.join(wide, "r", "left")

    def scalar(self, at: tuple[int, int]) -> DataFrame:
        return self.read((at[0], at[1], at[0], at[1])).select(F.col("c0").alias("value"))

    def capture(self, ref: str | Ref, base: tuple[int, int] | None = None) -> DataFrame:
        """The captured rectangle, through the reference's filters. Nothing there: no rows, unless opts say no_empty."""
        from loomgrid.operators.filters import apply

        parsed = parse(ref) if isinstance(ref, str) else ref
        try:
            rect = self.locate(parsed.first, parsed.second, parsed.expansions, base)
        except EmptyCapture:
            if parsed.opts.get("no_empty"):
                raise
            return self.read((0, 0, 0, 0)).where("false")
        df = self.scalar(rect) if len(rect) == 2 else self.read(rect)
        return apply(df, parsed.call) if parsed.call else df
