"""What is done with a captured rectangle: rows are numbered by r, values stand in c0, c1, and so on."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.refs import Call, parse_call

FILTERS: dict[str, Callable] = {}


def register(name: str):
    def put(f: Callable) -> Callable:
        FILTERS[name] = f
        return f

    return put


def apply(df: DataFrame, call: Call) -> DataFrame:
    """One filter; with lax, a filter that can't be planned leaves df as it is."""
    kwds = dict(call.kwds)
    lax = kwds.pop("lax", False)
    try:
        return FILTERS[call.func](df, *call.args, **kwds)
    except Exception:
        if lax:
            return df
        raise


def values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "r"]


@register("pipe")
def pipe(df: DataFrame, *specs) -> DataFrame:
    for spec in specs:
        df = apply(df, parse_call(spec))
    return df


@register("flatten")
def flatten(df: DataFrame) -> DataFrame:
    """All values in reading order: i, value."""
    n = len(values(df))
    out = df.select("r", F.posexplode(F.array(*values(df))).alias("c", "value"))
    first = df.agg(F.min("r").alias("first"))
    return out.join(F.broadcast(first)).select(((F.col("r") - F.col("first")) * n + F.col("c")).cast("int").alias("i"), "value")


def transpose_cells(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


#: The widest table that can be turned: a sheet has no more columns.
MOST_COLUMNS = 1 << 14


def transpose_table(df: DataFrame) -> DataFrame:
    """Rows become columns c0, c1, ... The old rows are columns then, so they must be no more than a sheet has columns."""
    cols = values(df)
    rows = [r[0] for r in df.select("r").distinct().orderBy("r").limit(MOST_COLUMNS + 1).collect()]
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"a table of over {MOST_COLUMNS} rows can't be transposed")
    kind = "string" if len({df.schema[c].dataType for c in cols}) > 1 else df.schema[cols[0]].dataType
    cells = df.select(F.col("r").alias("_old"), F.posexplode(F.array(*(F.col(c).cast(kind) for c in cols))).alias("r", "v"))
    turned = cells.groupBy("r").pivot("_old", rows).agg(F.first("v"))
    return turned.toDF("r", *(f"c{i}" for i in range(len(rows))))


@register("redim")
def redim(df: DataFrame, scalar=None, cell=None, row=None, col=None, table=None) -> DataFrame:  # noqa: ANN001
    """The captured rectangle with the number of dimensions asked for by its shape: n, or [n, transpose].

    Shapes are a cell (scalar and cell alike, as a capture of one value is one), a row, a column and a table. 2 and None
    leave a table of rows; 1 lists the values in reading order; 0 is the value alone and an error if there are more.
    Dimensions above 2 have no form as a table and are an error.
    """
    height, width = df.agg(F.count_distinct("r")).first()[0], len(values(df))
    want = (cell if cell is not None else scalar) if height <= 1 and width == 1 else row if height <= 1 else col if width == 1 else table
    n, turn = (want[0], bool(want[1]) if len(want) > 1 else False) if isinstance(want, (list, tuple)) else (want, False)
    if n not in (None, 0, 1, 2):
        raise ValueError(f"{n} dimensions can't be had of a table")
    if turn:
        df = transpose_table(df)
    if n == 1:
        return flatten(df)
    if n == 0:
        if height > 1 or width > 1:
            raise ValueError(f"{height} x {width} values are no scalar")
        return df.select(F.col(values(df)[0]).alias("value"))
    return df


@register("xlwings_dims")
def usual_dims(df: DataFrame) -> DataFrame:
    """A cell as it is, rows and columns as lists, tables as tables."""
    return redim(df, 0, 0, 1, 1, 2)


@register("numpy")
def arrays(df: DataFrame, dtype: str = "double") -> DataFrame:
    """One array of numbers for each row, in order of the columns; what isn't a number is null."""
    return df.select("r", F.array(*(F.expr(f"try_cast(`{c}` as {dtype})") for c in values(df))).alias("value"))


@register("dict")
def last_wins(df: DataFrame) -> DataFrame:
    """The first two columns as key and value; of rows with one key the last counts."""
    k, v = values(df)[:2]
    return df.groupBy(F.col(k).alias("key")).agg(F.max_by(F.col(v), F.col("r")).alias("value"))


FILTERS["odict"] = FILTERS["sr"] = last_wins


@register("sorted")
def sort_rows(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Rows in order of all columns from the left, nulls first, and their new place."""
    order = [(F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first()) for c in values(df)]
    return df.orderBy(*order)


def try_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest of long, double, boolean, string that takes all values of each column; one pass."""
    kinds = ("bigint", "double", "boolean")
    misses = df.agg(*(F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {k}) is null")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in kinds), *(F.count(c).alias(f"{i}_n") for i, c in enumerate(columns))).first()
    return {c: next((k for k in kinds if misses[f"{i}_n"] and not misses[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


@register("df")
def frame(
    df: DataFrame, header: int | None = 0, names: list[str] | None = None, index_col: int | list[int] | None = None, usecols: list | None = None, dtype: dict | None = None, skiprows: int = 0, nrows: int | None = None,
    skipfooter: int = 0, na_values: list[str] = (), true_values: list[str] = (), false_values: list[str] = (), thousands: str | None = None, comment: str | None = None, parse_dates: list[str] = (), squeeze: bool = False, mangle_dupe_cols: bool = True,
) -> DataFrame:
    """The rectangle as a table: a header row names the columns, the values below decide their types.

    Only the header row comes to the driver. index_col columns are filled from above where empty. The row number stays as r.
    """
    cols = values(df)
    first, last = df.agg(F.min("r"), F.max("r")).first()
    top = (first or 0) + skiprows
    if header is not None:
        top += header
        head = df.where(F.col("r") == top).first()
        titles = [str(head[c]) if head and head[c] is not None else f"Unnamed: {i}" for i, c in enumerate(cols)]
        top += 1
    else:
        titles = [str(i) for i in range(len(cols))]
    titles = list(names) if names else titles
    if mangle_dupe_cols:
        seen: dict[str, int] = {}
        for i, t in enumerate(titles):
            k = seen.get(t, 0)
            seen[t] = k + 1
            titles[i] = f"{t}.{k}" if k else t
    body = df.where((F.col("r") >= top) & (F.col("r") <= (last if last is not None else -1) - skipfooter))
    if nrows is not None:
        body = body.where(F.col("r") < top + nrows)

    def clean(c: str) -> Column:
        v = F.col(c).cast("string")
        if comment:
            v = F.trim(F.split_part(v, F.lit(comment), F.lit(1)))
        if thousands:
            v = F.when(F.rlike(v, F.lit(rf"^[-+]?[0-9{re.escape(thousands)}]+(\.[0-9]*)?$")), F.replace(v, F.lit(thousands), F.lit(""))).otherwise(v)
        for words, to in ((na_values, None), (true_values, "true"), (false_values, "false")):
            if words:
                v = F.when(v.isin(*words), F.lit(to)).otherwise(v)
        return v

    body = body.select("r", *(clean(c).alias(c) for c in cols))
    index = [index_col] if isinstance(index_col, int) else list(index_col or [])
    if index:
        above = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        body = body.select("r", *((F.last(c, ignorenulls=True).over(above) if i in index else F.col(c)).alias(c) for i, c in enumerate(cols)))
    kinds = try_kinds(body, cols)
    wanted = dtype or {}
    out = []
    for i, c in enumerate(cols):
        t = titles[i]
        if usecols is not None and i not in usecols and t not in usecols:
            continue
        kind = wanted.get(t, "timestamp" if t in parse_dates else kinds[c])
        out.append(F.expr(f"try_cast(`{c}` as {kind})").alias(t))
    out = out[:1] if squeeze else out
    return body.select("r", *out)


def evaluate(text: str, columns: dict[str, Column]) -> Column:
    """A Python-like arithmetic expression as a Column; names are columns. Anything but literals, + - * / ** % and comparisons is refused."""
    operators = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Mod: "__mod__", ast.Pow: "__pow__"}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in operators:
            return getattr(build(node.left), operators[type(node.op)])(build(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Div):
            return F.try_divide(build(node.left).cast("double"), build(node.right).cast("double"))
        raise ValueError(f"refused: {ast.dump(node)}")

    return build(ast.parse(text, mode="eval"))


@register("py")
def expression(df: DataFrame, text: str, to: str = "value") -> DataFrame:
    return df.withColumn(to, evaluate(text, {c: F.col(c) for c in df.columns}))


ARITHMETIC = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([-+*/])\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"


def cell_arithmetic(v: Column) -> Column:
    """The value of a text cell that is an operation on two numbers; null otherwise."""
    a, b = (F.expr("0d") + F.regexp_extract(v, ARITHMETIC, i).try_cast("double") for i in (1, 3))
    op = F.regexp_extract(v, ARITHMETIC, 2)
    out = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b))
    return F.when(F.rlike(v, F.lit(ARITHMETIC)), out)


@register("pyeval")
def evaluate_cells(df: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    return elementwise(df, lambda c: F.coalesce(cell_arithmetic(c).cast("string"), c), include, exclude)


def elementwise(df: DataFrame, f: Callable[[Column], Column], include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """f on the values of the included columns that aren't excluded."""
    chosen = [c for c in (include or values(df)) if c not in exclude]
    return df.select(*(f(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns))


def recurse(cells: DataFrame, most: int = 32) -> DataFrame:
    """Text cells of the form #A1 take the value of the cell they name, through chains; a cycle or a hole gives null.

    Each round doubles the length of the chains followed, so rounds grow with the logarithm of the longest.
    """
    ref = r"^#([A-Z])([1-9][0-9]*)$"
    is_ref = F.rlike("v", F.lit(ref))
    to_r, to_c = F.regexp_extract("v", ref, 2).try_cast("int") - 1, F.ascii(F.regexp_extract("v", ref, 1)) - 65
    links = cells.where(is_ref).select("r", "c", to_r.alias("tr"), to_c.alias("tc"))
    for _ in range(most.bit_length()):
        nxt = links.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("tr").alias("nr"), F.col("tc").alias("nc"))
        links = links.join(nxt, ["tr", "tc"], "left").select("r", "c", F.coalesce("nr", "tr").alias("tr"), F.coalesce("nc", "tc").alias("tc"))
    ends = cells.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.when(~is_ref, F.col("v")).alias("v"))
    found = links.join(ends, ["tr", "tc"], "left").select("r", "c", "v")
    return cells.where(~is_ref).select("r", "c", "v").unionByName(found)
