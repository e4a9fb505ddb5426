"""Registered queries over the operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import text as fx
from loomgrid.functions.names import first_line
from loomgrid.functions.paths import Rules, join_column, relocate, rename_columns, step_alias
from loomgrid.functions.refs import Cell, resolve
from loomgrid.functions.steps import Step, project, steps_from
from loomgrid.operators import filters, merge
from loomgrid.operators.components import Assembly, Component
from loomgrid.operators.grid import Sheet, cells_of, number_rows
from loomgrid.operators.validate import names_against, violations, with_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one(spark: SparkSession, **values: int | str) -> DataFrame:
    """One row; the query's answer is a few numbers that planning found."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


# The grid: months by priorities, full where a pending order was placed on the first of the month.

GRID = """g AS (SELECT ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::INT AS r, (ascii(o_orderpriority) - 49)::INT AS c, count(*)::BIGINT AS v
FROM orders WHERE o_orderstatus = 'P' AND day(o_orderdate) = 1 GROUP BY 1, 2)"""
LANDING = (5, 0)


def grid(spark: SparkSession, sf_dir: str) -> Sheet:
    o = load(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") & (F.dayofmonth("o_orderdate") == 1))
    r = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    return Sheet(o.groupBy(r.cast("int").alias("r"), (F.ascii("o_orderpriority") - 49).cast("int").alias("c")).agg(F.count("*").alias("v")))


def customer_sheet(spark: SparkSession, sf_dir: str, pad: int = 2) -> Sheet:
    """customer with a header row, shifted by `pad` empty rows and columns."""
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    rows = number_rows(load(spark, sf_dir, "customer").select(*columns), "c_custkey")
    body = cells_of(rows, "r", columns).select((F.col("r") + pad + 1).alias("r"), (F.col("c") + pad).alias("c"), "v")
    head = spark.createDataFrame([(pad, pad + i, c) for i, c in enumerate(columns)], "r int, c int, v string")
    return Sheet(head.unionByName(body))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_sheet(spark, sf_dir).capture('#A1(DR):..(DR):RULD:["df"]').drop("r")


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_capture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("""WITH n AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS r, * FROM customer)
SELECT r, 0::INT AS c, c_name AS v FROM n UNION ALL SELECT r, 1::INT, c_mktsegment FROM n""")
def q_cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(number_rows(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"), "r", ["c_name", "c_mktsegment"])


@query(f"WITH {GRID} SELECT min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2 FROM g")
def q_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    (r1, c1), (r2, c2) = grid(spark, sf_dir).margins
    return one(spark, r1=r1, c1=c1, r2=r2, c2=c2)


@query(f"WITH {GRID} SELECT r, count(*)::BIGINT AS n_full FROM g GROUP BY r")
def q_states_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).cells.groupBy("r").agg(F.count("*").alias("n_full"))


def _opposite(spark: SparkSession, sf_dir: str, at: tuple[int, int], moves: str) -> DataFrame:
    r, c = grid(spark, sf_dir).opposite(at, moves)
    return one(spark, r=r, c=c)


@query(f"WITH {GRID} SELECT r, c FROM g ORDER BY r, c LIMIT 1")
def q_target_opposite_rd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opposite(spark, sf_dir, (0, 0), "RD")


@query(f"WITH {GRID} SELECT r, c FROM g ORDER BY c, r LIMIT 1")
def q_target_opposite_dr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opposite(spark, sf_dir, (0, 0), "DR")


@query(f"WITH {GRID} SELECT r, c FROM g ORDER BY r DESC, c DESC LIMIT 1")
def q_target_opposite_lu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opposite(spark, sf_dir, (500, 500), "LU")


@query(f"""WITH {GRID}, f AS (SELECT r, c FROM g ORDER BY r, c LIMIT 1),
d AS (SELECT g.r, g.r - row_number() OVER (ORDER BY g.r) AS k, f.r AS r0 FROM g, f WHERE g.c = f.c AND g.r >= f.r),
e AS (SELECT g.c, g.c - row_number() OVER (ORDER BY g.c) AS k, f.c AS c0 FROM g, f WHERE g.r = f.r AND g.c >= f.c)
SELECT (SELECT max(r) FROM d WHERE k = r0 - 1) AS r, (SELECT max(c) FROM e WHERE k = c0 - 1) AS c""")
def q_target_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    r, c = sheet.same(sheet.opposite((0, 0), "RD"), "DR")
    return one(spark, r=r, c=c)


@query(f"""WITH {GRID}, f AS (SELECT r, c FROM g ORDER BY r, c LIMIT 1), l AS (SELECT DISTINCT g.c, f.c AS c0 FROM g, f WHERE g.r = f.r AND g.c > f.c),
n AS (SELECT c, c0, row_number() OVER (ORDER BY c) AS k FROM l)
SELECT f.r AS r1, f.c AS c1, f.r AS r2, coalesce((SELECT max(c) FROM n WHERE c = c0 + k), f.c)::INT AS c2 FROM f""")
def q_expand_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    r, c = sheet.opposite((0, 0), "RD")
    return one(spark, **dict(zip(("r1", "c1", "r2", "c2"), sheet.expand((r, c, r, c), (("R", 1 << 30),)), strict=True)))


@query(f"""WITH RECURSIVE {GRID}, f AS (SELECT r, c FROM g ORDER BY r, c LIMIT 1),
w AS (SELECT r AS r1, c AS c1, r AS r2, c AS c2, 0 AS n FROM f UNION ALL
SELECT w.r1 - (EXISTS (SELECT 1 FROM g WHERE g.r = w.r1 - 1 AND g.c BETWEEN w.c1 AND w.c2))::INT, w.c1 - (EXISTS (SELECT 1 FROM g WHERE g.c = w.c1 - 1 AND g.r BETWEEN w.r1 AND w.r2))::INT,
w.r2 + (EXISTS (SELECT 1 FROM g WHERE g.r = w.r2 + 1 AND g.c BETWEEN w.c1 AND w.c2))::INT, w.c2 + (EXISTS (SELECT 1 FROM g WHERE g.c = w.c2 + 1 AND g.r BETWEEN w.r1 AND w.r2))::INT, n + 1 FROM w WHERE n < 200)
SELECT r1, c1, r2, c2 FROM w WHERE n = 200""")
def q_expand_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    r, c = sheet.opposite((0, 0), "RD")
    return one(spark, **dict(zip(("r1", "c1", "r2", "c2"), sheet.expand((r, c, r, c), (("LURD", 1 << 30),)), strict=True)))


@query(f"""WITH {GRID}, a AS (SELECT r, c FROM g ORDER BY r, c LIMIT 1), b AS (SELECT r, c FROM g ORDER BY r DESC, c DESC LIMIT 1)
SELECT least(a.r, b.r) AS r1, least(a.c, b.c) AS c1, greatest(a.r, b.r) AS r2, greatest(a.c, b.c) AS c2 FROM a, b""")
def q_capture_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.functions.refs import parse

    ref = parse("#A1(RD):ZZ999(LU)")
    return one(spark, **dict(zip(("r1", "c1", "r2", "c2"), grid(spark, sf_dir).locate(ref.first, ref.second), strict=True)))


@query(f"""WITH {GRID}, s AS (SELECT unnest(range(0, 12))::INT AS r)
SELECT s.r, max(CASE WHEN c = 0 THEN v END) AS c0, max(CASE WHEN c = 1 THEN v END) AS c1, max(CASE WHEN c = 2 THEN v END) AS c2 FROM s LEFT JOIN g ON s.r = g.r GROUP BY s.r""")
def q_read_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).read((0, 0, 11, 2))


@query(f"WITH {GRID} SELECT max(v) AS value FROM g WHERE r = (SELECT max(r) FROM g) AND c = (SELECT max(c) FROM g)")
def q_read_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).capture("#__")


@query(f"WITH {GRID} SELECT max(r) - 1 AS r, max(c) - 2 AS c FROM g")
def q_negative_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    r, c = resolve(Cell("R-2", "C-3"), *sheet.margins, None)
    return one(spark, r=r, c=c)


@query(f"WITH {GRID}, e AS (SELECT max(r) AS r2, max(c) AS c2 FROM g), s AS (SELECT r, c, c2 FROM (SELECT unnest(range(0, r2 + 1))::INT AS r, c2 FROM e), (SELECT unnest(range(0, c2 + 1))::INT AS c FROM e)) SELECT (s.r * (c2 + 1) + s.c)::INT AS i, v AS value FROM s LEFT JOIN g ON s.r = g.r AND s.c = g.c")
def q_redim_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    return filters.flatten(sheet.read((0, 0, *sheet.margins[1])))


@query(f"WITH {GRID} SELECT c AS r, r AS c, v FROM g")
def q_redim_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.transpose_cells(grid(spark, sf_dir).cells)


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def q_df_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = customer_sheet(spark, sf_dir).capture("#A1(DR):..(DR)")
    return filters.frame(rect, names=["id", "name", "nation", "balance", "segment"], usecols=["id", "balance"]).drop("r")


@query(f"WITH {GRID}, s AS (SELECT unnest(range(0, (SELECT max(r) FROM g) + 1))::INT AS r) SELECT s.r, (last_value(v IGNORE NULLS) OVER (ORDER BY s.r))::BIGINT AS k FROM s LEFT JOIN g ON s.r = g.r AND c = 0")
def q_df_index_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = grid(spark, sf_dir)
    return filters.frame(sheet.read((0, 0, sheet.margins[1][0], 1)), header=None, names=["k", "x"], index_col=0, usecols=["k"], dtype={"k": "bigint"})


@query("SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS value FROM customer GROUP BY 1")
def q_dict_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("r"), F.col("c_mktsegment").alias("c0"), F.col("c_name").alias("c1"))
    return filters.last_wins(rows)


@query("SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name)::INT AS place FROM nation")
def q_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r"), "n_regionkey", "n_name")
    return filters.sort_rows(rows).select("n_name", "n_regionkey", F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("place"))


@query("SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer UNION ALL SELECT 'c_custkey', 'c_name'")
def q_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_sheet(spark, sf_dir).capture('#A1(DR):..(DR):["pipe", ["odict"]]')


@query("SELECT (c_custkey % 20)::INT AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def q_recurse_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell (i, 0) of customer i refers to cell B of row i % 20 + 1 by its name; resolved, it holds that row's number."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("r"))
    refs = rows.select("r", F.lit(0).alias("c"), F.concat(F.lit("#B"), (F.col("r") % 20 + 1).cast("string")).alias("v"))
    ends = rows.where("r < 20").select("r", F.lit(1).alias("c"), F.col("r").cast("string").alias("v"))
    return filters.recurse(refs.unionByName(ends)).where("c = 0").groupBy(F.col("v").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey + l_partkey)::DOUBLE AS value FROM lineitem")
def q_pyeval_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("+", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.cell_arithmetic(text).alias("value"))


@query("SELECT o_orderkey, (o_totalprice * 2 + 1)::DOUBLE AS value FROM orders")
def q_py_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.expression(load(spark, sf_dir, "orders"), "o_totalprice * 2 + 1").select("o_orderkey", "value")


@query("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation")
def q_elementwise_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.elementwise(load(spark, sf_dir, "nation"), F.lower, include=["n_name", "n_regionkey"], exclude=["n_regionkey"])


# Paths.

@query("SELECT n_nationkey AS id, n_name AS nation_name, n_regionkey AS nation_regionkey FROM nation")
def q_rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules.of([("/n_nationkey", "id"), (r"/~n_(.*)", r"nation_\1")])
    return rename_columns(load(spark, sf_dir, "nation"), rules)


PATHS = "concat('/', r_name, '/', n_name) AS p FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT p, CASE WHEN p LIKE '/%/NATION_1' THEN regexp_replace(p, '^/[^/]*/NATION_1$', '/one') WHEN p LIKE '/%/NATION_2' THEN regexp_replace(p, '/NATION_2$', '/X/two') ELSE p END AS q FROM (SELECT {PATHS})")
def q_relocate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules.of([("/~.*/NATION_1", "/one"), ("/~.*/NATION_2", "X/two")])
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    paths = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("p"))
    return relocate(paths, "p", rules, "q")


@query(r"SELECT n_name, CASE WHEN n_name = 'NATION_3' THEN 'exact' WHEN regexp_full_match(n_name, 'NATION_1.*') THEN regexp_replace(n_name, '^NATION_(1.*)$', 'late_\1') ELSE regexp_replace(n_name, '^NATION_(.*)$', 'early_\1') END AS alias FROM nation")
def q_regex_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules.of([("NATION_3", "exact"), (r"~NATION_(.*)", r"early_\1"), (r"~NATION_(1.*)", r"late_\1")])
    return load(spark, sf_dir, "nation").select("n_name", step_alias(F.col("n_name"), rules).alias("alias"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' WHEN 2 THEN '/r' ELSE '../..' END AS path FROM customer""")
def q_join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.element_at(F.array(*(F.lit(x) for x in ("a|.|b", "a|b|..", "a|b||r", "a|..|..|.."))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", join_column(F.split(steps, r"\|")).alias("path"))


@query("SELECT o_orderkey, replace(replace(o_orderpriority || '/~', '~', '~0'), '/', '~1') AS escaped, o_orderpriority || '/~' AS back FROM orders")
def q_pointer_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("o_orderpriority", F.lit("/~"))
    return load(spark, sf_dir, "orders").select("o_orderkey", fx.escape(s).alias("escaped"), fx.unescape(fx.escape(s)).alias("back"))


@query("SELECT c_custkey, 2::INT AS n, c_mktsegment AS first, 'a/b' AS second FROM customer")
def q_pointer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.pointer_parts(F.concat(F.lit("/"), "c_mktsegment", F.lit("/a~1b")))
    return load(spark, sf_dir, "customer").select("c_custkey", F.size(parts).alias("n"), parts[0].alias("first"), parts[1].alias("second"))


@query("SELECT event_id, json_extract(props, '/k')::BIGINT AS k FROM events")
def q_pointer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", fx.pointer_get(F.col("props"), "/k", "bigint").alias("k"))


@query("SELECT event_id, coalesce(json_extract(props, '/absent')::BIGINT, -1) AS k FROM events")
def q_pointer_get_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", fx.pointer_get(F.col("props"), "/absent", "bigint", F.lit(-1).cast("bigint")).alias("k"))


@query("SELECT event_id, json_extract_string(json_merge_patch(props, json_object('who', user_id::VARCHAR)), '/who') AS who, json_extract_string(props, '/k') AS k FROM events")
def q_pointer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = fx.pointer_set(F.col("props"), "who", F.col("user_id"))
    return load(spark, sf_dir, "events").select("event_id", fx.pointer_get(new, "/who").alias("who"), fx.pointer_get(new, "/k").alias("k"))


@query("SELECT p_partkey, p_name AS name, p_type AS units FROM part")
def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.units(F.concat("p_name", F.lit(" ["), "p_type", F.lit("]")))
    return load(spark, sf_dir, "part").select("p_partkey", u["name"].alias("name"), u["units"].alias("units"))


# Merges.

def _balances(spark: SparkSession, sf_dir: str, name: str, p: str, cond: Column) -> DataFrame:
    return load(spark, sf_dir, name).where(cond).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.max(f"{p}_acctbal").alias("balance"))


MERGE = """a AS (SELECT c_nationkey AS nation, max(c_acctbal) AS balance FROM customer WHERE c_nationkey < 15 GROUP BY 1), b AS (SELECT s_nationkey AS nation, max(s_acctbal) AS balance FROM supplier WHERE s_nationkey > 9 GROUP BY 1)"""


@query(f"WITH {MERGE} SELECT coalesce(a.nation, b.nation) AS nation, coalesce(b.balance, a.balance) AS balance FROM a FULL JOIN b ON a.nation = b.nation")
def q_merge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _balances(spark, sf_dir, "customer", "c", F.col("c_nationkey") < 15), _balances(spark, sf_dir, "supplier", "s", F.col("s_nationkey") > 9)
    return merge.series(a, b, "nation", "balance")


@query(f"WITH {MERGE} SELECT a.nation, coalesce(b.balance, a.balance) AS balance, b.balance * 2 AS twice FROM a LEFT JOIN b ON a.nation = b.nation")
def q_merge_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _balances(spark, sf_dir, "customer", "c", F.col("c_nationkey") < 15), _balances(spark, sf_dir, "supplier", "s", F.col("s_nationkey") > 9)
    return merge.frame(a, b.withColumn("twice", F.col("balance") * 2), "nation")


@query("SELECT user_id, 'b'::VARCHAR AS key, max(value) AS value FROM events GROUP BY user_id UNION ALL SELECT user_id, 'a', min(value) FROM events GROUP BY user_id UNION ALL SELECT user_id, 'c', min(value) FROM events GROUP BY user_id")
def q_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    m = merge.maps(F.create_map(F.lit("a"), F.col("lo"), F.lit("b"), F.col("lo")), F.create_map(F.lit("b"), F.col("hi"), F.lit("c"), F.col("lo"), F.lit("a"), F.lit(None).cast("double")))
    return e.select("user_id", F.explode(m).alias("key", "value"))


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN 1 ELSE len(embedding) END::INT AS n FROM embeddings")
def q_merge_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.when(F.col("label") % 2 == 0, F.array(F.lit(1.0).cast("float")))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size(merge.sequence(F.col("embedding"), over)).alias("n"))


# Schemas.

ORDER_SCHEMA = {
    "required": ["o_orderkey", "o_comment"],
    "properties": {"o_orderstatus": {"type": "string", "enum": ["F", "O"]}, "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 400000}, "o_orderkey": {"type": "integer"}, "o_custkey": {"type": "string"}},
}


@query("""SELECT o_orderkey, '/o_orderstatus' AS path, 'enum' AS keyword FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, '/o_totalprice', 'minimum' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, '/o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, '/o_custkey', 'type' FROM orders UNION ALL SELECT NULL, '/o_comment', 'required'""")
def q_validate_type_enum_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(load(spark, sf_dir, "orders"), ORDER_SCHEMA, "o_orderkey")


@query("SELECT 'o_comment' AS name, 'required' AS keyword")
def q_validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(names_against(load(spark, sf_dir, "orders"), ORDER_SCHEMA), "name string, keyword string")


@query("SELECT unnest(['r_regionkey']) AS name, 'additionalProperties' AS keyword")
def q_additional_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"properties": {"x": {}}, "patternProperties": {"_name$": {}}, "additionalProperties": False}
    return spark.createDataFrame(names_against(load(spark, sf_dir, "region"), schema), "name string, keyword string")


@query("SELECT s_suppkey, 'none' AS s_comment FROM supplier")
def q_auto_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(load(spark, sf_dir, "supplier").select("s_suppkey"), {"properties": {"s_comment": {"type": "string", "default": "none"}}})


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END::DOUBLE AS balance FROM supplier")
def q_auto_default_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    return with_defaults(d, {"properties": {"balance": {"type": "number", "default": 0.0}}}, nulls=True)


@query("SELECT s_suppkey, s_acctbal >= 0 AS has_balance FROM supplier")
def q_auto_remove_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.operators.validate import without_nulls

    d = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    out = without_nulls(d, {"properties": {"balance": {"type": "number"}}})
    return out.select("s_suppkey", F.array_contains(F.json_object_keys("value"), "balance").alias("has_balance"))


@query(f"WITH {MERGE} SELECT a.nation, coalesce(b.balance, a.balance) AS balance, 'x' AS tag FROM a LEFT JOIN b ON a.nation = b.nation")
def q_build_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _balances(spark, sf_dir, "customer", "c", F.col("c_nationkey") < 15), _balances(spark, sf_dir, "supplier", "s", F.col("s_nationkey") > 9)
    loose = {"properties": {"balance": {"type": "number"}}}
    strict = {"required": ["nation", "tag"], "properties": {"balance": {"type": "number", "minimum": -1000}, "tag": {"type": "string", "default": "x"}}}
    model, _ = merge.Build("nation", loose, strict).add(a).add(b).run()
    return model


# Components.

@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS rate FROM lineitem")
def q_component_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rate(p):  # noqa: ANN001, ANN202
        p["rate"] = p["V"] / p["T"]

    rules = Rules.of([("/rate/V", "l_extendedprice"), ("/rate/T", "l_quantity")])
    return Component(rate, rules=rules)(load(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "rate")


@query("SELECT c_custkey, round(c_acctbal / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS scaled FROM customer")
def q_component_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    std = c.agg(F.stddev_samp("c_acctbal")).first()[0]

    def scale(p):  # noqa: ANN001, ANN202
        p["scaled"] = F.round(p["c_acctbal"] / F.lit(std), 6)

    return Component(scale)(c).select("c_custkey", "scaled")


@query("SELECT unnest(['/root1/A', '/root2/B']) AS path, 'in' AS kind UNION ALL SELECT unnest(['/root1/B', '/root2/C']), 'out'")
def q_assembly_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f1(p):  # noqa: ANN001, ANN202
        p["B"] = p["A"] + 1

    def f2(p):  # noqa: ANN001, ANN202
        p["C"] = p["B"] * 2

    rules = Rules.of([("/f1", "root1"), ("/f2", "root2")])
    both = Assembly([Component(f2, rules=rules), Component(f1, rules=rules)])
    return spark.createDataFrame([(p, "in") for p in both.inputs] + [(p, "out") for p in both.outputs], "path string, kind string")


# Text.

@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS b FROM orders")
def q_str2bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, (" Yes ", "off", "0"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", fx.truth(s).alias("b"))


@query("SELECT c_custkey, 'market_segment_' || lower(c_mktsegment) AS snake FROM customer")
def q_camel_to_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", fx.snake(F.concat(F.lit("MarketSegment"), F.initcap("c_mktsegment"))).alias("snake"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.CSV' ELSE p_name || '.csv' END AS file FROM part")
def q_ensure_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(".CSV"))).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", fx.with_extension(name, "csv").alias("file"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL ELSE true END AS b FROM orders""")
def q_truth_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(F.lit("\tno\n"), F.lit("\r ON"), F.lit(" \x0b"), F.lit(None).cast("string"), F.lit("n o")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", fx.truth(s).alias("b"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'httpserver' WHEN 1 THEN 'co2_dice_app' WHEN 2 THEN 'my_urlpath' ELSE 'part_' || p_partkey END AS snake FROM part")
def q_snake_capital_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(F.lit("HTTPServer"), F.lit("CO2DiceApp"), F.lit("myURLPath"), F.concat(F.lit("Part_"), F.col("p_partkey").cast("string"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", fx.snake(s).alias("snake"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'foo.xlt' WHEN 1 THEN 'foo.xl^.xls' WHEN 2 THEN 'a.b/foo.xls' WHEN 3 THEN 'foo.XLSX' ELSE 'foo.xls' END AS file FROM part")
def q_ensure_ext_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("foo.xlt", "foo.xl^", "a.b/foo", "foo.XLSX", "foo."))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", fx.with_extension(name, ".xls", r"\.xl\w{1,2}", is_regex=True).alias("file"))


@query("SELECT c_custkey, '{\"a~b\":[1,' || c_nationkey || '],\"n\":{\"x/y\":{\"v\":' || c_custkey || '}}}' AS doc FROM customer")
def q_pointer_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to a list, makes objects where nothing is, and replaces a scalar in the way."""
    doc = F.lit('{"a~b":[1],"n":5}')
    doc = fx.pointer_put(doc, "/a~0b/-", F.col("c_nationkey").cast("string"))
    doc = fx.pointer_put(doc, "/n/x~1y/v", F.col("c_custkey").cast("string"))
    return load(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{\"a\":{\"x\":1,\"y\":' || c_nationkey || ',\"z\":3},\"l\":[9]}' ELSE '{\"a\":{\"x\":1,\"y\":2},\"l\":[1,2]}' END AS model FROM customer")
def q_merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects overlaid: keys of both, a null lets the value below show, a list replaces the one below."""
    over = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"a":{"x":null,"y":'), F.col("c_nationkey").cast("string"), F.lit(',"z":3},"l":[9]}')))
    return load(spark, sf_dir, "customer").select("c_custkey", merge.objects(F.lit('{"a":{"x":1,"y":2},"l":[1,2]}'), over).alias("model"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS value, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 'neither model has a value' END AS violation FROM customer")
def q_merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    b = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", merge.scalar(a, b).alias("s")).select("c_custkey", "s.*")


@query('SELECT c_custkey AS id, c_name AS "person/name", c_mktsegment AS c_mktsegment FROM customer')
def q_steps_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Step("", [("/c_custkey", "id"), ("/c_name", "person/name")])
    _ = steps.c_custkey, steps.c_name, steps.c_mktsegment
    return project(load(spark, sf_dir, "customer"), steps)


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def q_steps_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Step("", [("/c_custkey", "id"), ("/~c_acct(.*)", r"\1ance")])
    _ = steps.c_custkey._tag("out"), steps.c_acctbal._tag("out", "money"), steps.c_name._tag("in")
    return project(load(spark, sf_dir, "customer"), steps, tag="out")


@query("SELECT '/' || replace(n_name, ' ', '_') AS path, lower(n_name) AS name, n_regionkey::INT AS region FROM nation")
def q_steps_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load(spark, sf_dir, "nation").select(F.concat(F.lit("/"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("paths"), F.lower("n_name").alias("names"), F.col("n_regionkey").cast("int").alias("region"))
    steps = steps_from(rules)
    rows = [(path, name, getattr(steps, path[1:])._region) for path, name in steps._derrive_map_tuples() if path]
    return spark.createDataFrame(rows, "path string, name string, region int")


@query("SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS line FROM documents")
def q_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", first_line(F.col("text")).alias("line"))


@query(f"WITH {GRID} SELECT c AS r, max(CASE WHEN r = 0 THEN v END) AS c0, max(CASE WHEN r = 1 THEN v END) AS c1 FROM (SELECT unnest(range(0, 5))::INT AS c) LEFT JOIN g USING (c) GROUP BY 1")
def q_redim_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.redim(grid(spark, sf_dir).read((0, 0, 1, 4)), table=[2, True])


@query("SELECT n_nationkey::INT AS r, n_regionkey::DOUBLE AS a, NULL::DOUBLE AS b FROM nation")
def q_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("r"), F.col("n_regionkey").cast("string").alias("c0"), F.col("n_name").alias("c1"))
    return filters.arrays(rows).select("r", F.col("value")[0].alias("a"), F.col("value")[1].alias("b"))
