"""Mixing sources to target weights by Pareto order sampling.

Every document is taken floor(rate) times for certain, rate being its source's target over its source's size. One
more copy goes to the documents that come first when ordered by random odds over inclusion odds, as many as fill the
rest of the source's target. The place in that order where the target is reached is found by histograms of the order's
key, each of which refines one bin of the last, two or as many more as it takes for the last bin to hold few rows; no
source is ever sorted in one task. What the sample then misses of the target, less than its next document's size, is
given to the largest document left that fits, which is no part of Pareto's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, pick, row_numbered, small, written

WEIGHTS = (5, 2, 1)
#: The ordering key has KEY_BITS bits, and a second one for ties as many; each histogram looks at BIN_BITS more of them,
#: until the last bins hold no more than BIN_ROWS rows each.
KEY_BITS, BIN_BITS, BIN_ROWS = 52, 13, 1 << 16
SALT = "mix"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    Weights repeat over the sources in code-point order, null last. What a source can't take (above `most` times its
    size) is shared among the others by weight. That is water filling: ordered by cap over weight, sources are capped
    as long as their cap is below their share of what the ones before left. One row per source passes one task here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    by_cap = Window.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    d = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    d = d.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    d = d.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    d = d.withColumn("level", F.col("left_size").cast("double") / F.col("left_weight").cast("double"))
    free = F.col("cap").cast("double") >= F.col("level") * F.col("weight").cast("double")
    d = d.withColumn("level", F.min(F.when(free, F.struct(F.col("cap").cast("double") / F.col("weight").cast("double"), "level"))).over(everything)["level"])
    share = F.col("level") * F.col("weight").cast("double")
    return d.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _key(share: Column) -> Column:
    """Random odds over inclusion odds, mapped into 0..2^52. A row without doc_id has a random number of its own."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    digits = F.substring(F.md5(F.concat(name, F.lit(f":{SALT}")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (share / (1 - share))
    return F.floor(odds / (1 + odds) * float(1 << KEY_BITS)).cast("long")


def _digit(k: int) -> Column:
    """The k-th BIN_BITS bits of the key, then of the one for ties."""
    each = KEY_BITS // BIN_BITS
    of = F.col("key") if k < each else F.xxhash64("row")
    return F.shiftrightunsigned(of, KEY_BITS - BIN_BITS * (k % each + 1)).bitwiseAND(F.lit((1 << BIN_BITS) - 1)).cast("int")


def _digits(n: int) -> Column:
    return F.array(*(_digit(k) for k in range(n)))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Size counts words; null and empty texts have none and take none. A null source is a source, last in order. Rows
    with one doc_id share their random number, rows without have one each; rows are told apart by a row number, so each
    counts once. Reruns agree. Other columns are not read; an empty table gives an empty result. taken is copies times
    size, at most `most`. The columns named by keep come first in the result, read from docs again at the end, so that
    long ones are neither copied nor shuffled.
    """
    kept = {f"keep{i}": c for i, c in enumerate(keep)}
    numbered = row_numbered(pick(docs, doc_id=id_col, text=text_col, source=source_col, **kept))

    def measured(*columns: str) -> DataFrame:
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
        return numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size, "row", *columns)

    sized = written(measured())
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    rated = sources.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("share"))
    rated = rated.withColumn("budget", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))

    def with_keys(rows: DataFrame) -> DataFrame:
        joined = rows.join(small(rated), rows.source.eqNullSafe(F.col("s")), "left").drop("s")
        return joined.withColumn("key", F.when((F.col("share") > 0) & (F.col("share") < 1) & (F.col("size") > 0), _key(F.col("share"))))

    keyed = with_keys(sized)
    # What lies before the bin in which the budget ends, refined until that bin is small.
    cut = rated.select("s", F.array().cast("array<int>").alias("bin"), F.lit(0).cast("long").alias("spent"), "budget")
    n, rows = 0, BIN_ROWS + 1
    while n < 2 or (rows > BIN_ROWS and n < 2 * KEY_BITS // BIN_BITS):
        inside = keyed.where(F.col("key").isNotNull()).join(small(cut.drop("budget")), F.col("source").eqNullSafe(F.col("s"))).where(_digits(n).cast("array<int>") == F.col("bin"))
        bins = inside.groupBy("s", "bin", _digit(n).alias("next"), "spent", "budget").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        bins = bins.withColumn("upto", F.col("spent") + F.sum("n").over(Window.partitionBy("s").orderBy("next")))
        # The first bin that the budget doesn't cover whole; if it covers all, the last.
        found = F.struct("next", (F.col("upto") - F.col("n")).alias("before"), "rows")
        best = F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), found)), F.max(found))
        cut = bins.groupBy("s", "bin", "budget").agg(best.alias("b")).select("s", F.concat("bin", F.array("b.next")).alias("bin"), F.col("b.before").alias("spent"), "budget", F.col("b.rows").alias("rows"))
        cut = written(cut)
        n, rows = n + 1, cut.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
        cut = cut.drop("rows")
    limits = cut.select("s", "bin", "spent")

    def placed(rows: DataFrame) -> DataFrame:
        """0: before the last bin, so taken; 1: in it; 2: behind it; 3: without a key."""
        ranked = rows.join(small(limits), rows.source.eqNullSafe(F.col("s")), "left")
        return ranked.withColumn("place", F.when(F.col("key").isNull(), 3).when(_digits(n) < F.col("bin"), 0).when(_digits(n) == F.col("bin"), 1).otherwise(2))

    ranked = placed(keyed)
    run = F.sum("size").over(Window.partitionBy("s").orderBy("key", F.xxhash64("row"), "doc_id", "row"))
    fitting = written(ranked.where("place = 1").withColumn("upto", F.col("spent") + run).where("upto <= budget").select("s", "row", "upto"))
    # What is still missing is topped up by the largest document that fits.
    ends = fitting.groupBy("s").agg(F.max("upto").alias("upto"))
    got = written(limits.join(ends, limits.s.eqNullSafe(ends.s), "left").select(limits.s.alias("s2"), F.coalesce("upto", "spent").alias("got")))

    def decided(rows: DataFrame) -> DataFrame:
        marked = rows.drop("s").join(small(fitting.select("row", F.lit(1).alias("fits"))), "row", "left")
        return marked.withColumn("more", ((F.col("place") == 0) | F.col("fits").isNotNull()).cast("long"))

    rest = decided(ranked).where("more = 0 and key is not null").join(small(got), F.col("source").eqNullSafe(F.col("s2"))).where("size <= budget - got")
    extra = written(rest.groupBy("s2").agg(F.max(F.struct("size", (-F.col("key")).alias("k"), (-F.col("doc_id")).alias("d"), "row")).alias("b")).select(F.col("b.row").alias("row"), F.lit(1).alias("extra")))
    full = decided(placed(with_keys(measured(*kept))) if keep else ranked).join(small(extra), "row", "left")
    copies = F.col("whole") + F.when(F.col("extra").isNotNull(), 1).otherwise(F.col("more"))
    front = [F.col(c).alias(name) for c, name in kept.items()] if keep else ["doc_id"]
    return full.select(*front, "size", "source_size", "target", F.coalesce(copies * F.col("size"), F.lit(0)).cast("long").alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP2_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight, 3 * source_size AS cap FROM src),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT AS left_size,
  (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS left_weight FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(left_size::DOUBLE / left_weight::DOUBLE, cap::DOUBLE / weight::DOUBLE) AS level FROM f
  WHERE cap::DOUBLE >= left_size::DOUBLE / left_weight::DOUBLE * weight::DOUBLE),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight::DOUBLE) AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM t),
k AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS share,
  round(target)::BIGINT - floor(rate)::BIGINT * r.source_size AS budget,
  (('0x' || substr(md5(d.doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN share > 0 AND share < 1 AND size > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS odds FROM k),
o AS (SELECT *, floor(odds / (1 + odds) * 4503599627370496.0)::BIGINT AS key FROM q),
c AS (SELECT *, CASE WHEN key IS NOT NULL THEN sum(CASE WHEN key IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM o),
m AS (SELECT *, upto IS NOT NULL AND upto <= budget AS more, budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS missing FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY source, NOT more AND key IS NOT NULL AND size <= missing ORDER BY size DESC, key, doc_id) AS n FROM m)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN more OR (key IS NOT NULL AND size <= missing AND n = 1) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM e
"""
