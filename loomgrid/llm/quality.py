"""Quality rules: counts of bad form, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, one of the trusted documents and one
of all, give each bucket a log ratio; a document's score is the mean over its n-grams. Ratios are held as integers,
so sums, and with them the verdicts, do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, documents, estimated_bytes, id_and_text, pick, small, table, words_of, written

#: Words have BUCKETS places and pairs as many; that bounds the broadcast model.
BUCKETS, SMOOTHING, UNIT = 1 << 16, 1.0, 1_000_000
#: Documents score at least this mean log ratio to be kept.
THRESHOLD = -0.35
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the array."""
    n = F.size(words)
    # Windows are hashed; those of a text with equal hashes are then compared by their words.
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = F.when(n >= size, let(hashes, lambda h: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))))

    def covered(g: Column) -> Column:
        window = lambda i: F.slice(words, i + 1, F.lit(size))
        by_gram = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), window(i).alias("w"), i.alias("i"))))

        def twins(s: Column) -> Column:
            nothing = F.array(F.lit(None).cast("struct<g:bigint,w:array<string>,i:int>"))
            zipped = F.arrays_zip(s.alias("x"), F.concat(nothing, s).alias("before"), F.concat(F.slice(s, F.lit(2), F.size(s)), nothing).alias("after"))
            return F.transform(F.filter(zipped, lambda z: (z["x"]["w"] == z["before"]["w"]) | (z["x"]["w"] == z["after"]["w"])), lambda z: z["x"]["i"])

        at = F.array_sort(let(by_gram, twins))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return F.coalesce(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)), F.lit(0)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with words and the base columns."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return d.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def pairs(words: Column) -> Column:
    """Each word with the next one, null after the last."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def _word_bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(f"{c}.a"), F.lit(buckets)).cast("int")


def _pair_bucket(c: str, buckets: int) -> Column:
    return (F.pmod(F.xxhash64(f"{c}.a", f"{c}.b"), F.lit(buckets)) + buckets).cast("int")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, ratio over all n-grams of docs (doc_id, text); trusted has doc_id once each. At most 2 * buckets rows.

    Ids that are few enough are broadcast, so no text is shuffled. Beyond that the join shuffles texts, but none without
    doc_id, which nothing trusts: they may be many and would meet in one task.
    """
    ids = written(trusted.select("doc_id", F.lit(1).alias("t")))
    if estimated_bytes(ids) <= BROADCAST_BYTES:
        flagged = docs.join(small(ids), "doc_id", "left")
    else:
        named = docs.where("doc_id is not null").join(ids, "doc_id", "left")
        flagged = named.unionByName(docs.where("doc_id is null").withColumn("t", F.lit(None).cast("int")))
    grams = flagged.select(F.coalesce("t", F.lit(0)).cast("long").alias("t"), F.explode(pairs(words_of(F.col("text")))).alias("p"))
    counts = grams.select("t", F.explode(F.array(_word_bucket("p", buckets), _pair_bucket("p", buckets))).alias("bucket"))
    counts = written(counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))
    words = F.col("bucket") < buckets
    total = counts.agg(*(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)) for c in ("raw", "target") for cond in (words, ~words))).first()
    of = lambda c, k: F.when(words, F.lit(float(total[k]))).otherwise(F.lit(float(total[k + 1])))
    rate = lambda c, k: F.log((F.col(c) + SMOOTHING) / (of(c, k) + SMOOTHING * buckets))
    ratio = rate("target", 2) - rate("raw", 0) if total[2] else F.lit(0.0)
    return written(counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("ratio")))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every row of docs.

    Null and empty texts have no words, so fail the base rule of 10 words. Repeated rows are judged each by itself and
    counted each in the raw corpus; a null doc_id is kept and never trusted. A document is trusted once however often
    `trusted` names it. Other columns are not read. Empty tables give an empty result; with no trusted document every
    ratio is 0, so the base rules alone decide.
    """
    d = id_and_text(docs, id_col, text_col)
    ids = pick(trusted, doc_id=trusted.columns[0]).where("doc_id is not null").distinct()
    model = F.broadcast(fit(d, ids, buckets))
    based = base_rules(d).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = based.select(*keys, F.explode_outer(pairs(F.col("words"))).alias("p"))
    grams = grams.select(*keys, F.when(F.col("n_words") > 0, _word_bucket("p", buckets)).alias("b1"), F.when(F.col("n_words") > 0, _pair_bucket("p", buckets)).alias("b2"))
    scored = grams.join(model.select(F.col("bucket").alias("b1"), F.col("ratio").alias("r1")), "b1", "left").join(model.select(F.col("bucket").alias("b2"), F.col("ratio").alias("r2")), "b2", "left")
    total = scored.groupBy(*keys).agg(F.sum(F.coalesce("r1", F.lit(0)) + F.coalesce("r2", F.lit(0))).alias("total"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = F.col("total") >= F.lit(round(threshold * UNIT)) * 2 * F.col("n_words")
    score = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words")) / UNIT)
    return total.select(*keys[1:], failed.alias("base_failed"), score.alias("score"), (~failed & good).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality").where("quality = 1").select("doc_id")
    return judge(documents(spark, sf_dir), labels)
