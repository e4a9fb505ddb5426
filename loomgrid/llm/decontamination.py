"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds a posting (document row, position, term) for every document word that the benchmark uses, and is
written once. Phrases are looked up from their rarest terms: the rarest term's postings, shifted by its place in the
item, are intersected with those of the second rarest; what is left is checked against all terms of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, lower_ascii, pick, small, table, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def plain_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def item_words(items: DataFrame) -> DataFrame:
    """item_id, q (position in the item), term, n (words of the item)."""
    d = pick(items, item_id="item_id", text="text").select(F.col("item_id").cast("string").alias("item_id"), F.monotonically_increasing_id().alias("item"), plain_words(F.col("text")).alias("words"))
    return d.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "term"))


class Index:
    """Postings of the documents for the terms of a set of items."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.items = written(item_words(items))
        self.terms = written(self.items.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")))
        d = id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), plain_words(F.col("text")).alias("words"))
        # One more place per document, behind its last word, carries its length.
        placed = d.select("doc_id", "row", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
        found = placed.join(small(self.terms), "term", "left").where("tid is not null or term = ''")
        self.postings = written(found.select("row", "doc_id", "pos", F.coalesce("tid", F.lit(-1)).alias("tid")))

    def documents(self) -> DataFrame:
        return self.postings.where("tid = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def words(self) -> DataFrame:
        return self.postings.where("tid >= 0").select("row", "pos", "tid")

    def windows(self, size: int) -> DataFrame:
        """item, w (first position), len and the two rarest terms (t1 at q1, t2 at q2) of every window of the items."""
        df = self.words().groupBy("tid").agg(F.count("*").alias("df"))
        placed = self.items.join(small(self.terms), "term").join(df, "tid", "left").na.fill(0, ["df"])
        length = F.least("n", F.lit(size))
        first = F.sequence(F.greatest(F.lit(0), F.col("q") - length + 1), F.least(F.col("q"), F.col("n") - length))
        inside = placed.select("item", "q", "tid", "df", length.alias("len"), F.explode(first).alias("w"))
        rank = F.row_number().over(Window.partitionBy("item", "w").orderBy("df", "tid", "q"))
        ends = inside.withColumn("k", rank).where("k <= 2").groupBy("item", "w", "len")
        at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        return ends.agg(at(1, "q").alias("q1"), at(1, "tid").alias("t1"), F.coalesce(at(2, "q"), at(1, "q")).alias("q2"), F.coalesce(at(2, "tid"), at(1, "tid")).alias("t2"))

    def phrases(self, size: int = WINDOW) -> DataFrame:
        """row, item, start, len of every occurrence of a window of `size` words of an item (of a shorter item, all)."""
        windows = written(self.windows(size))
        anchors = written(windows.select("item", "q1", "t1", "q2", "t2").distinct())
        words = self.words()
        first = words.join(small(anchors), words.tid == anchors.t1).select("row", "item", (F.col("pos") - F.col("q1")).alias("shift"), "q2", "t2")
        first = first.where("shift + q2 >= 0").distinct()
        second = words.join(small(anchors.select(F.col("t2").alias("tid")).distinct()), "tid")
        shifted = first.select("row", "item", "shift", (F.col("shift") + F.col("q2")).alias("pos"), F.col("t2").alias("tid"))
        both = shifted.join(second, ["row", "pos", "tid"])
        candidates = written(both.select("row", "item", "shift").distinct())
        # All terms of an item at one shift: the item's positions that the document matches.
        placed = self.items.join(small(self.terms), "term").select("item", "q", "tid")
        rows = written(candidates.select("row").distinct())
        near = words.join(small(rows), "row", "left_semi")
        expected = candidates.join(small(written(placed)), "item").select("row", "item", "shift", "q", (F.col("shift") + F.col("q")).alias("pos"), "tid")
        matched = expected.join(near, ["row", "pos", "tid"]).groupBy("row", "item", "shift").agg(F.collect_set("q").alias("matched"))
        spans = matched.join(small(windows.select("item", "w", "len")), "item")
        whole = spans.where(F.size(F.array_intersect(F.sequence("w", F.col("w") + F.col("len") - 1), "matched")) == F.col("len"))
        return whole.select("row", "item", (F.col("shift") + F.col("w")).alias("start"), "len")

    def proximity(self, size: int = WINDOW, slop: int = 5) -> DataFrame:
        """row, item, w, pos: occurrences of a window's rarest term with all its other terms within size + slop words of it, in any order."""
        width = size + slop
        windows = written(self.windows(size))
        placed = self.items.join(small(self.terms), "term").select("item", "q", "tid")
        needed = written(windows.join(placed, "item").where("q >= w and q < w + len").select("item", "w", "t1", "tid").distinct())
        count = needed.groupBy("item", "w").agg(F.count("*").alias("need"))
        words = self.words()
        at = words.join(small(windows.select("item", "w", "t1")), words.tid == F.col("t1")).select("row", "item", "w", "pos")
        at = at.withColumn("slot", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: k + F.floor(F.col("pos") / width).cast("int"))))
        other = words.select("row", F.col("pos").alias("p"), "tid", F.floor(F.col("pos") / width).cast("int").alias("slot"))
        close = at.join(other, ["row", "slot"]).where(F.abs(F.col("p") - F.col("pos")) <= width)
        found = close.join(small(needed.select("item", "w", "tid")), ["item", "w", "tid"]).groupBy("row", "item", "w", "pos").agg(F.countDistinct("tid").alias("have"))
        return found.join(count, ["item", "w"]).where("have = need").select("row", "item", "w", "pos")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Null, empty and wordless texts have no words and no hits, and items without words match nothing. Repeated rows and
    repeated items are each treated by themselves (equal item ids count once); null ids stay. Other columns are not
    read; empty tables give an empty result or no hits.
    """
    index = Index(docs, items, id_col, text_col)
    hits = written(index.phrases(size))
    words = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = index.items.select("item", "item_id").distinct()
    found = hits.select("row", "item").distinct().join(small(written(names)), "item").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id"))).alias("ids"))
    d = index.documents().join(words, "row", "left").join(found, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return d.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[w : w + least(len(words), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS w FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS phrase FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, sizes WHERE len(words) >= n)),
hit AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
