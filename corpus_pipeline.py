"""A corpus pipeline: five stages over `documents`, each on all that the one before kept.

Every stage begins with the executors' garbage collected, as what one leaves behind would add to the next one's memory.
Every stage but the last returns the columns of documents; the last adds size, source_size, target, taken and copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import decontamination, mixing, pii, simhash, toxicity
from loomgrid.llm.common import collect_garbage, pick, row_numbered, small, tidy_batches, written

#: SQL can't express the fitted models and the fingerprints' hash.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _document_columns(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic, unchanged. Each row is judged by itself."""
    collect_garbage(spark)
    docs = _document_columns(docs)
    models = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = toxicity.Marks(toxicity.known(models))
        for batch in batches:
            good = [toxicity.probabilities(models, marks(t))[-1] < toxicity.THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy_batches(keep), docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of least doc_id, nulls last; of rows that share it, of least text hash.

    Groups are of rows, so rows that share a doc_id and differ in text can be in several. Documents without words share
    a fingerprint like any other, so one of them stays. Reruns agree: what remains equal in order is equal in all columns.
    """
    collect_garbage(spark)
    docs = row_numbered(_document_columns(docs))
    groups = written(simhash.near_groups(docs, id_col="row").select(F.col("doc_id").alias("row"), "component_id"))
    order = docs.select("row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.sha2("text", 256).alias("text"), "source", "lang", "n_chars", "row").alias("order"))
    kept = written(groups.join(order, "row").groupBy("component_id").agg(F.min("order").alias("first")).select("first.row"))
    dropped = written(groups.select("row").join(small(kept), "row", "left_anti"))
    return docs.join(small(dropped), "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, unchanged. Each row is judged by its own text, also without doc_id or with a shared one."""
    collect_garbage(spark)
    docs = row_numbered(_document_columns(docs))
    hit = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").where("contaminated")
    rows = written(hit.select(F.col("doc_id").alias("row")))
    return docs.join(small(rows), "row", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the type's name; n_chars follows. Others are unchanged."""
    collect_garbage(spark)
    docs = _document_columns(docs)
    weights = pii.fit(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [pii.masked(t, weights) for t in old]
            chars = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column("n_chars").to_pylist(), strict=True)]
            columns = {"text": pa.array(new, batch.schema.field("text").type), "n_chars": pa.array(chars, batch.schema.field("n_chars").type)}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(f.name)) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(tidy_batches(mask), docs.schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies: how often each goes into the training data."""
    collect_garbage(spark)
    # taken is a multiple of size.
    return mixing.mix(_document_columns(docs), keep=COLUMNS).where("taken > 0").withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
