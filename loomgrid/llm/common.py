"""What the corpus operators share: column picking, size estimates, tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; what separates words for most operators.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, by the size of its files, that is sent to every executor; above it joins shuffle.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by their exact names under new ones; all else, also names that differ by case only, is left out."""
    names = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate (the size of the files for a scan); takes no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, block_bytes: int, text_col: str = "text") -> int:
    """So many blocks that one holds about block_bytes of input; at least one for each shuffle partition.

    Tables that aren't scans of files have no estimate of use (of an unknown size the planner assumes the most); their
    texts' bytes are summed.
    """
    size = estimated_bytes(docs)
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() != 1 or not leaves.head().getClass().getSimpleName().startswith("LogicalRelation") or size >= 1 << 50:
        size = pick(docs, text=text_col).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shuffle_partitions(docs.sparkSession), -(-size // block_bytes))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is absent, a local folder on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already  # noqa: BLE001
        pass


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage, outlives executors. Deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def row_numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a long that tells all rows apart and is the same whenever the table is read again.

    For a scan of Parquet files it is made of the file's place among the sorted files and the row's place in the file, so
    nothing is copied. Other tables are written first.
    """
    spark = df.sparkSession
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()))
    files = placed.select("_path").distinct().select("_path", (F.row_number().over(Window.orderBy("_path")) - 1).cast("long").alias("_file"))
    return placed.join(small(written(files)), "_path").select(*df.columns, (F.shiftleft("_file", 36) + F.col("_place")).alias(name))


def give_back() -> None:
    """Returns this worker's free memory to the system; else it stays with the idle worker beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy_batches(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step on a task's batches, with its free memory given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def collect_garbage(spark: SparkSession) -> None:
    """Executors collect their garbage and so return the heap that earlier jobs had grown; else it adds up beside the Python workers.

    One small task for each core, so an executor may be passed by; nothing depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def small(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcast if its files are small enough; otherwise the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """The words between white space, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
