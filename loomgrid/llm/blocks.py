"""Rounds between blocks of documents and buckets of hashes, for finding repeats inside texts.

Documents are dealt into blocks once; each block is one group of a grouped function, and every later step that needs
the texts reads the same exchange again. A block sends each bucket one packed row of distinct keys, so an often
repeated key costs a bucket one entry per block, however often it occurs.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, give_back, id_and_text

BLOCK_BYTES = 2 << 20
PACKED = "block int, bucket int, kind int, data binary"
_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the number of blocks. Rows with one doc_id share a block."""
    n = block_count(docs, block_bytes, text_col)
    d = id_and_text(docs, id_col, text_col)
    return d.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), n


def rows_of(block: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """Ids and texts as bytes, in an order that every step sees: by doc_id, null last, then text."""
    t = block.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = t.column("doc_id").combine_chunks()
    return ids, [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]


def tidy(step: Callable) -> Callable:
    """The step on one or two tables, with its free memory given back after each group."""

    def one(a: pa.Table) -> pa.Table:
        out = step(a)
        give_back()
        return out

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        out = step(a, b)
        give_back()
        return out

    return one if len(inspect.signature(step).parameters) == 1 else two


def block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def packed(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], [], []), _SCHEMA, strict=True)], schema=_SCHEMA)


def cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins in sorted 64-bit keys; one more at the end."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def entries(table: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, bucket, kind, data) in an order that does not depend on arrival."""
    t = table.select(["block", "bucket", "kind", "data"]).sort_by([("bucket", "ascending"), ("block", "ascending"), ("kind", "ascending")])
    yield from zip(*(t.column(i).to_pylist() for i in range(4)), strict=True)


def join_bytes(parts: list[bytes]) -> bytes:
    return b"".join(parts)


def spread(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays behind one another, and which array each element came from."""
    sizes = [len(v) for v in values]
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.repeat(np.arange(len(values)), sizes)
