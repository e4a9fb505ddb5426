"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

Two nodes of the trie of distinct fingerprints are visited together as long as the bits in which their prefixes differ
are within the budget. Fingerprints within the budget agree in all but `budget` of more blocks of bits, so the trie is
built once for each choice of agreeing blocks, these bits first: there the budget is nothing, below it the whole, and
few node pairs live on. The exchange deals each trie's subtrees to tasks; a subtree with far more fingerprints than
others is dealt as pairs of its parts. Each task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, small, tidy_batches, written
from .components import stars

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: A subtree dealt to a task holds about so many fingerprints; there are 2^LEAST_LEVELS subtrees at least. One is split
#: if it has over twice its share and over LEAST_SPLIT.
SUBTREE, LEAST_LEVELS, LEAST_SPLIT = 1 << 17, 4, 1 << 11
#: From so many fingerprints on, one more block of bits is made, so that more bits agree.
MORE_BLOCKS = (1 << 24, 1 << 32)
#: Node pairs whose leaves make no more pairs than this are compared leaf by leaf; node pairs are walked in such chunks.
LEAVES, CHUNK = 64, 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the shingles' hashes; 0 without words. A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    bits = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, len(values), 4096):
        bits += np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row of (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.mapInArrow(tidy_batches(scan), "doc_id long, fp long")


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The concatenated ranges lo..lo+n."""
    total = int(n.sum())
    offsets = np.repeat(np.cumsum(n) - n, n)
    return np.arange(total) - offsets + np.repeat(lo, n)


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, budget: int, depth: int, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks two tries, given as sorted fingerprints that agree in their first `depth` bits each, together.

    Yields (i, j) of leaves that differ in 1 to `budget` bits; with same, i < j. Of pairs that differ in the first
    `exact` bits any may be left out.
    """
    if not len(a) or not len(b):
        return
    one = np.uint64(1)
    used = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    stack = [(depth, np.array([[0, len(a), 0, len(b), used]], np.int64))] if used <= budget else []
    while stack:
        level, nodes = stack.pop()
        leaf = ((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= LEAVES) | (level == 64)
        done, nodes = nodes[leaf], nodes[~leaf]
        if len(done):
            na, nb = done[:, 1] - done[:, 0], done[:, 3] - done[:, 2]
            i = _expand(done[:, 0], na)
            per = np.repeat(nb, na)
            j = _expand(np.repeat(done[:, 2], na), per)
            i = np.repeat(i, per)
            bits = np.bitwise_count(a[i] ^ b[j])
            ok = (bits <= budget) & ((i < j) if same else (bits > 0))
            yield i[ok], j[ok]
        if not len(nodes):
            continue
        bit = one << np.uint64(63 - level)
        clear = ~((bit << one) - one) if level else np.uint64(0)
        split = [np.searchsorted(v, (v[nodes[:, c]] & clear) | bit) for v, c in ((a, 0), (b, 2))]
        halves = [[(nodes[:, c], np.clip(m, nodes[:, c], nodes[:, c + 1])), (np.clip(m, nodes[:, c], nodes[:, c + 1]), nodes[:, c + 1])] for m, c in zip(split, (0, 2), strict=True)]
        for x in (0, 1):
            for y in (0, 1):
                (al, ah), (bl, bh) = halves[0][x], halves[1][y]
                diff = nodes[:, 4] + (x != y)
                keep = (al < ah) & (bl < bh) & (diff <= (0 if level < exact else budget))
                if same:  # each pair of nodes once
                    keep &= al < bh
                    keep &= ~((x == 1) & (y == 0) & (nodes[:, 0] == nodes[:, 2]))
                child = np.stack([al, ah, bl, bh, diff], axis=1)[keep]
                stack += [(level + 1, child[k : k + CHUNK]) for k in range(0, len(child), CHUNK)]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(root, np.maximum(x, y), low)
            while not np.array_equal(nxt := root[root], root):
                root = nxt
    return root


def tries(n: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The tries for n fingerprints: in which order each takes the blocks of bits (lowest bit, width), and how many bits agree."""
    m = budget + 1 + sum(n > k for k in MORE_BLOCKS)
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [(low, high - low) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return [([*head, *(b for b in blocks if b not in head)], sum(w for _, w in head)) for head in combinations(blocks, m - budget)]


def reordered(fp, order: list[tuple[int, int]], shift_down, shift_up):  # noqa: ANN001, ANN201
    """The fingerprint's blocks in the given order, highest first; for columns and arrays."""
    out, place = None, 64
    for low, width in order:
        place -= width
        part = shift_up(shift_down(fp, low, (1 << width) - 1), place)
        out = part if out is None else out + part  # no two share a bit
    return out


def linked(fps: DataFrame, budget: int = MOST_BITS) -> DataFrame:
    """(a, b) links over distinct values fp whose components are those of all pairs within budget."""
    n = fps.count()
    plan = tries(n, budget)
    levels = min(*(exact for _, exact in plan), max(LEAST_LEVELS, ceil(log2(max(n, 1) / SUBTREE))))
    limit = max(LEAST_SPLIT, 2 * n >> levels)
    top = [F.shiftrightunsigned(reordered(F.col("fp"), order, lambda x, k, mask: F.shiftrightunsigned(x, k).bitwiseAND(F.lit(mask)), F.shiftleft), 64 - levels) for order, _ in plan]
    each = fps.select("fp", F.posexplode(F.array(*top)).alias("trie", "p"))
    # At most half as many as there are subtrees.
    crowded = written(each.groupBy("trie", "p").count().where(F.col("count") > limit).select("trie", "p", F.ceil(2 * F.col("count") / limit).cast("int").alias("split")))
    each = each.join(small(crowded), ["trie", "p"], "left").withColumn("split", F.coalesce("split", F.lit(1)))
    each = each.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("split")).cast("int"))
    dealt = each.select("fp", "trie", "p", "own", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("other"))
    dealt = dealt.select("fp", "trie", "p", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        order, exact = plan[int(pdf["trie"].iloc[0])]
        fp, own, i, j = pdf["fp"].to_numpy(np.int64), pdf["own"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        value = reordered(fp.view(np.uint64), order, lambda x, k, mask: (x >> np.uint64(k)) & np.uint64(mask), lambda x, k: x << np.uint64(k))
        sort = np.lexsort((value, own))
        fp, value, own = fp[sort], value[sort], own[sort]
        if i == j:
            root = forest(len(value), trie_links(value, value, True, budget, levels, exact))
        else:
            a, b = value[own == i], value[own == j]
            root = forest(len(value), ((x, y + len(a)) for x, y in trie_links(a, b, False, budget, levels, exact)))
        k = np.flatnonzero(root != np.arange(len(value)))
        return pd.DataFrame({"a": fp[k], "b": fp[root[k]]})

    return dealt.groupBy("trie", "p", "i", "j").applyInPandas(walk, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Documents are linked if their fingerprints differ in at most `budget` bits; component_id is the least doc_id that
    links reach. Null, empty and wordless texts share fingerprint zero and are linked like any other. Repeated rows
    come out repeated; a null doc_id is kept and never the least unless alone. Other columns are not read; an empty
    table gives an empty result.
    """
    marked = written(fingerprints(id_and_text(docs, id_col, text_col), shingle))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = stars(linked(distinct.select("fp"), budget))
    rooted = distinct.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(groups, "root").select("fp", "component_id"))
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
