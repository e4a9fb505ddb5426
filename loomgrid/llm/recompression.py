"""Substring dedup over words by recompression.

Rounds of recompression replace runs of one symbol and pairs of neighbouring symbols by new symbols. A symbol's name is
a hash of what it stands for, so equal words get equal names in every document without asking around. For each symbol
the words on which its formation depends are kept: two equal windows hold the same symbols wherever those words lie
inside. The symbols of the last round are counted over the corpus in one Spark round. A window that holds a symbol
that occurs once cannot repeat; the other windows are compared by their own hashes in a second round, which verifies
the repeats. Hash names only choose what is compared: a collision costs work, never a wrong window, as windows are
compared by 96 bits of their words' 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .blocks import PACKED, block_of, cuts, dealt, entries, packed, rows_of, spread
from .common import documents

WINDOW = 35
#: After so many rounds a symbol spans 2.4 words and depends on about 16; windows of 35 words then hold several.
ROUNDS = 3
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_FAR, _ALL = 1 << 40, (1 << 64) - 1


class Hashes(dict):
    """128-bit hashes of words; keeps a bounded number."""

    def __missing__(self, word: bytes) -> bytes:
        digest = xxhash.xxh3_128_digest(word)
        if len(self) < 300_000:
            self[word] = digest
        return digest


_hashes = Hashes()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 2) 64-bit halves over all texts, and where each text's words begin (one more at the end)."""
    parts, starts, n = [], [0], 0
    get = _hashes.__getitem__
    for text in texts:
        words = text.split()
        parts.append(b"".join(map(get, words)))
        n += len(words)
        starts.append(n)
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2), np.array(starts, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


def symbols(names: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: name, and first and last-but-one word on which each depends.

    A symbol that depends on a document's edge reaches far outside, so that it lies within no window.
    """
    x = names.copy()
    lo, hi = np.arange(len(x)), np.arange(1, len(x) + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def beside(lo: np.ndarray, hi: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one behind; joint: whether a symbol and the next share a document."""
        before = np.concatenate([[-_FAR], np.where(joint, lo[:-1], -_FAR)])
        behind = np.concatenate([np.where(joint, hi[1:], _FAR), [_FAR]])
        return before, behind

    for r in range(rounds):
        if len(x) < 2:
            break
        # Runs.
        joint = doc[1:] == doc[:-1]
        before, behind = beside(lo, hi, joint)
        first = np.concatenate([[True], ~((x[1:] == x[:-1]) & joint)])
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(x)))
        last = at + length - 1
        lo, hi = np.minimum(before[at], lo[at]), np.maximum(behind[last], hi[last])
        x, doc = x[at], doc[at]
        runs = length > 1
        x[runs] = mixed(x[runs] + _U((2 * r + 1) * int(_BASES[0]) & _ALL) + length[runs].astype(_U))
        if len(x) < 2:
            break
        # Pairs: a left symbol and a right one behind it; which is which is a bit of the name.
        joint = doc[1:] == doc[:-1]
        right = (mixed(x + _U(r * int(_BASES[1]) & _ALL)) & _U(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & joint)
        before, behind = beside(lo, hi, joint)
        alone_lo, alone_hi = np.where(right, np.minimum(before, lo), lo), np.where(right, hi, np.maximum(behind, hi))
        new_x = x.copy()
        new_x[pair] = mixed(x[pair] * _BASES[0] + mixed(x[pair + 1] + _U(2 * r + 2)))
        alone_lo[pair], alone_hi[pair] = np.minimum(lo[pair], lo[pair + 1]), np.maximum(hi[pair], hi[pair + 1])
        stays = np.ones(len(x), bool)
        stays[pair + 1] = False
        x, lo, hi, doc = new_x[stays], alone_lo[stays], alone_hi[stays], doc[stays]
    return x, lo, hi


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        inverse = _U(pow(int(base), -1, 1 << 64))
        out.append(tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, b, _U))]) for b in (base, inverse)))
    return out


_kept_powers: list = [0, None]


def window_hashes(halves: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the windows of `size` words that begin at the given words."""
    n = len(halves)
    if _kept_powers[0] < n or _kept_powers[1] is None:
        _kept_powers[:] = [n, _powers(n)]
    out = []
    for half, (power, inverse) in enumerate(_kept_powers[1]):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(halves[:, half] * power[:n])])
        out.append(mixed((total[at + size] - total[at]) * inverse[at]))
    return out[0], (out[1] >> _U(32)).astype(np.uint32)


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"):
    """The blocks of documents, and packed word positions in each block at which repeated windows begin."""
    d, n = dealt(docs, id_col, text_col)

    def name(block: pa.Table) -> pa.Table:
        halves, starts = word_hashes(rows_of(block)[1])
        x, lo, hi = symbols(halves[:, 0], starts, rounds)
        keys, count = np.unique(x[hi - lo <= window], return_counts=True)
        at, b = cuts(keys, n), block_of(block)
        return packed([(b, k, 0, keys[i:j].tobytes() + np.packbits(count[i:j] > 1).tobytes()) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])

    def unpack(data: bytes, width: int) -> tuple[bytes, np.ndarray]:
        m = next(m for m in range(len(data) * 8 // (8 * width + 1), -1, -1) if m * width + (m + 7) // 8 <= len(data))
        return data[: m * width], np.unpackbits(np.frombuffer(data[m * width :], np.uint8), count=m).astype(bool)

    def count_names(bucket: pa.Table) -> pa.Table:
        rows = list(entries(bucket))
        keys, twice = zip(*(unpack(r[3], 8) for r in rows), strict=True)
        values, of = spread([np.frombuffer(k, _U) for k in keys])
        _, inverse = np.unique(values, return_inverse=True)
        shared = np.bincount(inverse, weights=1.0 + np.concatenate(twice))[inverse] > 1
        return packed([(r[0], r[1], 0, np.packbits(shared[of == i]).tobytes()) for i, r in enumerate(rows)])

    def verify(block: pa.Table, bits: pa.Table) -> pa.Table:
        if not block.num_rows:
            return packed([])
        halves, starts = word_hashes(rows_of(block)[1])
        x, lo, hi = symbols(halves[:, 0], starts, rounds)
        inside = hi - lo <= window
        keys = np.unique(x[inside])
        at = cuts(keys, n)
        shared = np.zeros(len(keys), bool)
        for _, k, _, data in entries(bits):
            shared[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=at[k + 1] - at[k])
        single = inside.copy()
        single[inside] = ~shared[np.searchsorted(keys, x[inside])]
        # A symbol that occurs once rules out every window around what it depends on.
        change = np.zeros(len(halves) + 1, np.int64)
        np.add.at(change, np.maximum(hi[single] - window, 0), 1)
        np.add.at(change, lo[single] + 1, -1)
        open_ = np.cumsum(change[:-1]) == 0
        fits = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(halves)) >= window
        where = np.flatnonzero(open_ & fits)
        a, c = window_hashes(halves, where, window)
        order = np.lexsort((c, a))
        a, c, where = a[order], c[order], where[order].astype(np.uint32)
        head = np.ones(len(a), bool)
        head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(head)
        times = np.diff(np.append(first, len(a))).astype(np.uint32)
        at, b = cuts(a[first], n), block_of(block)
        bound = np.append(first, len(a))
        out = []
        for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if j > i:
                m = np.array([j - i], np.uint32)
                out.append((b, k, 0, b"".join(v.tobytes() for v in (m, a[first[i:j]], c[first[i:j]], times[i:j], where[bound[i] : bound[j]]))))
        return packed(out)

    def compare(bucket: pa.Table) -> pa.Table:
        parts = []
        for b, k, _, data in entries(bucket):
            m = int(np.frombuffer(data, np.uint32, 1)[0])
            a = np.frombuffer(data, _U, m, 4)
            c = np.frombuffer(data, np.uint32, m, 4 + 8 * m)
            times = np.frombuffer(data, np.uint32, m, 4 + 12 * m)
            parts.append((b, k, a, c, times, np.frombuffer(data, np.uint32, -1, 4 + 16 * m)))
        a, of = spread([p[2] for p in parts])
        c, times = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        order = np.lexsort((c, a))
        head = np.ones(len(a), bool)
        head[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(head) - 1
        shared = np.bincount(group, weights=times)[group] > 1
        out = []
        for i, (b, k, _, _, t, where) in enumerate(parts):
            found = where[np.repeat(shared[of == i], t)]
            if len(found):
                out.append((b, k, 0, np.sort(found).tobytes()))
        return packed(out)

    names = d.groupBy("block").applyInArrow(name, PACKED)
    bits = names.groupBy("bucket").applyInArrow(count_names, PACKED)
    windows = d.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(verify, PACKED)
    return d, windows.groupBy("bucket").applyInArrow(compare, PACKED)


def drop_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining text) for every row of docs.

    Words covered by a window of `window` words that occurs twice or more in the corpus go, every occurrence alike.
    Null, empty and short texts keep all they have. Repeated rows are occurrences of each other; a null doc_id is a
    document like any other. Other columns are not read; an empty table gives an empty result.
    """
    d, found = repeated_windows(docs, window, rounds, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def remove(block: pa.Table, where: pa.Table) -> pa.Table:
        ids, texts = rows_of(block) if block.num_rows else (pa.array([], pa.int64()), [])
        words = [t.split() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        change = np.zeros(starts[-1] + window + 1, np.int64)
        for _, _, _, data in entries(where):
            at = np.frombuffer(data, np.uint32).astype(np.int64)
            change[at] += 1
            change[at + window] -= 1
        gone = np.cumsum(change) > 0
        removed, kept = [], []
        for i, w in enumerate(words):
            g = gone[starts[i] : starts[i + 1]]
            removed.append(int(g.sum()))
            kept.append(b" ".join(w if not removed[-1] else [x for x, y in zip(w, g.tolist(), strict=True) if not y]))
        columns = [ids, pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(columns, names)

    return d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(words[p : p + 34], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM d WHERE len(words) >= 35)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id),
x AS (SELECT doc_id, q, words[q] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS q FROM d)),
m AS (SELECT DISTINCT doc_id, unnest(gone) AS q FROM g),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.q) AS kept, count(*) AS n FROM x ANTI JOIN m ON x.doc_id = m.doc_id AND x.q = m.q GROUP BY x.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
