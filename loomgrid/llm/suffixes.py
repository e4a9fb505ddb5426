"""Substring dedup over bytes by a hash-compared suffix sort.

Suffixes that share WINDOW bytes share the least-hashed of the GRAM-byte strings inside them, their anchor, at one
distance from their start. A first Spark round counts the anchors' strings over the corpus. Where a string occurs more
than once, each occurrence's context (the bytes of all windows that chose it) goes to one bucket with the others. There
the contexts' suffixes from the anchor on are put in order by a mergesort whose comparison finds the common extension
of two suffixes by binary search over prefix polynomial hashes; windows are then equal if they share enough to the
right of the anchor, by that order, and to the left. Matches are verified byte by byte. Strings that occur more than
HEAVY times are dealt window by window instead, with their bytes, so no bucket gathers all contexts of a very common
string; there windows are found by 128-bit hashes and verified byte by byte too.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .blocks import PACKED, block_of, cuts, dealt, entries, packed, rows_of, tidy
from .common import documents

WINDOW, GRAM = 100, 36
HEAVY = 4096
#: Contexts are sorted in pieces of about so many bytes, which bounds a bucket's memory.
PIECE = 1 << 18
#: Windows are looked at in stretches of so many.
STRETCH = 1 << 20
_U = np.uint64
_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(5))
#: Each byte's value in the polynomials.
VALUES = _random.integers(0, 1 << 64, 256, _U) | _U(1)
_powers: list = [0, None, None]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers from 0 to n."""
    if _powers[0] < n:
        _powers[:] = [n, *(np.concatenate([[_U(1)], np.cumprod(np.full(n, b, _U))]) for b in (_BASE, _INVERSE))]
    return _powers[1], _powers[2]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of value times power over each prefix, modulo 2^64; a string's hash is a difference over the power at its start."""
    out = np.zeros(len(data) + 1, _U)
    np.take(VALUES, data, out=out[1:], mode="clip")
    out[1:] *= powers(len(data))[0][: len(data)]
    return np.cumsum(out, out=out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def least_before(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, _ALL, _U)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    np.minimum.accumulate(rows[:, ::-1], axis=1, out=rows[:, ::-1])
    return np.minimum(padded[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window start that chose it, hash of its gram. Windows lie within texts, which begin at starts."""
    width = window - gram + 1
    found = []
    total = len(data) - window + 1
    # Which window starts are within a text.
    fits = np.ones(max(total, 0), bool)
    for end in starts[1:-1]:
        fits[max(end - window + 1, 0) : min(end, total)] = False
    for a in range(0, total, STRETCH):
        b = min(a + STRETCH, total)
        part = data[a : b + window - 1]
        h = prefix_hashes(part)
        g = h[gram:] - h[:-gram]
        del h
        g *= powers(len(part))[1][: len(part) - gram + 1]
        g = mixed(g)
        ranked = g & ~_U((1 << 24) - 1)
        ranked |= np.arange(len(g), dtype=_U)
        at = least_before(ranked, width)
        del ranked
        at &= _U((1 << 24) - 1)
        at = at.view(np.int64)
        ok = fits[a:b]
        where = np.flatnonzero(ok)
        if not len(where):
            continue
        at = at[where]
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at)) - 1
        # Least hashes crowd near zero; hashed again, they fill the buckets evenly.
        found.append((at[first] + a, where[first] + a, where[last] + a, mixed(g[at[first]] * _U(0x9FB21C651E98DF25))))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def text_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


class Suffixes:
    """Suffixes of one text, each up to an end of its own, compared through prefix hashes."""

    def __init__(self, data: bytes):
        self.data = data
        self.hashes = prefix_hashes(np.frombuffer(data, np.uint8)).tolist()
        self.powers = powers(len(data))[0][: len(data) + 1].tolist()

    def common(self, a: int, b: int, most: int) -> int:
        """Length of the common extension of the suffixes at a and b: binary search on hashes, then verified."""
        h, data = self.hashes, self.data
        if a > b:
            a, b = b, a
        shift, low, high = self.powers[b - a], 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if (h[a + mid] - h[a]) * shift & _ALL == h[b + mid] - h[b] & _ALL:
                low = mid
            else:
                high = mid - 1
        if data[a : a + low] != data[b : b + low]:  # a collision: count byte by byte
            low = next(k for k in range(low) if data[a + k] != data[b + k])
        return low

    def order(self, suffixes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, name) in lexicographic order, by mergesort."""

        def compare(x: tuple, y: tuple) -> int:
            most = min(x[1] - x[0], y[1] - y[0])
            k = self.common(x[0], y[0], most)
            if k < most:
                return self.data[x[0] + k] - self.data[y[0] + k]
            return (x[1] - x[0]) - (y[1] - y[0])

        return sorted(suffixes, key=cmp_to_key(compare))


def repeats_of(contexts: list[bytes], left: np.ndarray, count: np.ndarray, gram: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Which windows of the contexts equal one of a lower rank. Contexts hold `count` windows each, all of one anchor string.

    Contexts are distinct; gram numbers the anchor's string; the anchor lies `left` bytes behind the context's start.
    Returns one flag per window, context after context.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    data = b"".join(contexts)
    text = Suffixes(data)
    place = np.empty(len(contexts), np.int64)
    by_gram = np.argsort(gram, kind="stable")
    edges = np.flatnonzero(np.diff(gram[by_gram])) + 1
    done = 0
    for group in np.split(by_gram, edges):
        ordered = text.order([(int(begin[c] + left[c]), int(begin[c] + size[c]), int(c)) for c in group])
        for _, _, c in ordered:
            place[c] = done
            done += 1
    # All windows: of context c, from o bytes behind its start; i bytes lie before the anchor.
    c = np.repeat(np.arange(len(contexts)), count)
    o = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    i = left[c] - o
    start = begin[c] + o
    h = prefix_hashes(np.frombuffer(data, np.uint8))
    inverse = powers(len(data))[1]
    of = lambda a, b: (h[b] - h[a]) * inverse[a]
    anchor = start + i
    right = of(anchor, start + window)
    by_suffix = np.lexsort((place[c], i, gram[c]))
    new = np.ones(len(c), bool)
    new[1:] = (gram[c[by_suffix]][1:] != gram[c[by_suffix]][:-1]) | (i[by_suffix][1:] != i[by_suffix][:-1]) | (right[by_suffix][1:] != right[by_suffix][:-1])
    right_class = np.empty(len(c), np.int64)
    right_class[by_suffix] = np.cumsum(new)
    before = of(start, anchor)
    by_class = np.lexsort((rank[c], before, right_class))
    new = np.ones(len(c), bool)
    new[1:] = (right_class[by_class][1:] != right_class[by_class][:-1]) | (before[by_class][1:] != before[by_class][:-1])
    leader = by_class[np.flatnonzero(new)[np.cumsum(new) - 1]]
    flags = np.zeros(len(c), bool)
    raw = np.frombuffer(data, np.uint8)
    span = np.arange(window)
    follow = by_class[~new]
    lead = leader[~new]
    same = np.ones(len(follow), bool)
    for k in range(0, len(follow), 20_000):
        x, y = start[follow[k : k + 20_000]], start[lead[k : k + 20_000]]
        same[k : k + 20_000] = (raw[x[:, None] + span] == raw[y[:, None] + span]).all(axis=1)
    flags[follow] = True
    if not same.all():  # windows of one hash that differ: sort those classes out by their bytes
        for bad in np.unique(lead[~same]):
            seen: set[bytes] = set()
            for w in [bad, *follow[lead == bad]]:
                piece = data[start[w] : start[w] + window]
                flags[w] = piece in seen
                seen.add(piece)
    return flags


def pieces(number: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of sorted group numbers that keep groups together and hold about `most` bytes, or one larger group."""
    edges = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(number)).tolist()
    total = np.concatenate([[0], np.cumsum(size)]).tolist()
    out, at = [], 0
    for k in range(1, len(edges)):
        if total[edges[k]] - total[at] >= most or k == len(edges) - 1:
            out.append((at, edges[k]))
            at = edges[k]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays[0])], np.uint32).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds) -> list:
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, memoryview(data)[at:]]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted whole numbers as runs: first, last."""
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] != starts[:-1] + 1
    first = np.flatnonzero(head)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts


def equal_to_earlier(order: np.ndarray, joined: np.ndarray, rows) -> np.ndarray:  # noqa: ANN001
    """Of things ordered by hash, then rank: which equal an earlier one by their bytes. joined: has the hash of the one before.

    rows gives the bytes of some of them, one row each. Those of one hash whose bytes differ are told apart one by one.
    """
    later = joined.copy()
    bad: list[int] = []
    at = np.flatnonzero(joined)
    for k in range(0, len(at), 20_000):
        part = at[k : k + 20_000]
        bad += part[(rows(order[part]) != rows(order[part - 1])).any(axis=1)].tolist()
    heads = np.append(np.flatnonzero(~joined), len(order))
    for h in np.unique(np.searchsorted(heads, bad, side="right") - 1).tolist() if bad else []:
        seen: set[bytes] = set()
        for p in range(heads[h], heads[h + 1]):
            piece = rows(order[p : p + 1]).tobytes()
            later[p] = piece in seen
            seen.add(piece)
    return later


def later_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text"):
    """The blocks of documents, and packed runs of starts in each block of windows that also start earlier."""
    d, n = dealt(docs, id_col, text_col)

    def name(block: pa.Table) -> pa.Table:
        data, starts = text_bytes(rows_of(block)[1])
        keys, count = np.unique(anchors(data, starts, window, gram)[3], return_counts=True)
        at, b = cuts(keys, n), block_of(block)
        count = np.minimum(count, 255).astype(np.uint8)
        return packed([(b, k, 0, _pack(keys[i:j], count[i:j])) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])

    def count_names(bucket: pa.Table) -> pa.Table:
        rows = [(b, k, *_unpack(data, _U, np.uint8)) for b, k, _, data in entries(bucket)]
        _, inverse = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([r[3] for r in rows]))[inverse]
        code = ((total > 1).astype(np.uint8) + (total > heavy)).astype(np.uint8)
        ends = np.cumsum([len(r[2]) for r in rows])
        return packed([(r[0], r[1], 0, c.tobytes()) for r, c in zip(rows, np.split(code, ends[:-1]), strict=True)])

    def gather(block: pa.Table, codes: pa.Table) -> pa.Table:
        if not block.num_rows:
            return packed([])
        ids, texts = rows_of(block)
        data, starts = text_bytes(texts)
        at, first, last, g = anchors(data, starts, window, gram)
        keys, inverse = np.unique(g, return_inverse=True)
        bounds = cuts(keys, n)
        code = np.zeros(len(keys), np.uint8)
        for _, k, _, c in entries(codes):
            code[bounds[k] : bounds[k + 1]] = np.frombuffer(c, np.uint8)
        code = code[inverse]
        owner = np.array([x if x is not None else _ALL >> 1 for x in ids.to_pylist()], np.int64)
        b, whole, out = block_of(block), data.tobytes(), []
        # Light strings: distinct contexts, each with its first place; the other places repeat it whole.
        light = np.flatnonzero(code == 1)
        seen: dict[bytes, int] = {}
        kept, again = [], []
        for x in light.tolist():
            p, i, j = int(at[x]), int(first[x]), int(last[x])
            key = xxhash.xxh3_128_digest(whole[i : j + window]) + (p - i).to_bytes(4, "little") + (j - i).to_bytes(4, "little")
            if key in seen and whole[i : j + window] == whole[(s := int(first[seen[key]])) : s + j + window - i]:
                again.append(x)
            else:
                seen[key] = x
                kept.append(x)
        kept = np.array(kept, np.int64)
        gone = [(first[again], last[again])] if again else []
        kept = kept[np.argsort(g[kept], kind="stable")]
        bounds = cuts(g[kept], n)
        doc = np.searchsorted(starts, first, side="right") - 1
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if j > i:
                x = kept[i:j]
                body = b"".join(whole[first[y] : last[y] + window] for y in x.tolist())
                out.append((b, k, 1, _pack(g[x], owner[doc[x]], first[x].astype(np.uint32), (at[x] - first[x]).astype(np.uint8 if window < 256 else np.uint32), (last[x] - first[x] + 1).astype(np.uint8 if window < 256 else np.uint32)) + body))
        # Heavy strings: every window by itself.
        crowd = np.flatnonzero(code == 2)
        if len(crowd):
            size = last[crowd] - first[crowd] + 1
            start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[crowd], size)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[s : s + window]) for s in start.tolist()), _U).reshape(-1, 2)
            order = np.lexsort((start, digests[:, 1], digests[:, 0]))
            start, digests = start[order], digests[order]
            joined = np.zeros(len(start), bool)
            joined[1:] = (digests[1:] == digests[:-1]).all(axis=1)
            later = equal_to_earlier(np.arange(len(start)), joined, lambda k: data[start[k][:, None] + np.arange(window)])  # noqa: B023
            gone.append(_runs(np.sort(start[later])))
            start, digests = start[~later], digests[~later]
            bounds = cuts(digests[:, 0], n)
            doc_of = np.searchsorted(starts, start, side="right") - 1
            for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if j > i:
                    body = b"".join(whole[s : s + window] for s in start[i:j].tolist())
                    out.append((b, k, 2, _pack(digests[i:j, 0].copy(), digests[i:j, 1].copy(), owner[doc_of[i:j]], start[i:j].astype(np.uint32)) + body))
        if gone:
            out.append((b, b % n, 3, _pack(*(np.concatenate(v).astype(np.uint32) for v in zip(*gone, strict=True)))))
        return packed(out)

    def settle(bucket: pa.Table) -> pa.Table:
        small = np.uint8 if window < 256 else np.uint32
        out, light, crowd = [], [], []
        for b, k, kind, data in entries(bucket):
            if kind == 3:
                out.append((b, k, 0, data))
            elif kind == 1:
                light.append((b, k, *_unpack(data, _U, np.int64, np.uint32, small, small)))
            else:
                crowd.append((b, k, *_unpack(data, _U, _U, np.int64, np.uint32)))
        gone: dict[int, list] = {}
        if light:
            block = np.repeat([x[0] for x in light], [len(x[2]) for x in light])
            g, owner, first, left, count = (np.concatenate([x[i] for x in light]) for i in range(2, 7))
            left, count, first = left.astype(np.int64), count.astype(np.int64), first.astype(np.int64)
            size = count + window - 1
            body, begin = b"".join(x[7] for x in light), np.cumsum(size) - size
            light.clear()
            rank = np.empty(len(g), np.int64)
            rank[np.lexsort((first, block, owner))] = np.arange(len(g))
            lead: dict[tuple, int] = {}
            same = np.empty(len(g), np.int64)
            for x in np.argsort(rank).tolist():  # equal contexts: all but the first place repeat it whole
                key = (int(left[x]), body[begin[x] : begin[x] + size[x]])
                same[x] = lead.setdefault(key, x)
            del lead
            heads = np.flatnonzero(same == np.arange(len(g)))
            follow = np.flatnonzero(same != np.arange(len(g)))
            for x in follow.tolist():
                gone.setdefault(int(block[x]), []).append((first[x : x + 1], first[x : x + 1] + count[x] - 1))
            _, number, times = np.unique(g[heads], return_inverse=True, return_counts=True)
            heads, number = heads[times[number] > 1], number[times[number] > 1]
            by_number = np.argsort(number, kind="stable")
            heads, number = heads[by_number], number[by_number]
            for i, j in pieces(number, size[heads], PIECE):
                part = heads[i:j]
                flags = repeats_of([body[begin[x] : begin[x] + size[x]] for x in part.tolist()], left[part], count[part], number[i:j], rank[part], window)
                start = np.arange(len(flags)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + np.repeat(first[part], count[part])
                of = np.repeat(block[part], count[part])[flags]
                start = start[flags]
                for b in np.unique(of).tolist():
                    gone.setdefault(b, []).append(_runs(np.sort(start[of == b])))
        if crowd:
            block = np.repeat([x[0] for x in crowd], [len(x[2]) for x in crowd])
            h0, h1, owner, start = (np.concatenate([x[i] for x in crowd]) for i in range(2, 6))
            body = np.frombuffer(b"".join(x[6] for x in crowd), np.uint8).reshape(-1, window)
            crowd.clear()
            order = np.lexsort((start, block, owner, h1, h0))
            joined = np.zeros(len(order), bool)
            joined[1:] = (h0[order][1:] == h0[order][:-1]) & (h1[order][1:] == h1[order][:-1])
            later = np.zeros(len(order), bool)
            later[order] = equal_to_earlier(order, joined, lambda k: body[k])
            for b in np.unique(block[later]).tolist():
                gone.setdefault(b, []).append(_runs(np.sort(start[later & (block == b)].astype(np.int64))))
        k = int(bucket.column("bucket")[0].as_py())
        for b, runs in gone.items():
            a, z = (np.concatenate(v) for v in zip(*runs, strict=True))
            out.append((b, k, 0, _pack(a.astype(np.uint32), z.astype(np.uint32))))
        return packed(out)

    names = d.groupBy("block").applyInArrow(tidy(name), PACKED)
    codes = names.groupBy("bucket").applyInArrow(tidy(count_names), PACKED)
    contexts = d.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(tidy(gather), PACKED)
    return d, contexts.groupBy("bucket").applyInArrow(tidy(settle), PACKED)


def drop_later_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row of docs.

    Bytes covered by a `window`-byte string that also starts earlier go; the first occurrence by doc_id (null last),
    then place, stays. Rows that share a doc_id are ordered by their text; of equal rows one counts as the earlier.
    Null, empty and short texts keep all they have. Other columns are not read; an empty table gives an empty result.
    """
    d, found = later_windows(docs, window, gram, heavy, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def remove(block: pa.Table, where: pa.Table) -> pa.Table:
        ids, texts = rows_of(block) if block.num_rows else (pa.array([], pa.int64()), [])
        data, starts = text_bytes(texts)
        change = np.zeros(len(data) + window + 1, np.int32)
        for _, _, _, packed_runs in entries(where):
            first, last, _ = _unpack(packed_runs, np.uint32, np.uint32)
            np.add.at(change, first.astype(np.int64), 1)
            np.add.at(change, last.astype(np.int64) + window, -1)
        gone = np.cumsum(change[: len(data)]) > 0
        removed, spans, kept = [], [], []
        for i, t in enumerate(texts):
            g = gone[starts[i] : starts[i + 1]]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed[-1] else 0)
            kept.append(data[starts[i] : starts[i + 1]][~g].tobytes() if removed[-1] else t)
        columns = [ids, *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.Table.from_arrays(columns, names)

    return d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(tidy(remove), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_later_copies(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, n, c, substr(h, (2 * c + 1)::BIGINT, 2198) AS piece FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, (len(h) // 2 - 99)::BIGINT, 1000)) AS c FROM d WHERE len(h) >= 200)),
w AS (SELECT doc_id, c + o AS p, md5(substr(piece, 2 * o + 1, 200)) AS k FROM (SELECT *, unnest(range(0, least(1000, n - 99 - c)::BIGINT)) AS o FROM c)),
f AS (SELECT k, min((doc_id, p)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT w.doc_id, p FROM w JOIN f USING (k) WHERE (w.doc_id, p) <> first),
s AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 100 AS fresh FROM r),
n AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
g AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM n GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
t AS (SELECT q.doc_id, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans, max(b) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
