"""Operators over the whole corpus, against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from llm_plain import SMALL, as_sorted, awkward_rows, prose, words
from pyspark.sql import functions as F

from loomgrid.llm import components, decontamination, mixing, recompression, simhash, suffixes, toxicity


def rows_with_repeats(seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    passages = [prose(100 + k, r.randint(20, 90)) for k in range(6)]
    out = []
    for i in range(40):
        out.append((i, " ".join(r.choice([r.choice(passages), prose(1000 * seed + 10 * i + k, r.randint(0, 30))]) for k in range(r.randint(0, 4)))))
    return out + [(40, "aaaa " * 120), (41, "a" * 700), (42, out[3][1]), (43, None), (44, ""), (45, "ab" * 300)]


def plain_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    grams = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, most=3):
    """Least id reachable; every pair is looked at."""
    v = np.array([f for _, f in fps], np.uint64)
    least = [i for i, _ in fps]
    while True:
        before = list(least)
        for k in range(len(v)):
            near = np.flatnonzero(np.bitwise_count(v ^ v[k]) <= most)
            known = [least[x] for x in near if least[x] is not None]
            if known:
                low = min(known)
                for x in near:
                    least[x] = low
        if before == least:
            return least


def test_simhash_groups(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = rows + [(i if i is None else i + 100_000, t) for i, t, *_ in awkward_rows()]
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, plain_groups(fps), strict=True)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert as_sorted(got) == as_sorted(expected)


@pytest.mark.parametrize("more", [(), (0,), (0, 1)])
def test_trie_join_loses_no_link(spark, more, monkeypatch):
    """Crowded subtrees, clusters, and tries with more blocks."""
    monkeypatch.setattr(simhash, "LEAST_SPLIT", 40)
    monkeypatch.setattr(simhash, "MORE_BLOCKS", more)
    r = random.Random(7)
    values = {r.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    center = r.getrandbits(64)
    values |= {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    for v in list(values)[:100]:
        values.add(v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in values)
    star = components.stars(simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    root = {x.a: x.b for x in star}
    fps = [(v, v & ((1 << 64) - 1)) for v in signed]
    assert [root.get(v, v) for v in signed] == plain_groups(fps)


def plain_contamination(docs, items, size=10):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = plain(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    ids |= found
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, awkward, empty):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()] + [r[:2] for r in awkward_rows()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(9001, prose(3, 12)), (9002, "TWO words"), (9003, None), (9004, "..."), (9005, "one"), (9005, "the same line the same line"), (9006, "w1 " * 30), (9007, prose(1, 25))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert as_sorted(got) == as_sorted(plain_contamination(docs, items))
    assert decontamination.contamination(empty, benchmark).collect() == []
    assert decontamination.contamination(awkward, benchmark.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    index = decontamination.Index(spark.createDataFrame([(1, "b x a y c"), (2, "a " + "z " * 40 + "b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    rows = index.proximity(3, 4).join(index.documents(), "row").select("doc_id").distinct().collect()
    assert [r.doc_id for r in rows] == [1]


def plain_drop_words(rows, window):
    text = [words(t) for _, t in rows]
    count = {}
    for w in text:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (doc, _), w in zip(rows, text, strict=True):
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = rows_with_repeats(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_sorted(recompression.drop_repeats(d).collect()) == as_sorted(plain_drop_words(rows, recompression.WINDOW))


def test_recompression_is_consistent():
    """Equal windows hold equal symbols wherever the symbols' surroundings lie inside."""
    a, b, c = (prose(k, 40).encode() for k in (1, 2, 3))
    halves, starts = recompression.word_hashes([a + b" " + b, c + b" " + b + b" " + a])
    x, lo, hi = recompression.symbols(halves[:, 0], starts)
    inside = lambda first: {(int(n), int(s) - first) for n, s, e in zip(x, lo, hi, strict=True) if first <= s and e <= first + 40}
    assert inside(40) == inside(120) and len(inside(40)) > 5
    assert inside(0) == inside(160)


def plain_drop_bytes(rows, window):
    seen, out = set(), []
    for doc, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                gone[i : i + window] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [suffixes.HEAVY, 3])
def test_suffix_dedup(spark, heavy):
    rows = rows_with_repeats(3)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_sorted(suffixes.drop_later_copies(d, heavy=heavy).collect()) == as_sorted(plain_drop_bytes(rows, suffixes.WINDOW))


def test_windows_of_one_hash_are_told_apart():
    body = np.frombuffer(b"aabbaaccbbaa", np.uint8).reshape(-1, 2)
    joined = np.array([False, True, True, False, True, True])
    assert suffixes.equal_to_earlier(np.arange(6), joined, lambda k: body[k]).tolist() == [False, False, True, False, False, False]


def test_anchors_memory():
    data = np.random.default_rng(5).integers(0, 256, 2 * suffixes.STRETCH).astype(np.uint8)
    suffixes.powers(suffixes.STRETCH + suffixes.WINDOW)
    tracemalloc.start()
    suffixes.anchors(data, np.array([0, len(data)]), suffixes.WINDOW, suffixes.GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * suffixes.STRETCH


def test_suffix_order_is_lexicographic():
    data = (b"banana bandana " * 9)[:100]
    text = suffixes.Suffixes(data)
    order = text.order([(i, len(data), i) for i in range(len(data))])
    assert [i for _, _, i in order] == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("operator", [recompression.drop_repeats, suffixes.drop_later_copies, simhash.near_groups, mixing.mix], ids=lambda f: f.__name__)
def test_awkward_rows_and_empty_tables(operator, awkward, empty):
    got = operator(awkward).collect()
    assert len(got) == len(awkward_rows()) and sum(r.doc_id is None for r in got) == 2
    assert operator(empty).collect() == []


def test_awkward_dedup_is_exact(awkward):
    rows = [r[:2] for r in awkward_rows()]
    assert as_sorted(recompression.drop_repeats(awkward).collect()) == as_sorted(plain_drop_words(rows, recompression.WINDOW))
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1]))
    assert as_sorted(suffixes.drop_later_copies(awkward).collect()) == as_sorted(plain_drop_bytes(rows, suffixes.WINDOW))


def test_mix_comes_near_its_targets(spark, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for d in (docs, awkward):
        rows = mixing.mix(d).collect()
        by = {}
        for r, source in [(r, (r.source_size, r.target)) for r in rows]:
            assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
            by.setdefault(source, []).append(r)
        for (size, target), own in by.items():
            assert target <= 3 * size + 1e-6
            assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
        assert as_sorted(rows) == as_sorted(mixing.mix(d).collect())
    assert docs.count() == len(mixing.mix(docs).collect())


def test_pareto_inclusion_follows_size_of_share(spark):
    """Over many salts a document's chance is its source's share."""
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 300 else "y") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 4 for r in got)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    models = toxicity.train(docs, labels.where(inside))
    got = toxicity.score(docs, models).join(labels.where(~inside).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    toxic = [r for r in got if r.truth == 1]
    assert sum(r.toxic == bool(r.truth) for r in got) >= 0.95 * len(got)
    assert sum(r.toxic for r in toxic) >= 0.8 * len(toxic)


def test_toxicity_with_more_labels(spark):
    """Ten times the labels of the test before: nearly all toxic documents are found, and next to no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    models = toxicity.train(docs, labels.where(inside))
    held_out = labels.where(~inside).select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.score(docs.join(held_out.select("doc_id"), "doc_id"), models).join(held_out, "doc_id").collect()
    toxic, clean = ([r for r in got if r.truth == k] for k in (1, 0))
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (8, None, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(awkward, toxicity.train(awkward, labels)).count() == len(awkward_rows())
    assert toxicity.score(empty, toxicity.train(empty, labels)).collect() == []
    assert toxicity.score(awkward, toxicity.train(awkward, labels.where("false"))).where("toxic").count() == 0
