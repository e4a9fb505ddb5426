"""The pipeline's stages on rows without doc_id and rows that share one."""

import weakref

import pytest
from llm_plain import as_sorted, prose

import corpus_pipeline
from loomgrid.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("q1", prose(90, 14))], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], COLUMNS).repartition(3)


def kept(df):
    return as_sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_contamination_is_judged_by_row(spark, folder):
    leak = prose(90, 14)
    clean = [(None, prose(1, 40), "web"), (None, "", "web"), (1, prose(2, 40), "web"), (2, prose(3, 40), "code")]
    leaked = [(None, leak + " end", "web"), (1, "so " + leak, "web"), (3, leak, "code")]
    docs = documents(spark, clean + leaked)
    got = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert got.columns == docs.columns
    assert kept(got) == as_sorted(clean)


def test_mix_takes_rows_and_not_ids(spark, folder):
    """Rows without doc_id and of equal size in several sources: each source comes near its target, and its figures are its own."""
    rows = [(None, prose(k, 10), s) for k, s in enumerate(["books"] * 40 + ["code"] * 40 + ["web"] * 40)]
    got = corpus_pipeline.mix_sources(spark, documents(spark, rows), folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "copies"]
    got = got.collect()
    assert len({r.text for r in got}) == len(got) and all(r.taken == r.copies * r.size for r in got)
    for place, source in enumerate(("books", "code", "web")):
        own = [r for r in got if r.source == source]
        assert {r.target for r in own} == {1200 * (5, 2, 1)[place] / 8}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10


def test_near_copies_are_dropped_by_row(spark, folder):
    """One row of each group stays, also of rows without doc_id; rows that share a doc_id and differ in text are in groups of their own."""
    a, b, c, d = (prose(k, 60) for k in range(4))
    once = [(1, a, "web"), (1, b, "web"), (None, c, "web"), (4, d, "code"), (None, "", "web")]
    copies = [(3, a, "code"), (None, a, "web"), (None, a.upper(), "web"), (2, b, "web"), (None, c, "web"), (4, d, "code"), (None, None, "zine")]
    got = kept(corpus_pipeline.drop_near_copies(spark, documents(spark, once[:4]).unionByName(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in once[4:] + copies], COLUMNS)), folder))
    wordless = [r for r in got if not r[1]]
    assert len(wordless) == 1
    assert as_sorted(r for r in got if r[1]) == as_sorted(once[:4])


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_personal_data, corpus_pipeline.mix_sources], ids=lambda f: f.__name__)
def test_stages_begin_with_garbage_collected(spark, folder, stage):
    docs = documents(spark, [(1, prose(1, 40), "web"), (2, prose(2, 40), "code")])
    before = collections(spark)
    stage(spark, docs, folder)
    assert collections(spark) > before


def test_a_step_leaves_nothing_behind(monkeypatch):
    class Cache(set):
        pass

    left = []

    def step(batches):
        cache = Cache()
        left.append(weakref.ref(cache))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: left.append(left[0]()))
    assert list(common.tidy_batches(step)([1, 2])) == [1, 2]
    assert left[1:] == [None]
