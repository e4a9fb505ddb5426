"""Operators that judge each row by itself, against plain versions."""

import hashlib
import re

import pytest
from llm_plain import SMALL, as_sorted, awkward_rows, words

from loomgrid.llm import pii, quality, secrets, token_counts


@pytest.fixture(scope="module")
def texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [r[:2] for r in awkward_rows()]


@pytest.fixture(scope="module")
def both(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


def test_token_counts_are_the_library_s(both, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
    expected = [(i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(texts, n, strict=True)]
    assert as_sorted(token_counts.count_tokens(both).collect()) == as_sorted(expected)


def test_parts_join_to_the_text_and_keep_counts():
    text = "one  two\n\n three " * 9000 + "'ll it's 12 34" + "z" * 100_000 + " end"
    assert "".join(token_counts.parts(text, 1000)) == text
    enc = token_counts.encoder(token_counts.vocabulary())
    assert token_counts.lengths([text], token_counts.vocabulary()) == [len(enc.encode(text, allowed_special="all"))]


@pytest.mark.parametrize("text", ["漢字、かな。交じり文" * 300, "a1b2c3;d4'e5's f" * 300, "x''s'll y!'s 9's\tz\r\n" * 200, "ab\u00a0cd\u3000ef " * 300])
def test_parts_keep_counts_without_blanks(text):
    enc, path = token_counts.encoder(token_counts.vocabulary()), token_counts.vocabulary()
    for size in (7, 50, 1000):
        cut = list(token_counts.parts(text, size))
        assert "".join(cut) == text and len(cut) > 1
        assert sum(len(enc.encode(p, allowed_special="all")) for p in cut) == token_counts.lengths([text], path)[0]


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    found = [("assign", m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], x[3]))


def test_secret_base_is_that_of_the_patterns(both, texts):
    expected = []
    for i, t in texts:
        f = plain_secrets(t or "")
        expected.append((i, *(sum(x[0] == k for x in f) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in f).encode()).hexdigest()))
    got = secrets.scan_secrets(both).collect()
    assert as_sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got]) == as_sorted(expected)


def test_guess_costs():
    bits = secrets.guess_bits
    assert bits("") == 0
    assert bits("password") < bits("passwprd") < bits("xk4!Qz9&vR2#")
    assert bits("aaaaaaaaaaaaaaaa") < 20 and bits("qwertyuiop") < 25 and bits("2021-04-17") < 25 and bits("abcdefghijkl") < 25
    assert bits("xK9v" * 6) < 2 * bits("xK9v")
    assert bits("Tq7$wZ1!mN5%") >= secrets.LEAST_BITS
    got = secrets.guessed_spans("passphrase: 'Tq7$wZ1!mN5%' pwd=password1234", [])
    assert [k for _, k, _ in got] == [3] and len(got) == 1


def brute_bits(value):
    """The same costs by trying each segmentation's last segment through the public function on shorter strings."""
    return min([secrets.guess_bits(value[:i]) + sum(secrets.BRUTE[c] for c in value[i:]) for i in range(len(value) + 1)])


@pytest.mark.parametrize("value", ["hello2021", "aaab", "qwerty12", "Zx!9passw0rd", "abcabcabc"])
def test_guess_cost_is_a_least_one(value):
    assert secrets.guess_bits(value) <= brute_bits(value) + 1e-9


def all_segmentations(value):
    """The least bits over every segmentation, each segment by itself; words, dates, walks, sequences, runs and repeats are told anew."""
    import math

    ranks, low = secrets.dictionary(), value.lower()
    plain = low.translate(secrets.LEET)
    beside = lambda t: all(b in secrets.BESIDE.get(a, ()) for a, b in zip(t, t[1:]))
    in_steps = lambda t: len({ord(b) - ord(a) for a, b in zip(t, t[1:])}) == 1 and abs(ord(t[1]) - ord(t[0])) == 1

    def costs(i, j):
        yield sum(secrets.BRUTE[c] for c in value[i:j])
        t, size = low[i:j], j - i
        if size < 3:
            return
        upper = sum(c.isupper() for c in value[i:j])
        case = 0 if not upper else 1 if upper in (1, size) else 2 * min(upper, size - upper)
        for text, extra in ((low, 0), (plain, 1.5)):
            if text[i:j] in ranks:
                yield math.log2(ranks[text[i:j]]) + 1 + extra + case
        if re.fullmatch(secrets.DATE, t):
            yield math.log2(120) + (math.log2(366) + 1 if size > 4 else 0)
        if beside(t):
            yield math.log2(188) + 2 * math.log2(size)
        if in_steps(t):
            yield math.log2(72) + 2 * math.log2(size)
        if len(set(value[i:j])) == 1:
            yield secrets.BRUTE[value[i]] + math.log2(size)

    def every(at):
        if at == len(value):
            yield 0.0
        for j in range(at + 1, len(value) + 1):
            for rest in every(j):
                yield min(costs(at, j)) + rest
        for unit in range(2, 9):  # repeats of the group that ends here
            group, times = value[at - unit : at], 1
            while at >= unit and value[at : at + unit * times] == group * times and at + unit * times <= len(value):
                for rest in every(at + unit * times):
                    yield 2 + math.log2(times) + rest
                times += 1

    return min(every(0))


@pytest.mark.parametrize("value", ["12019991231", "1201999123", "aaab1234", "qwer4321x", "abababab", "P4ssw0rd1", "x1999abcd", "abcxyabcxy", "11111999", "poiuytr", "The2001", "zzTop_9"])
def test_guess_cost_is_that_of_all_segmentations(value):
    assert secrets.guess_bits(value) == pytest.approx(all_segmentations(value))


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and plain_luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base_is_that_of_the_patterns(both, texts):
    expected = []
    for i, t in texts:
        f = plain_pii(t or "")
        expected.append((i, *(sum(x[0] == k for x in f) for k in PII), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in f).encode()).hexdigest()))
    got = pii.find_pii(both).collect()
    assert as_sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got]) == as_sorted(expected)
    by_text = {r.doc_id: r.spans for r in got if r.doc_id is not None}
    for i, t in texts:
        if i is not None:
            assert {f"{k}:{a}:{b}" for k, a, b in plain_pii(t or "")} <= set(by_text[i].split(",")) | {""}


def test_field_finds_held_out_segments():
    weights = pii.train(pii.invented(500, seed=11))
    right = wrong = missed = 0
    for zone, spans in pii.invented(300, seed=12):
        lattice = pii.Lattice(zone)
        got = {(kind, *lattice.at(k)) for k, kind in lattice.best(weights)}
        right += len(got & set(spans))
        wrong += len(got - set(spans))
        missed += len(set(spans) - got)
    assert right >= 0.9 * (right + missed) and right >= 0.9 * (right + wrong)


def test_field_s_dynamic_program_is_exact():
    """The best segmentation and the normaliser against all segmentations of a short zone."""
    import numpy as np

    weights = pii.train(pii.invented(60, seed=3), epochs=2)
    lattice = pii.Lattice("a@b.co 10.0.0.1")
    score = lattice.x @ weights.T

    def every(at):
        if at >= lattice.n:
            yield ()
            return
        yield from every(at + 1)
        for k, (i, j) in enumerate(lattice.spans):
            if i == at:
                for kind in range(4):
                    for rest in every(j):
                        yield ((k, kind), *rest)

    all_of = list(every(0))
    total = [sum(score[k, t] for k, t in s) for s in all_of]
    best = lattice.best(weights)
    assert sum(score[k, t] for k, t in best) == pytest.approx(max(total))
    z = np.logaddexp.reduce(total)
    p = np.zeros(score.shape)
    for s, x in zip(all_of, total, strict=True):
        for k, t in s:
            p[k, t] += np.exp(x - z)
    assert np.allclose(p, lattice.marginals(weights))


@pytest.mark.parametrize("sep", [" ", ",", ";"])
def test_field_sees_whole_zones(sep):
    """A segment is found wherever it lies in a long zone, and once: in a single-spaced list and in text without blanks."""
    weights = pii.train(pii.invented())
    for start in range(pii.ZONE_CHARS - 16, pii.ZONE_CHARS + 3):
        before = "a" * (start % 4) + ("ab1" + sep) * (start // 4)
        text = before + "(555) 123-4567" + (sep + "ab1") * 70
        assert pii.spans_of(text, weights)[1] == [(3, len(before), len(before) + 14)], start
        assert pii.masked(text, weights) == before + "<PHONE>" + (sep + "ab1") * 70


def test_masking():
    weights = pii.train(pii.invented(60, seed=3), epochs=2)
    assert pii.masked(None, weights) is None and pii.masked("", weights) == ""
    assert pii.masked("to jane@example.com now", weights) == "to <EMAIL> now"


def plain_quality(text):
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base(both, texts, spark):
    trusted = spark.createDataFrame([(i,) for i in (5, 7, 10)], "doc_id long")
    got = quality.judge(both, trusted).collect()
    assert as_sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == as_sorted([(i, *plain_quality(t)) for i, t in texts])
    assert not any(r.kept and r.base_failed for r in got)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got if r.score is not None and abs(r.score - quality.THRESHOLD) > 1e-6)


def test_quality_score_is_the_mean_log_ratio(spark):
    """Two texts over few words: the score by hand."""
    import math

    docs = spark.createDataFrame([(1, "good good fine"), (2, "bad good")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.judge(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    b = quality.BUCKETS
    raw, target = {"good": 3, "fine": 1, "bad": 1}, {"good": 2, "fine": 1}
    raw_pairs, target_pairs = {"gg": 1, "gf": 1, "f": 1, "bg": 1, "g": 1}, {"gg": 1, "gf": 1, "f": 1}
    ratio = lambda k, t, r: math.log((t.get(k, 0) + 1) / (sum(t.values()) + b)) - math.log((r[k] + 1) / (sum(r.values()) + b))
    one = [ratio(k, target, raw) for k in ("good", "good", "fine")] + [ratio(k, target_pairs, raw_pairs) for k in ("gg", "gf", "f")]
    two = [ratio(k, target, raw) for k in ("bad", "good")] + [ratio(k, target_pairs, raw_pairs) for k in ("bg", "g")]
    assert got[1] == pytest.approx(sum(one) / 6, abs=1e-5) and got[2] == pytest.approx(sum(two) / 4, abs=1e-5)


@pytest.mark.parametrize("operator", [token_counts.count_tokens, secrets.scan_secrets, pii.find_pii], ids=lambda f: f.__name__)
def test_awkward_rows_and_empty_tables(operator, awkward, empty):
    got = operator(awkward).collect()
    assert len(got) == len(awkward_rows()) and sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 3
    assert operator(empty).collect() == []


def test_quality_of_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(None,), (7,), (7,)], "doc_id long")
    assert quality.judge(awkward, labels).count() == len(awkward_rows())
    assert quality.judge(empty, labels).collect() == []
    assert quality.judge(awkward, labels.where("false")).where("score <> 0").count() == 0
