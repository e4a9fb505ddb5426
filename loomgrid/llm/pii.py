"""Personal data: patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments of a zone (a stretch of chunks with digits or an @) for each type, and a
dynamic program over segments of bounded length chooses boundaries and types together. It is trained on zones of the
corpus that the patterns label, on variants of them, and on made-up ones; its posterior gates what is added.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, tidy_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]+")

#: Pieces of zones taken for training, their longest length, and the longest segment in tokens.
TRAINING_ZONES, ZONE_CHARS, SEGMENT_TOKENS = 1500, 240, 24
#: A segment is added if the field gives it at least this probability.
LEAST_POSTERIOR = 0.9


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    found = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = DIGITS.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return found


# The field.

ZONE = re.compile(r"(?<!\S)(?:\S*[0-9@]\S*)(?:[ ]\S*[0-9@]\S*)*")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
N_FEATURES = 23


def _could_hold(zone: str) -> bool:
    """Whether a segment of the zone can be a candidate."""
    return "@" in zone or sum(c.isdigit() for c in zone) >= 7 or zone.count(".") >= 3


def zones(text: str) -> Iterator[tuple[int, str]]:
    """Stretches of neighbouring chunks that hold a digit or an @, whole."""
    if "@" not in text and not DIGIT.search(text):
        return
    for m in ZONE.finditer(text):
        if _could_hold(m[0]):
            yield m.start(), m[0]


def pieces(text: str) -> Iterator[str]:
    """The zones cut into pieces of bounded length: what the training sample is taken from."""
    for _, zone in zones(text):
        for start in range(0, len(zone), ZONE_CHARS):
            if _could_hold(piece := zone[start : start + ZONE_CHARS]):
                yield piece


def features(zone: str, start: int, end: int) -> list[float]:
    s = zone[start:end]
    digits = DIGITS.sub("", s)
    n = len(digits)
    left, right = zone[start - 1 : start], zone[end : end + 1]
    letters = any(c.isalpha() for c in s)
    number = not letters and "@" not in s
    parts = s.split(".")
    ip = number and len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    at = s.count("@") == 1
    name, _, host = s.partition("@")
    seps = {c for c in s if not c.isalnum()}
    return [
        1.0,
        float(at and bool(name) and all(c in LOCAL for c in name)),
        float(at and bool(DOMAIN.fullmatch(host))),
        float(at and bool(re.search(r"\.[A-Za-z]{2,}$", host))),
        float(ip),
        float(ip and all(map(_small, parts))),
        float(number and 13 <= n <= 19),
        float(number and 13 <= n <= 19 and luhn(digits)),
        float(number and 9 <= n <= 15 and s[:1] == "+"),
        float(number and n in (10, 11) and s[:1] != "+"),
        float(bool(re.fullmatch(r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}", s))),
        float(number and seps <= {" ", "-"}),
        float(number and not seps),
        float(number and n < 9),
        float(letters),
        float(letters and "@" not in s),
        float(left.isalnum() or left in ("+", "@", "_") if left else False),
        float(right.isalnum() or right in ("@", "_") if right else False),
        float(bool(re.search(r"[.-]$", left)) and bool(re.search(r"[0-9][.-]$", zone[max(0, start - 2) : start]))),
        float(bool(re.match(r"[.-]?[0-9]", zone[end : end + 2]))),
        float(at and bool(re.match(r"[.-][A-Za-z0-9]", zone[end : end + 2]))),
        float(at and bool(re.search(r"[A-Za-z0-9][._%+-]$", zone[max(0, start - 2) : start]))),
        float(number and bool(re.match(r"[ ()-]{1,2}[0-9]", zone[end : end + 3]))),
    ]


class Lattice:
    """The candidate segments of a zone; every token may also stand outside."""

    def __init__(self, zone: str):
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(zone)]
        self.n, self.tokens = len(tokens), tokens
        # The features are all 0 or 1; long zones have many rows.
        spans, rows = [], bytearray()
        for i, (a, _) in enumerate(tokens):
            if not (zone[a].isalnum() or zone[a] in "+(") or (i and zone[a].isalnum() and zone[tokens[i - 1][0]].isalnum()):
                continue
            for j in range(i + 1, min(self.n, i + SEGMENT_TOKENS) + 1):
                b = tokens[j - 1][1]
                s = zone[a:b]
                if not s[-1].isalnum() or (j < self.n and zone[tokens[j][0]].isalnum()) or "  " in s:
                    continue
                if "@" in s or sum(c.isdigit() for c in s) >= 7 or s.count(".") == 3:
                    spans.append((i, j))
                    rows += bytes(map(int, features(zone, a, b)))
        self.spans = spans
        self.x = np.frombuffer(rows, np.uint8).reshape(len(spans), N_FEATURES)

    def at(self, k: int) -> tuple[int, int]:
        i, j = self.spans[k]
        return self.tokens[i][0], self.tokens[j - 1][1]

    def marginals(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each candidate with each type, by the forward and backward sums over segmentations."""
        score = np.minimum(self.x @ weights.T, 60.0)
        total = np.logaddexp.reduce(score, axis=1) if len(self.spans) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, j) in enumerate(self.spans):
            ends[j].append(k)
            starts[i].append(k)
        f, b = [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        for j in range(1, self.n + 1):
            v = f[j - 1]
            for k in ends[j]:
                v = np.logaddexp(v, f[self.spans[k][0]] + total[k])
            f[j] = v
        for i in range(self.n - 1, -1, -1):
            v = b[i + 1]
            for k in starts[i]:
                v = np.logaddexp(v, b[self.spans[k][1]] + total[k])
            b[i] = v
        outer = np.array([f[i] + b[j] - f[self.n] for i, j in self.spans])
        return np.exp(outer[:, None] + score) if len(self.spans) else np.zeros((0, len(KINDS)))

    def best(self, weights: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, type) of the best segmentation."""
        score = self.x @ weights.T if len(self.spans) else np.zeros((0, len(KINDS)))
        kind = score.argmax(axis=1) if len(self.spans) else []
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.spans):
            ends[j].append(k)
        v, came = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            v[j] = v[j - 1]
            for k in ends[j]:
                if (x := v[self.spans[k][0]] + score[k, kind[k]]) > v[j]:
                    v[j], came[j] = x, k
        out, j = [], self.n
        while j > 0:
            if came[j] < 0:
                j -= 1
            else:
                out.append((came[j], int(kind[came[j]])))
                j = self.spans[came[j]][0]
        return out[::-1]


def invented(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Zones with known segments: every type in several shapes, and numbers that are none of them."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeinorstl") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    made = [
        lambda: (0, f"{w()}{r.choice(['', '.', '_'])}{d(2)}@{w()}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}"),
        lambda: (1, ".".join(str(r.randint(0, 255)) for _ in range(4))),
        lambda: (2, card()),
        lambda: (3, r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])),
        lambda: (None, r.choice([d(r.randint(1, 12)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"{r.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", d(16), f"{d(3)} {d(5)}", f"v{d(1)}.{d(1)}.{d(1)}.{d(1)}-{w()}", f"@{w()}", f"{d(2)}:{d(2)}:{d(2)}"])),
    ]
    out = []
    for i in range(n):
        kind, s = made[i % len(made)]()
        before, after = r.choice(["", "", w() + ":", "(", "<"]), r.choice(["", "", ".", ",", "###", ")"])
        if kind is None and s.isdigit() and len(s) == 16 and luhn(s):
            continue
        out.append((before + s + after, [] if kind is None else [(kind, len(before), len(before) + len(s))]))
    return out


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 12, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Weights by type and feature that make the labelled segmentations likely: stochastic ascent, deterministic order."""
    weights, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    weights[:, 0] = -4.0
    lattices = []
    for zone, spans in labelled:
        lattice = Lattice(zone)
        gold = np.zeros((len(lattice.spans), len(KINDS)))
        for k in range(len(lattice.spans)):
            a, b = lattice.at(k)
            for kind in range(len(KINDS)):
                gold[k, kind] = (kind, a, b) in spans
        if lattice.spans:
            lattices.append((lattice, gold))
    order = random.Random(3)
    for _ in range(epochs):
        order.shuffle(lattices)
        for lattice, gold in lattices:
            step = (gold - lattice.marginals(weights)).T @ lattice.x - penalty * weights
            seen += step * step
            weights += rate * step / np.sqrt(seen)
    return weights


def without_overlaps(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The pattern labels of a zone, of two that overlap the longer."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], s)):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in kept):
            kept.append(s)
    return kept


def labelled_zones(docs: DataFrame, limit: int = TRAINING_ZONES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `limit` pieces of zones, those of least hash: the classifier's training sample."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [z for text in batch.column("text").to_pylist() if text for z in pieces(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["zone"])

    rows = docs.select("text").mapInArrow(tidy_batches(take), "zone string").groupBy("zone").count().orderBy(F.xxhash64("zone"), "zone").limit(limit).collect()
    return [(r.zone, without_overlaps(base_spans(r.zone))) for r in rows]


def fit(docs: DataFrame, text_col: str = "text", limit: int = TRAINING_ZONES) -> np.ndarray:
    return train(labelled_zones(docs.select(F.col(text_col).alias("text")), limit) + invented())


def spans_of(text: str, weights: np.ndarray, least: float = LEAST_POSTERIOR) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: base ones and those that the field adds where no base one lies."""
    base = base_spans(text)
    added = []
    for offset, zone in zones(text):
        lattice = Lattice(zone)
        chosen = lattice.best(weights)
        if not chosen:
            continue
        fresh = []
        for k, kind in chosen:
            a, b = lattice.at(k)
            a, b = a + offset, b + offset
            if all(b <= x or y <= a for _, x, y in base):
                fresh.append((k, kind, a, b))
        if fresh:
            p = lattice.marginals(weights)
            added += [(kind, a, b) for k, kind, a, b in fresh if p[k, kind] >= least]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans for every row of docs.

    spans lists kind:start:end in code points, by kind, then start. Null and empty texts have none. Rows are
    independent: repeated rows and null ids come out as they are, other columns are not read, an empty table gives an
    empty result (the field is then trained on invented zones alone). The field sees whole zones; only its training
    sample is of pieces of them.
    """
    d = id_and_text(docs, id_col, text_col)
    weights = fit(d) if weights is None else weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = spans_of(text or "", weights)
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return d.mapInArrow(tidy_batches(scan), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every found span replaced by its type's name; None stays None."""
    if not text:
        return text
    spans = sorted(spans_of(text, weights)[1], key=lambda s: (s[1], -s[2]))
    out, last = [], 0
    for kind, a, b in spans:
        if b <= last:
            continue
        out += [text[last : max(a, last)], f"<{KINDS[kind].upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
