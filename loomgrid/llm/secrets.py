"""Secret scans: patterns, and the guess cost of values in credential contexts.

The guess cost of a value is the least number of bits with which a guesser who knows words, dates, repeats,
sequences, keyboard walks and brute force can write it, found by dynamic programming over its segmentations.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: Wider contexts, whose values count if they are hard to guess.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)["']?\x20*(?:=>|:=|[:=])\x20*(?:bearer\x20|basic\x20)?["']?([^\s"'<>,;`]{8,})""",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "key", "credential", "auth")
#: Values of at least so many bits are reported.
LEAST_BITS = 40.0
#: Longest segment that is matched as a word, walk, repeat or date.
SPAN = 24

WORDS = (
    "the of and in is to for that with this pass password passwd admin root user login secret token test guest demo default changeme change welcome letmein master dragon monkey "
    "qwerty hello world example sample value key apikey none null true false undefined your here public private local localhost server database data service client account "
    "home house love angel summer winter spring autumn monday sunday football baseball soccer hockey shadow sunshine princess flower freedom computer internet "
    "michael jennifer thomas robert daniel jordan george charlie andrew jessica michelle one two three four five six seven eight nine ten red green blue black white "
    "string field name email page file path http https www com org net config setting settings placeholder required optional env process get set"
).split()
_ranks: dict[str, dict[str, int]] = {}


def dictionary(path: str | None = None) -> dict[str, int]:
    """Words by rank: those of credentials and placeholders first, then the whole words of a public tokenizer, most frequent first.

    path is that of a vocabulary in which a word's end is marked by </w> and ids grow as words get rarer.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ranks:
        with open(path, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        whole = sorted((k, w[:-4]) for w, k in ids.items() if w.endswith("</w>"))
        _ranks[path] = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *(w for _, w in whole if len(w) >= 3 and w.isalpha())]))}
    return _ranks[path]


ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
BESIDE: dict[str, set[str]] = {}
for _y, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        BESIDE[_c] = {_r[i] for _r in ROWS[max(0, _y - 1) : _y + 2] for i in (_x - 1, _x, _x + 1) if 0 <= i < len(_r)} - {_c}
#: Whole dates, or years, in digits.
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301$5!7", "aaeoissit")


def _brute(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    return math.log2(26) if c.isalpha() and c.isascii() else math.log2(33)


BRUTE = {chr(i): _brute(chr(i)) for i in range(128)}


def _pattern_bits(kind: str, length: int) -> float:
    """Bits of a keyboard walk or of a sequence of so many signs."""
    return math.log2(47 * 4 if kind == "walk" else 36 * 2) + 2 * math.log2(length)


def _word_bits(cased: str, rank: int, swapped: bool) -> float:
    upper = sum(c.isupper() for c in cased)
    case = 0.0 if not upper else 1.0 if upper in (1, len(cased)) else float(min(upper, len(cased) - upper) * 2)
    return math.log2(rank) + 1 + (1.5 if swapped else 0.0) + case


def _date_bits(length: int) -> float:
    return math.log2(120) + (math.log2(366) + 1 if length > 4 else 0)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of every segment other than brute force, of SPAN signs at most, by its end.

    Words (as they are, or with signs put for letters), dates, keyboard walks, sequences and runs of one sign, of every
    start and every length. Repeats of a group of signs are left to guess_bits, as they cost by the group before them.
    """
    low = value.lower()
    plain, n = low.translate(LEET), len(low)
    walk, steps, same = ([0] * n for _ in range(3))  # how far each goes back from here
    for i in range(1, n):
        a, b = low[i - 1], low[i]
        walk[i] = walk[i - 1] + 1 if b in BESIDE.get(a, ()) else 0
        same[i] = same[i - 1] + 1 if value[i - 1] == value[i] else 0
        d = ord(b) - ord(a)
        steps[i] = (steps[i - 1] + 1 if i > 1 and d == ord(a) - ord(low[i - 2]) else 1) if abs(d) == 1 else 0
    for j in range(1, n + 1):
        for size in range(3, min(SPAN, j) + 1):
            start = j - size
            for text, swapped in ((low, False), (plain, True)):
                if (rank := ranks.get(text[start:j])) is not None:
                    yield start, j, _word_bits(value[start:j], rank, swapped)
            if (size == 4 or 8 <= size <= 10) and DATE.fullmatch(low, start, j):
                yield start, j, _date_bits(size)
            if size <= walk[j - 1] + 1:
                yield start, j, _pattern_bits("walk", size)
            if size <= steps[j - 1] + 1:
                yield start, j, _pattern_bits("steps", size)
            if size <= same[j - 1] + 1:
                yield start, j, BRUTE.get(value[j - 1], 7.0) + math.log2(size)


def repeated(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, middle, end): the signs from middle to end repeat those from start to middle, 2 to 8 of them, once or more."""
    n = len(value)
    for j in range(1, n + 1):
        for unit in range(2, min(8, j // 2) + 1):
            group, at = value[j - unit : j], j - 2 * unit
            while at >= 0 and value[at : at + unit] == group:
                yield at, at + unit, j
                at -= unit
                if j - at > SPAN:
                    break


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """Least bits over all segmentations; linear in the length, as segments other than brute force have a bound.

    A repeat costs two bits and the logarithm of its number of times, beside the group that it repeats, which comes
    directly before it in the segmentation.
    """
    n = len(value)
    if len(value.lower()) != n:  # lower-casing changed the length: nothing but brute force fits
        return sum(BRUTE.get(c, 7.0) for c in value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, end, bits in segments(value, dictionary() if ranks is None else ranks):
        ends.setdefault(end, []).append((start, bits))
    again: dict[int, list[tuple[int, float]]] = {}
    for start, middle, end in repeated(value):
        again.setdefault(end, []).append((middle, 2 + math.log2((end - start) // (middle - start) - 1)))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = min([best[j - 1] + BRUTE.get(value[j - 1], 7.0), *(best[i] + bits for i, bits in (*ends.get(j, ()), *again.get(j, ())))])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), by start, then kind."""
    low = text.lower()
    found = []
    if "token" in low or "passw" in low or "secret" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, int]], least_bits: float = LEAST_BITS, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Values in credential contexts that no base span touches and that are costly to guess."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".:!?)]}&#*%$":
            end -= 1
        if end - start >= 8 and not any(a < end and start < b for a, _, b in base) and guess_bits(text[start:end], ranks) >= least_bits:
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, least_bits: float = LEAST_BITS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans for every row of docs.

    spans lists kind:start:end in code points. Null and empty texts have no spans. Rows are independent: repeated rows
    and null ids come out as they are, other columns are not read, an empty table gives an empty result. path is that of
    the dictionary's vocabulary.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = dictionary(path)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + guessed_spans(text or "", base, least_bits, ranks))
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
