"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over a text's marks; each model also sees the earlier
categories' probabilities. In training those come from models fitted without the document's fold, as they will at use;
each such model also selects its marks without that fold.

Marks are the words, the words' beginnings (so that inflected and compound forms share one), each with how often it
occurs in steps of LEVELS, and the text's shape: its shares of capital words, of words with symbols and of repeats.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, pick, table, tidy_batches, written

#: The models are fitted on at most TRAINING_ROWS labelled documents, their earlier probabilities on FOLDS folds.
TRAINING_ROWS, FOLDS = 8000, 5
#: A model takes the MARKS marks of highest log-likelihood ratio (G2), of at least LEAST_G2; those that weigh less than
#: LEAST_WEIGHT are left out again.
MARKS, LEAST_G2, PENALTY, LEAST_WEIGHT = 512, 6.0, 0.3, 0.1
#: Lengths of words' beginnings, and the numbers of occurrences that make marks of their own.
BEGINNINGS, LEVELS, SHARES = range(3, 7), (1, 2, 4), (0.05, 0.2, 0.5)
#: The chain's order, low quality first, as its signs (shouting, junk) are not toxic by themselves; and how many wrongly
#: rejected documents are as bad as one missed.
CATEGORIES, MISS_WEIGHTS = ("low_quality", "toxic"), (1.0, 10.0)
THRESHOLD = 0.5
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_¡¿"
SYMBOLS = frozenset("<>*#$%&|!")


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _number(start: int, mark: str) -> int:
    """A mark's number; its upper half is that of the first letters, so that words with others are passed by."""
    return (start & 0x7FFFFFFF) << 32 | _crc(mark)


class Marks:
    """Numbers of a text's marks, of all or of the known ones only. Keeps what frequent words give, within a bound."""

    def __init__(self, known: set[int] | None = None, most: int = 200_000):
        self.known, self.most = known, most
        self.starts = None if known is None else {k >> 32 for k in known}
        self.words: dict[str, tuple] = {}
        self.without: set[str] = set()  # words that give nothing
        self.first: dict[str, int] = {}
        self.beginnings: dict[str, tuple] = {}

    def _takes(self, mark: int) -> bool:
        return self.known is None or mark in self.known

    def _of_beginning(self, start: int, beginning: str) -> tuple:
        """(number of occurrences, mark) for each level."""
        found = self.beginnings.get(beginning)
        if found is None:
            found = tuple((level, k) for level in LEVELS if self._takes(k := _number(start, f"{level}^{beginning}")))
            if len(self.beginnings) < self.most:
                self.beginnings[beginning] = found
        return found

    def _of_word(self, raw: str) -> tuple | None:
        """The word's mark or None, its beginnings' marks by level, whether it is in capitals, whether it has symbols."""
        upper, marked = len(raw) > 1 and raw.isupper(), not SYMBOLS.isdisjoint(raw)
        word = raw.lower().strip(STRIP)
        head = word[: BEGINNINGS[0]]
        start = self.first.get(head)
        if start is None:
            start = _crc(head) & 0x7FFFFFFF
            if len(self.first) < self.most:
                self.first[head] = start
        mark, levels = None, ()
        if word and (self.starts is None or start in self.starts):
            if not self._takes(mark := _number(start, f"={word}")):
                mark = None
            levels = tuple([x for n in BEGINNINGS if n <= len(word) and (x := self._of_beginning(start, word[:n]))])
        if mark is None and not levels and not upper and not marked:
            if len(self.without) < self.most:
                self.without.add(raw)
            return None
        found = (mark, levels, upper, marked)
        if len(self.words) < self.most:
            self.words[raw] = found
        return found

    def __call__(self, text: str | None) -> set[int]:
        counts = Counter((text or "").split())
        words, found, n = self.words, set(), counts.total()
        begun: dict[tuple, int] = {}
        capital = symbols = 0
        for raw in counts.keys() - self.without:
            entry = words.get(raw) or self._of_word(raw)
            if entry is None:
                continue
            mark, levels, upper, marked = entry
            times = counts[raw]
            if mark is not None:
                found.add(mark)
            for x in levels:
                begun[x] = begun.get(x, 0) + times
            capital += times * upper
            symbols += times * marked
        for levels, times in begun.items():
            found.update(k for level, k in levels if times >= level)
        for name, share in (("capital", capital), ("symbols", symbols), ("repeats", n - len(counts))):
            for least in SHARES:
                if share and share >= least * n and self._takes(k := _number(0, f"{name}>{least}")):
                    found.add(k)
        return found


@dataclass
class Linear:
    """Logistic regression over presence of marks, and over the earlier categories' probabilities."""

    weights: dict[int, float]
    bias: float
    chain: np.ndarray

    def margin(self, marks: set[int], earlier: np.ndarray) -> float:
        w = self.weights
        return sum(w[k] for k in sorted(marks & w.keys())) + self.bias + float(self.chain @ earlier)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(rows: list[np.ndarray], take: np.ndarray, earlier: np.ndarray, y: np.ndarray, miss_weight: float = 1.0) -> Linear:
    """Newton's steps on the penalised log loss, twice, without the light marks the second time; deterministic.

    rows has each row's marks, take those that the model may use, both sorted. Without positives nothing is positive.
    """
    if not y.any():
        return Linear({}, -35.0, np.zeros(earlier.shape[1]))
    w = _newton(rows, take, earlier, y, miss_weight)
    take = take[np.abs(w[: len(take)]) >= LEAST_WEIGHT]
    w = _newton(rows, take, earlier, y, miss_weight)
    return Linear(dict(zip(take.tolist(), w[: len(take)].tolist(), strict=True)), float(w[-1]), w[len(take) : -1])


def _newton(rows: list[np.ndarray], take: np.ndarray, earlier: np.ndarray, y: np.ndarray, miss_weight: float) -> np.ndarray:
    """Weights of the marks taken, the earlier probabilities and the bias."""
    x = np.zeros((len(y), len(take) + earlier.shape[1] + 1))
    if len(take):
        marks, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(take, marks), len(take) - 1)
        found = take[at] == marks
        x[row[found], at[found]] = 1
    x[:, len(take) : -1] = earlier
    x[:, -1] = 1
    cost = np.where(y > 0, miss_weight, 1.0)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((cost @ y + 0.5) / (cost @ (1 - y) + 0.5))
    penalty = np.full(len(w), PENALTY)
    penalty[-1] = 1e-3
    for _ in range(15):
        p = _sigmoid(x @ w)
        bend = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        bend[np.diag_indices(len(w))] += penalty
        step = np.linalg.solve(bend, x.T @ (cost * (y - p)) - penalty * w)
        longest = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(longest, 1e-12))
        if longest < 1e-2:
            break
    return w


def fit_chain(marks: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, chosen: dict[tuple[int, int], np.ndarray], miss_weights: tuple[float, ...] = MISS_WEIGHTS) -> list[Linear]:
    """One model per category; labels has a column for each, folds a number below FOLDS for each row.

    chosen gives the marks for each category and each fold left out, -1 for none.
    """
    models: list[Linear] = []
    earlier = np.zeros((len(marks), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_linear(marks, chosen[k, -1], earlier, y, miss_weights[k]))
        if k + 1 < labels.shape[1]:
            held_out = np.zeros(len(marks))
            for fold in range(FOLDS):
                inside = np.flatnonzero(folds != fold)
                m = fit_linear([marks[i] for i in inside], chosen[k, fold], earlier[inside], y[inside], miss_weights[k])
                for i in np.flatnonzero(folds == fold):
                    held_out[i] = _sigmoid(m.margin(set(marks[i].tolist()), earlier[i]))
            earlier = np.column_stack([earlier, held_out])
    return models


def probabilities(models: list[Linear], marks: set[int]) -> list[float]:
    out: list[float] = []
    for m in models:
        out.append(float(_sigmoid(m.margin(marks, np.array(out)))))
    return out


def known(models: list[Linear]) -> set[int]:
    return {k for m in models for k in m.weights}


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, fold, y (1 or 0 for each category), marks of at most `rows` labelled documents, those of least hash.

    Each doc_id comes once. The chosen ids are few by that bound and are broadcast; of rows that share one, that of
    least text is taken, before the shuffle where rows meet in a task.
    """
    labels = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    y = F.array((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"), y.alias("y"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch in batches:
            found = [np.sort(np.fromiter(marks(t), np.int64)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", "y")), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fold", "y", "marks"])

    once = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "fold", "y").agg(F.min("text").alias("text"))
    return written(once.mapInArrow(tidy_batches(mark), "doc_id long, fold int, y array<int>, marks array<long>"))


def chosen_marks(sample: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each category and each fold left out (-1: none) the marks that tell positives from negatives best, by G2 of presence."""
    wanted = [(k, fold) for k in range(len(CATEGORIES)) for fold in range(-1, FOLDS if k + 1 < len(CATEGORIES) else 0)]

    def counts(k: int, fold: int) -> tuple[Column, Column]:
        """How many rows outside the fold, and how many positive ones."""
        outside = (F.col("fold") != fold).cast("long")
        return F.sum(outside), F.sum(outside * F.col("y")[k])

    sums = [c.alias(f"{name}{i}") for i, w in enumerate(wanted) for name, c in zip(("both", "pos"), counts(*w), strict=True)]
    total = sample.agg(*sums).first()
    by_mark = written(sample.select("fold", "y", F.explode("marks").alias("mark")).groupBy("mark").agg(*sums, F.count("*").alias("rows")).where("rows >= 2").drop("rows"))

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    best: dict[tuple[int, int], np.ndarray] = {}
    for i, w in enumerate(wanted):
        n, n1 = (F.lit(float(total[f"{c}{i}"] or 0)) for c in ("both", "pos"))
        both, pos = (F.col(f"{c}{i}").cast("double") for c in ("both", "pos"))
        inside = part(pos) + part(both - pos) + part(n1 - pos) + part(n - n1 - both + pos)
        g2 = 2 * (inside - part(both) - part(n - both) - part(n1) - part(n - n1) + part(n))
        rows = by_mark.select("mark", F.round(g2, 6).alias("g2"), both.alias("both")).where((F.col("g2") >= LEAST_G2) & (F.col("both") >= 2))
        best[w] = np.sort(np.array([r.mark for r in rows.orderBy(F.desc("g2"), "mark").limit(MARKS).collect()], np.int64))
    return best


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> list[Linear]:
    """The chain's models. Labels without doc_id, quality or toxic are left out; a doc_id labelled twice counts once.

    Marks are counted and chosen on the executors; of the sample only what the models may use comes to the driver.
    """
    sample = training_sample(id_and_text(docs), labels, rows)
    chosen = chosen_marks(sample)
    some = np.unique(np.concatenate(list(chosen.values())))

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(np.asarray(x.values), some, assume_unique=True) for x in batch.column("marks")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", "y")), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fold", "y", "marks"])

    found = sample.mapInArrow(tidy_batches(use), "doc_id long, fold int, y array<int>, marks array<long>").toArrow().sort_by("doc_id")
    marks = [np.asarray(x.values) for x in found["marks"]]
    return fit_chain(marks, np.array(found["y"].to_pylist()).reshape(-1, len(CATEGORIES)), found["fold"].to_numpy(), chosen)


def score(docs: DataFrame, models: list[Linear], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic for every row of docs.

    Null and empty texts have no marks and get the models' base rates. Rows are independent: repeated rows and null ids
    come out as they are, other columns are not read, an empty table gives an empty result. Where no label is positive,
    as without labels, the probability is nothing, so nothing is toxic.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(known(models))
        for batch in batches:
            p = [probabilities(models, marks(t)) for t in batch.column("text").to_pylist()]
            p = np.array(p).reshape(len(p), len(CATEGORIES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= threshold)], ["doc_id", "p_low_quality", "p_toxic", "toxic"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy_batches(scan), "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
