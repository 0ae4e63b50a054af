"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Words are lower-cased and bounded by blanks; every n-gram of 3 to 6 bytes that begins in the text falls into one of 2^18
hash cells. Fitting takes three passes over a bounded sample of the labelled rows:

1. per class, the number of documents that have each cell (dense counts, summed per task and then over tasks);
2. the log-count ratio r = log((p + a) / |p|) - log((q + a) / |q|) of each cell. Cells that are rare, or whose ratio is
   within the range that chance gives, get no weight; all others get one;
3. a logistic regression with ridge penalty on the scaled features r * log(1 + count), fitted by Newton's method, whose steps
   come from conjugate gradients over the sparse rows: memory goes with the non-zero counts, not with rows times cells.

A text's score is the logistic of the bias and the weights of its cells: one gather a position, vectorised over the whole
text, with no limit of length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CELLS_LOG2 = 18
CELLS = 1 << CELLS_LOG2
LENGTHS = (3, 4, 5, 6)
#: Labelled rows of the sample at most; documents carry some kB each, so that a fit reads some tens of MB of text.
SAMPLE_ROWS = 16_000
LEAST_DOCUMENTS = 3
#: Size of a cell's log-count ratio against its error at least: what the largest of so many errors reaches by chance.
LEAST_EVIDENCE = math.sqrt(2 * math.log(CELLS))
#: Ridge penalty of the regression.
PENALTY = 1.0
#: Tasks that count a sample; each gives a row for each of its cells. The scan that finds the sample has its own tasks.
COUNTING_TASKS = 8
THRESHOLD = 0.7
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - CELLS_LOG2)

#: Every ASCII character but letters and digits becomes a blank and letters become small; bytes of other characters stay.
_FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


def cells_of(text: str) -> np.ndarray:
    """The cell of each n-gram of a text, longest texts included, repeats included."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]
    blank = raw == 32
    keep = ~(blank[1:] & blank[:-1])  # runs of blanks count as one
    raw = np.concatenate([raw[:1], raw[1:][keep]]).astype(np.uint64)
    found = []
    value = raw
    for n in range(2, LENGTHS[-1] + 1):
        if len(raw) < n:
            break
        value = (value[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :]
        if n in LENGTHS:
            found.append((((value + np.uint64(n << 56)) * _ODD) >> _SHIFT).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


def counts_of(text: str, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's weighted cells, ascending, and log(1 + count) of each."""
    at = slot[cells_of(text)]
    places, counts = np.unique(at[at >= 0], return_counts=True)
    return places, np.log1p(counts)


@dataclass
class Model:
    cells: np.ndarray  # int32, ascending
    weights: np.ndarray  # float64, the log-count ratio times the fitted coefficient
    bias: float

    def slots(self) -> np.ndarray:
        """The place of each cell's weight, -1 for cells without one."""
        slot = np.full(CELLS, -1, dtype=np.int32)
        slot[self.cells] = np.arange(len(self.cells), dtype=np.int32)
        return slot

    def score(self, texts: list[str]) -> np.ndarray:
        slot = self.slots()
        return np.array([self.score_one(t, slot) for t in texts])

    def score_one(self, text: str, slot: np.ndarray) -> float:
        places, x = counts_of(text, slot)
        z = self.bias + float(x @ self.weights[places])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, CELLS), dtype=np.int32), np.zeros(2, dtype=np.int64)
    for batch in common.in_slices(batches):
        for text, label in zip(common.texts_of(batch), batch.column("label").to_pylist(), strict=True):
            counts[label, np.unique(cells_of(text))] += 1
            rows[label] += 1
    if rows.sum():
        for label in (0, 1):
            at = np.flatnonzero(counts[label])
            yield pa.RecordBatch.from_pydict(
                {"label": np.full(len(at) + 1, label, np.int32), "cell": np.append(at, -1).astype(np.int32), "n": np.append(counts[label, at], rows[label]).astype(np.int64)}
            )


def log_count_ratios(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r of each cell, and its size against the error that chance gives it."""
    p, q = counts[1] + 1.0, counts[0] + 1.0
    r = np.log(p / (rows[1] + 2)) - np.log(q / (rows[0] + 2))
    return r, np.abs(r) / np.sqrt(1 / p + 1 / q)


class Sparse:
    """A matrix of single-precision entries sorted by row, and again by column, for products with vectors from either side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, x: np.ndarray, rows: int, columns: int):
        by_column = np.argsort(column, kind="stable")
        self.x, self.column, self.row_of = x.astype(np.float32), column.astype(np.int32), row[by_column].astype(np.int32)
        self.xt = self.x[by_column]
        self.rows, self.columns = np.bincount(row, minlength=rows), np.bincount(column, minlength=columns)

    @staticmethod
    def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(self.x * v.astype(np.float32)[self.column], self.rows)

    def back(self, u: np.ndarray, squared: bool = False) -> np.ndarray:
        values = self.xt * self.xt if squared else self.xt
        return self._sums(values * u.astype(np.float32)[self.row_of], self.columns)


def ridge_logistic(m: Sparse, y: np.ndarray, penalty: float = PENALTY, turns: int = 30, steps: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients and bias of a logistic regression; the bias isn't penalised.

    Newton's method. Each step solves its linear equations by conjugate gradients, preconditioned by their diagonal, only as
    exactly as the gradient is still large.
    """
    n = len(y)
    w = np.zeros(len(m.columns) + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    ridge = np.append(np.full(len(m.columns), penalty), 1e-6)
    times = lambda v: m.times(v[:-1]) + v[-1]
    back = lambda u, squared=False: np.append(m.back(u, squared), u.sum())
    loss = lambda z, v: float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * v * v).sum())
    z = times(w)
    best, first = loss(z, w), 0.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        h = p * (1 - p)
        rest = -(back(p - y) + ridge * w)
        left = float(np.linalg.norm(rest))
        first = first or left
        if left <= 1e-5 * first:
            break
        scale = 1 / (back(h, squared=True) + ridge)
        step, dz = np.zeros_like(w), np.zeros(n)
        along = scale * rest
        size = begun = rest @ along
        for _ in range(steps):
            ahead = times(along)
            image = back(h * ahead) + ridge * along
            by = size / (along @ image)
            step, dz, rest = step + by * along, dz + by * ahead, rest - by * image
            new = rest @ (scale * rest)
            if new <= min(0.01, left / first) * begun:
                break
            along = scale * rest + new / size * along
            size = new
        part, now = 1.0, loss(z + dz, w + step)
        while now > best and part > 1e-4:
            part /= 2
            now = loss(z + part * dz, w + part * step)
        if now >= best:
            break
        w, z, best = w + part * step, z + part * dz, now
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled rows, those with the smallest hash of their id; null labels don't count.

    An id that is labelled more than once has its greatest label; a document that comes more than once is learned from as often.
    ``labels`` holds the rows one may learn from. The chosen ids are broadcast: there are ``rows`` of them at most.
    """
    chosen = (
        labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
        .filter(F.col("label").isin(0, 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labels`` (doc_id, the label column), all of which may be learned from.

    The first pass gives one row for each cell and class; the second gives each sampled row's counts of the weighted cells.
    Both are bounded by CELLS and SAMPLE_ROWS. Without labels of both classes the model scores every text with
    the share of its only class, 0 if there is none.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    # the scan runs in as many tasks as it has; only the bounded sample is dealt anew
    sample = common.staged(labelled_sample(docs, labels, column, rows).repartition(COUNTING_TASKS, "doc_id"), "toxicity-sample")
    summed = sample.mapInArrow(_document_counts, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    rows_of = {r.label: r.n for r in summed.filter("cell = -1").collect()}
    total = np.array([rows_of.get(0, 0), rows_of.get(1, 0)])
    if not total[0] or not total[1]:
        return Model(np.zeros(0, np.int32), np.zeros(0), 30.0 if total[1] else -30.0)
    both = (
        summed.filter("cell >= 0").groupBy("cell")
        .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
        .filter(F.col("p") + F.col("q") >= LEAST_DOCUMENTS)
    )
    p, q = F.col("p") + 1.0, F.col("q") + 1.0
    ratio = F.log(p / float(total[1] + 2)) - F.log(q / float(total[0] + 2))
    evidence = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    weighted = both.select("cell", ratio.alias("r")).filter(evidence >= LEAST_EVIDENCE).collect()  # CELLS rows at most
    weighted.sort(key=lambda w: w.cell)
    cells, r = np.array([w.cell for w in weighted], dtype=np.int32), np.array([w.r for w in weighted], dtype=np.float64)
    if not len(cells):
        return Model(cells, np.zeros(0), float(np.log(total[1] / total[0])))
    blank = Model(cells, r, 0.0)

    def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = blank.slots()
        for batch in common.in_slices(batches):
            labels, at, values = batch.column("label").to_pylist(), [], []
            for text in common.texts_of(batch):
                places, x = counts_of(text, slot)
                at.append(places.astype(np.int32))
                values.append(x.astype(np.float32))
            yield pa.RecordBatch.from_pydict({
                "label": pa.array(labels, pa.int32()),
                "at": pa.array([a.tobytes() for a in at], pa.binary()),
                "x": pa.array([v.tobytes() for v in values], pa.binary()),
            })

    got = sample.mapInArrow(_features, "label int, at binary, x binary").collect()
    got.sort(key=lambda g: (g.label, bytes(g.at), bytes(g.x)))  # the fit doesn't hang on the order of tasks
    sizes, y = [len(g.at) // 4 for g in got], np.array([g.label for g in got], dtype=np.float64)
    column = np.frombuffer(b"".join(g.at for g in got), np.int32)
    x = np.frombuffer(b"".join(g.x for g in got), np.float32) * r[column].astype(np.float32)
    del got
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    w, bias = ridge_logistic(Sparse(row, column, x, len(y), len(cells)), y)
    return Model(cells, w * r, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null and empty texts get the score of the bias. Extra columns of ``docs`` are ignored."""
    common.prepare(docs.sparkSession)

    def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = model.slots()
        for batch in common.in_slices(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "score": pa.array([model.score_one(t, slot) for t in common.texts_of(batch)], pa.float64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learned from labels outside the held-out fold.

    Repeated rows give repeated rows, an empty table none; null ids are scored like any other.
    """
    model = fit(docs, labels.filter(common.fold(folds) != held))
    return score(docs, model).select("doc_id", (common.fold(folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, in one pass over the texts."""
    model = fit(docs, labels.filter(common.fold(3) != 1))
    common.prepare(docs.sparkSession)

    def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = model.slots()
        for batch in common.in_slices(batches):
            keep = [model.score_one(t, slot) < THRESHOLD for t in common.texts_of(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(_keep, docs.schema)
