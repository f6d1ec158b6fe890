"""A quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed words, word pairs and a few figures of the
text; ordered thresholds cut the line into grades: P(grade > k) = sigmoid(x w - t_k). A
document gets its expected grade and the tail probability of the best grades, by which it is
selected.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``, chosen by hash) by
L-BFGS; each step is one Spark job that sums loss and gradient over the sample. The
thresholds are a first one and the logarithms of the steps between them, so they stay ordered.

Defined results: null or empty text has the intercept only; a document with several labels
counts with its worst; labels of unknown documents and null labels don't count; without any
labels every grade is equally likely; repeated rows give equal rows; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.llm.scratch import stored
from volclock.llm.wordhash import LOWER, WordHasher, chunks

GRADES = 3
BITS = 16
FIGURES = 5
#: So many labelled documents at most are fitted on, about.
SAMPLE = 20_000
RIDGE = 3e-6
STEPS = 40
KEEP = 0.5


def dimensions(bits: int = BITS) -> int:
    return (1 << bits) + FIGURES


def features(batch: pa.RecordBatch, column: int, hasher: WordHasher, bits: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: (slice, row, index, value) of all entries; rows count from 0."""
    d = 1 << bits
    for part, texts in chunks(batch, column):
        words = hasher(texts)
        of = words.texts()
        n = np.diff(words.first)
        pairs = words.runs(2)
        inside = of[: len(pairs)] == of[1:] if len(of) > 1 else np.zeros(0, bool)
        where = np.concatenate([of, of[: len(pairs)][inside]])
        at = (np.concatenate([words.hashes, pairs[inside]]) >> np.uint64(64 - bits)).astype(np.int64)
        key, count = np.unique(where * d + at, return_counts=True)
        row, at = key // d, key % d
        value = 1 + np.log(count)
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
        value = value / np.sqrt(norm[row])  # long texts count less for each word, but not as little as at length 1
        lengths = np.bincount(of, (words.ends - words.starts), minlength=len(texts)) / np.maximum(n, 1)
        different = np.bincount(row, minlength=len(texts)) / np.maximum(2 * n - 1, 1)
        mean_count = np.bincount(row, count, minlength=len(texts)) / np.maximum(np.bincount(row, minlength=len(texts)), 1)
        figures = np.stack([np.log1p(n) / 8, lengths / 10, different, np.log1p(mean_count), n == 0], axis=1)
        rows = np.concatenate([row, np.repeat(np.arange(len(texts)), FIGURES)])
        order = np.argsort(rows, kind="stable")
        index = np.concatenate([at, np.tile(np.arange(d, d + FIGURES), len(texts))])
        yield part, rows[order], index[order], np.concatenate([value, figures.ravel()])[order]


def thresholds(free: np.ndarray) -> np.ndarray:
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def tails(z: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 0..number of grades (1 and 0 at the ends)."""
    inner = 0.5 * (1 + np.tanh(0.5 * (z[:, None] - cut)))
    return np.concatenate([np.ones((len(z), 1)), inner, np.zeros((len(z), 1))], axis=1)


def loss_and_gradient(z: np.ndarray, grade: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, its derivative by each z, and by the free thresholds."""
    cut = thresholds(free)
    tail = tails(z, cut)
    rows = np.arange(len(z))
    p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)
    slope = tail * (1 - tail)
    by_z = -(slope[rows, grade] - slope[rows, grade + 1]) / p
    by_cut = np.zeros(len(cut))
    for k in range(len(cut)):
        by_cut[k] = np.sum(np.where(grade == k + 1, slope[:, k + 1] / p, 0) - np.where(grade == k, slope[:, k + 1] / p, 0))
    by_free = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * np.exp(free[k]) for k in range(1, len(cut))]])
    return float(-np.log(p).sum()), by_z, by_free


class Objective:
    """Mean loss over a stored table of sparse rows; one Spark job for each point."""

    def __init__(self, rows: DataFrame, grades: int, bits: int, ridge: float):
        self.rows, self.cuts, self.d, self.ridge = rows, grades - 1, dimensions(bits), ridge
        self.n = rows.count()

    def __call__(self, point: np.ndarray) -> tuple[float, np.ndarray]:
        d, cuts = self.d, self.cuts
        context = self.rows.sparkSession.sparkContext
        sent = context.broadcast(point)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, free = sent.value[:d], sent.value[d:]
            total = np.zeros(1 + d + cuts)
            for batch in batches:
                grade = batch.column(0).to_numpy()
                lists = batch.column(1)
                row = np.repeat(np.arange(len(grade)), np.diff(lists.offsets.to_numpy()))
                index, value = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                z = np.bincount(row, w[index] * value, minlength=len(grade))
                loss, by_z, by_free = loss_and_gradient(z, grade, free)
                total[0] += loss
                total[1 : 1 + d] += np.bincount(index, value * by_z[row], minlength=d)
                total[1 + d :] += by_free
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        # one row for each partition of a bounded table
        parts = self.rows.mapInArrow(run, "part binary").collect()
        sent.destroy()
        total = np.sum([np.frombuffer(r["part"]) for r in parts], axis=0)
        w = point[:d]
        gradient = total[1:] / self.n
        gradient[:d] += self.ridge * w
        return total[0] / self.n + 0.5 * self.ridge * float(w @ w), gradient


def minimised(objective, point: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, gradient = objective(point)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q = gradient.copy()
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        slope = -float(gradient @ q)
        if slope > -1e-10:
            break
        step = 1.0
        while step > 1e-6:
            new = point - step * q
            new_value, new_gradient = objective(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.4
        else:
            break
        s, y = new - point, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        point, value, gradient = new, new_value, new_gradient
        if done:
            break
    return point


def toxic_poor_good(quality: Column, toxic: Column) -> Column:
    """Grades: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def fitted(docs: DataFrame, ratings: DataFrame, grades: int = GRADES, sample: int = SAMPLE, bits: int = BITS, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights and free thresholds from ``ratings`` (doc_id, grade) of ``docs``."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("_grade"))
    n = rated.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about ``sample`` rows of two numbers, whatever the size of the tables
    rated = rated.filter(part * n < sample).withColumnRenamed("doc_id", "_rated")
    chosen = docs.join(F.broadcast(rated), F.col("doc_id") == F.col("_rated")).select("_grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=LOWER)
        for batch in batches:
            for part, row, index, value in features(batch, 1, hasher, bits):
                offsets = pa.array(np.searchsorted(row, np.arange(part.stop - part.start + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *lists], ["grade", "at", "value"])

    rows = chosen.mapInArrow(run, "grade int, at array<int>, value array<double>")
    rows = stored(rows.repartition(8), "quality-sample")
    start = np.zeros(dimensions(bits) + grades - 1)
    start[dimensions(bits)] = -1.0
    objective = Objective(rows, grades, bits, ridge)
    return minimised(objective, start, steps) if objective.n else start


def graded(docs: DataFrame, model: np.ndarray, grades: int = GRADES, bits: int = BITS, keep: float = KEEP) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_probability (of the best grade), kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, d = WordHasher(fold=LOWER), dimensions(bits)
        w, cut = sent.value[:d], thresholds(sent.value[d:])
        for batch in batches:
            for part, row, index, value in features(batch, 1, hasher, bits):
                tail = tails(np.bincount(row, w[index] * value, minlength=part.stop - part.start), cut)
                best = tail[:, grades - 1]
                columns = [batch.column(0)[part], pa.array(tail[:, 1:].sum(axis=1)), pa.array(best), pa.array(best >= keep)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "kept"])

    lean = docs.select(F.col("doc_id").cast("long"), "text")
    return lean.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
