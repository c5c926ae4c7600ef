"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import ALNUM, SPACE, chunks, hash_runs, rows_of, utf8
from cohortforge.llm.shared import small_batches

#: Words are hashed to so many rows, so the vectors have one size however large the corpus is.
BUCKETS = 1 << 15
DIMS = 32
NONZERO = 4
WINDOW = 2

#: Most labelled rows that the network is fitted on (those of the least hash of doc_id).
MAX_TRAIN_ROWS = 20_000

_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[ALNUM] = 1
_CLASS[48:58] = 2
_CLASS[SPACE] = 0


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of the tokens: runs of letters, of digits, and of other marks, as they are written."""
    kind = _CLASS[data]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[[0, n]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    return (hash_runs(data, starts, ends) >> np.uint64(49)).astype(np.int64), rows_of(starts, offs)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the few non-zero entries of each bucket's sparse random index vector."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return at.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), size=(BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vector of each bucket: the sum of the index vectors of all neighbours in all texts.

    Sums are whole numbers, so the result does not depend on the order of addition.
    Spark adds them up; the driver gets BUCKETS rows of DIMS sums.  Vectors are
    centred on the mean and scaled to length one.
    """
    small_batches(docs.sparkSession)
    columns = [f"v{i}" for i in range(DIMS)]

    def run(batches):
        at, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in chunks(batches, 1 << 20):
            word, row = tokens(*utf8(batch.column("text")))
            for step in range(1, WINDOW + 1):
                near = row[step:] == row[:-step]
                a, b = word[:-step][near], word[step:][near]
                for one, other in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        total += np.bincount(one * DIMS + at[other, k], weights=sign[other, k], minlength=BUCKETS * DIMS)
        total = total.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[used, i])) for i in range(DIMS))], ["bucket", *columns])

    sums = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    table = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    vectors = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    if len(table):
        raw = np.stack([table.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        raw -= raw.mean(axis=0)
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        vectors[table.column("bucket").to_numpy()] = raw
    return vectors


FEATURES = 2 * DIMS + 2


def pooled(text, vectors: np.ndarray) -> np.ndarray:
    """Pooled vector of each whole text of a column: mean, spread, log of the length, how far neighbours differ."""
    word, row = tokens(*utf8(text))
    n = np.bincount(row, minlength=len(text))
    out = np.zeros((len(text), FEATURES))
    some = n > 0
    if some.any():
        starts = (np.cumsum(n) - n)[some]
        each = vectors[word]
        mean = np.add.reduceat(each, starts, axis=0) / n[some][:, None]
        square = np.add.reduceat(each * each, starts, axis=0) / n[some][:, None]
        out[some, :DIMS] = mean
        out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -2] = np.log1p(n[some]) / 8
        near = row[1:] == row[:-1]
        apart = (np.square(each[1:] - each[:-1]).sum(axis=1) * near).astype(np.float64)
        out[:, -1] = np.bincount(row[1:], weights=apart, minlength=len(n)) / np.maximum(n - 1, 1)
    return out


class Network:
    """Two layers (tanh, logistic), fitted with Adam, then one temperature fitted on rows set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside[:] = False
        fit_x, fit_y = x[~aside], y[~aside]
        self.mean, self.scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6
        self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0
        first, second, step, best, kept = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0, np.inf, None
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 256)):
                step += 1
                z = (fit_x[rows] - self.mean) / self.scale
                h = np.tanh(z @ self.weights[0] + self.weights[1])
                d = 1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3]))) - fit_y[rows]
                d /= len(rows)
                dh = d[:, None] * self.weights[2] * (1 - h * h)
                for i, g in enumerate([z.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]):
                    g = g + decay * self.weights[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            if aside.any():
                loss = self._loss(self.logits(x[aside]), y[aside])
                if loss < best:
                    best, kept = loss, list(self.weights)
        if kept:
            self.weights = kept
            z = self.logits(x[aside])
            grid = np.exp(np.linspace(-2, 2, 161))
            self.temperature = float(grid[np.argmin([self._loss(z / t, y[aside]) for t in grid])])

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Scorer:
    """Word vectors and network, as every task holds them; without a network, one constant score."""

    def __init__(self, vectors: np.ndarray, network: Network | None, constant: float = 0.5):
        self.vectors, self.network, self.constant = vectors, network, constant

    def scores(self, text) -> np.ndarray:
        if self.network is None:
            return np.full(len(text), self.constant)
        return self.network.scores(pooled(text, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_train_rows: int = MAX_TRAIN_ROWS) -> Scorer:
    """Word vectors from all texts, the network from labelled rows where ``train``, a condition on doc_id, holds.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are ignored; of
    repeated ids the least label counts).  At most ``max_train_rows`` of them are
    used.  With no labelled text every score is 0.5; with one label only, its
    smoothed share of one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors = word_vectors(docs)
    held = spark.sparkContext.broadcast(vectors)
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)

    def run(batches):
        for batch in chunks(batches, 1 << 20):
            values = pa.array(pooled(batch.column("text"), held.value).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(values, FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "y", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted), "doc_id").mapInArrow(run, "doc_id long, y int, features array<float>")  # at most max_train_rows ids
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_train_rows).toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return Scorer(vectors, None, float((y.sum() + 1) / (len(y) + 2)))
    x = np.array(sample.column("features").combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(y), FEATURES)
    return Scorer(vectors, Network(x, y))


def score_quality(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document, from its whole text alone.

    Null and empty texts have the zero vector.  A row without a doc_id and rows that
    repeat have a row each, equal texts equal scores; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns whatever their names, whose score reaches ``threshold``; one pass, no shuffle.

    Rows without an id or a text, and repeated rows, are judged by their texts like any other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in chunks(batches, 1 << 20):
            yield batch.filter(pa.array(held.value.scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
