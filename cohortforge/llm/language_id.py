"""Language ID: error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import LOWER, chunks, utf8
from cohortforge.llm.shared import materialise, small_batches

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 64

#: Letters (and all bytes of non-ASCII characters) in lower case; any other byte becomes a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = LOWER[97:123]
_FOLD[65:91] = LOWER[65:91]
_FOLD[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text, and the start of each text's share (n + 1).

    The third value is the row of each gram.  A text stands between two spaces, so that
    a single letter has a gram too.  Grams that hold two spaces side by side are left
    out, and with them all that cross texts.
    """
    offs = np.asarray(offs)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    low = np.full(len(data) + 2 * (len(offs) - 1), 32, dtype=np.uint32)
    low[np.arange(len(data)) + 2 * rows + 1] = _FOLD[data]
    offs = offs + 2 * np.arange(len(offs))
    if len(low) < 3:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(len(offs), np.int64), empty
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    space = low == 32
    at = np.flatnonzero(~((space[:-2] & space[1:-1]) | (space[1:-1] & space[2:])))
    share = np.searchsorted(at, offs)
    return code[at].astype(np.int64), share, np.repeat(np.arange(len(offs) - 1), np.diff(share))


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language, for any number of them.

    Up to seven languages: the exhaustive code, all ways to part them in two.  More:
    15 log2(n) balanced columns, 63 at least, drawn with a fixed seed; of several draws
    the one of the largest least distance.
    """
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        columns = [[1 if i == 0 or i in s else -1 for i in range(n)] for k in range(n - 1) for s in combinations(range(1, n), k)]
        return np.array(columns, dtype=np.int8).T
    rng = np.random.default_rng(7)
    bits = max(63, math.ceil(15 * math.log2(n)))
    best, far = None, -1.0
    for _ in range(50 if n <= 256 else 4):
        code = np.stack([rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)) for _ in range(bits)], axis=1).astype(np.int8)
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        gap = (bits - float(alike.max())) / 2
        if gap > far:
            best, far = code, gap
    return best


class Model:
    """One linear n-gram classifier per bit of the codewords."""

    def __init__(self, languages: list[str], code: np.ndarray, plus: np.ndarray, minus: np.ndarray):
        """``plus`` and ``minus``: mean rate of each bucket (rows) in the languages on either side of each bit (columns)."""
        self.languages, self.code = languages, code
        w = np.log(plus) - np.log(minus)
        trust = ((plus - minus) * w).sum(axis=0) / 2  # mean margin of a gram: the bit's power to tell
        self.weights = w.astype(np.float32)
        self.trust = trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / len(trust))

    def predict(self, data: np.ndarray, offs: np.ndarray, most: float = 60.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and margin of each text.

        A bit's margin is the sum of its weights over the grams, a long text counting
        as ``most`` grams.  Decoding takes the language of the least sum of logistic
        losses, each bit weighted by its power; the score is the share of that
        language when losses are turned to probabilities.
        """
        gram, share, _ = ngrams(data, offs)
        n = np.diff(share)
        margin = np.zeros((len(n), self.code.shape[1]))
        some = n > 0
        if some.any():
            margin[some] = np.add.reduceat(self.weights[gram], share[:-1][some], axis=0)
            margin[some] *= (np.minimum(n[some], most) / n[some])[:, None]
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None, :, :]) @ self.trust
        share_of = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share_of /= share_of.sum(axis=1, keepdims=True)
        ordered = np.sort(share_of, axis=1)
        gap = ordered[:, -1] - (ordered[:, -2] if ordered.shape[1] > 1 else 0)
        return share_of.argmax(axis=1), share_of.max(axis=1), gap


def fit(docs: DataFrame, train: Column) -> Model | None:
    """The classifiers, from the texts and languages of all rows where ``train`` holds.

    Spark counts grams by language and adds up rates over the languages of either side
    of each bit; the driver gets two sums for each bucket and bit, however many
    documents and languages there are.  Null where no row can be learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in total.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            total.clear()

        for batch in chunks(batches):
            gram, share, _ = ngrams(*utf8(batch.column("text")))
            lang = batch.column("lang").dictionary_encode()
            index, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
            of = np.repeat(index, np.diff(share))
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + np.bincount(gram[of == k], minlength=BUCKETS)
                if len(total) > HELD_LANGUAGES:
                    yield from flush()
        yield from flush()

    every = rows.select("lang").distinct().withColumns({"bucket": F.lit(None).cast("int"), "n": F.lit(0).cast("long")})  # one that has no gram is a language too
    counted = materialise(rows.mapInArrow(run, "lang string, bucket int, n long").union(every).groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").toArrow()
    languages = totals.column("lang").to_pylist()
    if not languages:
        return None
    code = codewords(len(languages))
    scale = 1.0 / (totals.column("n").to_numpy() + SMOOTHING * BUCKETS)
    table = spark.createDataFrame([(name, float(s), row) for name, s, row in zip(languages, scale, code.tolist(), strict=True)], "lang string, scale double, code array<int>")
    bits = code.shape[1]
    rated = counted.where("bucket is not null").join(F.broadcast(table), "lang").select("bucket", "code", (F.col("n") * F.col("scale")).alias("rate"))  # a row for each language
    side = lambda k, s: F.sum(F.when(F.col("code")[k] == s, F.col("rate")).otherwise(0.0))
    sums = rated.groupBy("bucket").agg(F.array(*(side(k, s) for s in (1, -1) for k in range(bits))).alias("x")).toArrow()
    rates = np.zeros((BUCKETS, 2 * bits))
    rates[sums.column("bucket").to_numpy()] = sums.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * bits)
    on = np.concatenate((code > 0, code < 0), axis=1).astype(float)
    rates += (SMOOTHING * scale)[None, :] @ on
    mean = rates / np.maximum(on.sum(axis=0), 1)
    plus, minus = mean[:, :bits], mean[:, bits:]
    return Model(languages, code, plus, np.where(on.sum(axis=0)[bits:] > 0, minus, plus))


def identify(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.1) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every document, from its whole text alone.

    ``und`` with score 0 if the text is null, has no letter, or no language was
    learned.  ``ambiguous``: the two nearest codewords are less than
    ``ambiguous_below`` apart in score.  Of equal scores the first language by name is
    taken.  A row without a doc_id and rows that repeat have a row each; other columns
    are not looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in chunks(batches):
            text = batch.column("text")
            known = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            if model is None:
                known = np.zeros(n, dtype=bool)
                best, score, gap = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            else:
                best, score, gap = model.predict(*utf8(text))
            names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (gap < ambiguous_below))],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
