"""Runs of words that repeat with a period of their own, by heavy/light lag counting.

A run of period p and length m has m - p neighbouring places that equal the place p
words on, 2 p or more of them and 24 - p or more.  So only a lag with that many equal
pairs inside a window needs a scan for islands.  Pairs are counted exactly: words that are frequent in
the window by the FFT autocorrelation of their places, rare ones by the differences of
their places.  Lags up to ``BASE`` are counted in windows of eight times as many words, longer
ones in windows that double with the lag; windows overlap by the least length of a
run, so none is missed, and the work on a text grows with its length, not its square.

Pairs inside a run that is known are taken off the counts of its period and of the multiples: a
run of such a period can share no pair with it, or its period would not be the least.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import chunks
from cohortforge.llm.shared import small_batches

#: Longest lag of the first windows, which have eight times as many words.
BASE = 512

#: A run has at least these words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3


def is_heavy(count: np.ndarray, words: int) -> np.ndarray:
    """Words whose pairs would cost more to list than an FFT of the window."""
    return count.astype(np.float64) ** 2 > words * np.log2(max(words, 2))


def _transform_size(least: int) -> int:
    """The smallest power of two, or 9/8, 5/4 or 3/2 of one, that is ``least`` or more."""
    size = 1 << max(0, least - 1).bit_length()
    return next((s for s in (size // 16 * 9, size // 8 * 5, size // 4 * 3) if s >= least and s % 2 == 0), size)


def lag_counts(ids: np.ndarray, top: int) -> np.ndarray:
    """Exact number of places i with ids[i] = ids[i + lag], for the lags 0 (left zero) to ``top``."""
    n = len(ids)
    heavy = is_heavy(np.bincount(ids), n)
    out = np.zeros(top + 1, np.int64)
    place = np.argsort(ids, kind="stable")
    if heavy.any():
        size = _transform_size(n + top + 1)
        power = np.zeros(size // 2 + 1)
        at = place[heavy[ids[place]]]
        for places in np.split(at, np.flatnonzero(np.diff(ids[at])) + 1):
            x = np.zeros(n)
            x[places] = 1.0
            f = np.fft.rfft(x, size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
        place = place[~heavy[ids[place]]]
    word = ids[place]
    alive = np.arange(len(place))
    step = 0
    while len(alive):
        step += 1
        alive = alive[: bisect(alive, len(place) - step - 1)]
        alive = alive[word[alive + step] == word[alive]]
        lag = place[alive + step] - place[alive]
        near = lag <= top
        alive = alive[near]
        out += np.bincount(lag[near], minlength=top + 1)
    out[0] = 0
    return out


def windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, least lag, greatest lag): each run of n words lies, for its first max(24, 3 lags) words, whole in a window of its lag."""
    if n <= 8 * BASE:
        yield 0, n, 1, n // LEAST_TIMES
        return
    low, high = 1, BASE
    while low <= n // LEAST_TIMES:
        most = min(high, n // LEAST_TIMES)
        wide = 8 * high
        step = wide - max(LEAST_WORDS, LEAST_TIMES * high)
        start = 0
        while True:
            yield start, min(start + wide, n), low, min(most, (min(start + wide, n) - start) // LEAST_TIMES)
            if start + wide >= n:
                break
            start += step
        low, high = high + 1, 2 * high


def _extended(ids: np.ndarray, start: int, stop: int, period: int) -> tuple[int, int]:
    """The longest stretch of this period around one."""
    width = 64
    while stop < len(ids):
        same = ids[stop : stop + width] == ids[stop - period : min(stop + width, len(ids)) - period]
        if not same.all():
            stop += int(same.argmin())
            break
        stop += len(same)
        width *= 2
    width = 64
    while start > 0:
        low = max(0, start - width)
        same = (ids[low:start] == ids[low + period : start + period])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start = low
        width *= 2
    return start, stop


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run in a sequence of word numbers, by start and then period."""
    n = len(ids)
    known: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    if n < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    lags = np.arange(n // LEAST_TIMES + 1)
    least = np.maximum(LEAST_WORDS - lags, (LEAST_TIMES - 1) * lags)
    for a, b, low, high in windows(n):
        if high < low or b - a < LEAST_WORDS:
            continue
        part = ids[a:b]
        counts = lag_counts(part, high)

        def explain(start, stop, period, counts=counts, a=a, b=b, low=low, high=high):
            inside = min(stop, b) - max(start, a)
            at = np.arange(-(-low // period) * period, min(high, inside - 1) + 1, period)
            counts[at] -= inside - at

        if known:
            table = np.array(known)
            for run in table[(table[:, 0] < b) & (table[:, 1] > a)].tolist():
                explain(*run)
        for p in (low + np.flatnonzero(counts[low:] >= least[low : high + 1])).tolist():
            if counts[p] < least[p]:  # explained by a run found since
                continue
            same = np.zeros(len(part) - p + 2, np.int8)
            same[1:-1] = part[:-p] == part[p:]
            edge = np.flatnonzero(np.diff(same))
            start, stop = edge[::2], edge[1::2]
            for i in np.flatnonzero(stop - start >= least[p]):
                run = _extended(ids, a + int(start[i]), a + int(stop[i]) + p, p)
                if run not in seen:  # else a smaller period has it
                    seen.add(run)
                    known.append((*run, p))
                    explain(*run, p)
    out = np.array([(s, e - s, p) for s, e, p in known], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


Rewrite = Callable[[int | None, int], np.ndarray | None]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, the runs (start, length, period; by start, then period) and the collapsed text of every whole text.

    A run is a stretch of words between ASCII white space with smallest period p, of 24 words and
    3 p or more, that no neighbouring word prolongs.  The collapsed text drops the words that any run holds
    after its first p, and joins the rest by one space.  Null and empty texts have no words and no
    runs; rows that repeat and rows without a doc_id have a row each; other columns are not looked at.
    ``rewrite``: for a document's id and number of words, which word stands at each
    place instead, or None.
    """
    small_batches(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in chunks(batches, 2 << 20):
            size, runs, text = [], [], []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = t.encode().split() if t else []
                number = defaultdict(count().__next__)
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                order = rewrite(doc_id, len(words)) if rewrite else None
                if order is not None:
                    ids = ids[order]
                    words = [words[i] for i in order.tolist()]
                found = find_runs(ids)
                size.append(len(words))
                runs.append(found)
                if len(found):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, found[:, 0] + found[:, 2], 1)
                    np.add.at(change, found[:, 0] + found[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                text.append(b" ".join(words))
            flat = np.concatenate(runs)
            held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(run_type))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(ends, held), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the production query: a tenth of the documents becomes periodic from some word on; none without an id."""
    from zlib import crc32

    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one repeated most often, and SHA-256 of all runs and of the collapsed text; no run: nulls."""
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
