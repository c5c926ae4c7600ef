"""Whether a propensity design holds up in resamples: fits, tails, effective sizes and balance of each, and a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.operators.refits import MODELS, Subjects, expit, propensities, subjects, totals, with_multiplicities
from cohortforge.operators.resample import with_places
from cohortforge.operators.running import exact_quantiles


@dataclass(frozen=True)
class Gates:
    """Largest shares of propensities within ``tail`` of 0 and of 1, and largest standardised difference, in a replicate; smallest and largest shares over the replicates."""

    tail: float = 0.01
    below: float = 0.02
    above: float = 0.02
    difference: float = 0.02
    settled: float = 0.95
    tail_failures: float = 0.05
    balance_failures: float = 0.05


#: Bins of the propensities of a replicate between its least and its largest; only those that hold a quantile are looked into.
BINS = 2048
_QUANTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
_ROW = (
    "replicate int, success boolean, error string, max_abs_coefficient double, max_abs_difference double, worst_feature string, tail_pass boolean, balance_pass boolean, least double, most double, below double, above double, "
    "ess_treated double, ess_control double, ess_share_treated double, ess_share_control double, overlap_mass double, normalised_overlap double"
)


def imputed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, missing ones at the table's exact median, 0 where all are missing."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    n, *there = df.agg(F.count("*"), *(F.count(known(c)) for c in features)).first()
    broken = [c for c, k in zip(features, there, strict=True) if k < n]
    middle = {}
    if broken:
        spread = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in broken))).alias("x")).select("x.*")
        middle = {r["f"]: r["m"] for r in exact_quantiles(spread.where("not isnan(v)"), ["f"], "v", {"m": 0.5}).collect()}  # a row for each feature
    return df.withColumns({c: F.coalesce(known(c), F.lit(float(middle.get(c, 0.0)))) for c in features})


def _difference(n1, s1, q1, n0, s0, q0) -> np.ndarray:
    """Standardised difference from weights, sums and sums of squares; 0 or infinite where neither arm varies."""
    m1, m0 = s1 / n1, s0 / n0
    pooled = (np.maximum(q1 / n1 - m1**2, 0) + np.maximum(q0 / n0 - m0**2, 0)) / 2
    flat = np.where(np.abs(m1 - m0) < 1e-12, 0.0, np.inf)
    return np.where(pooled > 1e-18, np.abs(m1 - m0) / np.sqrt(np.where(pooled > 1e-18, pooled, 1.0)), flat)


def propensity_feasibility(df: DataFrame, key: str, arm: str, features: Sequence[str], replicates: int, seed: int = 0, gates: Gates | None = None, models: int = 64) -> tuple[DataFrame, DataFrame]:
    """A row for each resample, 1 to ``replicates``, and a row that judges all.

    Treatment is fitted in each resample by maximum likelihood, with overlap weights for balance; missing
    features stand at the median of the whole table.  All fits of a wave of ``models`` replicates share
    their passes.  A separated resample, whose coefficients do not settle, is a row without
    success: nothing is raised.  Shares of failed gates are over the fits that settled.
    """
    gates = gates or Gates()
    spark = df.sparkSession
    p = len(features)
    if models > MODELS:
        raise ValueError(f"at most {MODELS} models in a wave")
    filled = imputed(df, features)
    facts = filled.agg(*(x for c in features for x in (F.avg(c), F.stddev_pop(c)))).first()
    centred = filled.withColumns({c: (F.col(c) - F.lit(float(facts[2 * i] or 0.0))) / F.lit(float(facts[2 * i + 1] or 1.0)) for i, c in enumerate(features)})
    base = subjects(centred.withColumns({"_zero": F.lit(0.0)}), key, "_zero", arm, arm, features, 1, seed).withColumn("_f", F.array(F.lit(0)))
    base = with_places(base, key)[0].persist()
    rows, spread = [], None
    for first in range(1, replicates + 1, models):
        wave = list(range(first, min(first + models, replicates + 1)))
        held = with_multiplicities(base, key, wave, seed).drop(key).persist()
        beta, settled = propensities(held, p, len(wave))
        rows += _judged(held, p, wave, beta, settled, features, gates)
        ends = [(r[8], r[9]) if r[8] is not None else (0.0, 1.0) for r in rows[-len(wave) :]]  # least and most
        told = _propensity_rows(held, p, wave, beta, np.array(ends)).persist()
        middle = spark.createDataFrame(exact_quantiles(told, ["replicate"], "e", _QUANTILES, "times").collect(), f"replicate int, {', '.join(f'{n} double' for n in _QUANTILES)}")  # a row for each replicate
        told.unpersist()
        spread = middle if spread is None else spread.unionByName(middle)
        held.unpersist()
    base.unpersist()
    out = spark.createDataFrame(rows, _ROW)
    out = out.join(spread, "replicate", "left") if spread is not None else out.withColumns({n: F.lit(None).cast("double") for n in _QUANTILES})
    good = F.col("success")
    failed = lambda c: F.coalesce(F.avg(F.when(good, (~F.col(c)).cast("double"))), F.lit(1.0))
    verdict = out.agg(
        F.count("*").alias("replicates"), F.count_if(good).alias("settled"), F.coalesce(F.avg(good.cast("double")), F.lit(0.0)).alias("settled_share"),
        failed("tail_pass").alias("tail_failure_share"), failed("balance_pass").alias("balance_failure_share"), F.max(F.when(good, F.col("max_abs_coefficient"))).alias("max_abs_coefficient"), F.max(F.when(good, F.col("max_abs_difference"))).alias("max_abs_difference"),
    )
    fine = (F.col("settled_share") >= gates.settled) & (F.col("tail_failure_share") <= gates.tail_failures) & (F.col("balance_failure_share") <= gates.balance_failures)
    return out, verdict.withColumn("feasible", fine)


def _propensity_rows(rows: DataFrame, p: int, wave: Sequence[int], beta: np.ndarray, ends: np.ndarray) -> DataFrame:
    """replicate, e and times, of the same quantiles as all subjects that are drawn: where no quantile can be, a bin of them is one row at its middle."""
    reps, (low, high) = len(wave), ends.T
    wide = high - low > 1e-9
    scale = np.where(wide, BINS / np.where(wide, high - low, 1.0), 0.0)

    def placed(s):
        e = expit(s.one @ beta.T)
        return e, np.clip(((e - low) * scale).astype(np.int64), 0, BINS - 1)

    def counts(batch):
        out = np.zeros(reps * BINS)
        for s in Subjects.of(batch, p).parts(reps):
            _, at = placed(s)
            out += np.bincount((at + np.arange(reps) * BINS).ravel(), weights=s.times.ravel(), minlength=reps * BINS)
        return out, np.zeros(0)

    table = totals(rows, reps * BINS, 0, counts)[0].reshape(reps, BINS)
    upto = table.cumsum(axis=1)
    looked = np.zeros((reps, BINS), bool)
    for i in range(reps):
        for q in _QUANTILES.values():
            place = q * (upto[i, -1] - 1)
            looked[i, np.searchsorted(upto[i], [np.floor(place), np.ceil(place)], side="right").clip(0, BINS - 1)] = True
    others = [(int(wave[i]), float(low[i] + (k + 0.5) / scale[i]), int(table[i, k])) for i, k in zip(*np.nonzero(~looked & (table > 0)), strict=True)]

    def run(batches):
        for batch in batches:
            for s in Subjects.of(batch, p).parts(reps) if batch.num_rows else ():
                e, at = placed(s)
                i, r = np.nonzero((s.times > 0) & looked[np.arange(reps), at])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(wave, np.int32)[r]), pa.array(e[i, r]), pa.array(s.times[i, r].astype(np.int64))], ["replicate", "e", "times"])

    kind = "replicate int, e double, times long"
    return rows.mapInArrow(run, kind).unionByName(rows.sparkSession.createDataFrame(others, kind))  # BINS rows for each replicate


def _judged(rows: DataFrame, p: int, wave: Sequence[int], beta: np.ndarray, settled: np.ndarray, features: Sequence[str], gates: Gates) -> list[tuple]:
    reps = len(wave)

    def work(batch):
        sums, ends = np.zeros((2, reps, 6 + 4 * p)), np.full((2, reps), np.inf)
        s = Subjects.of(batch, p)
        e = expit(s.one @ beta.T)
        for a in (0, 1):
            m = s.arm == a
            t, score = s.times[m], e[m]
            w = t * (1 - score if a else score)
            square = s.x[m] ** 2
            plain = (t, w, w * (1 - score if a else score), t * (score < gates.tail), t * (score > 1 - gates.tail), t * score * (1 - score))
            sums[a] += np.concatenate([np.stack([v.sum(axis=0) for v in plain], axis=1), t.T @ s.x[m], t.T @ square, w.T @ s.x[m], w.T @ square], axis=1)
        drawn = s.times > 0
        ends[0] = np.where(drawn, e, np.inf).min(axis=0)
        ends[1] = np.where(drawn, -e, np.inf).min(axis=0)
        return sums.ravel(), ends.ravel()

    sums, ends = totals(rows, 2 * reps * (6 + 4 * p), 2 * reps, work)
    sums, ends = sums.reshape(2, reps, 6 + 4 * p), ends.reshape(2, reps)
    out = []
    for i, r in enumerate(wave):
        n, w, ww, low, high, h = (sums[:, i, j] for j in range(6))
        if not n.all():
            out.append((r, False, "one arm only", *(None,) * 15))
            continue
        block = lambda a, j: sums[a, i, 6 + j * p : 6 + (j + 1) * p]  # noqa: B023, E731
        every = n.sum()
        mean = (block(0, 0) + block(1, 0)) / every
        sd = np.sqrt(np.maximum((block(0, 1) + block(1, 1)) / every - mean**2, 0))
        size = float(np.abs(np.concatenate(([beta[i, 0] + beta[i, 1:] @ mean], beta[i, 1:] * sd))).max())
        gap = _difference(w[1], block(1, 2), block(1, 3), w[0], block(0, 2), block(0, 3)) if p else np.zeros(1)
        share = (float(low.sum() / every), float(high.sum() / every))
        ess = w**2 / ww
        # a separated fit has all its propensities in the tails, and no weight to judge balance by
        tail = share[0] <= gates.below and share[1] <= gates.above
        worst = features[int(gap.argmax())] if p else None
        out.append((r, bool(settled[i]), None if settled[i] else "the propensity model did not settle", size, float(gap.max()), worst, tail, bool(gap.max() <= gates.difference), float(ends[0, i]), float(-ends[1, i]), *share, *map(float, (ess[1], ess[0], ess[1] / n[1], ess[0] / n[0], h.sum(), h.sum() / every / 0.25))))
    return out
