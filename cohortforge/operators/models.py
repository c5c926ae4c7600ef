"""Fitted models: propensity, ridge outcomes, Cox regression, Markov-blanket selection.

Fits on a cluster are sums over rows: each Newton step aggregates a small matrix in
Spark and solves it on the driver.  Where many small fits are independent (folds,
replicates), each is one group of an Arrow function.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip, logistic
from cohortforge.operators.running import cut_points, running_sums, summed


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(df)


def crossfit_propensity(df: DataFrame, arm: str, features: Sequence[str], fold: str, folds: int, penalty: float = 1e-3, elastic: float = 0.0, bounds: tuple[float, float] = (0.01, 0.99), name: str = "propensity") -> DataFrame:
    """Propensity of each row from a penalised logistic regression fitted on the other folds."""
    x = _assembled(df, features).cache()
    out = None
    for k in range(folds):
        model = LogisticRegression(featuresCol="_x", labelCol=arm, regParam=penalty, elasticNetParam=elastic, maxIter=100).fit(x.where(F.col(fold) != k))
        part = model.transform(x.where(F.col(fold) == k)).withColumn(name, clip(vector_to_array("probability")[1], *bounds)).select(*df.columns, name)
        out = part if out is None else out.union(part)
    x.unpersist()
    return out


def logistic_mle(df: DataFrame, arm: str, features: Sequence[str], tolerance: float = 1e-10, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of the unpenalised logistic fit, by Newton steps.

    A step is one aggregation of the gradient and the Hessian over all rows; the driver
    gets p + p (p + 1) / 2 sums, whatever the number of rows.
    """
    names = ["_one", *features]
    p = len(names)
    rows = df.withColumn("_one", F.lit(1.0)).select(F.col(arm).cast("double").alias("_a"), *(F.col(c).cast("double").alias(c) for c in names)).persist()
    beta = np.zeros(p)
    for _ in range(steps):
        eta = sum((F.col(c) * float(b) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
        fitted = rows.withColumn("_e", logistic(eta))
        v = F.col("_e") * (1 - F.col("_e"))
        sums = [F.sum((F.col("_a") - F.col("_e")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)]
        sums += [F.sum(v * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        got = fitted.agg(*sums).first()
        gradient = np.array([got[f"g{i}"] for i in range(p)])
        hessian = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                hessian[i, j] = hessian[j, i] = got[f"h{i}_{j}"]
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tolerance:
            rows.unpersist()
            return beta
    rows.unpersist()
    raise ArithmeticError("the logistic fit did not settle")


def predict_logistic(df: DataFrame, beta: np.ndarray, features: Sequence[str], name: str = "propensity") -> DataFrame:
    eta = sum((F.col(c) * float(b) for c, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
    return df.withColumn(name, logistic(eta))


def crossfit_outcomes(df: DataFrame, y: str, arm: str, features: Sequence[str], fold: str, folds: int, kind: str = "ridge", penalty: float = 1.0, bounds: tuple[float, float] | None = None) -> DataFrame:
    """mu0 and mu1 of each row from arm-wise regressions (ridge or boosted trees) fitted on the other folds."""
    x = _assembled(df, features).cache()
    out = None
    for k in range(folds):
        part = x.where(F.col(fold) == k)
        for a in (0, 1):
            learner = LinearRegression(featuresCol="_x", labelCol=y, predictionCol=f"mu{a}", regParam=penalty, elasticNetParam=0.0) if kind == "ridge" else GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=f"mu{a}", maxDepth=3, maxIter=20, seed=1)
            part = learner.fit(x.where((F.col(fold) != k) & (F.col(arm) == a))).transform(part)
        out = part if out is None else out.union(part)
    x.unpersist()
    out = out.drop("_x")
    return out.withColumns({f"mu{a}": clip(f"mu{a}", *bounds) for a in (0, 1)}) if bounds else out


def residual_effect(df: DataFrame, y: str, arm: str, m: str, e: str, features: Sequence[str], penalty: float = 1.0, floor: float = 0.05) -> DataFrame:
    """R-learner: tau of each row by weighted ridge of outcome residuals over treatment residuals.

    A treatment residual nearer to zero than ``floor`` is taken as the floor, with its
    sign, plus for zero.
    """
    ra = F.col(arm) - F.col(e)
    safe = F.when(F.abs(ra) >= floor, ra).when(ra >= 0, floor).otherwise(-floor)
    x = _assembled(df.withColumns({"_t": (F.col(y) - F.col(m)) / safe, "_w": safe * safe}), features)
    model = LinearRegression(featuresCol="_x", labelCol="_t", weightCol="_w", predictionCol="tau", regParam=penalty, elasticNetParam=0.0).fit(x)
    return model.transform(x).drop("_x", "_t", "_w")


def principal_components(df: DataFrame, features: Sequence[str], k: int, name: str = "pc") -> DataFrame:
    """First k principal components of the features, as an array column."""
    x = _assembled(df, features)
    return PCA(k=k, inputCol="_x", outputCol="_pc").fit(x).transform(x).withColumn(name, vector_to_array("_pc")).drop("_x", "_pc")


def cox_newton(x: np.ndarray, time: np.ndarray, event: np.ndarray, penalty: float = 0.0, steps: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients of Cox regression, ties by Efron's method, with a ridge penalty penalty / 2 * n * |b|^2."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order], time[order], event[order]
    n, p = x.shape
    beta = np.zeros(p)
    starts = np.flatnonzero(np.concatenate(([True], time[1:] != time[:-1])))
    ends = np.append(starts[1:], n)
    for _ in range(steps):
        eta = x @ beta
        w = np.exp(eta - eta.max())
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))
        gradient, hessian = -penalty * n * beta, penalty * n * np.eye(p)
        for s, e in zip(starts, ends, strict=True):
            xs, ws = x[s:e], w[s:e]
            s0 += ws.sum()
            s1 = s1 + ws @ xs
            s2 = s2 + (xs * ws[:, None]).T @ xs
            dead = event[s:e] == 1
            d = int(dead.sum())
            if not d:
                continue
            xd, wd = xs[dead], ws[dead]
            d0, d1, d2 = wd.sum(), wd @ xd, (xd * wd[:, None]).T @ xd
            gradient = gradient + xd.sum(axis=0)
            for k in range(d):
                f = k / d
                a0, a1, a2 = s0 - f * d0, s1 - f * d1, s2 - f * d2
                m = a1 / a0
                gradient = gradient - m
                hessian = hessian + a2 / a0 - np.outer(m, m)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return beta


#: Rows of a group that one task fits; where a group has more, every Newton step is a Spark job.
COX_TASK_ROWS = 200_000


def cox_by_group(df: DataFrame, by: Sequence[str], time: str, event: str, features: Sequence[str], penalty: float = 0.0, task_rows: int = COX_TASK_ROWS) -> DataFrame:
    """Cox coefficients of each group (a fold, a replicate, a model).

    If no group has over ``task_rows`` rows each is one Arrow group; else all are
    fitted together by ``cox_spread``.  Rows with a null are left out.  A group
    without an event or with fewer than two rows gives null coefficients.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*by, time, event, *features)
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > task_rows:
        return cox_spread(rows, by, time, event, features, penalty)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        use = pdf.dropna()
        if len(use) < 2 or not (use[event] == 1).any():
            beta = [None] * len(features)
        else:
            beta = cox_newton(use[list(features)].to_numpy(float), use[time].to_numpy(float), use[event].to_numpy(), penalty).tolist()
        return pd.DataFrame({**{b: [k] * len(features) for b, k in zip(by, key, strict=True)}, "feature": list(features), "coefficient": beta})

    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "feature string", "coefficient double"])
    return rows.groupBy(*by).applyInPandas(fit, schema)


def _efron_terms(batch: pa.RecordBatch, p: int, pairs: list[tuple[int, int]], part: int = 1 << 16) -> list[np.ndarray]:
    """Gradient and hessian terms of each event time, from the sums of its risk set (s) and of its events (d)."""
    get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    s0, d0, deaths = get("s"), get("d"), get("deaths").astype(np.int64)
    s1, d1 = (np.stack([get(f"{k}{i}") for i in range(p)], axis=1) for k in "sd")
    s2, d2 = (np.stack([get(f"{k}{i}_{j}") for i, j in pairs], axis=1) for k in "sd")
    gradient = np.stack([get(f"x{i}") for i in range(p)], axis=1)
    hessian = np.zeros((batch.num_rows, len(pairs)))
    i, j = (np.array(c) for c in zip(*pairs, strict=True))
    for row in range(batch.num_rows):
        for at in range(0, deaths[row], part):
            f = np.arange(at, min(at + part, deaths[row])) / deaths[row]
            a0 = s0[row] - f * d0[row]
            m = (s1[row] - f[:, None] * d1[row]) / a0[:, None]
            gradient[row] -= m.sum(axis=0)
            hessian[row] += s2[row] * (1 / a0).sum() - d2[row] * (f / a0).sum() - (m[:, i] * m[:, j]).sum(axis=0)
    return [*gradient.T, *hessian.T]


def cox_spread(df: DataFrame, by: Sequence[str], time: str, event: str, features: Sequence[str], penalty: float = 0.0, steps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """The same coefficients where groups are larger than a task: each Newton step sums over rows in Spark.

    Rows are summed by time first and risk sets are running sums along time; the
    driver gets one gradient and hessian per group.  Features are centred on the means of their
    group, which leaves the coefficients as they are and keeps exponents small.
    """
    spark, p = df.sparkSession, len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    rows = df.select(*by, F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features))).dropna()
    means = rows.groupBy(*by).agg(*(F.avg(f"_x{i}").alias(f"_m{i}") for i in range(p)))
    rows = (rows.join(F.broadcast(means), list(by)) if by else rows.join(F.broadcast(means))).select(*by, "_t", "_e", *((F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(p))).persist()  # a row for each group
    cuts = cut_points(rows, F.col("_t"))[0]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_e") == 1).alias("d")).collect()
    key_of = lambda r: tuple(r[b] for b in by)
    sizes = {key_of(r): r["n"] for r in found}
    beta = {key_of(r): np.zeros(p) for r in found if r["n"] >= 2 and r["d"]}
    moving = set(beta)
    x = [F.col(f"_x{i}") for i in range(p)]
    dead = F.col("_e") == 1
    sums = ["s", *(f"s{i}" for i in range(p)), *(f"s{i}_{j}" for i, j in pairs)]
    out = [*(f"g{i}" for i in range(p)), *(f"h{i}_{j}" for i, j in pairs)]

    def terms(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), *(pa.array(np.ascontiguousarray(c)) for c in _efron_terms(batch, p, pairs))], [*by, *out])

    for _ in range(steps):
        if not moving:
            break
        now = spark.createDataFrame([(*k, [float(v) for v in beta[k]]) for k in sorted(moving, key=str)], f"{keys}, _b array<double>")
        w = F.exp(sum((x[i] * F.col("_b")[i] for i in range(p)), F.lit(0.0)))
        weighed = rows.join(F.broadcast(now), list(by)).withColumn("_w", w)  # a row per group
        products = {"": F.col("_w"), **{f"{i}": F.col("_w") * x[i] for i in range(p)}, **{f"{i}_{j}": F.col("_w") * x[i] * x[j] for i, j in pairs}}
        by_time = weighed.groupBy(*by, "_t").agg(
            F.count_if(dead).alias("deaths"),
            *(F.sum(F.when(dead, c).otherwise(0.0)).alias(f"x{i}") for i, c in enumerate(x)),
            *(F.sum(F.when(dead, c).otherwise(0.0)).alias(f"d{n}") for n, c in products.items()),
            *(F.sum(c).alias(f"_at{n}") for n, c in products.items()),
        )
        at_risk = running_sums(by_time, by, "_t", {n: F.col("_at" + n[1:]) for n in sums}, descending=True, cuts=cuts).where("deaths > 0")
        each = at_risk.mapInArrow(terms, ", ".join([keys, *(f"{n} double" for n in out)])).groupBy(*by).agg(*(F.sum(n).alias(n) for n in out)).collect()
        for r in each:
            k = key_of(r)
            gradient = np.array([r[f"g{i}"] for i in range(p)]) - penalty * sizes[k] * beta[k]
            hessian = penalty * sizes[k] * np.eye(p)
            for i, j in pairs:
                hessian[i, j] += r[f"h{i}_{j}"]
                hessian[j, i] = hessian[i, j]
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            beta[k] = beta[k] + step
            if np.abs(step).max() < tolerance:
                moving.discard(k)
    rows.unpersist()
    table = [(*key_of(r), c, float(beta[key_of(r)][i]) if key_of(r) in beta else None) for r in found for i, c in enumerate(features)]
    return spark.createDataFrame(table, f"{keys}, feature string, coefficient double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Correlations of a few hundred columns at most, and the number of complete rows.

    Means first, then the Gram matrix of the centred columns, summed over Arrow batches.
    """
    use = df.select(*(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns))).dropna()
    p = len(columns)
    mean = np.array([m or 0.0 for m in use.agg(*(F.avg(f"_x{i}") for i in range(p))).first()])

    def gram(batch):
        x = np.stack([batch.column(i).to_numpy() for i in range(p)], axis=1) - mean
        return np.append((x.T @ x).ravel(), len(x))

    sums = summed(use, p * p + 1, gram)
    cross = sums[:-1].reshape(p, p)
    sd = np.sqrt(np.diag(cross))
    scale = np.outer(sd, sd)
    out = np.where(scale > 0, cross / np.where(scale > 0, scale, 1.0), 0.0)
    np.fill_diagonal(out, 1.0)
    return out, int(sums[-1])


def _log_beta_tail(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + k * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + k / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def partial_p(corr: np.ndarray, n: int, i: int, j: int, given: Sequence[int]) -> float:
    """p-value of the partial correlation of i and j given others, from the correlation matrix."""
    at = [i, j, *given]
    inverse = np.linalg.pinv(corr[np.ix_(at, at)])
    r = -inverse[0, 1] / np.sqrt(max(inverse[0, 0] * inverse[1, 1], 1e-300))
    r = float(np.clip(r, -0.9999999, 0.9999999))
    dof = n - 2 - len(given)
    return _log_beta_tail(r * np.sqrt(dof / (1 - r * r)), dof) if dof > 0 else 1.0


def markov_blanket(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.05, most: int | None = None) -> list[str]:
    """IAMB: grow by the smallest significant p-value, then drop what the others make needless until none is.

    Spark gives the correlation matrix once; the search runs on it.  ``most`` ends the
    growth at so many features, where the caller wants that.
    """
    corr, n = correlation_matrix(df, [target, *features])
    chosen: list[int] = []
    while most is None or len(chosen) < most:
        rest = [j for j in range(1, len(features) + 1) if j not in chosen]
        scored = [(partial_p(corr, n, 0, j, chosen), j) for j in rest]
        if not scored or min(scored)[0] >= alpha:
            break
        chosen.append(min(scored)[1])
    changed = True
    while changed:
        changed = False
        for j in list(chosen):
            if not partial_p(corr, n, 0, j, [k for k in chosen if k != j]) < alpha:
                chosen.remove(j)
                changed = True
    return [features[j - 1] for j in chosen]


def exponential_tilt(df: DataFrame, features: Sequence[str], targets: Sequence[float], ridge: float = 1e-7, steps: int = 60) -> np.ndarray:
    """Lambda of weights exp(x lambda) whose weighted means meet the targets: Newton steps on Spark sums."""
    p = len(features)
    lam = np.zeros(p)
    df = df.select(*features).persist()
    for _ in range(steps):
        w = F.exp(sum((F.col(c) * float(v) for c, v in zip(features, lam, strict=True)), F.lit(0.0)))
        sums = [F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"m{i}") for i, c in enumerate(features))]
        sums += [F.sum(w * F.col(features[i]) * F.col(features[j])).alias(f"v{i}_{j}") for i in range(p) for j in range(i, p)]
        got = df.agg(*sums).first()
        mean = np.array([got[f"m{i}"] for i in range(p)]) / got["w"]
        var = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                var[i, j] = var[j, i] = got[f"v{i}_{j}"] / got["w"] - mean[i] * mean[j]
        step = np.linalg.lstsq(var + 2 * ridge * np.eye(p), mean - np.asarray(targets, float) + 2 * ridge * lam, rcond=None)[0]
        lam = lam - step
        if np.abs(step).max() < 1e-10:
            break
    df.unpersist()
    return lam


def simulate_cohort(spark, n: int, seed: int, hazard: float = 0.03, censoring: float = 0.02, effect: float = -0.3, intervals: int = 8) -> DataFrame:
    """Subjects with a confounded treatment and discrete event and censoring times, all from seeded columns."""
    base = spark.range(n).select(F.col("id"), F.randn(seed).alias("x1"), (F.rand(seed + 1) < 0.4).cast("double").alias("x2"))
    e = logistic(F.lit(-0.2) + 0.5 * F.col("x1") - 0.3 * F.col("x2"))
    treated = base.withColumn("e", e).withColumn("arm", (F.rand(seed + 2) < F.col("e")).cast("int"))
    h = 1 - F.pow(F.lit(1.0 - hazard), F.exp(0.3 * F.col("x1") + effect * F.col("arm")))
    first = lambda rate, s: F.floor(F.ln(1 - F.rand(s)) / F.ln(1 - rate)).cast("int")  # noqa: E731  a geometric time
    timed = treated.withColumns({"event_interval": first(h, seed + 3), "censor_interval": first(F.lit(censoring), seed + 4)})
    stop = F.least("event_interval", "censor_interval", F.lit(intervals - 1))
    return timed.withColumns({"time": (stop + 1).cast("double"), "event": ((F.col("event_interval") <= F.col("censor_interval")) & (F.col("event_interval") < intervals)).cast("int")})
