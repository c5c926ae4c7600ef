"""Cross-fitted models with an inner choice of the penalty: logistic (propensity, hazards) and ridge (outcomes).

All fits of a grid move together: a Newton step of every (fold, inner fold, penalty)
is one pass over the rows, whose small sums Spark adds up, so the number of jobs is that
of the steps of one fit, whatever the number of fits.  In larger tables the ridge models that choose a penalty are
solved from polynomials about a pilot (``operators/expansion.py``), one pass for all; those that are kept start from there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip, logistic
from cohortforge.operators.expansion import Polynomial, degree_for, derivatives, solved
from cohortforge.operators.resample import hashed
from cohortforge.operators.running import summed

#: Inverse penalties of the propensity model, as the sum of losses is weighed, and penalties of the ridge.
INVERSE_PENALTIES = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
RIDGE_PENALTIES = (0.1, 1.0, 10.0, 100.0)


def _design(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """A row of one and the p features for each row."""
    return np.stack([np.ones(batch.num_rows), *(batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(p))], axis=1)


def _prepared(df: DataFrame, key: str, label: str, features: Sequence[str], fold: str, inner: int, seed: int) -> DataFrame:
    """Label, fold, inner fold by a hash of the key, and features as doubles; a null feature is an error."""
    x = [F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"{c} is null; impute it first")).cast("double")).alias(f"_x{i}") for i, c in enumerate(features)]
    return df.select(F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_f"), F.pmod(hashed(seed, key), F.lit(inner)).cast("int").alias("_g"), *x)


def _member(batch: pa.RecordBatch, models: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which rows each model (fold left out, inner fold left out or -1) learns from."""
    f, g = batch.column("_f").to_numpy(), batch.column("_g").to_numpy()
    return np.stack([(f != a) & (g != b) for a, b in models], axis=1)


def _descent(hessian: np.ndarray, gradient: np.ndarray, beta: np.ndarray, absolute: np.ndarray, sweeps: int = 5000, tolerance: float = 1e-13) -> np.ndarray:
    """Minimum of each model's quadratic at ``beta`` with a penalty on absolute values, by coordinate descent; zeros are exact."""
    new, slope = beta.copy(), gradient.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(beta.shape[1]):
            own = hessian[:, j, j]
            z = slope[:, j] + own * new[:, j]
            to = np.where(own > 0, np.sign(z) * np.maximum(np.abs(z) - absolute[:, j], 0) / np.where(own > 0, own, 1.0), 0.0)
            step = to - new[:, j]
            new[:, j] = to
            slope -= hessian[:, :, j] * step[:, None]
            most = max(most, float(np.abs(step).max(initial=0)))
        if most < tolerance:
            break
    return new


def _newton(rows: DataFrame, p: int, models: Sequence[tuple[int, int]], penalty: np.ndarray, absolute: np.ndarray | None = None, steps: int = 60, tolerance: float = 1e-8, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of each logistic model, a row each; ``penalty``, ``absolute``: those of the squares and of the sizes of every coefficient.

    Fits that do not settle are an error.
    """
    m, q = len(models), p + 1
    beta = np.zeros((m, q)) if start is None else start.copy()
    at = np.triu_indices(q)
    for _ in range(steps):

        def work(batch, beta=beta):
            x, y = _design(batch, p), batch.column("_y").to_numpy()
            use = _member(batch, models)
            e = 1 / (1 + np.exp(-np.clip(x @ beta.T, -35, 35)))
            gradient = ((y[:, None] - e) * use).T @ x
            v = e * (1 - e) * use
            cross = x[:, at[0]] * x[:, at[1]]
            return np.concatenate((gradient.ravel(), (v.T @ cross).ravel()))

        sums = summed(rows, m * (q + len(at[0])), work)
        gradient = sums[: m * q].reshape(m, q) - penalty * beta
        hessian = np.zeros((m, q, q))
        hessian[:, at[0], at[1]] = hessian[:, at[1], at[0]] = sums[m * q :].reshape(m, -1)
        hessian[:, np.arange(q), np.arange(q)] += penalty
        if absolute is None:
            change = (np.linalg.pinv(hessian, rcond=1e-12, hermitian=True) @ gradient[:, :, None])[:, :, 0]
        else:
            change = _descent(hessian, gradient, beta, absolute) - beta
        beta = beta + np.clip(change, -5, 5)
        if np.abs(change).max() < tolerance:
            return beta
    raise ArithmeticError(f"logistic models did not settle in {steps} steps")


def _polynomials(rows: DataFrame, p: int, folds: Sequence[int], inner: int, n: int) -> tuple[Polynomial, np.ndarray, np.ndarray] | None:
    """Polynomials, their pilot, and terms by fold and inner fold with the number of rows last; None where passes are cheaper or the pilot does not settle."""
    degree = degree_for(n, p + 1)
    if not degree or len(folds) < 2:
        return None
    try:
        pilot = _newton(rows, p, [(min(folds) - 1, -1)], np.zeros((1, p + 1)), tolerance=1e-3)[0]
    except ArithmeticError:
        return None
    polynomial, names = Polynomial(p + 1, degree), np.array(folds)
    size = len(polynomial.exponents) + 1

    def work(batch):
        out = np.zeros((len(folds) * inner, size))
        for part in (batch.slice(s, 2048) for s in range(0, batch.num_rows, 2048)):
            x, y = _design(part, p), part.column("_y").to_numpy()
            cell = np.searchsorted(names, part.column("_f").to_numpy()) * inner + part.column("_g").to_numpy()
            columns = polynomial.columns(x, [v[:, None] for v in derivatives(x @ pilot, y, degree)])
            of = (cell == np.arange(len(out))[:, None]).astype(float)
            out[:, :-1] += of @ columns
            out[:, -1] += of.sum(axis=1)
        return out.ravel()

    return polynomial, pilot, summed(rows, len(folds) * inner * size, work).reshape(len(folds), inner, size)


def crossfit_logistic(df: DataFrame, key: str, label: str, features: Sequence[str], fold: str, inverse_penalties: Sequence[float] = INVERSE_PENALTIES, inner: int = 4, bounds: tuple[float, float] = (0.01, 0.99), name: str = "probability", seed: int = 0, mixing: Sequence[float] = (0.0,)) -> DataFrame:
    """Adds the probability of the label from a penalised logistic model that was fitted on the other folds.

    Features are scaled by the population deviations of the training rows; of the inverse
    penalties C and mixing values r (C times the summed loss, plus (1 - r) / 2 times the squared coefficients and r
    times their sizes; r = 0 is ridge) those of the least mean log-loss over ``inner`` inner folds
    are taken, the first of equals.  A fold whose training rows have one label only gives its smoothed share (s + 1/2) / (n + 1).
    """
    return tuned_logistic(df, key, label, features, fold, inverse_penalties, inner, bounds, name, seed, mixing)[0]


def tuned_logistic(df: DataFrame, key: str, label: str, features: Sequence[str], fold: str, inverse_penalties: Sequence[float] = INVERSE_PENALTIES, inner: int = 4, bounds: tuple[float, float] = (0.01, 0.99), name: str = "probability", seed: int = 0, mixing: Sequence[float] = (0.0,)) -> tuple[DataFrame, DataFrame]:
    """``crossfit_logistic``, and a row for each fold: chosen C and mixing, its inner log-loss, features with a coefficient, and coefficients, intercept first."""
    p = len(features)
    rows = _prepared(df, key, label, features, fold, inner, seed).persist()
    facts = rows.groupBy("_f").agg(F.count("*").alias("n"), F.sum("_y").alias("s"), *(x for i in range(p) for x in (F.sum(f"_x{i}").alias(f"a{i}"), F.sum(F.col(f"_x{i}") * F.col(f"_x{i}")).alias(f"b{i}"), F.min(f"_x{i}").alias(f"l{i}"), F.max(f"_x{i}").alias(f"h{i}")))).orderBy("_f").collect()  # a row for each fold
    folds = [r["_f"] for r in facts]
    table = np.array([[r["n"], r["s"], *(r[f"a{i}"] for i in range(p)), *(r[f"b{i}"] for i in range(p))] for r in facts], dtype=float).reshape(len(folds), 2 + 2 * p)
    train = table.sum(axis=0, keepdims=True) - table
    n, s = train[:, 0], train[:, 1]
    variance = train[:, 2 + p :] / np.maximum(n, 1)[:, None] - (train[:, 2 : 2 + p] / np.maximum(n, 1)[:, None]) ** 2
    square = np.concatenate((np.zeros((len(folds), 1)), np.where(variance > 1e-18, variance, 1.0)), axis=1)  # of the deviations; none for the intercept
    good = [k for k in range(len(folds)) if 0 < s[k] < n[k]]
    choices = [(c, r) for r in mixing for c in inverse_penalties]
    grid = [(k, g, c) for k in good for c in choices for g in range(inner)] if len(choices) > 1 else []
    models = [(folds[k], g) for k, g, _ in grid]
    squares = lambda held: np.array([square[k] * (1 - r) / c for k, (c, r) in held])
    sizes = lambda held: np.array([np.sqrt(square[k]) * r / c for k, (c, r) in held]) if any(mixing) else None
    held_grid = [(k, c) for k, _, c in grid]
    ridge = not any(mixing)
    held = _polynomials(rows, p, folds, inner, int(table[:, 0].sum())) if good and ridge else None
    low = np.array([1.0, *(min(r[f"l{i}"] for r in facts) for i in range(p))]) if facts else None
    high = np.array([1.0, *(max(r[f"h{i}"] for r in facts) for i in range(p))]) if facts else None

    def close(asked: Sequence[tuple[int, int]], penalty: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of models without a fold and an inner fold (-1: none) from the polynomials, and which of them hold."""
        if not held:
            return np.zeros((len(asked), p + 1)), np.zeros(len(asked), bool)
        polynomial, pilot, terms = held
        other = terms.sum(axis=0) - terms
        own = np.stack([other[k].sum(axis=0) - (other[k, g] if g >= 0 else 0.0) for k, g in asked])[:, :-1]
        return solved(polynomial, own, pilot, penalty, low, high, 60, tolerance)

    beta, near = close([(k, g) for k, g, _ in grid], squares(held_grid), 1e-9) if grid else (np.zeros((0, p + 1)), np.zeros(0, bool))
    near = np.repeat(near.reshape(len(good), -1).all(axis=1), len(choices) * inner) if grid else near  # the choices of a fold are compared by one measure
    far = np.flatnonzero(~near)
    every = models
    models = [every[i] for i in far]
    if len(far):
        beta[far] = _newton(rows, p, models, squares([held_grid[i] for i in far]), sizes([held_grid[i] for i in far]), tolerance=1e-6)

    def loss(batch):
        x, y, f, g = _design(batch, p), batch.column("_y").to_numpy(), batch.column("_f").to_numpy(), batch.column("_g").to_numpy()
        eta = x @ beta[far].T
        each = np.logaddexp(0, eta) - y[:, None] * eta
        out = np.stack([(f != a) & (g == b) for a, b in models], axis=1)
        return np.concatenate(((each * out).sum(axis=0), out.sum(axis=0)))

    chosen = {k: (choices[0], None) for k in good}
    if grid:
        mean = np.zeros(len(grid))
        if len(far):
            sums = summed(rows, 2 * len(far), loss)
            mean[far] = sums[: len(far)] / np.maximum(sums[len(far) :], 1)
        if near.any():
            polynomial, pilot, terms = held
            other = terms.sum(axis=0) - terms
            out = np.stack([other[k, g] for (k, g, _), kept in zip(grid, near, strict=True) if kept])
            mean[near] = polynomial.value(out[:, :-1], beta[near] - pilot) / np.maximum(out[:, -1], 1)
        for k in good:
            by = {c: float(np.mean([mean[i] for i, (a, _, d) in enumerate(grid) if a == k and d == c])) for c in choices}
            best = min(by, key=by.get)
            chosen[k] = (best, by[best])
    last = [(k, chosen[k][0]) for k in good]
    start, sure = close([(k, -1) for k in good], squares(last), 1e-12) if good else (np.zeros((0, p + 1)), np.zeros(0, bool))
    final = _newton(rows, p, [(folds[k], -1) for k in good], squares(last), sizes(last), start=np.where(sure[:, None], start, 0.0)) if good else np.zeros((0, p + 1))
    rows.unpersist()
    held = {k: final[i].tolist() for i, k in enumerate(good)}
    fitted = df.sparkSession.createDataFrame([(f, held.get(k), None if k in held else float((s[k] + 0.5) / (n[k] + 1))) for k, f in enumerate(folds)], "_f int, _b array<double>, _share double")
    eta = sum((F.col(c).cast("double") * F.col("_b")[i + 1] for i, c in enumerate(features)), F.col("_b")[0])
    joined = df.withColumn("_f", F.col(fold).cast("int")).join(F.broadcast(fitted), "_f")  # a row for each fold
    out = joined.withColumn(name, clip(F.coalesce(logistic(eta), "_share"), *bounds)).drop("_f", "_b", "_share")
    tuned = [(folds[k], float(chosen[k][0][0]), float(chosen[k][0][1]), chosen[k][1], int((final[i, 1:] != 0).sum()), final[i].tolist()) for i, k in enumerate(good)]
    return out, df.sparkSession.createDataFrame(tuned, "fold int, inverse_penalty double, mixing double, log_loss double, n_nonzero int, coefficients array<double>")


def crossfit_ridge(df: DataFrame, y: str, arm: str, features: Sequence[str], fold: str, penalties: Sequence[float] = RIDGE_PENALTIES, least_rows: int = 20, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Adds mu0 and mu1: the outcome in either arm by ridge regression on the rows of that arm in the other folds.

    Features are scaled by the training rows; the penalty is that of the least
    leave-one-out error among them, worked out from leverages in one pass.  An arm with fewer
    than ``least_rows`` training rows is an error.  Gram matrices are summed once by arm
    and fold; those without a fold are differences.
    """
    p = len(features)
    q = p + 2  # one, features, outcome
    rows = df.select(F.col(y).cast("double").alias("_y"), F.col(arm).cast("int").alias("_a"), F.col(fold).cast("int").alias("_f"), *(F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"{c} is null; impute it first")).cast("double")).alias(f"_x{i}") for i, c in enumerate(features))).persist()
    folds = [r[0] for r in rows.select("_f").distinct().orderBy("_f").collect()]
    of = {f: k for k, f in enumerate(folds)}

    def gram(batch):
        z = np.concatenate((_design(batch, p), batch.column("_y").to_numpy()[:, None]), axis=1)
        a, f = batch.column("_a").to_numpy(), np.array([of[v] for v in batch.column("_f").to_pylist()])
        return np.concatenate([(z[m].T @ z[m]).ravel() for k in range(len(folds)) for arm in (0, 1) for m in [(f == k) & (a == arm)]])

    grams = summed(rows, 2 * len(folds) * q * q, gram).reshape(len(folds), 2, q, q) if folds else np.zeros((0, 2, q, q))
    fits = {}
    for k in range(len(folds)):
        for a in (0, 1):
            g = grams[:, a].sum(axis=0) - grams[k, a]
            n = g[0, 0]
            if n < least_rows:
                rows.unpersist()
                raise ValueError(f"arm {a} without fold {folds[k]}: {int(n)} rows to learn from, {least_rows} needed")
            mean = g[0, 1:-1] / n
            deviation = np.sqrt(np.maximum(np.diag(g)[1:-1] / n - mean**2, 0))
            deviation = np.where(deviation > 1e-12, deviation, 1.0)
            middle = g[0, -1] / n
            xx = (g[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(deviation, deviation)
            xy = (g[1:-1, -1] - n * mean * middle) / deviation
            for c in penalties:
                inverse = np.linalg.inv(xx + c * np.eye(p))
                fits[k, a, c] = (mean, deviation, middle, inverse @ xy, inverse, n)

    def errors(batch):
        x, value = _design(batch, p)[:, 1:], batch.column("_y").to_numpy()
        arms, f = batch.column("_a").to_numpy(), np.array([of[v] for v in batch.column("_f").to_pylist()])
        out = []
        for (k, a, _), (mean, deviation, middle, b, inverse, n) in fits.items():
            m = (f != k) & (arms == a)
            z = (x[m] - mean) / deviation
            leverage = 1 / n + np.einsum("ij,jk,ik->i", z, inverse, z)
            out.append(float((((value[m] - middle - z @ b) / np.maximum(1 - leverage, 1e-9)) ** 2).sum()))
        return np.array(out)

    loss = dict(zip(fits, summed(rows, len(fits), errors), strict=True)) if fits else {}
    rows.unpersist()
    table = []
    for k, f in enumerate(folds):
        line = [f]
        for a in (0, 1):
            c = min(penalties, key=lambda v: loss[k, a, v])  # noqa: B023
            mean, deviation, middle, b, _, _ = fits[k, a, c]
            slope = b / deviation
            line.append([float(middle - slope @ mean), *slope.tolist()])
        table.append(tuple(line))
    fitted = df.sparkSession.createDataFrame(table, "_f int, _b0 array<double>, _b1 array<double>")
    joined = df.drop("mu0", "mu1").withColumn("_f", F.col(fold).cast("int")).join(F.broadcast(fitted), "_f")  # a row for each fold
    value = lambda a: sum((F.col(c).cast("double") * F.col(f"_b{a}")[i + 1] for i, c in enumerate(features)), F.col(f"_b{a}")[0])
    return joined.withColumns({f"mu{a}": clip(value(a), *bounds) if bounds else value(a) for a in (0, 1)}).drop("_f", "_b0", "_b1")


def crossfit_hazard(rows: DataFrame, key: str, outcome: str, features: Sequence[str], fold: str, by: Sequence[str], name: str, inverse_penalties: Sequence[float] = (0.003, 0.01, 0.03, 0.1, 0.3), inner: int = 3, seed: int = 0) -> DataFrame:
    """Adds the discrete hazard of ``outcome`` in each row, held in [1e-5, 0.95], from the other folds.

    A logistic model by ``crossfit_logistic``; where the other folds have one outcome only,
    the smoothed share (s + 1/2) / (n + 1) of the row's cell ``by`` in them, or of all of
    them for a cell that they have not.
    """
    fitted = crossfit_logistic(rows, key, outcome, features, fold, inverse_penalties, inner, (1e-5, 0.95), name, seed)
    cells = rows.groupBy(F.col(fold).alias("_cf"), *by).agg(F.count("*").alias("_n"), F.sum(outcome).alias("_s"))
    folds = cells.groupBy("_cf").agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    total = folds.agg(F.sum("_fn").alias("_tn"), F.sum("_fs").alias("_ts"))
    flat = folds.join(F.broadcast(total)).select("_cf", (F.col("_tn") - F.col("_fn")).alias("_rn"), (F.col("_ts") - F.col("_fs")).alias("_rs")).where("_rs = 0 or _rs = _rn")  # one row
    if flat.isEmpty():
        return fitted
    every = cells.groupBy(*by).agg(F.sum("_n").alias("_an"), F.sum("_s").alias("_as"))
    without = flat.join(every).join(cells, ["_cf", *by], "left").withColumns({"_n": F.col("_an") - F.coalesce("_n", F.lit(0)), "_s": F.col("_as") - F.coalesce("_s", F.lit(0))})  # folds by cells: a small table
    share = F.when(F.col("_n") > 0, (F.col("_s") + 0.5) / (F.col("_n") + 1)).otherwise((F.col("_rs") + 0.5) / (F.col("_rn") + 1))
    table = without.select("_cf", *by, clip(share, 1e-5, 0.95).alias("_share"))
    return fitted.withColumn("_cf", F.col(fold)).join(F.broadcast(table), ["_cf", *by], "left").withColumn(name, F.coalesce("_share", name)).drop("_cf", "_share")


def censor_survival(rows: DataFrame, key: str, hazard: str, outcome: str, interval: str = "interval", name: str = "g") -> tuple[DataFrame, DataFrame]:
    """Chance to be uncensored before each row's interval, held in [0.005, 1]; and one row of log-loss, Brier score and least chance."""
    from cohortforge.operators.survival import running_survival

    out = running_survival(rows, [key], interval, hazard, name).withColumn(name, clip(name, 0.005, 1.0))
    y, h = F.col(outcome).cast("double"), clip(hazard, 1e-12, 1 - 1e-12)
    facts = out.agg(F.avg(-(y * F.ln(h) + (1 - y) * F.ln(1 - h))).alias("log_loss"), F.avg((y - F.col(hazard)) * (y - F.col(hazard))).alias("brier"), F.min(name).alias("least"))
    return out, facts


def clone_weights(rows: DataFrame, by: Sequence[str], order: str, factor: str | Column, low: float = 0.01, high: float = 25.0, name: str = "weight") -> DataFrame:
    """Adds to each row the product of the factors of the earlier rows of its clone, held in [low, high] after each; 1 for the first.

    The rows of a clone (bounded by its intervals) are gathered once and folded in order; they join nothing.
    """
    f = (F.col(factor) if isinstance(factor, str) else factor).cast("double")
    own = F.struct(*(c for c in rows.columns if c not in by))
    clones = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), f.alias("f"), own.alias("r")))).alias("_s"))
    held = F.aggregate(
        "_s",
        F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("out")),
        lambda a, s: F.struct(F.greatest(F.lit(low), F.least(F.lit(high), a["w"] * s["f"])).alias("w"), F.concat(a["out"], F.array(a["w"])).alias("out")),
    )
    each = clones.select(*by, F.explode(F.zip_with("_s", held["out"], lambda s, w: F.struct(s["r"].alias("r"), w.alias("w")))).alias("_x"))
    return each.select(*(F.col(c) if c in by else F.col(f"_x.r.{c}").alias(c) for c in rows.columns), F.col("_x.w").alias(name))


def weighted_interval_curve(rows: DataFrame, by: Sequence[str], weight: str, event: str) -> DataFrame:
    """By interval: weight at risk, of events, hazard, survival after it, and the area up to its end (survival ahead of each interval times its width)."""
    from pyspark.sql import Window as W

    each = rows.groupBy(*by, "interval").agg(F.sum(weight).alias("risk"), F.sum(F.col(weight) * F.col(event)).alias("events"), F.min("start").alias("_from"), F.max("stop").alias("_to"))
    hazard = F.coalesce(F.col("events") / F.nullif(F.col("risk"), F.lit(0.0)), F.lit(0.0))
    w = W.partitionBy(*by).orderBy("interval")  # a row for each interval of the grid
    stay = F.greatest(F.lit(0.0), 1 - hazard)
    out = each.withColumns({"hazard": hazard, "survival": F.product(stay).over(w.rowsBetween(W.unboundedPreceding, 0)), "_before": F.coalesce(F.product(stay).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))})
    return out.withColumn("area", F.sum(F.col("_before") * (F.col("_to") - F.col("_from"))).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_before", "_from", "_to")
