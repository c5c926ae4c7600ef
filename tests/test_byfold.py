"""Models by fold against numpy on explicit training sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.operators import byfold as B
from cohortforge.operators import crossfit as X

ALPHAS = (0.1, 1.0, 10.0, 100.0)


def data(n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 30, 0.2] + [5, -100, 0]
    arm = (rng.random(n) < 0.4).astype(int)
    y = x[:, 0] + 0.02 * x[:, 1] + arm * (1 + 2 * x[:, 2]) + rng.normal(size=n)
    e = 0.2 + 0.5 * rng.random(n)
    return x, arm, y, e, np.arange(n) % 4


def frame(spark, x, arm, y, e, fold):
    rows = [(i, *map(float, x[i]), int(arm[i]), float(y[i]), float(e[i]), int(fold[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, arm int, y double, e double, fold int").repartition(3)


def ridge(x, y, w, held):
    """Weighted ridge with its penalty by explicit leave-one-out refits; prediction of ``held``."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack((np.ones(len(x)), (x - mean) / sd))

    def fit(rows, c):
        p = np.diag([0.0, *[c] * x.shape[1]])
        return np.linalg.solve(z[rows].T @ (z[rows] * w[rows][:, None]) + p, z[rows].T @ (w[rows] * y[rows]))

    every = np.arange(len(x))
    lost = {c: sum(w[i] * (y[i] - z[i] @ fit(every != i, c)) ** 2 for i in every) for c in ALPHAS}
    b = fit(every >= 0, min(lost, key=lost.get))
    return np.column_stack((np.ones(len(held)), (held - mean) / sd)) @ b


def test_pooled_ridge_and_effect_by_fold(spark):
    x, arm, y, e, fold = data()
    df = frame(spark, x, arm, y, e, fold).withColumn("m", F.lit(2.0))
    pooled = {r.id: r for r in B.crossfit_pooled_ridge(df, "y", "arm", ["a", "b", "c"], "fold").collect()}
    tau = B.crossfit_effect(df, "y", "arm", "m", "e", ["a", "b", "c"], "fold").cache()
    got = {r.id: r for r in tau.collect()}
    design = lambda v, a: np.column_stack((v, a, v * a[:, None]))
    ra, ry = arm - e, y - 2.0
    safe = np.where(np.abs(ra) >= 0.05, ra, np.where(ra >= 0, 0.05, -0.05))
    want_tau, want_flat = np.zeros(len(y)), np.zeros(len(y))
    for f in range(4):
        t, h = fold != f, fold == f
        for a in (0, 1):
            want = ridge(design(x[t], arm[t]), y[t], np.ones(t.sum()), design(x[h], np.full(h.sum(), a)))
            assert [pooled[i][f"mu{a}"] for i in np.flatnonzero(h)] == pytest.approx(want, rel=1e-6)
        want_tau[h] = ridge(x[t], (ry / safe)[t], (safe**2)[t], x[h])
        want_flat[h] = (ry[t] * ra[t]).sum() / (ra[t] ** 2).sum()
    assert [got[i].tau for i in range(len(y))] == pytest.approx(want_tau, rel=1e-6)
    assert [got[i].tau_constant for i in range(len(y))] == pytest.approx(want_flat, rel=1e-6)
    gain = (ry - want_flat * ra) ** 2 - (ry - want_tau * ra) ** 2
    losses = {r.fold: r for r in B.effect_losses(tau, "y", "arm", "m", "e", "fold").collect()}
    for f in (None, 0, 1, 2, 3):
        g = gain if f is None else gain[fold == f]
        assert (losses[f].n, losses[f].improvement, losses[f].t) == pytest.approx((len(g), g.mean(), g.mean() / (g.std(ddof=1) / len(g) ** 0.5)), rel=1e-6)


def test_components_by_fold(spark):
    x, arm, y, e, fold = data()
    got = {r.id: r.pc for r in B.crossfit_components(frame(spark, x, arm, y, e, fold), ["a", "b", "c"], "fold", 2).collect()}
    for f in range(4):
        t, h = fold != f, fold == f
        z = (x[t] - x[t].mean(axis=0)) / x[t].std(axis=0)
        _, _, v = np.linalg.svd(z, full_matrices=False)
        v = v[:2] * np.sign(v[[0, 1], np.abs(v[:2]).argmax(axis=1)])[:, None]
        want = (x[h] - x[t].mean(axis=0)) / x[t].std(axis=0) @ v.T
        assert np.array([got[i] for i in np.flatnonzero(h)]) == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_boosted_models_see_other_folds_only_and_beat_a_line(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.uniform(-1, 1, size=(n, 3))
    p = np.where(x[:, 0] * x[:, 1] > 0, 0.9, 0.1)
    label = (rng.random(n) < p).astype(int)
    df = frame(spark, x, label, np.where(label == 1, 5 * np.abs(x[:, 0]), 0.0), p, np.arange(n) % 3).cache()
    trees = {"rounds": 12, "rate": 0.3}
    both = X.crossfit_logistic(B.crossfit_boosted(df, "arm", ["a", "b", "c"], "fold", "boosted", True, bounds=(1e-5, 0.95), **trees), "id", "arm", ["a", "b", "c"], "fold", (0.1, 1.0), 2, name="line")
    lost = {(r.model, r.fold): r.log_loss for r in B.probability_losses(both, "arm", ["boosted", "line"], "fold").collect()}
    assert len(lost) == 8 and all(lost["boosted", f] < lost["line", f] - 0.1 for f in (None, 0, 1, 2))
    plain = {r.id: r for r in both.collect()}
    q = np.clip([plain[i].boosted for i in range(n)], 1e-12, 1)
    assert lost["boosted", None] == pytest.approx(-np.mean(np.where(label == 1, np.log(q), np.log(1 - q))))
    swapped = df.withColumn("arm", F.when(F.col("fold") == 0, 1 - F.col("arm")).otherwise(F.col("arm")))
    again = {r.id: r.boosted for r in B.crossfit_boosted(swapped, "arm", ["a", "b", "c"], "fold", "boosted", True, bounds=(1e-5, 0.95), **trees).where("fold = 0").collect()}
    assert all(again[i] == pytest.approx(plain[i].boosted) for i in again)
    mu = B.crossfit_boosted_outcomes(df, "y", "arm", ["a", "b", "c"], "fold", (0.0, 5.0), rounds=8, rate=0.3).collect()
    assert len(mu) == n and all(r.mu0 == 0 and 0 <= r.mu1 <= 5 for r in mu)
    with pytest.raises(ValueError, match="needed"):
        B.crossfit_boosted(df.limit(20), "arm", ["a"], "fold", "p", True)
