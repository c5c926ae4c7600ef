"""Polynomials about a pilot against passes over the rows, and packed draws against their definition."""

import hashlib

import numpy as np
import pytest
from test_refits import CHAIN, cohort, draw, frame

from cohortforge.operators import expansion as E
from cohortforge.operators import feasibility as Y
from cohortforge.operators import refits as R
from cohortforge.operators.resample import hashed_many, with_draws, with_places


def test_polynomials_follow_the_loss():
    rng = np.random.default_rng(1)
    x, v = np.column_stack((np.ones(50), rng.normal(size=(50, 2)))), np.arange(4.0)
    y, w = (rng.random((50, 4)) < 0.3).astype(float), rng.integers(0, 3, 50)
    pilot, move = np.array([-0.4, 0.3, -0.2, 0.1]), np.array([0.02, -0.03, 0.01, -0.01])
    for degree in (3, 4, 5):
        poly = E.Polynomial(4, degree, True)
        eta = (x @ pilot[:3])[:, None] + v * pilot[3]
        sums = [s @ v[:, None] ** np.arange(d + 1) for d, s in enumerate(E.derivatives(eta, y, degree))]
        table = (w @ poly.columns(x, sums))[None]
        to = (x @ (pilot + move)[:3])[:, None] + v * (pilot + move)[3]
        loss, slope, bend = (s * w[:, None] for s in E.derivatives(to, y, 2))
        design = np.concatenate((np.repeat(x[:, None], 4, axis=1), np.broadcast_to(v[None, :, None], (50, 4, 1))), axis=2).reshape(-1, 4)
        gradient, upper = poly.slopes(table, move[None])
        small = 0.2 ** (degree - 1)
        assert poly.value(table, move[None])[0] == pytest.approx(loss.sum(), abs=small)
        assert gradient[0] == pytest.approx(-(slope.reshape(-1) @ design), abs=50 * small)
        assert upper[0] == pytest.approx(((design * bend.reshape(-1, 1)).T @ design)[np.triu_indices(4)], abs=500 * small)
    near = poly.near(np.array([[0.01, 0, 0, 0], [3.0, 0, 0, 0]]), np.full(4, -1.0), np.ones(4))
    assert near.tolist() == [True, False]
    assert E.degree_for(100, 6) == 0 and E.degree_for(1_000_000, 6) == 5 and E.degree_for(100_000_000, 6) == 3 and E.degree_for(1_000_000, 40) == 0


def test_refits_are_the_same_with_fewer_models_by_passes(spark, monkeypatch):
    rows = frame(spark, cohort(2500)).cache()
    whole, passes = R.totals, []
    monkeypatch.setattr(E, "REMAINDER", 1e-3)  # of so few rows models lie further apart
    monkeypatch.setattr(R, "totals", lambda *a: passes.append((a[3].__qualname__, a[1])) or whole(*a))
    got = {}
    for least in (0, 1 << 60):
        monkeypatch.setattr(E, "LEAST_ROWS", least)
        passes.clear()
        got[least] = {r.replicate: r for r in R.refit_bootstrap(rows, "id", "time", "event", "arm", ["x0", "x1"], 2, 2, 7, CHAIN).collect()}
        by_pass = [size for name, size in passes if "_hazards" in name and "step" in name]
        got[least, "work"] = sum(by_pass)
    for r in range(3):
        for c in ("estimate", "if_se", "partition_sd", "least_g"):
            assert got[0][r][c] == pytest.approx(got[1 << 60][r][c], rel=1e-7, abs=1e-7), c
    assert got[0, "work"] < got[1 << 60, "work"] / 3


def test_draws_travel_packed(spark, monkeypatch):
    for prefix, first, count in (("7:3:", 0, 1200), ("123456789012:300:", 95, 30), ("0:1:", 9_999_990, 20)):
        want = [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:15], 16) for k in range(first, first + count)]
        assert hashed_many(prefix, first, count).tolist() == want
    import cohortforge.operators.resample as S

    monkeypatch.setattr(S, "BUCKET", 16)
    monkeypatch.setattr(S, "BLOCK", 32)
    keys = spark.createDataFrame([(3 * k - 7,) for k in range(101)], "id long").repartition(3)
    placed, n = with_places(keys, "id")
    got = {r.id: list(r._w) for r in with_draws(placed, n, [1, 5], 9).collect()}
    for i, r in enumerate((1, 5)):
        want = np.bincount([draw(9, r, k) % n for k in range(n)], minlength=n)
        assert [got[3 * k - 7][i] for k in range(n)] == want.tolist()
    for broken in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError, match="unique"):
            with_places(spark.createDataFrame(broken, "id long"), "id")


def test_quantiles_look_into_few_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.random() < 0.4), float(rng.normal())) for i in range(4000)]
    base = spark.createDataFrame(data, "id long, arm int, a double")
    rows = R.with_multiplicities(R.subjects(base.selectExpr("*", "0.0 AS z"), "id", "z", "arm", "arm", ["a"], 1, 0).selectExpr("*", "array(0) AS _f"), "id", [1, 2], 0).drop("id").cache()
    beta = np.array([[-0.4, 0.7], [0.2, -0.5]])
    e = {k: 1 / (1 + np.exp(-(b[0] + b[1] * np.array([d[2] for d in data])))) for k, b in zip((1, 2), beta, strict=True)}
    times = {r: np.bincount([draw(0, r, k) % 4000 for k in range(4000)], minlength=4000) for r in (1, 2)}
    ends = np.array([(e[r][times[r] > 0].min(), e[r][times[r] > 0].max()) for r in (1, 2)])
    told = Y._propensity_rows(rows, 1, [1, 2], beta, ends).cache()
    assert told.count() < 5200 and told.groupBy("replicate").sum("times").where("`sum(times)` = 4000").count() == 2
    for r in Y.exact_quantiles(told, ["replicate"], "e", Y._QUANTILES, "times").collect():
        for name, q in Y._QUANTILES.items():
            assert r[name] == pytest.approx(np.quantile(np.repeat(e[r.replicate], times[r.replicate]), q), rel=1e-9)


def test_cross_fitted_models_are_the_same_in_fewer_passes(spark, monkeypatch):
    from cohortforge.operators import crossfit as X

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(1 - 0.6 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), i % 3) for i in range(3000)], "id long, y int, a double, b double, fold int").cache()
    monkeypatch.setattr(E, "REMAINDER", 1e-3)
    plain, asked, got = X.summed, [], {}
    monkeypatch.setattr(X, "summed", lambda rows, size, work: asked.append(size) or plain(rows, size, work))
    for least in (0, 1 << 60):
        monkeypatch.setattr(E, "LEAST_ROWS", least)
        asked.clear()
        out, tuned = X.tuned_logistic(df, "id", "y", ["a", "b"], "fold", (0.1, 0.3, 1.0))
        got[least] = {r.id: r.probability for r in out.collect()}, {r.fold: (r.inverse_penalty, r.log_loss) for r in tuned.collect()}, asked.count(36 * 9)
    assert max(abs(got[0][0][i] - got[1 << 60][0][i]) for i in got[0][0]) < 1e-8
    for f, (penalty, loss) in got[0][1].items():
        assert (penalty, loss) == pytest.approx(got[1 << 60][1][f], rel=1e-6)
    assert got[0][2] == 0 < got[1 << 60][2]  # no pass of all 36 models
