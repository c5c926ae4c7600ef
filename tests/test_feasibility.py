"""Feasibility of a propensity design against a loop over explicit copies."""

import numpy as np
import pytest
from test_refits import draw, newton

from cohortforge.operators.feasibility import Gates, propensity_feasibility


def rows(n=120, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 40, 1] + [0, 900, 0]
    arm = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    return [(i * 2, int(arm[i]), float(x[i, 0]), None if i % 9 == 0 else float(x[i, 1]), 5.0) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, arm int, a double, b double, flat double").repartition(3)


def plain(data, r, seed, gates):
    ids = sorted(d[0] for d in data)
    by = {d[0]: d for d in data}
    middle = float(np.median([d[3] for d in data if d[3] is not None]))
    sample = [by[ids[draw(seed, r, k) % len(ids)]] for k in range(len(ids))]
    arm = np.array([d[1] for d in sample])
    x = np.array([[d[2], middle if d[3] is None else d[3]] for d in sample])
    z = np.column_stack((np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)))
    b = newton(z, arm, np.zeros(3))
    e = 1 / (1 + np.exp(-z @ b))
    w = np.where(arm == 1, 1 - e, e)
    gap = []
    for c in range(2):
        m, v = [], []
        for a in (1, 0):
            u, q = w[arm == a] / w[arm == a].sum(), x[arm == a, c]
            m.append(u @ q)
            v.append(u @ (q - u @ q) ** 2)
        gap.append(abs(m[0] - m[1]) / np.sqrt(np.mean(v)))
    ess = [w[arm == a].sum() ** 2 / (w[arm == a] ** 2).sum() for a in (1, 0)]
    low, high = np.mean(e < gates.tail), np.mean(e > 1 - gates.tail)
    return {
        "max_abs_coefficient": np.abs(b).max(), "max_abs_difference": max(gap), "least": e.min(), "most": e.max(), "below": low, "above": high, "ess_treated": ess[0], "ess_control": ess[1], "ess_share_treated": ess[0] / (arm == 1).sum(),
        "overlap_mass": (e * (1 - e)).sum(), "normalised_overlap": (e * (1 - e)).mean() / 0.25, "p01": np.quantile(e, 0.01), "median": np.median(e), "p95": np.quantile(e, 0.95), "tail_pass": low <= gates.below and high <= gates.above, "balance_pass": max(gap) <= gates.difference,
    }


def test_rows_and_verdict_equal_a_plain_loop(spark):
    data, gates = rows(), Gates(tail=0.05, below=0.03, above=0.02)
    out, verdict = propensity_feasibility(frame(spark, data), "id", "arm", ["a", "b", "flat"], 9, 4, gates, models=4)
    got = {r.replicate: r for r in out.collect()}
    assert sorted(got) == list(range(1, 10)) and all(r.success for r in got.values())
    want = {r: plain(data, r, 4, gates) for r in got}
    for r, w in want.items():
        for c, v in w.items():
            assert got[r][c] == pytest.approx(v, rel=1e-6, abs=1e-6), (r, c)
    v = verdict.first()
    fails = [np.mean([not w[c] for w in want.values()]) for c in ("tail_pass", "balance_pass")]
    assert 0 < fails[0] < 1
    assert (v.replicates, v.settled, v.settled_share) == (9, 9, 1.0) and (v.tail_failure_share, v.balance_failure_share) == pytest.approx(fails)
    assert v.max_abs_coefficient == pytest.approx(max(w["max_abs_coefficient"] for w in want.values()), rel=1e-6) and not v.feasible


def test_separation_is_reported(spark):
    data = [(i, int(a > 0), a, b, f) for i, _, a, b, f in rows(60)]
    out, verdict = propensity_feasibility(frame(spark, data), "id", "arm", ["a", "b"], 3)
    assert all(not r.success and r.error for r in out.collect())
    v = verdict.first()
    assert (v.settled, v.settled_share, v.tail_failure_share, v.feasible) == (0, 0.0, 1.0, False)
    one = [(i, 1, a, b, f) for i, _, a, b, f in rows(20)]
    assert [r.error for r in propensity_feasibility(frame(spark, one), "id", "arm", ["a"], 1)[0].collect()] == ["one arm only"]
