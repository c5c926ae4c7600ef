"""Elastic-net logistic models against a plain proximal solver."""

import hashlib

import numpy as np
import pytest

from cohortforge.operators import crossfit as X


def plain(x, y, c, r, sd=None, steps=200_000):
    """Proximal gradient with momentum on scaled features until nothing moves; coefficients of the features as they are."""
    mean, sd = x.mean(axis=0), x.std(axis=0) if sd is None else sd
    z = np.column_stack((np.ones(len(x)), (x - mean) / sd))
    two, one = np.full(z.shape[1], (1 - r) / c), np.full(z.shape[1], r / c)
    two[0] = one[0] = 0
    step = 1 / (np.linalg.eigvalsh(z.T @ z / 4).max() + two.max())
    b = np.zeros(z.shape[1])
    u, t = b.copy(), 1.0
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-z @ u)) - y) + two * u
        v = u - step * g
        new = np.sign(v) * np.maximum(np.abs(v) - step * one, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - b) @ (u - new) > 0:
            t2 = 1.0
        u = new + (t - 1) / t2 * (new - b)
        if np.abs(new - b).max() < 1e-13 and np.abs(new - u).max() < 1e-12:
            b = new
            break
        b, t = new, t2
    slope = b[1:] / sd
    return np.append(b[0] - slope @ mean, slope)


def data(n=220, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 10, 1, 1, 0.1, 1]
    x[:, 5] = x[:, 0] + 0.1 * x[:, 5]
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] + 0.8 * x[:, 2]))).astype(int)
    return x, y, np.arange(n) % 4


def frame(spark, x, y, fold):
    return spark.createDataFrame([(i, int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(len(y))], "id long, y int, fold int, " + ", ".join(f"x{i} double" for i in range(6))).repartition(3)


NAMES = [f"x{i}" for i in range(6)]


@pytest.mark.parametrize("r", [0.25, 0.5, 1.0])
def test_equals_a_plain_solver(spark, r):
    x, y, fold = data()
    _, tuned = X.tuned_logistic(frame(spark, x, y, fold), "id", "y", NAMES, "fold", (0.05,), mixing=(r,))
    zeros = 0
    for row in tuned.collect():
        want = plain(x[fold != row.fold], y[fold != row.fold], 0.05, r)
        assert row.coefficients == pytest.approx(want, abs=1e-6)
        assert [c == 0 for c in row.coefficients[1:]] == [abs(c) < 1e-9 for c in want[1:]]
        assert row.n_nonzero == sum(c != 0 for c in row.coefficients[1:])
        zeros += 6 - row.n_nonzero
    assert zeros > 0


def test_inner_choice_over_both_grids(spark):
    x, y, fold = data()
    cs, rs, inner = (0.01, 0.1), (0.0, 0.5, 1.0), 3
    out, tuned = X.tuned_logistic(frame(spark, x, y, fold), "id", "y", NAMES, "fold", cs, inner, mixing=rs)
    g = np.array([int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], 16) % inner for i in range(len(y))])
    got = {r.id: r.probability for r in out.collect()}
    for row in tuned.collect():
        t = fold != row.fold
        sd = x[t].std(axis=0)
        lost = {}
        for r in rs:
            for c in cs:
                each = []
                for k in range(inner):
                    m, h = t & (g != k), t & (g == k)
                    b = plain(x[m], y[m], c, r, sd)
                    eta = b[0] + x[h] @ b[1:]
                    each.append(np.mean(np.logaddexp(0, eta) - y[h] * eta))
                lost[c, r] = np.mean(each)
        assert (row.inverse_penalty, row.mixing) == min(lost, key=lost.get) and row.log_loss == pytest.approx(min(lost.values()), abs=1e-5)
        b = plain(x[t], y[t], row.inverse_penalty, row.mixing)
        for i in np.flatnonzero(~t):
            assert got[i] == pytest.approx(np.clip(1 / (1 + np.exp(-b[0] - x[i] @ b[1:])), 0.01, 0.99), abs=1e-6)
