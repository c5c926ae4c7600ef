"""Cross-fitted models, clone weights, locks and levels against plain versions and hand-worked values."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions import columns as C
from cohortforge.functions.status import level_of
from cohortforge.operators import crossfit as X
from cohortforge.operators import govern as G
from cohortforge.operators import studies as S
from cohortforge.sources import sinks


def cohort(spark, n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 100.0]
    a = (rng.random(n) < 1 / (1 + np.exp(-0.8 * x[:, 0]))).astype(int)
    y = 2 * x[:, 0] + 0.01 * x[:, 1] + a + rng.normal(size=n)
    rows = [(i, i % 3, int(a[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, fold int, a int, x1 double, x2 double, y double")


def plain_logistic(x, y, penalty):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        e = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (e * (1 - e))[:, None]).T @ x + np.diag(penalty), x.T @ (y - e) - penalty * beta)
    return beta


def test_crossfit_logistic_against_a_plain_fit(spark):
    """Penalty by inner folds, scaling by the training rows, and probabilities, each worked out fit by fit."""
    import hashlib

    rows, df = cohort(spark)
    grid, inner = (0.01, 0.3), 3
    got = {r.id: r.p for r in X.crossfit_logistic(df, "id", "a", ["x1", "x2"], "fold", grid, inner, name="p").collect()}
    table = np.array([[1, r[3], r[4]] for r in rows])
    fold, a = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    group = np.array([int(hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[:15], 16) % inner for r in rows])
    for f in range(3):
        train = fold != f
        square = np.concatenate(([0.0], table[train][:, 1:].var(axis=0)))
        loss = {}
        for c in grid:
            each = []
            for g in range(inner):
                fit, out = train & (group != g), train & (group == g)
                eta = table[out] @ plain_logistic(table[fit], a[fit], square / c)
                each.append(np.mean(np.logaddexp(0, eta) - a[out] * eta))
            loss[c] = np.mean(each)
        beta = plain_logistic(table[train], a[train], square / min(loss, key=loss.get))
        want = np.clip(1 / (1 + np.exp(-table[~train] @ beta)), 0.01, 0.99)
        assert np.allclose([got[r[0]] for r in rows if r[1] == f], want, atol=1e-7)


def test_a_fold_of_one_label_gets_the_share(spark):
    df = spark.createDataFrame([(i, i % 2, 1 if i % 2 else 0, float(i)) for i in range(20)], "id int, fold int, a int, x double")
    got = {r.fold: r.p for r in X.crossfit_logistic(df, "id", "a", ["x"], "fold", name="p", bounds=(0.0, 1.0)).collect()}
    assert got == {0: pytest.approx(10.5 / 11), 1: pytest.approx(0.5 / 11)}
    rows = spark.createDataFrame([(i, i % 2, k, int(i % 2 == 0 and k == 1 and i < 6)) for i in range(20) for k in range(2)], "id int, fold int, k int, d int")
    got = {(r.fold, r.k): r.h for r in X.crossfit_hazard(rows, "id", "d", ["k"], "fold", ["k"], "h").collect()}
    assert got[0, 0] == pytest.approx(0.5 / 11) and got[0, 1] == pytest.approx(0.5 / 11)  # the other fold has no event
    with pytest.raises(Exception, match="null"):
        X.crossfit_logistic(df.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), "id", "a", ["x"], "fold").collect()


def test_crossfit_ridge_against_a_plain_fit(spark):
    rows, df = cohort(spark)
    got = {r.id: (r.mu0, r.mu1) for r in X.crossfit_ridge(df, "y", "a", ["x1", "x2"], "fold").collect()}
    x, y = np.array([r[3:5] for r in rows]), np.array([r[5] for r in rows])
    fold, a = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for f in range(3):
        for arm in (0, 1):
            m = (fold != f) & (a == arm)
            mean, sd = x[m].mean(axis=0), x[m].std(axis=0)
            z, t = (x[m] - mean) / sd, y[m]

            def fit(z, t, c):
                return np.linalg.solve((z - z.mean(axis=0)).T @ (z - z.mean(axis=0)) + c * np.eye(2), (z - z.mean(axis=0)).T @ (t - t.mean()))

            best = None
            for c in X.RIDGE_PENALTIES:  # leave-one-out error from leverages
                inverse = np.linalg.inv(z.T @ z + c * np.eye(2))
                e = (t - t.mean() - z @ fit(z, t, c)) / (1 - 1 / len(t) - np.einsum("ij,jk,ik->i", z, inverse, z))
                if best is None or (e**2).sum() < best[0] - 1e-12:
                    best = ((e**2).sum(), fit(z, t, c))
            want = t.mean() + (x[fold == f] - mean) / sd @ best[1]
            assert np.allclose([got[r[0]][arm] for r in rows if r[1] == f], want, atol=1e-8)
    with pytest.raises(ValueError, match="needed"):
        X.crossfit_ridge(df.limit(30), "y", "a", ["x1"], "fold")


def test_clone_weights_start_at_one_and_are_held(spark):
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate((10.0, 10.0, 0.1, 0.5))] + [(2, 0, 3.0)], "id int, interval int, f double")
    got = {(r.id, r.interval): r.weight for r in X.clone_weights(df, ["id"], "interval", "f").collect()}
    assert [got[1, k] for k in range(4)] == pytest.approx([1.0, 10.0, 25.0, 2.5]) and got[2, 0] == 1.0


def test_weighted_area_counts_the_survival_ahead_of_each_interval(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 10.0, 1.0, 1), (0, 0, 0.0, 10.0, 1.0, 0), (0, 1, 10.0, 15.0, 2.0, 0)], "s int, interval int, start double, stop double, w double, event int")
    got = {r.interval: (r.survival, r.area) for r in X.weighted_interval_curve(df, ["s"], "w", "event").collect()}
    assert got == {0: (0.5, 10.0), 1: (0.5, 12.5)}


def test_fisher_against_all_tables(spark):
    from math import comb

    def plain(a, b, c, d):
        n, row, column = a + b + c + d, a + b, a + c
        p = {i: comb(row, i) * comb(n - row, column - i) / comb(n, column) for i in range(max(0, row + column - n), min(row, column) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))

    tables = [(3, 1, 1, 3), (0, 5, 7, 2), (10, 10, 10, 10), (1, 0, 0, 1), (50, 3, 40, 20)]
    got = [r.p for r in spark.createDataFrame(tables, "a int, b int, c int, d int").select(C.fisher_exact("a", "b", "c", "d").alias("p")).collect()]
    assert np.allclose(got, [plain(*t) for t in tables], atol=1e-9)
    assert spark.createDataFrame([(0, 0, 1, 2)], "a int, b int, c int, d int").select(C.fisher_exact("a", "b", "c", "d")).first()[0] is None


@pytest.mark.parametrize("name, kind, level", [("AJCC_T_T2a", "t", 2.0), ("x_t0", "t", 0.0), ("Tis", "t", 0.0), ("pT_tx", "t", None), ("Grade 3", "grade", 3.0), ("G2", "grade", 2.0), ("stage_IIIA", "stage", 3.0), ("Stage IV", "stage", 4.0), ("stage_x", "stage", None), ("stage_not_reported", "stage", None), ("m_M1a", "m", 1.0), ("N0", "n", 0.0), ("nothing", "n", None)])
def test_levels_of_coded_names(name, kind, level):
    assert level_of(name, kind) == level


def test_strings_of_json_texts(spark):
    texts = [json.dumps({"a": "x", "b": [{"c": "y, z"}, 3], "d": {"e": 'q"r'}}), "[]", None, json.dumps({"k": ""})]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.json_strings("t").alias("s")).collect()]
    assert got == [["x", "y, z", 'q"r'], [], None, [""]]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="no"):
        sinks.write_table(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_locks_and_identities(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(4)}
    path = str(tmp_path / "lock")
    G.lock(G.manifest(spark, tables), path)
    with pytest.raises(G.GateError, match="locked"):
        G.lock(G.manifest(spark, tables), path)
    assert G.enforce_lock(spark, path, tables).count() == 2
    with pytest.raises(G.GateError, match="changed"):
        G.enforce_lock(spark, path, {**tables, "b": spark.range(5)})
    at = str(tmp_path / "identity")
    first = G.checkpoint_identity(spark, at, {"k": 1}, tables)
    assert G.checkpoint_identity(spark, at, {"k": 1}, tables) == first
    with pytest.raises(G.GateError, match="another"):
        G.checkpoint_identity(spark, at, {"k": 2}, tables)


def test_cox_survival_without_covariates_is_breslow(spark):
    df = spark.createDataFrame([(1, 1.0, 1, 0.0), (2, 2.0, 0, 0.0), (3, 3.0, 1, 0.0)], "id int, t double, e int, lp double")
    base = S.cox_baseline(df, [], "t", "e", "lp")
    assert [(r.time, r.cumulative_hazard) for r in base.orderBy("time").collect()] == [(1.0, pytest.approx(1 / 3)), (3.0, pytest.approx(4 / 3))]
    got = {(r.id, r["at"]): r.survival for r in S.cox_survival(df, base, [], "id", "lp", [0.5, 2.0]).collect()}
    assert got[1, 0.5] == 1.0 and got[3, 2.0] == pytest.approx(math.exp(-1 / 3))


def test_names():
    assert S.prefixed(["id", "W_b", "W_a", "diagnosis_year", "W_b"]) == ["W_b", "W_a", "diagnosis_year"]
    assert S.metadata_columns(["gene1", "id", "os_time", "age"], ["id"]) == ["id", "os_time", "age"]


def test_curve_mappings_put_the_true_reading_first(spark):
    rows = [(i, i % 2, float(1 + (i * 37) % 50), int(i % 3 > 0), 0.5 + (i % 5) / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, arm int, time double, event int, w double")
    from cohortforge.operators.survival import weighted_curve

    truth = weighted_curve(df, ["arm"], "time", "event", "w").select("arm", "time", "survival")
    readings = {"plain": ("arm", "time", "event", F.lit(1.0)), "swap": (1 - F.col("arm"), "time", "event", "w"), "true": ("arm", "time", "event", "w"), "late": ("arm", F.col("time") + 5, "event", "w")}
    got = S.curve_mappings(df, truth, readings, 40.0).collect()
    assert got[0].mapping == "true" and got[0].area < 1e-9 and got[0].gap < 1e-9 and got[0].score < 1e-7

    def curve(arm, time, event, weight):
        t, d = sorted({time(r) for r in rows if arm(r) >= 0}), {}
        for a in (0, 1):
            s, steps = 1.0, []
            for x in t:
                risk = sum(weight(r) for r in rows if arm(r) == a and time(r) >= x)
                dead = sum(weight(r) for r in rows if arm(r) == a and time(r) == x and event(r))
                s *= 1 - dead / risk if risk else 1
                steps.append((x, s))
            d[a] = steps
        return d

    value = lambda steps, x: next((s for t, s in reversed(steps) if t <= x), 1.0)
    base = curve(lambda r: r[1], lambda r: r[2], lambda r: r[3], lambda r: r[4])
    late = curve(lambda r: r[1], lambda r: r[2] + 5, lambda r: r[3], lambda r: r[4])
    grid = [i / 2 for i in range(80)]  # all steps are at whole numbers
    off = {a: [value(late[a], x) - value(base[a], x) for x in grid] for a in (0, 1)}
    row = next(r for r in got if r.mapping == "late")
    assert row.area == pytest.approx(sum(abs(v) / 2 for a in off for v in off[a])) and row.mean_error == pytest.approx(sum(abs(sum(off[a])) / 2 for a in off))


def test_clones_and_their_weights_join_nothing(spark):
    """A join of the clones by subject became a broadcast of all of them, and so went through the driver."""
    from cohortforge.operators import survival as V

    s = spark.createDataFrame([(i, 100.0 * i, i % 2, 50.0 if i % 3 else None, float(i)) for i in range(1, 9)], "id long, time double, event int, started double, x2 double")
    rows = V.clone_censor(s, "id", "time", "event", "started", 180.0, 730.0, 90.0, ["x2"]).withColumn("f", F.lit(2.0) - F.col("interval") % 2)
    weighted = X.clone_weights(rows, ["id", "strategy"], "interval", "f", 0.01, 3.0)
    assert "Join" not in weighted._jdf.queryExecution().optimizedPlan().toString()
    assert weighted.columns == [*rows.columns, "weight"] and weighted.count() == rows.count()
    got = {(r.id, r.strategy, r.interval): (r.weight, r.x2) for r in weighted.collect()}
    for (i, strategy, k), (w, x2) in got.items():
        want = 1.0
        for j in range(k):
            want = min(3.0, want * (2.0 - j % 2))
        assert (w, x2) == (want, float(i))
