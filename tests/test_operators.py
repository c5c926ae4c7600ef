"""Hand-worked values, invariants and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions import columns as C
from cohortforge.operators import aggregates as A
from cohortforge.operators import causal as K
from cohortforge.operators import govern as G
from cohortforge.operators import joins as J
from cohortforge.operators import metrics as M
from cohortforge.operators import models as D
from cohortforge.operators import ordered as O
from cohortforge.operators import resample as R
from cohortforge.operators import survival as V


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    """Orders are cut into pieces here, as those of large tables are; the queries run without."""
    from cohortforge.operators import running

    monkeypatch.setattr(running, "PIECE_ROWS", 20)


def test_lookup_where_most_rows_stand_at_one_time(spark):
    from cohortforge.operators.joins import step_lookup

    points = [(i, "a" if i % 3 else None, 7.0 if i % 10 else float(i)) for i in range(300)] + [(999, "a", None)]
    curve = [(g, float(t), t / 100) for g in ("a", None) for t in range(3, 200, 7)]
    df, steps = spark.createDataFrame(points, "id int, g string, t double"), spark.createDataFrame(curve, "g string, time double, v double")
    for left in (False, True):
        got = {r.id: r.v for r in step_lookup(df, steps, ["g"], "t", "time", "v", before=-1.0, left_limit=left).collect()}
        want = lambda t: max((v for g, x, v in curve if t is not None and (x < t if left else x <= t)), default=-1.0)  # noqa: B023, E731
        assert got == {i: want(t) for i, _, t in points}


def test_pieces_follow_the_rows(spark, monkeypatch):
    from cohortforge.operators import running

    df = spark.range(3000).withColumn("x", F.col("id") * 1.5)
    monkeypatch.setattr(running, "PIECE_ROWS", 10)
    assert len(running.cut_points(df, F.col("x"))[0]) == 1023
    monkeypatch.setattr(running, "PIECE_ROWS", 100)
    assert len(running.cut_points(df, F.col("x"))[0]) == 63
    monkeypatch.setattr(running, "PIECE_ROWS", 3000)
    assert running.cut_points(df, F.col("x")) == [[]] and len(running.cut_points(df, F.col("x"), least=64)[0]) == 63



def test_no_events_gives_the_horizon(spark):
    rows = spark.createDataFrame([(0, 1.0, 0, 0.0, 10.0, "a"), (0, 2.0, 0, 0.0, 10.0, "b")], "arm int, w double, event int, start double, stop double, clone string")
    curve = V.counting_curve(rows, ["arm"], "start", "stop", "event", "w")
    r = V.restricted_mean(curve, ["arm"], 10.0, rows).first()
    assert abs(r.rmst - 10) < 1e-12 and abs(r.survival - 1) < 1e-12


def test_conditional_area_of_a_step_curve(spark):
    curve = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 0.8), (1, 5.0, 0.6)], "arm int, time double, survival double")
    r = V.restricted_mean(curve, ["arm"], 6.0, start=2.0).first()
    assert abs(r.rmst / 0.8 - 3.75) < 1e-12


def test_components_add_up(spark):
    df = spark.createDataFrame([(1.0, 0, 0.4, 1.5, 2.0), (2.0, 1, 0.5, 1.5, 2.0), (3.0, 0, 0.6, 2.5, 3.0), (4.0, 1, 0.5, 2.5, 3.0)], "y double, a int, e double, mu0 double, mu1 double")
    for scored in (K.clipped_scores(df, "y", "a", "e", "mu0", "mu1"), K.stabilised_scores(df, "y", "a", "e", "mu0", "mu1")):
        r = K.score_estimate(scored).first()
        assert abs(r.plugin + r.treated_residual + r.control_residual - r.estimate) < 1e-12


def test_scores_stay_finite_at_propensity_zero_and_one(spark):
    df = spark.createDataFrame([(1.0, 0, 0.0, 1.0, 2.0), (2.0, 1, 1.0, 1.0, 2.0), (2.0, 1, 0.5, 1.0, 2.0)], "y double, a int, e double, mu0 double, mu1 double")
    assert all(math.isfinite(r.score_num) for r in K.stabilised_scores(df, "y", "a", "e", "mu0", "mu1").collect())


def test_curve_reaches_zero_and_stays(spark):
    df = spark.createDataFrame([(1, 1.0, 1, 1.0), (1, 2.0, 1, 1.0), (0, 3.0, 0, 1.0)], "arm int, time double, event int, w double")
    got = {(r.arm, r.time): r.survival for r in V.weighted_curve(df, ["arm"], "time", "event", "w").collect()}
    assert got == {(1, 1.0): pytest.approx(0.5), (1, 2.0): 0.0}
    r = V.arm_contrast(df, "arm", "time", "event", "w", 4.0).first()
    assert r.rmst_0 == pytest.approx(4.0) and r.rmst_1 == pytest.approx(1.5)


def test_a_time_on_a_border_counts_in_two_intervals(spark):
    df = spark.createDataFrame([(1, 90.0, 0)], "id int, time double, event int")
    rows = V.person_period(df, 270.0, 90.0).orderBy("interval").collect()
    assert [(r.interval, r.censor_event) for r in rows] == [(0, 1), (1, 1)]


def test_pseudo_outcome_without_time_is_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 100.0)], "id int, time double")
    g = spark.createDataFrame([(i, k, 0.5) for i in (1, 2) for k in range(3)], "id int, interval int, g double")
    got = {r.id: r.pseudo for r in V.ipcw_pseudo(df, g, "id", "time", 270.0, 90.0, 0.1).collect()}
    assert got == {1: 0.0, 2: pytest.approx(200.0)}


def test_clipped_weights_are_clipped_at_each_step(spark):
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate((10.0, 10.0, 0.1, 0.0))], "id int, k int, f double")
    got = [r.weight for r in V.clipped_weights(df, ["id"], "k", "f", 0.01, 25.0).orderBy("k").collect()]
    assert got == pytest.approx([10.0, 25.0, 2.5, 0.01])


def test_checked_join_raises_on_a_repeated_key(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "w")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert J.checked_join(b, a.where("a <> 'y'"), ["k"], "left").count() == 2
    with pytest.raises(Exception, match="not unique"):
        J.checked_join(a, b, ["k"]).collect()
    assert J.checked_join(a, b, ["k"], cardinality="m:1").count() == 2


def test_bridge_wants_coverage(spark):
    rows = spark.createDataFrame([(1, 1), (2, 9)], "id int, k int")
    links, right = spark.createDataFrame([(1, 5)], "k int, n int"), spark.createDataFrame([(5, "x")], "n int, v string")
    assert J.bridge(rows, links, right, "k", "n", 0.5).count() == 2
    with pytest.raises(Exception, match="coverage"):
        J.bridge(rows, links, right, "k", "n").collect()


def test_step_lookup_left_limit(spark):
    p = spark.createDataFrame([(1, 2.0, "a"), (1, 0.5, "b")], "g int, t double, name string")
    c = spark.createDataFrame([(1, 1.0, 0.9), (1, 2.0, 0.5)], "g int, time double, s double")
    get = lambda **k: {r.name: r.s for r in J.step_lookup(p, c, ["g"], "t", "time", "s", **k).collect()}
    assert get() == {"a": 0.5, "b": 1.0}
    assert get(left_limit=True) == {"a": 0.9, "b": 1.0}


def test_tristate_and_coercion(spark):
    df = spark.createDataFrame([("Yes",), ("0.7",), ("0.2",), ("NA",), (None,), ("nan",), ("negative",)], "v string")
    assert [r.f for r in df.select(C.tristate("v").alias("f")).collect()] == [1, 1, 0, None, None, None, 0]
    assert [r.f for r in df.select(C.numeric("v").alias("f")).collect()] == [None, 0.7, 0.2, None, None, None, None]


def test_normal_quantile_and_log_gamma(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.z for r in df.select(C.normal_quantile("p").alias("z")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)
    xs = [0.5, 1.0, 2.0, 10.0, 171.5]
    got = [r.z for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.log_gamma("x").alias("z")).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], atol=1e-9)


def test_empty_sets_overlap_fully(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c", "c"])], "a array<string>, b array<string>")
    j, o = C.set_overlap("a", "b")
    assert [(round(r.j, 6), r.o) for r in df.select(j.alias("j"), o.alias("o")).collect()] == [(1.0, 1.0), (0.0, 1.0), (round(1 / 3, 6), 0.5)]


def test_flat_variance_variants(spark):
    row = spark.range(1).select(*(A.smd(F.lit(m), F.lit(1.0), F.lit(0.0), F.lit(0.0), flat).alias(n) for n, m, flat in (("a", 1.0, "null"), ("b", 1.0, "inf"), ("c", 2.0, "inf")))).first()
    assert row.a is None and row.b == 0.0 and row.c == float("inf")


def test_folds_are_balanced_and_groups_whole(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("int").alias("s"), (F.col("id") / 4).cast("long").alias("g"))
    n = [r["count"] for r in R.stratified_folds(df, "id", ["s"], 5).groupBy("s", "fold").count().collect()]
    assert n == [10] * 10
    assert R.grouped_folds(df, "g", "s", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


def test_bootstrap_counts_add_up(spark):
    keys = spark.range(50).select((F.col("id") * F.col("id") - 7).alias("id"))  # with gaps
    got = R.bootstrap_counts(keys, "id", 6).groupBy("replicate").agg(F.sum("times").alias("n")).collect()
    assert sorted((r.replicate, r.n) for r in got) == [(k, 50) for k in range(6)]
    assert R.bootstrap_counts(keys.limit(0), "id", 2).count() == 0
    with pytest.raises(Exception, match="not unique"):
        R.bootstrap_counts(keys.union(keys.limit(1)), "id", 2).collect()
    with pytest.raises(Exception, match="null"):
        R.bootstrap_counts(keys.union(spark.createDataFrame([(None,)], "id long")), "id", 2).collect()


def test_bootstrap_draws_have_the_moments_of_draws_with_replacement(spark):
    """Share of keys never drawn, variance of multiplicities, and spread of means, each within four Monte Carlo errors."""
    n, b = 1000, 60
    table = np.zeros((b, n))
    for r in R.bootstrap_counts(spark.range(n), "id", b, seed=4).collect():
        table[r.replicate, r.id] = r.times
    never = (table == 0).mean(axis=1)
    assert abs(never.mean() - (1 - 1 / n) ** n) < 4 * never.std(ddof=1) / np.sqrt(b)
    variance = table.var(axis=1)
    assert abs(variance.mean() - (1 - 1 / n)) < 4 * variance.std(ddof=1) / np.sqrt(b)
    x = np.linspace(-1, 1, n) ** 3
    means = table @ x / n
    assert abs(means.std(ddof=1) / (x.std() / np.sqrt(n)) - 1) < 4 / np.sqrt(2 * b)
    assert abs(means.mean() - x.mean()) < 4 * x.std() / np.sqrt(n * b)
    flat = np.corrcoef(table)
    assert abs(flat[np.triu_indices(b, 1)]).max() < 6 / np.sqrt(n)  # replicates are not one another's shifts


def test_dense_positions_have_no_gap(spark):
    keys = spark.createDataFrame([(k,) for k in (10**12, -5, 3, 7, 10**15)], "k long")
    assert {r.k: r.pos for r in R.dense_positions(keys, "k").collect()} == {-5: 0, 3: 1, 7: 2, 10**12: 3, 10**15: 4}


def test_ladder_goes_down_until_strata_suffice(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).alias("t"), (F.col("id") < 3).cast("int").alias("e"))
    rungs = lambda ladder: {r.rung for r in R.ladder_folds(df, "id", ladder, 5).collect()}
    assert rungs([["t", "e"], ["t"], ["e"]]) == {"t"} and rungs([["e"]]) == {"none"} and rungs([["t"], ["e"]]) == {"t"}
    n = R.ladder_folds(df, "id", [["t", "e"], ["t"]], 5).groupBy("t", "fold").count().collect()
    assert sorted(r["count"] for r in n) == [6] * 10


def test_running_folds_against_loops(spark):
    """Sums, extremes and carried values in both directions, with an outlier, ties, nulls in groups and values."""
    from cohortforge.operators.running import running

    rng = np.random.default_rng(6)
    rows = [(None if i % 9 == 0 else i % 3, float(rng.integers(40)) if i else 1e18, i, None if i % 4 == 0 else float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, tie int, v double")
    for down in (False, True):
        for inclusive in (True, False):
            folds = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "held": ("last", F.col("v"))}
            got = {r.tie: (r.s, r.lo, r.hi, r.held) for r in running(df, ["g"], "x", folds, down, inclusive, ["tie"]).collect()}
            assert len(got) == len(rows)
            for g in (None, 0, 1, 2):
                own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]), reverse=down)
                for k, r in enumerate(own):
                    seen = [x[3] for x in own[: k + inclusive] if x[3] is not None]
                    s, lo, hi, held = got[r[2]]
                    assert abs(s - sum(seen)) < 1e-9 and (lo, hi, held) == ((min(seen), max(seen), seen[-1]) if seen else (None, None, None))


def test_exact_quantiles_against_numpy(spark):
    from cohortforge.operators.running import exact_quantiles

    rng = np.random.default_rng(2)
    rows = [(int(i % 3), None if i % 11 == 0 else float(rng.integers(30)) if i % 3 else float(rng.lognormal(0, 9))) for i in range(700)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.025, "m": 0.5, "z": 1.0}).collect()}
    for g in range(3):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose([got[g].a, got[g].m, got[g].z], np.quantile(v, [0.025, 0.5, 1.0]), rtol=1e-9)


def test_lookup_in_the_order_of_draws(spark):
    draws = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "pos int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert [(r.pos, r.v) for r in J.ordered_lookup(draws, table, "k").orderBy("pos").collect()] == [(0, 2), (1, 1), (2, 2)]
    with pytest.raises(Exception, match="not found"):
        J.ordered_lookup(draws, table.where("k <> 'a'"), "k").collect()
    left, right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(2, "q", "?"), (1, "p", "?")], "k int, b string, a string")
    assert sorted(tuple(r) for r in J.bind_columns(left, right, "k").collect()) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(Exception, match="one side"):
        J.bind_columns(left, right.where("k = 1"), "k").collect()


def brute_c(rows, weight=lambda t: 1.0):
    num = den = 0.0
    for t, e, r in rows:
        if e:
            for t2, _, r2 in rows:
                if t2 > t:
                    den += weight(t)
                    num += weight(t) * (1.0 if r > r2 else 0.5 if r == r2 else 0.0)
    return num / den


def test_concordance_against_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(float(t), int(e), float(r)) for t, e, r in zip(rng.integers(1, 30, 200), rng.integers(0, 2, 200), rng.integers(0, 12, 200), strict=True)]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, t double, e int, r double")
    assert M.concordance(df, ["g"], "t", "e", "r").first().c_index == pytest.approx(brute_c(rows))

    def g(t):  # censoring survival just before t
        s = 1.0
        for u in sorted({x for x, e, _ in rows if not e and x < t}):
            s *= 1 - sum(1 for x, e, _ in rows if x == u and not e) / sum(1 for x, _, _ in rows if x >= u)
        return s

    assert M.uno(df, ["g"], "t", "e", "r").first().c_index == pytest.approx(brute_c(rows, lambda t: g(t) ** -2))


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 0, 2.0), (1, 0, 1.0), (1, None, 5.0)], "g int, y int, r double")
    assert M.auc(df, ["g"], "y", "r").first().auc == pytest.approx(0.75)


def test_bh_is_monotone_and_capped(spark):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate((0.01, 0.02, 0.03, 0.9))], "f int, k int, p double")
    assert [round(r.q, 6) for r in O.bh_adjust(df, ["f"], "p", "k").orderBy("k").collect()] == [0.04, 0.04, 0.04, 0.9]


def test_cox_solves_the_score_equation():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    t = np.ceil(rng.exponential(1 / np.exp(x @ np.array([0.7, -0.4]))) * 20)
    e = (rng.random(300) < 0.8).astype(int)
    b = D.cox_newton(x, t, e)
    assert np.allclose(b, [0.7, -0.4], atol=0.25)

    def loglik(b):
        out, eta = 0.0, x @ b
        for u in np.unique(t[e == 1]):
            dead, risk = (t == u) & (e == 1), t >= u
            out += eta[dead].sum() - sum(np.log(np.exp(eta[risk]).sum() - k / dead.sum() * np.exp(eta[dead]).sum()) for k in range(int(dead.sum())))
        return out

    h = 1e-5
    assert all(abs(loglik(b + h * u) - loglik(b - h * u)) / (2 * h) < 1e-3 for u in np.eye(2))


def test_cox_over_many_tasks_equals_one_group_in_a_task(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    t = np.ceil(rng.exponential(1 / np.exp(x @ np.array([0.7, -0.4]))) * 8)
    e = (rng.random(240) < 0.7).astype(int)
    rows = [("ab"[i % 2], float(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(240)] + [("c", 1.0, 0, 1.0, 1.0), ("c", 2.0, 0, 1.0, 2.0), ("a", 1.0, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, t double, e int, u double, v double")
    one = {(r.g, r.feature): r.coefficient for r in D.cox_by_group(df, ["g"], "t", "e", ["u", "v"], 0.01).collect()}
    many = {(r.g, r.feature): r.coefficient for r in D.cox_by_group(df, ["g"], "t", "e", ["u", "v"], 0.01, task_rows=50).collect()}
    assert one.keys() == many.keys() and one["c", "u"] is None and many["c", "u"] is None
    assert all(abs(one[k] - many[k]) < 1e-7 for k in one if one[k] is not None)


def test_logistic_mle_and_tilt(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=500)
    a = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame([(float(u), int(v)) for u, v in zip(x, a, strict=True)], "x double, a int")
    b = D.logistic_mle(df, "a", ["x"])
    e = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
    assert abs((a - e).sum()) < 1e-6 and abs(((a - e) * x).sum()) < 1e-6
    lam = D.exponential_tilt(df, ["x"], [0.5])
    w = np.exp(x * lam[0])
    assert (w * x).sum() / w.sum() == pytest.approx(0.5, abs=1e-4)


def test_t_tail():
    assert D._log_beta_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert D._log_beta_tail(0.0, 5) == pytest.approx(1.0)


def test_contract_gates_and_manifest(spark):
    good = spark.createDataFrame([("P1", 1.0, 1), ("P2", 2.0, 0)], "id string, time double, event int")
    assert G.enforce_contract(good, "id", ["time"], ["event"]).count() == 2
    bad = good.union(spark.createDataFrame([("P1", -1.0, 3), (None, None, None)], good.schema))
    row = G.contract(bad, "id", ["time"], ["event"]).first()
    assert (row.missing_keys, row.repeated_keys, row.bad_time, row.bad_event) == (1, 1, 2, 2)
    with pytest.raises(G.GateError):
        G.enforce_contract(bad, "id", ["time"], ["event"])
    with pytest.raises(G.GateError):
        G.enforce_gates(G.gates(good.agg(F.count("*").alias("n")), {"n": 3}))
    locked = G.manifest(spark, {"a": good, "b": bad})
    status = {r.table: r.status for r in G.verify_manifest(locked, G.manifest(spark, {"a": good.orderBy(F.desc("id")), "b": good, "c": good})).collect()}
    assert status == {"a": "ok", "b": "changed", "c": "new"}


def test_upsert_last_wins(spark):
    held = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, s int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, s int")
    assert sorted((r.k, r.v) for r in G.upsert(held, new, ["k"], "s").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "arm int, time double, event int, w double, id int")
    assert V.weighted_curve(none, ["arm"], "time", "event", "w").count() == 0
    assert O.average_ranks(none, ["arm"], "time").count() == 0
    assert M.concordance(none, ["arm"], "time", "event", "w").count() == 0
    assert A.weighted_moments(none, ["arm"], "time", "w").count() == 0
