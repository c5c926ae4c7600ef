"""Queries: survival, causal estimators, resampling, accuracy, governance, harmonisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.columns import tidy
from cohortforge.operators import aggregates as A
from cohortforge.operators import causal as K
from cohortforge.operators import govern as G
from cohortforge.operators import metrics as M
from cohortforge.operators import resample as R
from cohortforge.operators import survival as V
from cohortforge.operators.running import exact_quantiles
from cohortforge.plans.registry import query
from cohortforge.plans.shapes import COHORT, OUTCOMES, RECORDS, REPLICATES, STARTS, cohort, hashed_sql, outcomes, records, replicates, starts, table

# ---- survival


_GRID = "grid AS (SELECT CAST(k AS INTEGER) AS interval, k * 90.0::DOUBLE AS start, least((k + 1) * 90.0::DOUBLE, 730.0::DOUBLE) AS stop FROM (SELECT unnest(range(0, 9)) AS k))"


@query("sv_interval_grid", f"WITH {COHORT}, {_GRID} SELECT interval, start, stop AS \"end\", count(*) FILTER (time >= start) AS at_risk, round(sum(greatest(least(time, stop) - start, 0)), 3) AS lived FROM c, grid GROUP BY 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The grid with the subjects that are there at the start of each interval, and the time that they live in it."""
    each = cohort(spark, d).select("time", F.explode(V.interval_grid(730.0, 90.0)).alias("x")).select("time", "x.*")
    lived = F.greatest(F.least("time", "end") - F.col("start"), F.lit(0.0))
    return each.groupBy("interval", "start", "end").agg(F.count_if(F.col("time") >= F.col("start")).alias("at_risk"), tidy(F.sum(lived), 3).alias("lived"))


@query("sv_person_period", f"WITH {COHORT}, {_GRID} SELECT interval, arm, count(*) AS n, CAST(sum(CASE WHEN event = 0 AND time BETWEEN start AND stop THEN 1 ELSE 0 END) AS BIGINT) AS censored, CAST(sum(CASE WHEN event = 1 AND time BETWEEN start AND stop THEN 1 ELSE 0 END) AS BIGINT) AS events FROM c JOIN grid ON time >= start GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.person_period(cohort(spark, d), 730.0, 90.0).groupBy("interval", "arm").agg(F.count("*").alias("n"), F.sum("censor_event").alias("censored"), F.sum("event_in").alias("events"))


@query("sv_single_exit_period", f"WITH {COHORT}, x AS (SELECT id, CASE WHEN event = 1 THEN CAST(floor(time / 90) AS INTEGER) END AS ev, CASE WHEN event = 0 THEN CAST(floor(time / 90) AS INTEGER) END AS ce FROM c) SELECT k AS interval, count(*) AS n, count(*) FILTER (ev = k) AS events, count(*) FILTER (ce = k AND ev IS DISTINCT FROM k) AS censored FROM x JOIN (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k) ON k <= least(coalesce(ev, 8), coalesce(ce, 8), 7) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.floor(F.col("time") / 90).cast("int")
    c = cohort(spark, d).select("id", F.when(F.col("event") == 1, k).alias("ev"), F.when(F.col("event") == 0, k).alias("ce"))
    return V.single_exit_period(c, "ev", "ce", 8).groupBy("interval").agg(F.count("*").alias("n"), F.sum("event_in").cast("long").alias("events"), F.sum("censor_in").cast("long").alias("censored"))


_KM = """t AS (SELECT arm, time, sum(w) AS w, sum(CASE WHEN event = 1 THEN w ELSE 0 END) AS events FROM src GROUP BY 1, 2),
 k AS (SELECT arm, time, events, sum(w) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM t),
 km AS (SELECT arm, time, risk, events, CASE WHEN bool_or(1 - events / risk <= 1e-12) OVER o THEN 0 ELSE exp(sum(CASE WHEN 1 - events / risk <= 1e-12 THEN 0 ELSE ln(1 - events / risk) END) OVER o) END AS survival FROM k WHERE events > 0 WINDOW o AS (PARTITION BY arm ORDER BY time))"""


@query("sv_weighted_km", f"WITH {COHORT}, src AS (SELECT arm, time, event, e AS w FROM c), {_KM} SELECT arm, time, round(risk, 5) AS risk, round(events, 6) AS events, round(survival, 6) AS survival FROM km")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.weighted_curve(cohort(spark, d), ["arm"], "time", "event", "e").select("arm", "time", tidy("risk", 5).alias("risk"), tidy("events").alias("events"), tidy("survival").alias("survival"))


_OW = "CASE WHEN arm = 1 THEN 1 - e ELSE e END"
_RMST = """a AS (SELECT arm, time, survival, coalesce(lead(time) OVER (PARTITION BY arm ORDER BY time), 730.0) AS nxt FROM km WHERE time <= 730),
 m AS (SELECT arm, min(time) + sum(survival * (nxt - time)) AS rmst, arg_max(survival, time) AS s FROM a GROUP BY 1)"""


@query(
    "sv_rmst_contrast",
    f"""WITH {COHORT}, src AS (SELECT arm, least(time, 730.0) AS time, CASE WHEN time > 730 THEN 0 ELSE event END AS event, {_OW} AS w FROM c), {_KM}, {_RMST}
 SELECT round(x.rmst, 4) AS rmst_1, round(y.rmst, 4) AS rmst_0, round(x.s, 6) AS survival_1, round(y.s, 6) AS survival_0, round(x.rmst - y.rmst, 4) AS rmst_difference, round(x.s - y.s, 6) AS survival_difference FROM m x, m y WHERE x.arm = 1 AND y.arm = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("w", K.overlap_weight("arm", "e"))
    r = V.arm_contrast(c, "arm", "time", "event", "w", 730.0)
    return r.select(*(tidy(x, 4 if "rmst" in x else 6).alias(x) for x in r.columns))


@query(
    "sv_counting_km",
    f"""WITH {COHORT}, s AS (SELECT arm, x2 * 20 AS a, x2 * 20 + time AS b, event, e FROM c), ch AS (SELECT arm, a AS t, e AS en, 0 AS le, 0 AS d FROM s UNION ALL SELECT arm, b, 0, e, CASE WHEN event = 1 THEN e ELSE 0 END FROM s),
 g AS (SELECT arm, t, sum(en) AS en, sum(le) AS le, sum(d) AS d FROM ch GROUP BY 1, 2), r AS (SELECT arm, t, d, coalesce(sum(en - le) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS risk FROM g),
 q AS (SELECT * FROM r WHERE d > 0 AND risk > 0) SELECT arm, t AS time, round(risk, 4) AS risk, round(CASE WHEN bool_or(1 - d / risk <= 1e-12) OVER o THEN 0 ELSE exp(sum(CASE WHEN 1 - d / risk <= 1e-12 THEN 0 ELSE ln(1 - d / risk) END) OVER o) END, 6) AS survival FROM q WINDOW o AS (PARTITION BY arm ORDER BY t)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cohort(spark, d).withColumns({"a": F.col("x2") * 20, "b": F.col("x2") * 20 + F.col("time")})
    return V.counting_curve(rows, ["arm"], "a", "b", "event", "e").select("arm", "time", tidy("risk", 4).alias("risk"), tidy("survival").alias("survival"))


@query("sv_reverse_km", f"WITH {COHORT}, src AS (SELECT arm, time, 1 - event AS event, 1.0::DOUBLE AS w FROM c), {_KM} SELECT arm, time, round(survival, 6) AS g FROM km")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.censoring_survival(cohort(spark, d), ["arm"], "time", "event").select("arm", "time", tidy("g").alias("g"))


_HAZ = f"""pp AS (SELECT c.*, interval, start, stop, CASE WHEN event = 0 AND time BETWEEN start AND stop THEN 1 ELSE 0 END AS cens FROM c JOIN grid ON time >= start),
 h AS (SELECT arm, interval, (sum(cens) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS hazard FROM pp GROUP BY 1, 2),
 gg AS (SELECT arm, interval, exp(coalesce(sum(ln(1 - hazard)) OVER (PARTITION BY arm ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM h)"""


def censoring_by_interval(spark: SparkSession, d: str) -> DataFrame:
    """arm, interval, hazard and survival before it, of censoring."""
    h = V.empirical_hazard(V.person_period(cohort(spark, d), 730.0, 90.0), ["arm"], "interval", "censor_event")
    return V.running_survival(h, ["arm"], "interval", "hazard", "g")


@query("wn_running_survival", f"WITH {COHORT}, {_GRID}, {_HAZ} SELECT arm, interval, round(hazard, 6) AS hazard, round(g, 6) AS g FROM h JOIN gg USING (arm, interval)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return censoring_by_interval(spark, d).select("arm", "interval", tidy("hazard").alias("hazard"), tidy("g").alias("g"))


@query("sv_ipcw_pseudo", f"WITH {COHORT}, {_GRID}, {_HAZ}, y AS (SELECT c.id, sum((least(time, stop) - start) / greatest(least(g, 1), 0.1)) AS v FROM c JOIN grid ON time > start JOIN gg ON gg.arm = c.arm AND gg.interval = grid.interval GROUP BY 1) SELECT c.id, round(coalesce(v, 0), 5) AS pseudo FROM c LEFT JOIN y ON y.id = c.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    own = c.select("id", "arm").join(censoring_by_interval(spark, d).select("arm", "interval", "g"), "arm").select("id", "interval", "g")
    return V.ipcw_pseudo(c, own, "id", "time", 730.0, 90.0, 0.1).select("id", tidy("pseudo", 5).alias("pseudo"))


@query("sv_censor_diagnostics", f"WITH {COHORT}, {_GRID}, {_HAZ} SELECT id, round(min(g), 6) AS min_g, round(median(g), 6) AS median_g, round(max(1 / g), 6) AS max_weight FROM pp JOIN gg ON gg.arm = pp.arm AND gg.interval = pp.interval GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    pp = V.person_period(cohort(spark, d), 730.0, 90.0).select("id", "arm", "interval")
    x = pp.join(censoring_by_interval(spark, d).select("arm", "interval", "g"), ["arm", "interval"])
    return x.groupBy("id").agg(tidy(F.min("g")).alias("min_g"), tidy(F.expr("percentile(g, 0.5)")).alias("median_g"), tidy(F.max(1 / F.col("g"))).alias("max_weight"))


@query("sv_landmark_cohort", f"WITH {STARTS} SELECT id, CASE WHEN started BETWEEN 0 AND 180 THEN 1 ELSE 0 END AS analysis_treatment, CASE WHEN started > 180 THEN 1 ELSE 0 END AS later_initiator, time - 180 AS analysis_time FROM s WHERE time > 180 AND ambiguous = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.landmark_cohort(starts(spark, d), "time", "started", "ambiguous", 180.0).select("id", "analysis_treatment", "later_initiator", "analysis_time")


_CLONE = """cl AS (SELECT s.*, strategy, CASE WHEN strategy = 0 AND started IS NOT NULL AND started <= 180 THEN started WHEN strategy = 1 AND NOT coalesce(started <= 180, FALSE) THEN 180.0 END AS cut FROM s, (SELECT unnest([0, 1]) AS strategy)),
 ce AS (SELECT *, coalesce(cut < time, FALSE) AS off, least(CASE WHEN coalesce(cut < time, FALSE) THEN cut ELSE time END, 730.0) AS fin FROM cl),
 cr AS (SELECT id, strategy, interval, start, least(stop, fin) AS stop, (fin <= stop OR stop >= 730) AS last, off, event AS ev, time, cut FROM ce JOIN grid ON start < fin OR (start = 0 AND fin = 0))"""


@query("sv_clone_censor", f"WITH {STARTS}, {_GRID}, {_CLONE} SELECT strategy, interval, count(*) AS n, count(*) FILTER (last AND NOT off AND ev = 1 AND time <= 730) AS events, count(*) FILTER (last AND NOT off AND ev = 0 AND time <= 730) AS natural, count(*) FILTER (last AND off AND cut <= 730) AS artificial, round(sum(stop - start), 6) AS lived FROM cr GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = V.clone_censor(starts(spark, d), "id", "time", "event", "started", 180.0, 730.0, 90.0)
    return rows.groupBy("strategy", "interval").agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.sum("natural_censor").alias("natural"), F.sum("artificial_censor").alias("artificial"), tidy(F.sum(F.col("stop") - F.col("start"))).alias("lived"))


@query(
    "wn_clipped_fold",
    """WITH RECURSIVE li AS (SELECT l_orderkey, l_linenumber, min(l_quantity) / 21.0 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
 w AS (SELECT l_orderkey, l_linenumber, k, greatest(0.01, least(25.0, f))::DOUBLE AS weight FROM li WHERE k = 1 UNION ALL SELECT li.l_orderkey, li.l_linenumber, li.k, greatest(0.01, least(25.0, w.weight * li.f))::DOUBLE FROM w JOIN li ON li.l_orderkey = w.l_orderkey AND li.k = w.k + 1)
 SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS step, round(weight, 6) AS weight FROM w""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q")).withColumn("f", F.col("q") / 21.0)
    return V.clipped_weights(li, ["l_orderkey"], "l_linenumber", "f", 0.01, 25.0).select("l_orderkey", F.col("l_linenumber").cast("long").alias("step"), tidy("weight").alias("weight"))


@query("sv_weight_cap", f"WITH {COHORT}, q AS (SELECT quantile_cont(1 / e, 0.95) AS cap FROM c) SELECT id, round(least(1 / e, cap), 6) AS capped FROM c, q")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.cap_weights(cohort(spark, d).select("id", (1 / F.col("e")).alias("w")), "w", quantile=0.95).select("id", tidy("capped").alias("capped"))


@query("sv_hazard_rmst", f"WITH {COHORT} SELECT DISTINCT x2, round(90 * list_sum(list_transform(range(1, 9), lambda k: (1 - (0.02 + x2 / 50)) ^ k)), 6) AS rmst, round((0.02 + x2 / 50) * (1 - ((1 - (0.02 + x2 / 50)) * 0.97) ^ 8) / (1 - (1 - (0.02 + x2 / 50)) * 0.97), 6) AS probability FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = cohort(spark, d).select("x2").distinct().withColumns({"h": F.lit(0.02) + F.col("x2") / 50, "g": F.lit(0.03)})
    return h.select("x2", tidy(V.hazard_restricted_mean("h", 8, 90.0)).alias("rmst"), tidy(V.event_probability("h", "g", 8)).alias("probability"))


# ---- causal


@query("ca_overlap_weights", f"WITH {COHORT} SELECT id, round({_OW}, 6) AS overlap FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", tidy(K.overlap_weight("arm", "e")).alias("overlap"))


@query("ca_stabilized_iptw", f"WITH {COHORT}, k AS (SELECT * FROM c WHERE e BETWEEN 0.1 AND 0.9), p AS (SELECT avg(arm) AS p FROM k), w AS (SELECT id, CASE WHEN arm = 1 THEN p / e ELSE (1 - p) / (1 - e) END AS w FROM k, p), q AS (SELECT quantile_cont(w, 0.99) AS cap FROM w) SELECT id, round(least(w, cap), 6) AS iptw FROM w, q")
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.stabilised_weights(cohort(spark, d), "arm", "e", truncate=0.99, trim=(0.1, 0.9)).select("id", tidy("iptw").alias("iptw"))


_EST = "ROUND_(sum(num) / sum(h)) AS estimate, ROUND_(sum(plug) / sum(h)) AS plugin, ROUND_(sum(tr) / sum(h)) AS treated_residual, ROUND_(-sum(co) / sum(h)) AS control_residual"


def _aipw(e: str, tr: str, co: str) -> str:
    return f"""WITH {OUTCOMES}, z AS (SELECT *, {e} AS ee FROM o), x AS (SELECT *, ee * (1 - ee) AS h, ee * (1 - ee) * (mu1 - mu0) AS plug, {tr} AS tr, {co} AS co FROM z), n AS (SELECT *, plug + tr - co AS num FROM x),
 t AS (SELECT count(*) AS n, sum(num) / sum(h) AS est, avg(h) AS mh, {_EST.replace('ROUND_(', 'round(1.0 * ').replace(') AS', ', 5) AS')} FROM n), f AS (SELECT stddev_samp((num - est * h) / mh) / sqrt(any_value(t.n)) AS se FROM n, t)
 SELECT t.n, estimate, plugin, treated_residual, control_residual, round(se, 5) AS se, round(est - 1.96 * se, 4) AS ci_low, round(est + 1.96 * se, 4) AS ci_high FROM t, f"""


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("n", *(tidy(c, 4 if c.startswith("ci") else 5).alias(c) for c in e.columns if c != "n"))


@query("ca_aipw_clipped", _aipw("greatest(least(e, 0.8), 0.2)", "ee * (1 - ee) * arm / ee * (y - mu1)", "ee * (1 - ee) * (1 - arm) / (1 - ee) * (y - mu0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.score_estimate(K.clipped_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1", 0.2, 0.8)))


@query("ca_aipw_stabilized", _aipw("e", "arm * (1 - ee) * (y - mu1)", "(1 - arm) * ee * (y - mu0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.score_estimate(K.stabilised_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1")))


@query("ca_crossfit_arm_mean", f"WITH {OUTCOMES}, f AS (SELECT DISTINCT fold FROM o) SELECT f.fold, round(avg(y) FILTER (arm = 0), 5) AS mu0, round(avg(y) FILTER (arm = 1), 5) AS mu1 FROM f JOIN o ON o.fold <> f.fold GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = K.crossfit_arm_means(outcomes(spark, d).select("y", "arm", "fold"), "y", "arm", "fold")
    return m.groupBy("fold").agg(tidy(F.first("mu0"), 5).alias("mu0"), tidy(F.first("mu1"), 5).alias("mu1"))


_SC = f"{OUTCOMES}, sc AS (SELECT *, e * (1 - e) AS h, e * (1 - e) * (mu1 - mu0) + arm * (1 - e) * (y - mu1) - (1 - arm) * e * (y - mu0) AS num FROM o)"


@query("ca_partition_scores", f"WITH {_SC}, u AS (SELECT cust, avg(num) AS a, avg(h) AS b FROM sc GROUP BY 1) SELECT count(*) AS n_units, round(sum(a) / sum(b), 5) AS estimate FROM u")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = A.ratio_estimand(K.stabilised_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1"), "cust", "score_num", "h")
    return r.select("n_units", tidy("estimate", 5).alias("estimate"))


@query("wn_leave_one_out", f"WITH {_SC}, g AS (SELECT fold, sum(num) AS a, sum(h) AS b, count(*) AS n FROM sc GROUP BY 1) SELECT fold, n, round(a / b, 5) AS alone, round((sum(a) OVER () - a) / (sum(b) OVER () - b), 5) AS without, round(sum(a) OVER () / sum(b) OVER (), 5) AS overall FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = K.leave_one_group_out(K.stabilised_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1"), "fold")
    return r.select("fold", "n", *(tidy(c, 5).alias(c) for c in ("alone", "without", "overall")))


@query("ca_calibration", f"WITH {OUTCOMES}, r AS (SELECT arm, y, CASE WHEN arm = 1 THEN mu1 ELSE mu0 END AS p FROM o) SELECT CASE WHEN grouping(arm) = 1 THEN 'all' ELSE CAST(arm AS VARCHAR) END AS arm, count(*) AS n, round(avg(y - p), 5) AS bias, round(sqrt(avg((y - p) ^ 2)), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(avg(y), 5) AS mean_y, round(avg(p), 5) AS mean_pred FROM r GROUP BY CUBE (arm)")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = K.calibration(outcomes(spark, d), "y", "arm", "mu0", "mu1")
    return r.select("arm", "n", *(tidy(c, 5).alias(c) for c in r.columns[2:]))


_FAM = {"purchase": "chemo", "signup": "hormone", "error": "radiation"}


@query(
    "ca_sequence_registry",
    f"""WITH {RECORDS}, g AS (SELECT patient, count(*) AS n_records, min(day) FILTER (family = 'purchase' AND day >= 0) AS chemo_start, min(day) FILTER (family = 'signup' AND day >= 0) AS hormone_start,
 coalesce(bool_or(family = 'purchase'), FALSE) AS ca, coalesce(bool_or(family = 'signup'), FALSE) AS ha FROM r GROUP BY 1)
 SELECT patient, n_records, chemo_start, hormone_start, CASE WHEN chemo_start IS NULL AND hormone_start IS NULL THEN 'neither' WHEN hormone_start IS NULL THEN 'chemo_only' WHEN chemo_start IS NULL THEN 'hormone_only' WHEN chemo_start < hormone_start THEN 'chemo_first' WHEN chemo_start > hormone_start THEN 'hormone_first' ELSE 'same_day' END AS sequence_order,
 CASE WHEN chemo_start <= 3 THEN CASE WHEN hormone_start <= 3 THEN 'both_by_landmark' ELSE 'chemo_by_landmark' END WHEN hormone_start <= 3 THEN 'hormone_by_landmark' ELSE 'none_by_landmark' END AS landmark_category,
 CASE WHEN (ca AND chemo_start IS NULL) OR (ha AND hormone_start IS NULL) THEN 0 ELSE 1 END AS ascertainable FROM g""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = K.sequence_registry(records(spark, d), "patient", "family", "day", _FAM, 3.0)
    return r.select("patient", "n_records", "chemo_start", "hormone_start", "sequence_order", "landmark_category", "ascertainable")


@query("ca_sequence_audit", f"WITH {RECORDS}, g AS (SELECT patient, count(*) AS n, min(day) FILTER (family = 'purchase' AND day >= 0) AS a, min(day) FILTER (family = 'signup' AND day >= 0) AS b FROM r GROUP BY 1), s AS (SELECT CASE WHEN a < b THEN 1 ELSE 0 END AS first, n FROM g WHERE a IS NOT NULL AND b IS NOT NULL) SELECT first, count(*) AS n_patients, round(avg(n), 6) AS mean_records, round(stddev_samp(n), 6) AS sd_records FROM s GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = K.sequence_registry(records(spark, d), "patient", "family", "day", _FAM, 3.0).where("chemo_start is not null and hormone_start is not null")
    return r.groupBy((F.col("chemo_start") < F.col("hormone_start")).cast("int").alias("first")).agg(F.count("*").alias("n_patients"), tidy(F.avg("n_records")).alias("mean_records"), tidy(F.stddev_samp("n_records")).alias("sd_records"))


@query("ca_target_bridge", f"WITH {OUTCOMES}, u AS (SELECT 'unweighted' AS target, avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS v FROM o UNION ALL SELECT 'overlap', sum(y * (1 - e)) FILTER (arm = 1) / sum(1 - e) FILTER (arm = 1) - sum(y * e) FILTER (arm = 0) / sum(e) FILTER (arm = 0) FROM o UNION ALL SELECT 'ipw', sum(y / e) FILTER (arm = 1) / sum(1 / e) FILTER (arm = 1) - sum(y / (1 - e)) FILTER (arm = 0) / sum(1 / (1 - e)) FILTER (arm = 0) FROM o) SELECT target, round(v, 5) AS estimate, round(v - max(v) FILTER (target = 'unweighted') OVER (), 5) AS shift FROM u")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, y = F.col("arm"), F.col("y")
    schemes = {"unweighted": F.lit(1.0), "overlap": K.overlap_weight("arm", "e"), "ipw": F.when(a == 1, 1 / F.col("e")).otherwise(1 / (1 - F.col("e")))}
    mean = lambda w, k: F.sum(F.when(a == k, w * y)) / F.sum(F.when(a == k, w))
    wide = outcomes(spark, d).agg(*((mean(w, 1) - mean(w, 0)).alias(n) for n, w in schemes.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).alias("v"), (F.col(n) - F.col("unweighted")).alias("s")) for n in schemes))).alias("x")
    return wide.select(rows).select("x.target", tidy("x.v", 5).alias("estimate"), tidy("x.s", 5).alias("shift"))


# ---- resampling


@query("rs_stratified_folds", f"WITH {COHORT} SELECT id, CAST((row_number() OVER (PARTITION BY arm, event ORDER BY {hashed_sql('0', 'id')}, id) - 1) % 5 AS INTEGER) AS fold FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified_folds(cohort(spark, d), "id", ["arm", "event"], 5).select("id", "fold")


@query(
    "rs_ladder_folds",
    f"""WITH {COHORT}, n AS (SELECT (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY cust, event)) AS a, (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY cust)) AS b),
 r AS (SELECT CASE WHEN a >= 5 THEN 'custxevent' WHEN b >= 5 THEN 'cust' ELSE 'event' END AS rung FROM n)
 SELECT id, rung, CAST((row_number() OVER (PARTITION BY CASE WHEN rung <> 'event' THEN cust END, CASE WHEN rung <> 'cust' THEN event END ORDER BY {hashed_sql('0', 'id')}, id) - 1) % 5 AS INTEGER) AS fold FROM c, r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.ladder_folds(cohort(spark, d), "id", [["cust", "event"], ["cust"], ["event"]], 5).select("id", "rung", "fold")


@query("rs_grouped_folds", f"WITH {COHORT}, g AS (SELECT cust, max(event) AS s FROM c GROUP BY 1), f AS (SELECT cust, CAST((row_number() OVER (PARTITION BY s ORDER BY {hashed_sql('0', 'cust')}, cust) - 1) % 5 AS INTEGER) AS fold FROM g) SELECT id, fold FROM c JOIN f USING (cust)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_folds(cohort(spark, d), "cust", "event", 5).select("id", "fold")


_DRAWS = f"k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), dr AS (SELECT r AS replicate, {hashed_sql('0', 'r', 'pos')} % n AS pos FROM k, (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS r)), bt AS (SELECT replicate, c_custkey, count(*) AS times FROM dr JOIN k USING (pos) GROUP BY ALL)"


@query("rs_bootstrap_multiplicity", f"WITH {_DRAWS} SELECT replicate, c_custkey, times FROM bt")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.bootstrap_counts(table(spark, d, "customer"), "c_custkey", 20)


@query("rs_bootstrap_interval", f"WITH {_DRAWS}, m AS (SELECT replicate, sum(times * c_acctbal) / sum(times) AS v FROM bt JOIN customer USING (c_custkey) GROUP BY 1), p AS (SELECT avg(c_acctbal) AS point FROM customer) SELECT count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.025), 4) AS percentile_low, round(quantile_cont(v, 0.975), 4) AS percentile_high, round(2 * any_value(point) - quantile_cont(v, 0.975), 4) AS basic_low, round(any_value(point) - 1.96 * stddev_samp(v), 4) AS normal_low FROM m, p")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    drawn = R.bootstrap_counts(c, "c_custkey", 20).join(c, "c_custkey")
    m = drawn.groupBy("replicate").agg((F.sum(F.col("times") * F.col("c_acctbal")) / F.sum("times")).alias("v"))
    i = R.intervals(m.join(F.broadcast(c.agg(F.avg("c_acctbal").alias("point")))), [], "v", F.col("point"))
    return i.select("n", *(tidy(x, 4).alias(x) for x in ("mean", "sd", "percentile_low", "percentile_high", "basic_low", "normal_low")))


@query(
    "rs_intervals",
    f"""WITH {REPLICATES} SELECT scenario, method, count(estimate) AS n, round(avg(estimate), 4) AS mean, round(stddev_samp(estimate) / sqrt(count(estimate)), 4) AS mcse, round(quantile_cont(estimate, 0.025), 4) AS percentile_low, round(9 - quantile_cont(estimate, 0.025), 4) AS basic_high, round(4.5 - 1.96 * stddev_samp(estimate), 4) AS normal_low,
 round(abs(avg(estimate) - 4.5) / (stddev_samp(estimate) / sqrt(count(estimate))), 5) AS centering FROM p GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = R.intervals(replicates(spark, d), ["scenario", "method"], "estimate", F.col("truth"))
    return i.select("scenario", "method", "n", *(tidy(c, 4).alias(c) for c in ("mean", "mcse", "percentile_low", "basic_high", "normal_low")), tidy("centering", 5).alias("centering"))


@query(
    "rs_sim_summary",
    f"""WITH {REPLICATES}, x AS (SELECT *, CASE WHEN ok = 1 THEN estimate - truth END AS err, CASE WHEN ok = 1 THEN CASE WHEN low <= truth AND truth <= high THEN 1.0 ELSE 0.0 END END AS cov, CASE WHEN ok = 1 THEN CASE WHEN low > 0 OR high < 0 THEN 1.0 ELSE 0.0 END END AS exc FROM p)
 SELECT scenario, method, count(*) AS n_runs, count(err) AS n_ok, round(avg(err), 6) AS bias, round(stddev_samp(err) / sqrt(count(err)), 6) AS bias_mcse, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(cov), 6) AS coverage, round(sqrt(avg(cov) * (1 - avg(cov)) / count(err)), 6) AS coverage_mcse, round(avg(exc), 6) AS exclusion, round(1 - count(err) / count(*)::DOUBLE, 6) AS failed FROM x GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = R.simulation_summary(replicates(spark, d), ["scenario", "method"], "estimate", "truth", "low", "high", "ok")
    return s.select("scenario", "method", "n_runs", "n_ok", *(tidy(c).alias(c) for c in s.columns[4:]))


@query("rs_grid_pending", f"WITH {REPLICATES}, g AS (SELECT s AS scenario, r AS rep FROM (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS s), (SELECT unnest(range(1, 41)) AS r)) SELECT scenario, rep FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.scenario = g.scenario AND p.rep = g.rep AND ok = 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1, 41).withColumnRenamed("id", "rep").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scenario"), "rep")
    return R.pending(grid, replicates(spark, d).where("ok = 1"), ["scenario", "rep"])


@query("rs_power_gate", f"WITH {REPLICATES}, r AS (SELECT method, scenario, count(*) AS n, avg(CASE WHEN low > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM p GROUP BY 1, 2) SELECT method, scenario, n, round(rate, 6) AS rate, min(CASE WHEN rate >= 0.6 THEN scenario END) OVER (PARTITION BY method)::DOUBLE AS minimum_signal FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = replicates(spark, d).withColumn("hit", (F.col("low") > 0).cast("int"))
    return R.power_gate(p, ["method"], "scenario", "hit", 0.6).select("method", "scenario", "n", tidy("rate").alias("rate"), F.col("minimum_signal").cast("double").alias("minimum_signal"))


# ---- accuracy

_RISK = "(x1 / 1000.0 - x3 * 3)"
_G = f"{COHORT}, s AS (SELECT id, arm, time, event, {_RISK} AS risk FROM c), src AS (SELECT arm, time, 1 - event AS event, 1.0::DOUBLE AS w FROM s), {_KM}"
_GL = "gl AS (SELECT s.*, coalesce((SELECT arg_max(survival, km.time) FROM km WHERE km.arm = s.arm AND km.time < s.time), 1.0) AS g FROM s)"


def risks(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", "arm", "time", "event", (F.col("x1") / 1000.0 - F.col("x3") * 3).alias("risk"))


@query("md_harrell_c", f"WITH {COHORT}, s AS (SELECT arm, time, event, {_RISK} AS risk FROM c) SELECT a.arm, count(*) AS pairs, round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END), 6) AS c_index FROM s a JOIN s b ON a.arm = b.arm AND a.event = 1 AND b.time > a.time GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.concordance(risks(spark, d), ["arm"], "time", "event", "risk").withColumn("c_index", tidy("c_index"))


@query("md_auc_horizon", f"WITH {COHORT}, s AS (SELECT arm, {_RISK} AS risk, CASE WHEN event = 1 AND time <= 730 THEN 1 WHEN time > 730 THEN 0 END AS y FROM c) SELECT a.arm, count(DISTINCT a.rowid_) AS n_cases, count(DISTINCT b.rowid_) AS n_controls, round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END), 6) AS auc FROM (SELECT *, row_number() OVER () AS rowid_ FROM s) a JOIN (SELECT *, row_number() OVER () AS rowid_ FROM s) b ON a.arm = b.arm AND a.y = 1 AND b.y = 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.auc_at_horizon(risks(spark, d), ["arm"], "time", "event", "risk", 730.0).withColumn("auc", tidy("auc"))


@query("md_uno_c", f"WITH {_G}, {_GL} SELECT a.arm, round(sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END / greatest(a.g, 1e-6) ^ 2) / sum(1 / greatest(a.g, 1e-6) ^ 2), 6) AS c_index FROM gl a JOIN s b ON a.arm = b.arm AND a.event = 1 AND b.time > a.time GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.uno(risks(spark, d), ["arm"], "time", "event", "risk").select("arm", tidy("c_index").alias("c_index"))


@query("md_dynamic_auc", f"WITH {_G}, {_GL} SELECT a.arm, round(sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END / greatest(a.g, 1e-6)) / sum(1 / greatest(a.g, 1e-6)), 6) AS auc FROM gl a JOIN s b ON a.arm = b.arm AND a.event = 1 AND a.time <= 730 AND b.time > 730 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.dynamic_auc(risks(spark, d), ["arm"], "time", "event", "risk", 730.0).select("arm", tidy("auc").alias("auc"))


_BRIER = f"WITH {_G}, {_GL}, hz AS (SELECT arm, h AS horizon, coalesce((SELECT arg_max(survival, km.time) FROM km WHERE km.arm = a.arm AND km.time <= h), 1.0) AS gh FROM (SELECT DISTINCT arm FROM s) a, (SELECT CAST(unnest([365, 730, 1095]) AS DOUBLE) AS h)), b AS (SELECT gl.arm, horizon, avg(CASE WHEN time <= horizon AND event = 1 THEN p * p / greatest(g, 1e-6) WHEN time > horizon THEN (1 - p) * (1 - p) / greatest(gh, 1e-6) ELSE 0 END) AS brier, count(*) AS n FROM (SELECT *, 1 / (1 + exp(risk / 200)) AS p FROM gl) gl JOIN hz ON hz.arm = gl.arm GROUP BY 1, 2)"


def _brier(spark: SparkSession, d: str) -> DataFrame:
    return M.ipcw_brier(risks(spark, d).withColumn("p", 1 / (1 + F.exp(F.col("risk") / 200))), ["arm"], "time", "event", "p", [365.0, 730.0, 1095.0])


@query("md_ipcw_brier", _BRIER + " SELECT arm, horizon, round(brier, 6) AS brier, n FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _brier(spark, d).withColumn("brier", tidy("brier"))


@query("md_ibs", _BRIER + ", a AS (SELECT arm, horizon, (brier + lag(brier) OVER w) / 2 * (horizon - lag(horizon) OVER w) AS a FROM b WINDOW w AS (PARTITION BY arm ORDER BY horizon)) SELECT arm, round(sum(a) / (max(horizon) - min(horizon)), 6) AS ibs FROM a GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.ordered import trapezoid

    return trapezoid(_brier(spark, d), ["arm"], "horizon", "brier").select("arm", tidy("mean_height").alias("ibs"))


# ---- governance and harmonisation


@query("qa_contract", "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS missing_keys, count(*) FILTER (o_totalprice < 0) AS \"bad_o_totalprice\", count(*) FILTER (flag NOT IN (0, 1)) AS bad_flag, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM (SELECT *, o_custkey % 3 AS flag FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.contract(table(spark, d, "orders").withColumn("flag", F.pmod("o_custkey", F.lit(3))), "o_orderkey", ["o_totalprice"], ["flag"])


@query("qa_gates", f"WITH {COHORT}, m AS (SELECT count(*) FILTER (id IS NULL) AS missing, count(*) - count(DISTINCT id) AS repeated, avg(arm) AS share FROM c) SELECT 'missing' AS \"check\", missing::DOUBLE AS observed, 0.0::DOUBLE AS expected, CASE WHEN missing = 0 THEN 1 ELSE 0 END AS passed FROM m UNION ALL SELECT 'repeated', repeated::DOUBLE, 0.0, CASE WHEN repeated = 0 THEN 1 ELSE 0 END FROM m UNION ALL SELECT 'share', round(share, 9), 0.9, CASE WHEN round(share, 9) = 0.9 THEN 1 ELSE 0 END FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = cohort(spark, d).agg(F.count_if(F.col("id").isNull()).alias("missing"), (F.count("*") - F.count_distinct("id")).alias("repeated"), F.round(F.avg("arm"), 9).alias("share"))
    return G.gates(m, {"missing": 0, "repeated": 0, "share": 0.9})


@query("qa_checkpoint_upsert", "SELECT o_custkey AS key, arg_max(v, seq) AS v, max(seq) AS seq FROM (SELECT o_custkey, round(o_totalprice, 2) AS v, 2 * o_orderkey AS seq FROM orders UNION ALL SELECT o_custkey, -1.0, 2 * o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    held = o.select(F.col("o_custkey").alias("key"), F.round("o_totalprice", 2).alias("v"), (F.col("o_orderkey") * 2).alias("seq"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.lit(-1.0).alias("v"), (F.col("o_orderkey") * 2 + 1).alias("seq"))
    return G.upsert(held, new, ["key"], "seq")


@query("qa_manifest")
def _(spark: SparkSession, d: str) -> DataFrame:
    locked = G.manifest(spark, {"nation": table(spark, d, "nation"), "region": table(spark, d, "region"), "gone": table(spark, d, "region")})
    return G.verify_manifest(locked, G.manifest(spark, {"nation": table(spark, d, "nation"), "region": table(spark, d, "region").withColumn("r_name", F.lower("r_name"))}))


@query("qa_identity", "SELECT count(*) FILTER (s_acctbal < 0) AS only_left, CAST(0 AS BIGINT) AS only_right, 0.5::DOUBLE AS gap_v, 0 AS identical FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.round("s_acctbal", 0).alias("v"))
    t = s.where("s_acctbal >= 0").select("s_suppkey", (F.col("v") + F.when(F.pmod("s_suppkey", F.lit(5)) == 0, 0.5).otherwise(0.0)).alias("v"))
    return G.identity_report(s.drop("s_acctbal"), t, ["s_suppkey"], ["v"])


@query("qa_status", f"WITH {REPLICATES} SELECT scenario, method, rep, CASE WHEN low > 0 THEN 'above' WHEN high < 0 THEN 'below' ELSE 'unresolved' END AS status FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return replicates(spark, d).select("scenario", "method", "rep", G.interval_status("low", "high").alias("status"))


@query("qa_stale_claims", "SELECT doc_id, claim FROM (SELECT doc_id, unnest(list_filter([CASE WHEN contains(lower(text), 'all rights reserved') THEN 'rights' END, CASE WHEN contains(lower(text), 'mit license') THEN 'mit' END], lambda x: x IS NOT NULL)) AS claim FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.stale_claims(table(spark, d, "documents"), "doc_id", "text", {"rights": "All rights reserved", "mit": "MIT License"})


@query("qa_restore_label", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN regexp_extract(p_brand || '|' || p_type, '^([^|]+)', 1) ELSE p_brand END AS label FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.pmod("p_partkey", F.lit(3)) == 0, "").otherwise(F.col("p_brand")).alias("label"), F.concat_ws("|", "p_brand", "p_type").alias("composite"))
    return p.select("p_partkey", G.restore_label("label", "composite", r"^([^|]+)").alias("label"))


@query("hz_mapping_status", "SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unmapped' WHEN b IS NULL THEN 'current_only' WHEN a IS NULL THEN 'old_only' WHEN a = b THEN 'agree' ELSE 'ambiguous' END AS status FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END AS b FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = F.when(k % 4 != 0, F.col("p_brand")), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.col("p_type"))
    status = F.when(a.isNull() & b.isNull(), "unmapped").when(b.isNull(), "current_only").when(a.isNull(), "old_only").when(a == b, "agree").otherwise("ambiguous")
    return table(spark, d, "part").select("p_partkey", status.alias("status"))


@query("hz_coverage", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_left, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_right, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS n_both")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    sides = a.distinct().withColumn("s", F.lit(1)).union(b.distinct().withColumn("s", F.lit(2))).groupBy("k").agg(F.sum("s").alias("s"))
    return sides.agg(F.count_if(F.col("s").isin(1, 3)).alias("n_left"), F.count_if(F.col("s").isin(2, 3)).alias("n_right"), F.count_if(F.col("s") == 3).alias("n_both"))


@query("hz_provenance", "SELECT round(corr(a, b), 6) AS r, round(median(abs(a - b)), 6) AS median_gap, count(*) AS n FROM (SELECT c_acctbal AS a, c_acctbal * 1.01 + c_custkey % 7 AS b FROM customer)")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select(F.col("c_acctbal").alias("a"), (F.col("c_acctbal") * 1.01 + F.col("c_custkey") % 7).alias("b"))
    gap = exact_quantiles(x.withColumn("gap", F.abs(F.col("a") - F.col("b"))), [], "gap", {"median_gap": 0.5})
    return x.agg(tidy(F.corr("a", "b")).alias("r"), F.count("*").alias("n")).join(F.broadcast(gap)).select("r", tidy("median_gap").alias("median_gap"), "n")  # one row


@query("xo_confusion", "SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS agreement, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity, round(tn / (tn + fp)::DOUBLE, 6) AS specificity FROM (SELECT count(*) FILTER (t = 1 AND d = 1) AS tp, count(*) FILTER (t = 0 AND d = 0) AS tn, count(*) FILTER (t = 0 AND d = 1) AS fp, count(*) FILTER (t = 1 AND d = 0) AS fn FROM (SELECT quality AS t, 1 - toxic AS d FROM labels))")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = A.confusion(table(spark, d, "labels").withColumn("d", F.lit(1) - F.col("toxic")), "quality", "d")
    return c.select("tp", "tn", "fp", "fn", *(tidy(x).alias(x) for x in ("agreement", "sensitivity", "specificity")))


@query("xo_any_flag", "SELECT c_custkey, coalesce(m, 0) AS any_urgent FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("m"))
    return table(spark, d, "customer").select("c_custkey").join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("any_urgent"))


@query("xo_two_modal", "WITH m AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT l_linenumber::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 2)) SELECT l_linenumber, CASE WHEN l_linenumber = lo THEN 0.0 WHEN l_linenumber = hi THEN 1.0 END::DOUBLE AS recovered, count(*) AS n FROM lineitem, m GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.two_modes(table(spark, d, "lineitem"), "l_linenumber").groupBy("l_linenumber", F.col("recovered").cast("double").alias("recovered")).agg(F.count("*").alias("n"))


@query("xo_availability", f"WITH l AS (SELECT doc_id, lang AS m FROM documents UNION SELECT doc_id, source FROM documents), z AS (SELECT m, count(*) AS n FROM l GROUP BY 1), i AS (SELECT a.m AS a, b.m AS b, count(*) AS k FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.m < b.m GROUP BY 1, 2) SELECT x.m AS a, y.m AS b, coalesce(k, 0) AS shared, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))::DOUBLE, 6) AS jaccard FROM z x JOIN z y ON x.m < y.m LEFT JOIN i ON i.a = x.m AND i.b = y.m")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.sets import pair_overlaps

    docs = table(spark, d, "documents")
    long = docs.select("doc_id", F.col("lang").alias("m")).union(docs.select("doc_id", "source")).distinct()
    return pair_overlaps(long, "m", "doc_id").select("a", "b", "shared", tidy("jaccard").alias("jaccard"))


@query("xo_mutation_grid", "SELECT c.c_custkey, e.t AS gene, CASE WHEN x.user_id IS NULL THEN 0 ELSE 1 END AS mutated FROM customer c CROSS JOIN (SELECT DISTINCT event_type AS t FROM events) e LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50) x ON x.user_id = c.c_custkey AND x.event_type = e.t")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    genes = e.agg(F.collect_set("event_type").alias("genes"))  # a panel: one row
    grid = table(spark, d, "customer").select("c_custkey").join(F.broadcast(genes)).select("c_custkey", F.explode("genes").alias("gene"))
    calls = e.where("value > 50").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("gene"), F.lit(1).alias("hit")).distinct()
    return grid.join(calls, ["c_custkey", "gene"], "left").select("c_custkey", "gene", F.coalesce("hit", F.lit(0)).alias("mutated"))
