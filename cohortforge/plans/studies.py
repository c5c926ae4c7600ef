"""Queries: weighted clones, hazards, imbalance audits, intervals, concordance of sets, transport, targets, Cox prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions import columns as C
from cohortforge.functions.columns import tidy
from cohortforge.operators import causal as K
from cohortforge.operators import crossfit as X
from cohortforge.operators import joins as J
from cohortforge.operators import resample as R
from cohortforge.operators import studies as S
from cohortforge.operators import survival as V
from cohortforge.plans.analysis import _CLONE, _GRID, _SC
from cohortforge.plans.registry import query
from cohortforge.plans.shapes import COHORT, OUTCOMES, RECORDS, REPLICATES, SELECTIONS, STARTS, cohort, hashed_sql, outcomes, records, replicates, selections, starts, table

# ---- weighted clones


def clone_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.clone_censor(starts(spark, d), "id", "time", "event", "started", 180.0, 730.0, 90.0, ["x2"])


_SHARES = "(sum(c) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE)"


@query(
    "sv_clone_weighted_km",
    f"""WITH RECURSIVE {STARTS}, {_GRID}, {_CLONE}, r AS (SELECT cr.id, strategy, interval, start, stop, x2, CAST(last AND NOT off AND ev = 1 AND cr.time <= 730 AS INTEGER) AS event, CAST((last AND off AND cut <= 730) OR (last AND NOT off AND ev = 0 AND cr.time <= 730) AS INTEGER) AS c FROM cr JOIN s ON s.id = cr.id),
 num AS (SELECT strategy, interval, {_SHARES} AS h FROM r GROUP BY 1, 2), den AS (SELECT strategy, interval, x2, {_SHARES} AS h FROM r GROUP BY 1, 2, 3),
 f AS (SELECT r.*, (1 - num.h) / (1 - den.h) AS f FROM r JOIN num USING (strategy, interval) JOIN den USING (strategy, interval, x2)),
 w AS (SELECT id, strategy, interval, 1.0::DOUBLE AS weight, f FROM f WHERE interval = 0 UNION ALL SELECT f.id, f.strategy, f.interval, greatest(0.01, least(25.0, w.weight * w.f))::DOUBLE, f.f FROM w JOIN f ON f.id = w.id AND f.strategy = w.strategy AND f.interval = w.interval + 1),
 g AS (SELECT w.strategy, w.interval, sum(weight) AS risk, sum(weight * event) AS events, max(grid.stop) AS stop, min(grid.start) AS start FROM w JOIN r USING (id, strategy, interval) JOIN grid ON grid.interval = w.interval GROUP BY 1, 2),
 sv AS (SELECT *, events / risk AS h FROM g), o AS (SELECT *, exp(sum(ln(1 - h)) OVER (PARTITION BY strategy ORDER BY interval)) AS survival, exp(coalesce(sum(ln(1 - h)) OVER (PARTITION BY strategy ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM sv)
 SELECT strategy, interval, round(risk, 4) AS risk, round(h, 6) AS hazard, round(survival, 6) AS survival, round(sum(before * (stop - start)) OVER (PARTITION BY strategy ORDER BY interval), 4) AS area FROM o""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = clone_rows(spark, d).withColumn("c", F.col("natural_censor") + F.col("artificial_censor"))
    cells = V.empirical_hazard(rows, ["strategy", "x2"], "interval", "c")
    every = W.partitionBy("strategy", "interval")  # strategies by intervals by values of x2: a small table
    factors = cells.withColumn("_all", (F.sum("s").over(every) + 0.5) / (F.sum("n").over(every) + 1.0)).select("strategy", "x2", "interval", ((1 - F.col("_all")) / (1 - F.col("hazard"))).alias("factor"))
    each = rows.select("id", "strategy", "interval", "x2", "event").join(F.broadcast(factors), ["strategy", "x2", "interval"])
    weighted = X.clone_weights(each, ["id", "strategy"], "interval", "factor")
    grid = spark.range(1).select(F.explode(V.interval_grid(730.0, 90.0)).alias("x")).select("x.interval", F.col("x.start").alias("start"), F.col("x.end").alias("stop"))
    curve = X.weighted_interval_curve(weighted.join(F.broadcast(grid), "interval"), ["strategy"], "weight", "event")  # nine intervals
    return curve.select("strategy", "interval", tidy("risk", 4).alias("risk"), tidy("hazard").alias("hazard"), tidy("survival").alias("survival"), tidy("area", 4).alias("area"))


@query("xo_clone_checks", f"WITH {STARTS}, {_GRID}, {_CLONE}, cc AS (SELECT id, strategy, min(interval) AS lo, max(interval) AS hi, count(*) AS n, count(*) FILTER (last AND ((NOT off AND time <= 730) OR (off AND cut <= 730))) AS ends FROM cr GROUP BY 1, 2), k AS (SELECT count(*) AS clones, count(*) FILTER (lo = 0) AS firsts, count(*) FILTER (ends > 1) AS twice, count(*) FILTER (n <> hi - lo + 1) AS gaps, (SELECT count(*) FROM s) AS n FROM cc) SELECT \"check\", CAST(observed AS BIGINT) AS observed, CAST(expected AS BIGINT) AS expected, CASE WHEN observed = expected THEN 1 ELSE 0 END AS passed FROM (SELECT 'two_clones_a_subject' AS \"check\", clones AS observed, 2 * n AS expected FROM k UNION ALL SELECT 'one_first_row_a_clone', firsts, 2 * n FROM k UNION ALL SELECT 'clones_that_end_twice', twice, 0 FROM k UNION ALL SELECT 'clones_with_gaps', gaps, 0 FROM k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.clone_checks(clone_rows(spark, d), starts(spark, d), "id")


# ---- fits with an inner choice


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).withColumns({"z1": F.col("x1") / 100000.0, "z2": F.col("x2") / 7, "z3": F.col("x3") / 12})


_Z = ["z1", "z2", "z3"]


@query("ca_propensity_inner_cv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.crossfit_logistic(_unit(spark, d), "id", "arm", _Z, "fold").select("id", "fold", tidy("probability", 4).alias("propensity"))


@query("ca_ridge_inner_cv")
def _(spark: SparkSession, d: str) -> DataFrame:
    fitted = X.crossfit_ridge(_unit(spark, d), "y", "arm", _Z, "fold", bounds=(0.0, 730.0))
    return fitted.select("id", "fold", tidy("mu0", 3).alias("mu0"), tidy("mu1", 3).alias("mu1"))


@query("sv_crossfit_censoring")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = V.person_period(_unit(spark, d), 730.0, 90.0)
    hazard = X.crossfit_hazard(rows, "id", "censor_event", ["arm", "interval", *_Z], "fold", ["arm", "interval"], "hazard")
    kept, _ = X.censor_survival(hazard, "id", "hazard", "censor_event")
    return kept.select("id", "interval", tidy("hazard", 5).alias("hazard"), tidy("g", 5).alias("g"))


@query("xo_landmark_estimate")
def _(spark: SparkSession, d: str) -> DataFrame:
    """From censoring to the estimate: hazards, pseudo-outcomes, propensity, outcome models, score."""
    s = _unit(spark, d).drop("mu0", "mu1", "y", "e")
    rows = V.person_period(s, 730.0, 90.0)
    hazard = X.crossfit_hazard(rows, "id", "censor_event", ["arm", "interval", *_Z], "fold", ["arm", "interval"], "hazard")
    kept, _ = X.censor_survival(hazard, "id", "hazard", "censor_event")
    y = V.ipcw_pseudo(s, kept.select("id", "interval", "g"), "id", "time", 730.0, 90.0, 0.1)
    full = X.crossfit_ridge(s.join(y, "id"), "pseudo", "arm", _Z, "fold")
    scored = X.crossfit_logistic(full, "id", "arm", _Z, "fold")
    e = K.score_estimate(K.clipped_scores(scored, "pseudo", "arm", "probability", "mu0", "mu1"))
    return e.select("n", *(tidy(c, 2).alias(c) for c in e.columns if c != "n"))


@query("xo_selection_auc")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.metrics import auc

    picked = X.crossfit_logistic(_unit(spark, d), "id", "event", _Z, "fold")
    return auc(picked, [], "event", "probability").select("n_cases", "n_controls", tidy("auc", 4).alias("auc"))


@query("fs_nested_cox")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.metrics import concordance

    s = _unit(spark, d).drop("fold")
    folds = None
    for repeat in range(2):
        one = R.stratified_folds(s.select("id", "event"), "id", ["event"], 3, repeat).select("id", F.lit(repeat).alias("repeat"), "fold")
        folds = one if folds is None else folds.union(one)
    oof = S.nested_cox(s, "id", "time", "event", ["arm", *_Z], folds, 0.001)
    return concordance(oof, ["repeat"], "time", "event", "log_risk").select("repeat", "pairs", tidy("c_index", 4).alias("c_index"))


# ---- Cox prediction

_LP = "(x1 / 200000.0 - x3 / 24.0)"


@query("md_cox_baseline", f"WITH {COHORT}, t AS (SELECT arm, time, sum(exp({_LP})) AS w, count(*) FILTER (event = 1) AS events FROM c GROUP BY 1, 2), k AS (SELECT *, sum(w) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM t) SELECT arm, time, events, round(risk, 5) AS risk, round(sum(events / risk) OVER (PARTITION BY arm ORDER BY time), 6) AS cumulative_hazard FROM k WHERE events > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("lp", F.col("x1") / 200000.0 - F.col("x3") / 24.0)
    return S.cox_baseline(c, ["arm"], "time", "event", "lp").select("arm", "time", "events", tidy("risk", 5).alias("risk"), tidy("cumulative_hazard").alias("cumulative_hazard"))


@query("md_cox_survival", f"WITH {COHORT}, t AS (SELECT arm, time, sum(exp({_LP})) AS w, count(*) FILTER (event = 1) AS events FROM c GROUP BY 1, 2), k AS (SELECT *, sum(w) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM t), h AS (SELECT arm, a.at, coalesce(sum(events / risk) FILTER (time <= a.at), 0) AS h FROM k, (SELECT CAST(unnest([365, 1095]) AS DOUBLE) AS at) a GROUP BY 1, 2) SELECT c.id, h.at, round(exp({_LP}), 6) AS partial_hazard, round(exp(-h.h * exp({_LP})), 6) AS survival FROM c JOIN h ON h.arm = c.arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("lp", F.col("x1") / 200000.0 - F.col("x3") / 24.0)
    s = S.cox_survival(c, S.cox_baseline(c, ["arm"], "time", "event", "lp"), ["arm"], "id", "lp", [365.0, 1095.0])
    return s.select("id", "at", tidy("partial_hazard").alias("partial_hazard"), tidy("survival").alias("survival"))


# ---- audits

_FL = "f AS (SELECT arm, event, CAST(x2 < 2 AS INTEGER) AS low, CAST(x3 > 6 AS INTEGER) AS late, CAST(cust % 50 = 0 AS INTEGER) AS rare FROM c)"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("arm", "event", (F.col("x2") < 2).cast("int").alias("low"), (F.col("x3") > 6).cast("int").alias("late"), (F.pmod("cust", F.lit(50)) == 0).cast("int").alias("rare"))


_CH = "lgamma(k11 + k10 + 1) - lgamma({i} + 1) - lgamma(k11 + k10 - {i} + 1) + lgamma(k01 + k00 + 1) - lgamma(k11 + k01 - {i} + 1) - lgamma(k01 + k00 - (k11 + k01 - {i}) + 1) - (lgamma(k11 + k10 + k01 + k00 + 1) - lgamma(k11 + k01 + 1) - lgamma(k10 + k00 + 1))"


@query(
    "ca_imbalance_audit",
    f"""WITH {COHORT}, {_FL}, l AS (SELECT arm, unnest(['low', 'late', 'rare']) AS variable, unnest([low, late, rare]) AS v FROM f),
 n AS (SELECT variable, count(*) FILTER (arm = 1 AND v = 1) AS k11, count(*) FILTER (arm = 1 AND v = 0) AS k10, count(*) FILTER (arm = 0 AND v = 1) AS k01, count(*) FILTER (arm = 0 AND v = 0) AS k00 FROM l GROUP BY 1),
 p AS (SELECT *, k11 / (k11 + k10)::DOUBLE AS p1, k01 / (k01 + k00)::DOUBLE AS p0, {_CH.format(i='k11')} AS own FROM n),
 s AS (SELECT *, (p1 - p0) / sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2) AS smd, least(1.0, list_sum(list_transform(range(greatest(0, k11 + k01 - k01 - k00), least(k11 + k10, k11 + k01) + 1), lambda i: CASE WHEN {_CH.format(i='i')} <= own + 1e-7 THEN exp({_CH.format(i='i')}) ELSE 0 END))) AS fp FROM p)
 SELECT variable, round(p1, 6) AS treated_fraction, round(p0, 6) AS control_fraction, round(p1 - p0, 6) AS risk_difference, round(smd, 6) AS smd, round(fp, 5) AS fisher_p, CAST(abs(smd) >= 0.1 AS INTEGER) AS flagged, CAST(abs(smd) >= 0.25 AS INTEGER) AS severe FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = S.imbalance_audit(_flags(spark, d), "arm", ["low", "late", "rare"])
    return a.select("variable", *(tidy(c).alias(c) for c in ("treated_fraction", "control_fraction", "risk_difference", "smd")), tidy("fisher_p", 5).alias("fisher_p"), "flagged", "severe")


@query("ca_feasible_populations", f"WITH {COHORT}, {_FL}, m AS (SELECT unnest(list_filter(['all', CASE WHEN low = 1 THEN 'low' END, CASE WHEN rare = 1 AND late = 1 THEN 'rare_late' END], lambda x: x IS NOT NULL)) AS population, arm, event FROM f) SELECT *, CAST(least(treated, control) >= 40 AND events >= 30 AS INTEGER) AS feasible FROM (SELECT population, count(*) AS n, count(*) FILTER (arm = 1) AS treated, count(*) FILTER (arm = 0) AS control, CAST(sum(event) AS BIGINT) AS events FROM m GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    masks = {"all": F.lit(True), "low": F.col("low") == 1, "rare_late": (F.col("rare") == 1) & (F.col("late") == 1), "none": F.lit(False)}
    return S.feasible_populations(_flags(spark, d), "arm", "event", masks, 40, 30)


@query("rs_studentised", f"WITH {REPLICATES}, t AS (SELECT method, (estimate - 4.5) / (0.5::DOUBLE + rep % 7 / 10.0::DOUBLE) AS t FROM p) SELECT method, count(*) AS n, round(4.5 - quantile_cont(t, 0.975) * 0.8, 5) AS studentised_low, round(4.5 - quantile_cont(t, 0.025) * 0.8, 5) AS studentised_high FROM t GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = replicates(spark, d).withColumn("se", F.lit(0.5) + F.col("rep") % 7 / 10.0)
    s = S.studentised_interval(p, ["method"], "estimate", "se", F.col("truth"), F.lit(0.8))
    return s.select("method", "n", tidy("studentised_low", 5).alias("studentised_low"), tidy("studentised_high", 5).alias("studentised_high"))


@query("rs_partition_error", f"WITH {REPLICATES}, x AS (SELECT scenario, CASE WHEN abs(estimate) <= 9 THEN estimate END AS v FROM p) SELECT scenario, count(*) AS n, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(v)), 6) AS mcse, round(1 - count(v) / count(*)::DOUBLE, 6) AS exploded, round(min(v), 6) AS least, round(max(v), 6) AS most FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = S.partition_error(replicates(spark, d), ["scenario"], "estimate", 9.0)
    return e.select("scenario", "n", *(tidy(c).alias(c) for c in ("sd", "mcse", "exploded", "least", "most")))


@query("rs_leave_one_out", f"WITH {_SC}, u AS (SELECT cust, sum(num) AS a, sum(h) AS b FROM sc GROUP BY 1), t AS (SELECT sum(a) AS a, sum(b) AS b FROM u) SELECT cust, round((t.a - u.a) / (t.b - u.b), 6) AS estimate_without, round((t.a - u.a) / (t.b - u.b) - t.a / t.b, 6) AS shift FROM u, t")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = S.leave_one_out(K.stabilised_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1"), "cust")
    return s.select("cust", tidy("estimate_without").alias("estimate_without"), tidy("shift").alias("shift"))


@query("fs_pad_selection", f"WITH {COHORT}, l AS (SELECT 'x1' AS feature, x1 AS v, time FROM c UNION ALL SELECT 'x2', x2, time FROM c UNION ALL SELECT 'x3', x3, time FROM c), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY time) + (count(*) OVER (PARTITION BY feature, time) - 1) / 2.0::DOUBLE AS ry FROM l), s AS (SELECT feature, corr(rx, ry) AS rho FROM r GROUP BY 1) SELECT 1 AS place, 'x3' AS feature UNION ALL SELECT 2, feature FROM (SELECT feature FROM s WHERE feature <> 'x3' ORDER BY abs(rho) DESC, feature LIMIT 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.aggregates import unpivot
    from cohortforge.operators.ordered import spearman

    screened = spearman(unpivot(cohort(spark, d), ["time"], ["x1", "x2", "x3"]), "feature", "value", "time")
    return S.pad_selection(spark.createDataFrame([(1, "x3")], "place int, feature string"), screened, 2)


@query(
    "st_set_concordance",
    f"""WITH {SELECTIONS}, a AS (SELECT DISTINCT fold, feature FROM sel WHERE repeat = 0), b AS (SELECT DISTINCT fold, feature FROM sel WHERE repeat = 1), u AS (SELECT DISTINCT k AS fold, p_brand || '-' || p_size AS feature FROM part, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS k) WHERE p_size % 5 <> 0),
 n AS (SELECT u.fold, count(*) AS universe FROM u GROUP BY 1), x AS (SELECT n.fold, universe, (SELECT count(*) FROM a WHERE a.fold = n.fold) AS selected, (SELECT count(*) FROM a JOIN u USING (fold, feature) WHERE a.fold = n.fold) AS assayable, (SELECT count(*) FROM b WHERE b.fold = n.fold) AS other, (SELECT count(*) FROM a JOIN u USING (fold, feature) JOIN b USING (fold, feature) WHERE a.fold = n.fold) AS shared FROM n)
 SELECT fold, selected, assayable, other, universe, shared, round(shared / (assayable + other - shared)::DOUBLE, 6) AS jaccard, round(shared / least(assayable, other)::DOUBLE, 6) AS overlap, round(assayable / selected::DOUBLE, 6) AS assayable_share, 'estimable' AS status FROM x""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = selections(spark, d)
    part = table(spark, d, "part").where("p_size % 5 <> 0").select(F.concat_ws("-", "p_brand", "p_size").alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))
    c = S.set_concordance(s.where("repeat = 0"), s.where("repeat = 1"), part, ["fold"], "feature")
    return c.select("fold", "selected", "assayable", "other", "universe", "shared", tidy("jaccard").alias("jaccard"), tidy("overlap").alias("overlap"), tidy("assayable_share").alias("assayable_share"), "status")


@query("hz_transport_role", "SELECT p_partkey, CASE WHEN s IN ('agree', 'current') AND m THEN 'PRIMARY_TRANSPORTABLE' WHEN s = 'fallback' AND m THEN 'SENSITIVITY_ONLY_MAPPING_FALLBACK' WHEN s IN ('agree', 'current', 'fallback') AND NOT m THEN 'MAPPED_BUT_NOT_ASSAYED' ELSE 'EXCLUDED_AMBIGUOUS_OR_UNMAPPED' END AS role FROM (SELECT p_partkey, ['agree', 'current', 'fallback', 'ambiguous', 'unmapped'][p_partkey % 5 + 1] AS s, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS m FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("hit")).distinct()
    status = F.element_at(F.array(*map(F.lit, ("agree", "current", "fallback", "ambiguous", "unmapped"))), F.pmod("p_partkey", F.lit(5)).cast("int") + 1)
    parts = table(spark, d, "part").select("p_partkey", status.alias("s")).join(have, "p_partkey", "left")
    return parts.select("p_partkey", S.transport_role("s", F.coalesce("hit", F.lit(False)), ["agree", "current"], ["fallback"]).alias("role"))


@query("hz_assayability", "WITH m AS (SELECT DISTINCT p_brand AS modality, 'S' || p_size AS symbol FROM part), a AS (SELECT DISTINCT p_brand AS modality, 'S' || p_size AS symbol FROM part WHERE p_partkey % 2 = 0) SELECT modality, count(*) AS mapped, count(a.symbol) AS available, count(*) - count(a.symbol) AS unavailable, round(count(a.symbol) / count(*)::DOUBLE, 6) AS share, coalesce(string_agg(CASE WHEN a.symbol IS NULL THEN m.symbol END, ' | ' ORDER BY m.symbol), '') AS missing FROM m LEFT JOIN a USING (modality, symbol) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("modality"), F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("symbol"))
    return S.assayability(m, m.where("p_partkey % 2 = 0"), ["modality"], "symbol").withColumn("share", tidy("share"))


@query(
    "xo_probe_mapping",
    """WITH l AS (SELECT DISTINCT l_suppkey, 'B' || split_part(p_brand, '#', 2) AS gene FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT upper(s_name) AS probe, string_agg(gene, ' | ' ORDER BY gene) AS genes, count(gene) AS n_genes FROM supplier JOIN l ON l_suppkey = s_suppkey GROUP BY s_name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as probes, the brands that they deliver as genes, several for each; one row of annotation a supplier and brand."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("b"), F.split("p_brand", "#")[1]).alias("g"))
    sold = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).join(brands, "l_partkey").select("s_suppkey", "g").distinct()
    s = table(spark, d, "supplier")
    notes = sold.join(s, "s_suppkey").select(F.xxhash64("s_suppkey", "g").alias("row"), F.lower("s_name").alias("probe_id"), F.concat(F.col("g"), F.lit("; ?")).alias("Gene_Symbol"))
    return S.map_by_best_column(notes, s, "s_name")


@query("rs_truths", f"WITH {OUTCOMES} SELECT arm, round(avg(mu1 - mu0), 6) AS average, round(sum(e * (mu1 - mu0)) / sum(e), 6) AS treated, round(sum(e * (1 - e) * (mu1 - mu0)) / sum(e * (1 - e)), 6) AS overlap, round(sum(e * (1 - e) * (mu1 - mu0)) / sum(e * (1 - e)) - avg(mu1 - mu0), 6) AS drift FROM o GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = S.truths(outcomes(spark, d), ["arm"], "e", "mu0", "mu1")
    return t.select("arm", *(tidy(c).alias(c) for c in t.columns[1:]))


@query("xo_empirical_targets", f"WITH {COHORT} SELECT unnest(['share_treated', 'event_share_0', 'mean_x2_0', 'sd_x2_0', 'event_share_1', 'mean_x2_1', 'sd_x2_1']) AS target, unnest([round(avg(arm), 6), round(avg(event) FILTER (arm = 0), 6), round(avg(x2) FILTER (arm = 0), 6), round(stddev_samp(x2) FILTER (arm = 0), 6), round(avg(event) FILTER (arm = 1), 6), round(avg(x2) FILTER (arm = 1), 6), round(stddev_samp(x2) FILTER (arm = 1), 6)]) AS value FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.empirical_targets(cohort(spark, d), "arm", "event", ["x2"]).select("target", tidy("value").alias("value"))


@query("md_clinical_indicators", "SELECT p_partkey, p_retailprice AS age, CASE WHEN s = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS stage_II, CASE WHEN s = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS stage_III, CASE WHEN s = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS stage_IV, CASE WHEN n IS NOT NULL THEN CAST(n > 0 AS INTEGER) END::DOUBLE AS node_positive FROM (SELECT *, CASE WHEN p_size % 6 <> 5 THEN p_size % 6 END AS s, CASE WHEN p_partkey % 4 <> 3 THEN p_partkey % 4 END AS n FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("a"), F.when(F.col("p_size") % 6 != 5, F.col("p_size") % 6).cast("string").alias("s"), F.when(F.col("p_partkey") % 4 != 3, F.col("p_partkey") % 4).cast("string").alias("n"))
    return S.clinical_indicators(p, "a", "s", "n").select("p_partkey", "age", "stage_II", "stage_III", "stage_IV", "node_positive")


@query("xo_earliest_start", f"WITH {RECORDS} SELECT patient, min(day) FILTER (regexp_matches(family, 'sign|click') AND day >= 0) AS start, count(*) FILTER (regexp_matches(family, 'sign|click')) AS n_records FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.earliest_start(records(spark, d), "patient", "family", "day", "sign|click")


@query("xo_repeat_summary", f"WITH {REPLICATES}, e AS (SELECT method, scenario, avg(estimate) AS v FROM p GROUP BY 1, 2) SELECT method, count(*) AS n_repeats, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most FROM e GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = S.repeat_summary(replicates(spark, d), ["method"], "scenario", "estimate")
    return s.select("method", "n_repeats", *(tidy(c).alias(c) for c in s.columns[2:]))


@query("ca_r_loss", f"WITH {OUTCOMES}, r AS (SELECT y - (mu0 + mu1) / 2 AS ry, arm - e AS ra, mu1 - mu0 AS tau FROM o), k AS (SELECT sum(ry * ra) / sum(ra * ra) AS c FROM r), l AS (SELECT (ry - tau * ra) ^ 2 AS l, (ry - c * ra) ^ 2 AS k FROM r, k) SELECT count(*) AS n, round(avg(l), 3) AS loss, round(avg(k), 3) AS constant_loss, round(1 - avg(l) / avg(k), 6) AS improvement, round(avg(k - l) / (stddev_samp(k - l) / sqrt(count(*))), 5) AS t FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d).withColumns({"m": (F.col("mu0") + F.col("mu1")) / 2, "tau": F.col("mu1") - F.col("mu0")})
    r = S.r_loss(o, "y", "arm", "m", "e", "tau")
    return r.select("n", tidy("loss", 3).alias("loss"), tidy("constant_loss", 3).alias("constant_loss"), tidy("improvement").alias("improvement"), tidy("t", 5).alias("t"))


@query("xo_mapping_errors")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumns({"w": K.overlap_weight("arm", "e"), "one": F.lit(1.0)})
    m = S.mapping_errors(c, 0.0, {"overlap": ("arm", "time", "event", "w"), "plain": ("arm", "time", "event", "one")}, 730.0)
    return m.select("mapping", tidy("estimate", 3).alias("estimate"), tidy("error", 3).alias("error"))


@query("prj_joined_texts", "SELECT c_custkey, concat_ws(' | ', nullif(trim(c_mktsegment), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END), ''), CASE WHEN c_custkey % 3 = 0 THEN 'x' END) AS joined FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", C.joined_texts("c_mktsegment", F.when(k % 2 == 0, " ").otherwise(F.col("c_name")), F.when(k % 3 == 0, "x")).alias("joined"))


@query("jn_ordered_lookup", f"WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), dr AS (SELECT pos AS draw, {hashed_sql('7', 'pos')} % n AS pos FROM k) SELECT draw, k.c_custkey, c_name FROM dr JOIN k ON k.pos = dr.pos JOIN customer ON customer.c_custkey = k.c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    placed = R.dense_positions(c, "c_custkey")
    n = c.count()
    draws = placed.select(F.col("pos").alias("draw"), F.pmod(R.hashed(7, "pos"), F.lit(n)).alias("pos")).join(placed, "pos").select("draw", "c_custkey")
    return J.ordered_lookup(draws, c, "c_custkey").select("draw", "c_custkey", "c_name")


@query("jn_bind_columns", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return J.bind_columns(s.select("s_suppkey", "s_name"), s.select("s_suppkey", "s_acctbal", F.lit("other").alias("s_name")), "s_suppkey")


_JSON = """e AS (SELECT event_id, json_object('a', event_id, 'b', json_object('t', event_type, 'u', ', yes'), 'c', json_array(event_type || '"]', 'x' || chr(92) || '/' || chr(10) || 'é', user_id % 3, NULL)) AS j FROM events)"""


def _json(spark: SparkSession, d: str) -> DataFrame:
    inner = F.struct(F.col("event_type").alias("t"), F.lit(", yes").alias("u"))
    texts = F.to_json(F.array(F.concat("event_type", F.lit('"]')), F.lit("x\\/\né")))
    listed = F.concat(F.left(texts, F.length(texts) - 1), F.lit(","), F.pmod("user_id", F.lit(3)).cast("string"), F.lit(",null]"))
    text = F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit(',"b":'), F.to_json(inner), F.lit(',"c":'), listed, F.lit("}"))
    return table(spark, d, "events").select("event_id", text.alias("j"))


@query("prj_json_strings", f"WITH {_JSON} SELECT event_id, count(*) AS n, string_agg(t.atom ->> '$', '|' ORDER BY t.id) AS strings FROM e, json_tree(e.j) AS t WHERE t.type = 'VARCHAR' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _json(spark, d).select("event_id", C.json_strings("j").alias("s"))
    return found.select("event_id", F.size("s").alias("n"), F.array_join("s", "|").alias("strings"))


@query("prj_json_walk", f"WITH {_JSON} SELECT event_id, t.fullkey AS path, t.path AS parent, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.atom ->> '$' END AS value FROM e, json_tree(e.j) AS t WHERE t.fullkey <> '$'")
def _(spark: SparkSession, d: str) -> DataFrame:
    from cohortforge.operators.json_walk import json_walk

    return json_walk(_json(spark, d), "event_id", "j").where("parent is not null").select("event_id", "path", "parent", "kind", "value")


# ---- readings of a table against a published curve

_READINGS = """pub AS (SELECT * FROM cv WHERE mapping = 'true'),
 pt AS (SELECT DISTINCT mapping, arm, time FROM (SELECT mapping, arm, time FROM cv UNION ALL SELECT m.mapping, p.arm, p.time FROM pub AS p, (SELECT DISTINCT mapping FROM cv) AS m UNION ALL SELECT DISTINCT mapping, arm, 0.0::DOUBLE FROM cv) WHERE time <= 730),
 v AS (SELECT pt.mapping, pt.arm, pt.time, coalesce(s.survival, 1) - coalesce(p.survival, 1) AS off, coalesce(lead(pt.time) OVER (PARTITION BY pt.mapping, pt.arm ORDER BY pt.time), 730) - pt.time AS width
  FROM pt ASOF LEFT JOIN cv AS s ON s.mapping = pt.mapping AND s.arm = pt.arm AND s.time <= pt.time ASOF LEFT JOIN pub AS p ON p.arm = pt.arm AND p.time <= pt.time),
 a AS (SELECT mapping, arm, sum(abs(off) * width) AS area, max(abs(off)) AS gap, abs(sum(off * width)) AS me, abs(arg_max(off, time)) AS ee FROM v GROUP BY 1, 2)"""


@query(
    "xo_curve_mappings",
    f"""WITH {COHORT}, w AS (SELECT *, arm * (1 - e) + (1 - arm) * e AS w FROM c),
 r AS (SELECT 'true' AS mapping, arm, time, event, w FROM w UNION ALL SELECT 'swapped', 1 - arm, time, event, w FROM w UNION ALL SELECT 'unweighted', arm, time, event, 1 FROM w
  UNION ALL SELECT 'censoring', arm, time, 1 - event, w FROM w UNION ALL SELECT 'inverse', arm, time, event, CASE WHEN arm = 1 THEN 1 / e ELSE 1 / (1 - e) END FROM w UNION ALL SELECT 'months', arm, time / 30.4375, event, w FROM w),
 bt AS (SELECT mapping, arm, time, sum(w) AS w, sum(w * event) AS d FROM r GROUP BY 1, 2, 3), rk AS (SELECT *, sum(w) OVER (PARTITION BY mapping, arm ORDER BY time DESC) AS risk FROM bt),
 cv AS (SELECT mapping, arm, time, product(greatest(1 - d / risk, 0)) OVER (PARTITION BY mapping, arm ORDER BY time) AS survival FROM rk WHERE d > 0), {_READINGS}
 SELECT mapping, round(sum(area), 4) AS area, round(max(gap), 5) AS gap, round(sum(me), 4) AS mean_error, round(sum(ee), 5) AS end_error, round(sum(me) + 100 * sum(ee), 3) AS score FROM a GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Six readings of the cohort against the curves of overlap weights."""
    c = cohort(spark, d).withColumn("w", K.overlap_weight("arm", "e"))
    curve = V.weighted_curve(c, ["arm"], "time", "event", "w").select("arm", "time", "survival")
    inverse = F.when(F.col("arm") == 1, 1 / F.col("e")).otherwise(1 / (1 - F.col("e")))
    readings = {
        "true": ("arm", "time", "event", "w"),
        "swapped": (1 - F.col("arm"), "time", "event", "w"),
        "unweighted": ("arm", "time", "event", F.lit(1.0)),
        "censoring": ("arm", "time", 1 - F.col("event"), "w"),
        "inverse": ("arm", "time", "event", inverse),
        "months": ("arm", F.col("time") / 30.4375, "event", "w"),
    }
    m = S.curve_mappings(c, curve, readings, 730.0)
    return m.select("mapping", tidy("area", 4).alias("area"), tidy("gap", 5).alias("gap"), tidy("mean_error", 4).alias("mean_error"), tidy("end_error", 5).alias("end_error"), tidy("score", 3).alias("score"))
