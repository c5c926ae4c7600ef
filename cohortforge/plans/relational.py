"""Queries: joins, aggregations, ordered operators, sets, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions import columns as C
from cohortforge.functions.columns import tidy
from cohortforge.operators import aggregates as A
from cohortforge.operators import joins as J
from cohortforge.operators import ordered as O
from cohortforge.operators import sets as S
from cohortforge.operators.survival import weighted_curve
from cohortforge.plans.registry import query
from cohortforge.plans.shapes import COHORT, RECORDS, REPLICATES, SELECTIONS, cohort, records, replicates, selections, table

# ---- joins


@query("jn_checked_inner", "SELECT o_orderkey, o_totalprice, sum(l_quantity) AS qty, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))
    return J.checked_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


@query("jn_left_lookup", "SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = J.checked_join(c, table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"], "left", "m:1")
    return J.checked_join(n, table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"], "left", "m:1").select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query(
    "jn_full_coalesce",
    """SELECT coalesce(a.c_custkey, b.o_custkey) AS patient_id, a.v AS v_x, b.v AS v_y FROM (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_acctbal > 0) a
 FULL JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    b = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return J.full_join(a, b, "c_custkey", "o_custkey", "patient_id")


@query(
    "jn_anti_report",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
 SELECT k, 'left_only' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return J.anti_report(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("jn_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(
    "jn_pair_self",
    f"""WITH {COHORT}, u AS (SELECT cust, stratum, avg(x1) AS v FROM c WHERE arm = 1 GROUP BY 1, 2), m AS (SELECT cust, x3, arm, avg(x1) AS v FROM c GROUP BY 1, 2, 3)
 SELECT a.cust, a.x3, round(a.v, 6) AS v1, round(b.v, 6) AS v0, round(a.v - b.v, 6) AS difference FROM m a JOIN m b ON a.cust = b.cust AND a.x3 = b.x3 AND a.arm = 1 AND b.arm = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    # one aggregation gives both sides of the pair; no second scan, no self join
    pick = lambda a: F.avg(F.when(F.col("arm") == a, F.col("x1")))
    pairs = cohort(spark, d).groupBy("cust", "x3").agg(pick(1).alias("v1"), pick(0).alias("v0")).where("v1 is not null and v0 is not null")
    return pairs.select("cust", "x3", tidy("v1").alias("v1"), tidy("v0").alias("v0"), tidy(F.col("v1") - F.col("v0")).alias("difference"))


_KM = """t AS (SELECT arm, time, sum(e) AS w, sum(CASE WHEN event = 1 THEN e ELSE 0 END) AS events FROM c GROUP BY 1, 2),
 k AS (SELECT arm, time, events, sum(w) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM t),
 km AS (SELECT arm, time, risk, events, exp(sum(ln(1 - events / risk)) OVER (PARTITION BY arm ORDER BY time)) AS survival FROM k WHERE events > 0)"""


@query(
    "jn_asof_step",
    f"""WITH {COHORT}, {_KM}, q AS (SELECT DISTINCT arm, CAST(g AS DOUBLE) AS at FROM c, (SELECT unnest(range(0, 1500, 30)) AS g))
 SELECT q.arm, q.at, round(coalesce((SELECT arg_max(survival, km.time) FROM km WHERE km.arm = q.arm AND km.time <= q.at), 1.0), 6) AS survival FROM q""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    grid = c.select("arm").distinct().select("arm", F.explode(F.transform(F.sequence(F.lit(0), F.lit(1470), F.lit(30)), lambda x: x.cast("double"))).alias("at"))
    return J.step_lookup(grid, weighted_curve(c, ["arm"], "time", "event", "e"), ["arm"], "at", "time", "survival").select("arm", "at", tidy("survival").alias("survival"))


@query(
    "jn_interval_risk",
    f"""WITH {COHORT}, s AS (SELECT arm, x2 * 20 AS a, x2 * 20 + time AS b, event, e FROM c), t AS (SELECT DISTINCT arm, b AS t FROM s)
 SELECT t.arm, t.t, round(sum(s.e), 6) AS risk, round(sum(CASE WHEN s.b = t.t AND s.event = 1 THEN s.e ELSE 0 END), 6) AS events FROM t JOIN s ON s.arm = t.arm AND s.a < t.t AND t.t <= s.b GROUP BY 1, 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cohort(spark, d).withColumns({"a": F.col("x2") * 20, "b": F.col("x2") * 20 + F.col("time")})
    return J.at_risk(rows, ["arm"], "a", "b", "e", "event").select("arm", "t", tidy("risk").alias("risk"), tidy("events").alias("events"))


@query("jn_cross_clone", f"WITH {COHORT} SELECT id, strategy, k AS interval, k * 365.0::DOUBLE AS start FROM c, (SELECT unnest([0, 1]) AS strategy), (SELECT unnest(range(0, 4)) AS k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    both = c.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("strategy"))
    return both.select("id", "strategy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("interval")).withColumn("start", F.col("interval") * F.lit(365.0))


@query("jn_add_new_columns", "SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.lit("other").alias("s_name"))
    return J.add_new_columns(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), n, ["s_nationkey"], "inner", "m:1").select("s_suppkey", "s_name", "s_nationkey", "n_name")


@query("jn_bridge", "SELECT o_orderkey AS row_id, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("k"))
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return J.bridge(rows, links, table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), "n_name"), "k", "n").select("row_id", "n_name")


# ---- aggregations


@query("ag_named", f"WITH {COHORT} SELECT stratum, count(*) AS n, count(DISTINCT cust) AS n_cust, round(min(x1), 6) AS lo, round(max(x1), 6) AS hi, round(avg(x1), 6) AS mean, round(median(x1), 6) AS med, round(stddev_samp(x1), 6) AS sd FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    named = c.groupBy("stratum").agg(F.count("*").alias("n"), F.count_distinct("cust").alias("n_cust"), tidy(F.min("x1")).alias("lo"), tidy(F.max("x1")).alias("hi"), tidy(F.avg("x1")).alias("mean"), tidy(F.stddev_samp("x1")).alias("sd"))
    return named.join(O.exact_quantiles(c, ["stratum"], "x1", {"med": 0.5}), "stratum").withColumn("med", tidy("med"))


@query("ag_null_keys", f"WITH {RECORDS} SELECT day, count(*) AS n, count(day) AS n_dated, 1 AS keeps_null FROM r GROUP BY 1 UNION ALL SELECT day, count(*), count(day), 0 FROM r WHERE day IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    by = records(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count("day").alias("n_dated"))
    return by.select("day", "n", "n_dated", F.explode(F.when(F.col("day").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))).alias("keeps_null"))


@query("ag_filtered", f"WITH {RECORDS} SELECT patient, min(day) FILTER (day >= 0) AS first_day, count(*) FILTER (day < 0) AS n_before, round(avg(CASE WHEN day > 10 THEN 1.0 WHEN day IS NOT NULL THEN 0.0 END), 6) AS share_late FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("patient").agg(F.min(F.when(F.col("day") >= 0, F.col("day"))).alias("first_day"), F.count_if(F.col("day") < 0).alias("n_before"), tidy(F.avg((F.col("day") > 10).cast("double"))).alias("share_late"))


@query("ag_quantiles", f"WITH {COHORT} SELECT arm, round(quantile_cont(x1, 0.025), 6) AS q025, round(quantile_cont(x1, 0.25), 6) AS q25, round(quantile_cont(x1, 0.5), 6) AS q50, round(quantile_cont(x1, 0.975), 6) AS q975 FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q975": 0.975}
    return O.exact_quantiles(cohort(spark, d), ["arm"], "x1", names).select("arm", *(tidy(n).alias(n) for n in names))


@query("ag_crosstab_margins", f"WITH {COHORT} SELECT CASE WHEN grouping(stratum) = 1 THEN 'All' ELSE stratum END AS row_key, CASE WHEN grouping(arm) = 1 THEN 'All' ELSE CAST(arm AS VARCHAR) END AS column_key, count(*) AS n FROM c GROUP BY CUBE (stratum, arm)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab(cohort(spark, d), "stratum", "arm")


@query("ag_pivot_first", f"WITH {REPLICATES} SELECT method, " + ", ".join(f"arg_min(estimate, rep) FILTER (scenario = {k}) AS s{k}" for k in range(4)) + " FROM p GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    wide = replicates(spark, d).groupBy("method").pivot("scenario", [0, 1, 2, 3]).agg(F.min_by("estimate", "rep"))
    return wide.select("method", *(F.col(str(k)).alias(f"s{k}") for k in range(4)))


@query("ag_median_collapse", "SELECT p_brand, p_size, round(median(p_retailprice), 6) AS price FROM part GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(tidy(F.expr("percentile(p_retailprice, 0.5)")).alias("price"))


@query("ag_conflict_resolve", f"WITH {COHORT} SELECT cust, round(median(x3), 6) AS value, count(DISTINCT x3) AS n_values, CASE WHEN count(DISTINCT x3) > 1 THEN 1 ELSE 0 END AS conflict FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve_conflicts(cohort(spark, d), ["cust"], "x3").withColumn("value", tidy("value"))


@query("ag_first_nonempty", "SELECT user_id, arg_min(event_type, event_id) AS value, count(DISTINCT event_type) AS n_values FROM events WHERE event_type <> 'view' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("event_type")))
    return A.first_nonempty(e, ["user_id"], "t", "event_id")


_MOMENTS = "count(*) AS n, sum(e * x1) / sum(e) AS mean, sum(e * x1 * x1) / sum(e) - (sum(e * x1) / sum(e)) ^ 2 AS variance, sum(e) ^ 2 / sum(e * e) AS ess"


@query("ag_weighted_moments", f"WITH {COHORT} SELECT stratum, n, round(mean, 4) AS mean, round(variance / 1e6, 3) AS variance, round(ess, 4) AS ess FROM (SELECT stratum, {_MOMENTS} FROM c GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = A.weighted_moments(cohort(spark, d), ["stratum"], "x1", "e")
    return m.select("stratum", "n", tidy("mean", 4).alias("mean"), tidy(F.col("variance") / 1e6, 3).alias("variance"), tidy("ess", 4).alias("ess"))


@query("ag_ess", f"WITH {COHORT} SELECT arm, round(sum(e) ^ 2 / sum(e * e), 5) AS ess, round(sum(e) ^ 2 / sum(e * e) / count(*), 6) AS share FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("arm").agg(tidy(A.effective_size("e"), 5).alias("ess"), tidy(A.effective_size("e") / F.count("*")).alias("share"))


@query("ag_smd", f"WITH {COHORT}, m AS (SELECT stratum, arm, avg(x2) AS m, var_pop(x2) AS v FROM (SELECT x3 AS stratum, arm, x2 FROM c) GROUP BY 1, 2) SELECT a.stratum AS month, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd FROM m a JOIN m b ON a.stratum = b.stratum AND a.arm = 1 AND b.arm = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    of = lambda f, a: f(F.when(F.col("arm") == a, F.col("x2")))
    g = cohort(spark, d).groupBy(F.col("x3").alias("month")).agg(of(F.avg, 1).alias("m1"), of(F.avg, 0).alias("m0"), of(F.var_pop, 1).alias("v1"), of(F.var_pop, 0).alias("v0"))
    return g.select("month", tidy(A.smd(F.col("m1"), F.col("m0"), F.col("v1"), F.col("v0"))).alias("smd"))


_BAL = " UNION ALL ".join(f"SELECT '{x}' AS feature, arm, {x} AS v, CASE WHEN arm = 1 THEN 1 - e ELSE e END AS w FROM c" for x in ("x1", "x2", "x3"))


@query(
    "ag_balance_table",
    f"""WITH {COHORT}, l AS ({_BAL}), m AS (SELECT feature, arm, avg(v) AS m, var_pop(v) AS s, sum(w * v) / sum(w) AS wm, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ^ 2 AS ws FROM l GROUP BY 1, 2)
 SELECT a.feature, round(a.m, 4) AS mean_treated, round(b.m, 4) AS mean_control, round((a.m - b.m) / sqrt((a.s + b.s) / 2), 6) AS smd_raw, round(a.wm, 4) AS w_mean_treated, round(b.wm, 4) AS w_mean_control,
 round((a.wm - b.wm) / sqrt((a.ws + b.ws) / 2), 6) AS smd_weighted FROM m a JOIN m b ON a.feature = b.feature AND a.arm = 1 AND b.arm = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("w", F.when(F.col("arm") == 1, 1 - F.col("e")).otherwise(F.col("e")))
    b = A.balance_table(c, "arm", "w", ["x1", "x2", "x3"])
    return b.select("feature", *(tidy(x, 4).alias(x) if "mean" in x else tidy(x).alias(x) for x in b.columns[1:]))


@query("ag_propensity_summary", f"WITH {COHORT} SELECT arm, count(*) AS n, round(avg(e), 6) AS mean, round(min(e), 6) AS lo, round(max(e), 6) AS hi, round(quantile_cont(e, 0.05), 6) AS q05, round(quantile_cont(e, 0.95), 6) AS q95, round(avg(CASE WHEN e < 0.15 OR e > 0.85 THEN 1.0 ELSE 0.0 END), 6) AS tails FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    ends = O.exact_quantiles(c, ["arm"], "e", {"q05": 0.05, "q95": 0.95}).select("arm", tidy("q05").alias("q05"), tidy("q95").alias("q95"))
    return c.groupBy("arm").agg(F.count("*").alias("n"), tidy(F.avg("e")).alias("mean"), tidy(F.min("e")).alias("lo"), tidy(F.max("e")).alias("hi"), tidy(F.avg(((F.col("e") < 0.15) | (F.col("e") > 0.85)).cast("double"))).alias("tails")).join(ends, "arm")


@query("ag_corr", f"WITH {COHORT} SELECT stratum, round(corr(x1, x3), 6) AS r FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("stratum").agg(tidy(F.corr("x1", "x3")).alias("r"))


@query("ag_ratio_estimand", f"WITH {COHORT}, u AS (SELECT arm, cust, avg(x1 / 1000.0::DOUBLE) AS num, avg(e) AS den FROM c GROUP BY 1, 2) SELECT arm, count(*) AS n_units, round(sum(num) / sum(den), 5) AS estimate FROM u GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = A.ratio_estimand(cohort(spark, d).withColumn("x", F.col("x1") / 1000.0), "cust", "x", "e", ["arm"])
    return r.select("arm", "n_units", tidy("estimate", 5).alias("estimate"))


@query("ag_gates", f"WITH {REPLICATES} SELECT method, CASE WHEN bool_and(ok = 1) THEN 1 ELSE 0 END AS all_ok, CASE WHEN bool_or(low > 0) THEN 1 ELSE 0 END AS any_above FROM p GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return replicates(spark, d).groupBy("method").agg(F.bool_and(F.col("ok") == 1).cast("int").alias("all_ok"), F.bool_or(F.col("low") > 0).cast("int").alias("any_above"))


@query(
    "ag_profile_missing",
    """WITH v AS (SELECT "column", n_rows, n_missing, n_distinct FROM (
 SELECT 'user_id' AS "column", count(*) AS n_rows, count(*) - count(user_id) AS n_missing, count(DISTINCT user_id) AS n_distinct FROM events UNION ALL
 SELECT 'event_type', count(*), count(*) - count(event_type), count(DISTINCT event_type) FROM events UNION ALL
 SELECT 'rare', count(*), count(*) - count(CASE WHEN event_id % 9 = 0 THEN event_type END), count(DISTINCT CASE WHEN event_id % 9 = 0 THEN event_type END) FROM events))
 SELECT *, round(n_missing / n_rows::DOUBLE, 6) AS share_missing, CASE WHEN n_distinct <= 1 THEN 1 ELSE 0 END AS is_constant FROM v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.when(F.pmod("event_id", F.lit(9)) == 0, F.col("event_type")).alias("rare"))
    return A.profile(e).withColumn("share_missing", tidy("share_missing"))


@query("ag_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("ag_concat_sorted", "SELECT user_id, string_agg(t, '|' ORDER BY t) AS types FROM (SELECT DISTINCT user_id, event_type AS t FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"))


# ---- ordered


@query("wn_avg_rank", f"WITH {COHORT} SELECT id, arm, rank() OVER (PARTITION BY arm ORDER BY x3) + (count(*) OVER (PARTITION BY arm, x3) - 1) / 2.0::DOUBLE AS avg_rank FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", "arm", "x3")
    return c.join(O.average_ranks(c, ["arm"], "x3").drop("n"), ["arm", "x3"]).select("id", "arm", "avg_rank")


@query("wn_rank_gaussian")
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.rank_gaussian(cohort(spark, d), ["arm"], "time").select("arm", "time", "n", tidy("z").alias("z"))


@query("wn_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_last(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").withColumn("value", tidy("value"))


@query(
    "wn_prefix_summary",
    f"""WITH {REPLICATES} SELECT k, count(estimate) AS n, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS sd, round(quantile_cont(estimate, 0.025), 6) AS q025, round(median(estimate), 6) AS median,
 round(quantile_cont(estimate, 0.975), 6) AS q975 FROM p JOIN (SELECT unnest([25, 50, 100]) AS k) ON rep <= k GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = O.prefix_summary(replicates(spark, d), "rep", "estimate", [25, 50, 100])
    return s.select("k", "n", *(tidy(c).alias(c) for c in s.columns[2:]))


@query("wn_block_summary", f"WITH {REPLICATES} SELECT CAST(floor((rep - 1) / 20.0) AS BIGINT) AS block, count(estimate) AS n, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS sd FROM p GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = O.block_summary(replicates(spark, d), "rep", "estimate", 20)
    return s.select("block", "n", tidy("mean").alias("mean"), tidy("sd").alias("sd"))


_PV = "pv AS (SELECT p_brand AS family, p_partkey AS key, ((p_partkey * 7919) % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS p FROM part)"


@query("wn_bh_fdr", f"WITH {_PV}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS r, count(*) OVER (PARTITION BY family) AS n FROM pv) SELECT family, key, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("key"), ((F.pmod(F.col("p_partkey") * 7919, F.lit(1000)) + 0.5) / 1000.0).alias("p"))
    return O.bh_adjust(t, ["family"], "p", "key").select("family", "key", tidy("p").alias("p"), tidy("q").alias("q"))


@query("wn_baseline_delta", f"WITH {REPLICATES}, m AS (SELECT scenario, method, avg(estimate) AS v FROM p GROUP BY 1, 2) SELECT scenario, method, round(v - max(v) FILTER (method = 'BUILDING') OVER (PARTITION BY scenario), 6) AS delta FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = replicates(spark, d).groupBy("scenario", "method").agg(F.avg("estimate").alias("v"))
    return O.baseline_delta(m, ["scenario"], F.col("method") == "BUILDING", "v").select("scenario", "method", tidy("delta").alias("delta"))


@query("wn_trapezoid", f"WITH {COHORT}, g AS (SELECT arm, x3 AS x, avg(x2) AS y FROM c GROUP BY 1, 2), a AS (SELECT arm, x, (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS a FROM g WINDOW w AS (PARTITION BY arm ORDER BY x)) SELECT arm, round(sum(a), 6) AS area, round(sum(a) / (max(x) - min(x)), 6) AS mean_height FROM a GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("arm", F.col("x3").alias("x")).agg(F.avg("x2").alias("y"))
    return O.trapezoid(g, ["arm"], "x", "y").select("arm", tidy("area").alias("area"), tidy("mean_height").alias("mean_height"))


@query("tk_signed_topk", "WITH s AS (SELECT c_mktsegment AS g, c_name AS name, c_acctbal - 4000 AS score, CASE WHEN c_acctbal > 4000 THEN 'positive' WHEN c_acctbal < 4000 THEN 'negative' END AS side FROM customer) SELECT g, name, round(score, 6) AS score, side, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY abs(score) DESC, name) AS r FROM s WHERE side IS NOT NULL) WHERE r <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_name").alias("name"), (F.col("c_acctbal") - 4000).alias("score"))
    return O.signed_topk(t, ["g"], "score", "name", 5).withColumn("score", tidy("score"))


@query("tk_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("tk_argmin", "SELECT c_nationkey, arg_min(c_custkey, c_acctbal) AS poorest, arg_max(c_custkey, c_acctbal) AS richest FROM customer GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of customers with equal balances the one with the smallest key, which SQL meets first; without a balance none counts."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    place = lambda tie: F.when(balance.isNotNull() & key.isNotNull(), F.struct(balance, tie))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by(key, place(key)).alias("poorest"), F.max_by(key, place(-key)).alias("richest"))


@query("tk_reindex", "SELECT s.pos, s.segment, count(c_custkey) AS n FROM (SELECT unnest([0, 1, 2]) AS pos, unnest(['HOUSEHOLD', 'ABSENT', 'BUILDING']) AS segment) s LEFT JOIN customer ON c_mktsegment = s.segment GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    order = spark.createDataFrame([(0, "HOUSEHOLD"), (1, "ABSENT"), (2, "BUILDING")], "pos int, segment string")
    n = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return order.join(n, "segment", "left").select("pos", "segment", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("fs_spearman_screen", f"WITH {COHORT}, l AS (SELECT 'x1' AS feature, x1 AS v, time FROM c UNION ALL SELECT 'x2', x2, time FROM c UNION ALL SELECT 'x3', x3, time FROM c), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY time) + (count(*) OVER (PARTITION BY feature, time) - 1) / 2.0::DOUBLE AS ry FROM l) SELECT feature, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    long = A.unpivot(cohort(spark, d), ["time"], ["x1", "x2", "x3"])
    return O.spearman(long, "feature", "value", "time").withColumn("rho", tidy("rho"))


# ---- sets

_PAIRS = """g AS (SELECT DISTINCT repeat * 10 + fold AS g, feature FROM sel), z AS (SELECT g, count(*) AS n FROM g GROUP BY 1), pr AS (SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b FROM z a JOIN z b ON a.g < b.g),
 i AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM g x JOIN g y ON x.feature = y.feature AND x.g < y.g GROUP BY 1, 2), pq AS (SELECT pr.*, coalesce(k, 0) AS shared FROM pr LEFT JOIN i USING (a, b))"""


@query("st_jaccard_pairs", f"WITH {SELECTIONS}, {_PAIRS} SELECT a, b, n_a, n_b, shared, round(shared / (n_a + n_b - shared)::DOUBLE, 6) AS jaccard, round(shared / least(n_a, n_b)::DOUBLE, 6) AS overlap FROM pq")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = selections(spark, d).withColumn("g", F.col("repeat") * 10 + F.col("fold"))
    return S.pair_overlaps(s, "g", "feature").select("a", "b", "n_a", "n_b", "shared", tidy("jaccard").alias("jaccard"), tidy("overlap").alias("overlap"))


@query("st_chance_adjusted", f"WITH {SELECTIONS}, {_PAIRS} SELECT a, b, round(n_a * n_b / k::DOUBLE, 6) AS expected, round((shared - n_a * n_b / k::DOUBLE) / nullif(least(n_a, n_b) - n_a * n_b / k::DOUBLE, 0), 6) AS beyond_chance FROM pq, (SELECT count(DISTINCT p_brand || '-' || p_size) AS k FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = selections(spark, d).withColumn("g", F.col("repeat") * 10 + F.col("fold"))
    known = table(spark, d, "part").select("p_brand", "p_size").distinct().count()
    return S.pair_overlaps(s, "g", "feature", known).select("a", "b", tidy("expected").alias("expected"), tidy("beyond_chance").alias("beyond_chance"))


@query(
    "st_hypergeom",
    """WITH b AS (SELECT p_brand, count(*) AS drawn, count(*) FILTER (p_size <= 15) AS overlap FROM part GROUP BY 1), t AS (SELECT count(*) AS population, count(*) FILTER (p_size <= 15) AS marked FROM part)
 SELECT p_brand, drawn, overlap, round(CASE WHEN overlap <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(greatest(overlap, drawn + marked - population), least(marked, drawn) + 1), lambda i: exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(population - marked + 1) - lgamma(drawn - i + 1) - lgamma(population - marked - drawn + i + 1) - lgamma(population + 1) + lgamma(drawn + 1) + lgamma(population - drawn + 1))))) END, 6) AS p FROM b, t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The chance of as many small parts in each brand."""
    part = table(spark, d, "part")
    small = F.count_if(F.col("p_size") <= 15)
    whole = part.agg(F.count("*").alias("population"), small.alias("marked"))
    brands = part.groupBy("p_brand").agg(F.count("*").alias("drawn"), small.alias("overlap")).join(F.broadcast(whole))  # one row
    return brands.select("p_brand", "drawn", "overlap", tidy(C.hypergeometric_tail("overlap", "population", "marked", "drawn")).alias("p"))


@query(
    "st_enrichment",
    """WITH q AS (SELECT l_partkey AS gene, sum(l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT gene FROM q JOIN part ON p_partkey = gene WHERE q.q > (SELECT avg(q) FROM q)),
 t AS (SELECT (SELECT count(*) FROM part) AS population, (SELECT count(*) FROM s) AS drawn), c AS (SELECT p_brand AS pathway, count(*) AS marked, count(s.gene) AS overlap FROM part LEFT JOIN s ON s.gene = p_partkey GROUP BY 1),
 p AS (SELECT pathway, marked, overlap, population, drawn, CASE WHEN overlap <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(greatest(overlap, drawn + marked - population), least(marked, drawn) + 1), lambda i: exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(population - marked + 1) - lgamma(drawn - i + 1) - lgamma(population - marked - drawn + i + 1) - lgamma(population + 1) + lgamma(drawn + 1) + lgamma(population - drawn + 1))))) END::DOUBLE AS p FROM c, t),
 r AS (SELECT *, row_number() OVER (ORDER BY p, pathway) AS r, count(*) OVER () AS m FROM p)
 SELECT pathway, marked, overlap, population, drawn, round(p, 6) AS p, round(overlap / (marked * drawn / population::DOUBLE), 6) AS fold, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    named = part.select(F.col("p_brand").alias("pathway"), F.col("p_partkey").alias("gene"))
    total = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("q"))
    chosen = total.where(F.col("q") > total.agg(F.avg("q")).scalar()).select("gene")
    e = S.enrichment(chosen, named, part.select(F.col("p_partkey").alias("gene")), "pathway", "gene")
    return e.select("pathway", "marked", "overlap", "population", "drawn", tidy("p").alias("p"), tidy("fold").alias("fold"), tidy("q").alias("q"))


@query("st_selection_frequency", f"WITH {SELECTIONS}, f AS (SELECT repeat, count(DISTINCT fold) AS folds FROM sel GROUP BY 1), n AS (SELECT repeat, feature, count(DISTINCT fold) AS n FROM sel GROUP BY 1, 2) SELECT feature, CAST(sum(n) AS BIGINT) AS n_folds, count(*) AS n_repeats, count(*) FILTER (n >= 0.5 * folds) AS n_stable FROM n JOIN f USING (repeat) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.selection_frequency(selections(spark, d), "repeat", "fold", "feature")


@query("st_common_population", f"WITH {COHORT} SELECT cust, count(DISTINCT stratum) AS n_repeats FROM c GROUP BY 1 HAVING count(DISTINCT stratum) = (SELECT count(DISTINCT stratum) FROM c)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.common_population(cohort(spark, d), "cust", "stratum")


@query("st_union_by_name", "SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("st_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- projections

_TRI = (" Yes ", "no", "0.7", "[Not Available]", "2", "", "Positive", "0.2", "pos", "TRUE", "1", "1.0", "present", " Detected", "negative", "neg", "False", "0", "0.0", "absent", "not detected", "y", "treated")
_RAW = "SELECT event_id, [" + ", ".join(f"'{t}'" for t in _TRI) + f"][event_id % {len(_TRI)} + 1] AS raw FROM events"


@query("prj_tristate", f"SELECT event_id, CASE WHEN lower(trim(raw)) IN ('positive','pos','yes','true','1','1.0','present','detected') THEN 1 WHEN lower(trim(raw)) IN ('negative','neg','no','false','0','0.0','absent','not detected') THEN 0 WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN CAST(try_cast(raw AS DOUBLE) > 0.5 AS INTEGER) END::DOUBLE AS flag FROM ({_RAW})")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _TRI)), F.pmod("event_id", F.lit(len(_TRI))).cast("int") + 1)
    return table(spark, d, "events").select("event_id", C.tristate(raw).cast("double").alias("flag"))


@query("prj_numeric", "SELECT event_id, try_cast(v AS DOUBLE) AS x FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'NA' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.pmod("event_id", F.lit(4)) == 0, "NA").otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", C.numeric(raw).alias("x"))


@query("prj_id_normalize", "SELECT c_custkey, CASE WHEN regexp_extract(t, '^([A-Z]+-[0-9]{3})', 1) <> '' THEN regexp_extract(t, '^([A-Z]+-[0-9]{3})', 1) ELSE t END AS patient FROM (SELECT c_custkey, replace(upper(trim(' case_' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || CASE WHEN c_custkey % 2 = 0 THEN '_01a ' ELSE '' END)), '_', '-') AS t FROM customer)")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" case_"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "_01a ").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", C.normalise_id(raw, "^([A-Z]+-[0-9]{3})").alias("patient"))


_FAMILIES = (("hormone", "purchase|tamox"), ("chemo", "click|signup"), ("targeted", "sign|trast"))


@query("prj_family_regex", "SELECT event_id, CASE WHEN regexp_matches(event_type, 'purchase|tamox') THEN 'hormone' WHEN regexp_matches(event_type, 'click|signup') THEN 'chemo' WHEN regexp_matches(event_type, 'sign|trast') THEN 'targeted' ELSE 'other' END AS family, concat_ws('|', CASE WHEN regexp_matches(event_type, 'purchase|tamox') THEN 'hormone' END, CASE WHEN regexp_matches(event_type, 'click|signup') THEN 'chemo' END, CASE WHEN regexp_matches(event_type, 'sign|trast') THEN 'targeted' END) AS families FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.first_family("event_type", _FAMILIES).alias("family"), C.all_families("event_type", _FAMILIES).alias("families"))


@query("prj_ordinal_collapse", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 3.0 WHEN p_size % 3 = 0 THEN 2.0 WHEN p_size % 2 = 0 THEN 1.0 END::DOUBLE AS stage, CASE WHEN p_size % 5 = 0 OR p_size % 3 = 0 OR p_size % 2 = 0 THEN 0 ELSE 1 END AS stage_missing FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    flags = {f"s{k}": (F.pmod("p_size", F.lit(m)) == 0).cast("int") for k, m in ((1, 2), (2, 3), (3, 5))}
    top, unknown = C.one_hot_ordinal([("s1", 1), ("s2", 2), ("s3", 3)])
    return table(spark, d, "part").withColumns(flags).select("p_partkey", top.alias("stage"), unknown.alias("stage_missing"))


@query("prj_valid_day", f"WITH {RECORDS} SELECT event_id, CASE WHEN day BETWEEN 0 AND 20 THEN day END AS day FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("event_id", C.in_range("day", 0, 20).alias("day"))


@query("prj_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS held FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", C.clip("c_acctbal", 0.0, 5000.0).alias("held"))


@query("prj_impute_scale", "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer), m AS (SELECT median(x) AS md FROM t WHERE k % 5 <> 0), f AS (SELECT k, coalesce(x, md) AS x FROM t, m), s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f WHERE k % 5 <> 0) SELECT k, round((x - mu) / sd, 6) AS x FROM f, s")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.pmod("c_custkey", F.lit(6)) != 0, F.col("c_acctbal")).alias("x"))
    return A.impute_scale(t, F.pmod("k", F.lit(5)) != 0, ["x"]).select("k", tidy("x").alias("x"))


@query("prj_status_5y", f"WITH {COHORT}, k AS (SELECT id, event, CASE WHEN id % 7 <> 0 THEN time - id % 40 END AS time FROM c) SELECT id, CASE WHEN time IS NULL OR time < 0 THEN 'invalid' WHEN time > 1095 THEN 'alive' WHEN event = 1 THEN 'death' ELSE 'censored' END AS status FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Times counted from a later day, so that some lie before it; a seventh has none."""
    status = F.when(F.col("time").isNull() | (F.col("time") < 0), "invalid").when(F.col("time") > 1095, "alive").when(F.col("event") == 1, "death").otherwise("censored")
    later = F.when(F.pmod("id", F.lit(7)) != 0, F.col("time") - F.pmod("id", F.lit(40)))
    return cohort(spark, d).withColumn("time", later).select("id", status.alias("status"))


@query("prj_bins", "SELECT o_orderkey, CASE WHEN y <= 1993 THEN 'early' WHEN y <= 1996 THEN 'middle' ELSE 'late' END AS era FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.when(y <= 1993, "early").when(y <= 1996, "middle").otherwise("late").alias("era"))


@query("prj_identifier_class", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#[0-9]+$') THEN 'brand' ELSE 'other' END AS kind, regexp_replace(p_brand, '^Brand#', '') AS bare FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_brand").rlike("^Brand#[0-9]+$"), "brand").otherwise("other").alias("kind"), F.regexp_replace("p_brand", "^Brand#", "").alias("bare"))


@query("prj_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: len(w) BETWEEN 3 AND 4))), ',') AS tokens FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w).between(3, 4))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("tokens"))
