"""Queries: status texts, cohort flags, column roles and pruning, id pairs, Table 1, centring, influence, quasi-random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions import status as T
from cohortforge.functions.columns import tidy
from cohortforge.operators import causal as K
from cohortforge.operators import cohorts as H
from cohortforge.plans.registry import query
from cohortforge.plans.shapes import COHORT, OUTCOMES, REPLICATES, cohort, outcomes, replicates, table

_TEXTS = (" Yes ", "not received", "TREATED", "untreated", "Positive", "neg", "1:DECEASED", "0:LIVING", "Alive", "died of disease", "", "unknown")
_RAW = "SELECT event_id, [" + ", ".join(f"'{t}'" for t in _TEXTS) + f"][event_id % {len(_TEXTS)} + 1] AS raw FROM events"


@query(
    "prj_status_texts",
    f"""WITH r AS (SELECT event_id, upper(trim(raw)) AS s FROM ({_RAW})) SELECT event_id,
 CASE WHEN s = '' THEN NULL WHEN s IN ('YES','Y','TRUE','T','1','RECEIVED','TREATED') THEN 1 WHEN s IN ('NO','N','FALSE','F','0','NOT RECEIVED','UNTREATED') THEN 0 WHEN contains(s, 'YES') OR contains(s, 'RECEIV') OR (contains(s, 'TREAT') AND NOT contains(s, 'NO')) THEN 1 WHEN starts_with(s, 'NO') THEN 0 END AS treated,
 CASE WHEN s IN ('+','1','YES') OR contains(s, 'POS') THEN 1 WHEN s IN ('-','0','NO') OR contains(s, 'NEG') THEN 0 END AS receptor,
 CASE WHEN regexp_matches(s, '^1(\\D|$)|DECEASED|DEAD|DIED|EVENT') THEN 1 WHEN regexp_matches(s, '^0(\\D|$)|LIVING|ALIVE|CENSORED') THEN 0 WHEN s IN ('TRUE','YES') THEN 1 WHEN s IN ('FALSE','NO') THEN 0 END AS died FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _TEXTS)), F.pmod("event_id", F.lit(len(_TEXTS))).cast("int") + 1)
    return table(spark, d, "events").select("event_id", T.status_text(raw).alias("treated"), T.receptor_text(raw).alias("receptor"), T.event_text(raw).alias("died"))


@query("prj_event_flag", "SELECT event_id, CASE WHEN v > 50 THEN 1 ELSE 0 END AS event, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS by_text FROM (SELECT event_id, value AS v, event_type FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") - 50).cast("string").alias("v"), F.when(F.col("event_type") == "purchase", "Yes").when(F.col("event_type") == "error", "no").otherwise(F.col("event_type")).alias("text"))
    return T.event_flag(T.event_flag(e, "v", "event", 0.8), "text", "by_text").select("event_id", "event", "by_text")


@query("flt_cohort_flags", f"WITH {COHORT}, f AS (SELECT id, CASE WHEN x2 < 2 THEN 1 WHEN x2 < 6 THEN 0 END AS er, CASE WHEN x3 < 4 THEN 1 ELSE 0 END AS pr, event AS her2 FROM c) SELECT id, CASE WHEN er IS NOT NULL AND (er = 1 OR pr = 1) AND her2 = 0 THEN 1 ELSE 0 END AS hr_positive, CASE WHEN er = 0 AND pr = 0 AND her2 = 0 THEN 1 ELSE 0 END AS triple_negative FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", F.when(F.col("x2") < 2, 1).when(F.col("x2") < 6, 0).alias("er"), (F.col("x3") < 4).cast("int").alias("pr"), F.col("event").alias("her2"))
    return H.cohort_flags(c, "er", "pr", "her2").select("id", "hr_positive", "triple_negative")


_FACTS = "SELECT unnest(['p_size', 'p_retailprice', 'p_name', 'fixed']) AS col, unnest([CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR), p_name, '3']) AS v FROM part"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"), "p_name", F.lit("3").alias("fixed"))


@query("flt_prune_columns", f"""WITH l AS ({_FACTS}), f AS (SELECT col, count(*) AS n, count(x) AS k, min(x) AS lo, max(x) AS hi FROM (SELECT col, try_cast(v AS DOUBLE) AS x FROM l) GROUP BY 1), r AS (SELECT col, CASE WHEN k < greatest(20, floor(n * 0.1)) THEN 'too_few_numeric_values' WHEN lo = hi THEN 'constant' ELSE 'included' END AS reason FROM f)
 SELECT col AS "column", CASE WHEN reason = 'included' THEN 'include' ELSE 'exclude' END AS decision, reason FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return H.prune_columns(_part(spark, d), ["p_size", "p_retailprice", "p_name", "fixed"])


@query("flt_column_roles", f"WITH {COHORT}, l AS (SELECT unnest(['arm', 'e', 'time', 'lack', 'stratum']) AS col, unnest([CAST(arm AS VARCHAR), CAST(e AS VARCHAR), CAST(time AS VARCHAR), CAST(x1 - 1000000 AS VARCHAR), stratum]) AS v FROM c), f AS (SELECT col, count(*) AS n, count(x) AS k, min(x) AS lo, max(x) AS hi, count(*) FILTER (x NOT IN (0, 1)) AS other FROM (SELECT col, try_cast(v AS DOUBLE) AS x FROM l) GROUP BY 1) SELECT col AS \"column\", CASE WHEN k < 0.8 * n THEN 'text' WHEN other = 0 THEN 'binary' WHEN lo >= 0 AND hi <= 1 THEN 'propensity' WHEN lo >= 0 THEN 'time' ELSE 'numeric' END AS role FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("lack", F.col("x1") - 1000000)
    return H.column_roles(c, ["arm", "e", "time", "lack", "stratum"]).select("column", "role")


@query("flt_frequent_features", "SELECT feature, round(frequency, 6) AS frequency FROM (SELECT p_brand AS feature, avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0 END) AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE frequency >= 0.4 ORDER BY frequency DESC, feature LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity") > 25).cast("int").alias("hit")).join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("feature")), "p_partkey")
    return H.frequent_features(long, "feature", "hit", 0.4, 10).select("feature", tidy("frequency").alias("frequency"))


@query(
    "jn_id_pairs",
    """WITH a AS (SELECT DISTINCT unnest(['l_orderkey', 'l_suppkey']) AS lc, unnest([l_orderkey, l_suppkey]) AS id FROM lineitem), b AS (SELECT DISTINCT unnest(['o_orderkey', 'o_custkey']) AS rc, unnest([o_orderkey, o_custkey]) AS id FROM orders),
 s AS (SELECT lc, rc, count(*) AS shared FROM a JOIN b USING (id) GROUP BY 1, 2), na AS (SELECT lc, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT rc, count(*) AS m FROM b GROUP BY 1)
 SELECT lc AS left_column, rc AS right_column, shared, round(shared / (n + m - shared)::DOUBLE, 6) AS jaccard, round(shared / least(n, m)::DOUBLE, 6) AS coverage FROM s JOIN na USING (lc) JOIN nb USING (rc)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = H.id_pairs(table(spark, d, "lineitem"), table(spark, d, "orders"), ["l_orderkey", "l_suppkey"], ["o_orderkey", "o_custkey"])
    return p.select("left_column", "right_column", "shared", tidy("jaccard").alias("jaccard"), tidy("coverage").alias("coverage"))


@query(
    "xo_table_one",
    f"""WITH {COHORT}, l AS (SELECT arm, e AS w, unnest(['x2', 'x3']) AS feature, unnest([x2, x3]) AS x FROM c),
 g AS (SELECT feature, arm, avg(x) AS m, sum(w * x) / sum(w) AS wm, var_pop(x) AS v, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2 AS wv, count(*) - count(x) AS miss FROM l GROUP BY 1, 2)
 SELECT feature, round((max(m) FILTER (arm = 1) - max(m) FILTER (arm = 0)) / sqrt(avg(v)), 6) AS smd_raw, round((max(wm) FILTER (arm = 1) - max(wm) FILTER (arm = 0)) / sqrt(avg(wv)), 6) AS smd_weighted, round(max(m) FILTER (arm = 1), 6) AS mean_treated, round(max(m) FILTER (arm = 0), 6) AS mean_control, round(max(wm) FILTER (arm = 1), 6) AS w_mean_treated, round(max(wm) FILTER (arm = 0), 6) AS w_mean_control, CAST(sum(miss) AS BIGINT) AS missing FROM g GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = H.table_one(cohort(spark, d), "arm", "e", ["x2", "x3"])
    return t.select("feature", *(tidy(c).alias(c) for c in ("smd_raw", "smd_weighted", "mean_treated", "mean_control", "w_mean_treated", "w_mean_control")), "missing")


@query("xo_centring", f"WITH {REPLICATES}, g AS (SELECT scenario, count(*) AS n, avg(estimate) AS m, stddev_samp(estimate) / sqrt(count(*)) AS mcse FROM p GROUP BY 1) SELECT scenario, n, round(m, 6) AS mean, round(abs(m - 4.5) / mcse, 6) AS z, CASE WHEN n < 100 THEN 'too_few' WHEN abs(m - 4.5) / mcse <= 2 THEN 'acceptable' ELSE 'concern' END AS status FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = H.centring(replicates(spark, d), ["scenario"], "estimate", F.lit(4.5))
    return c.select("scenario", "n", tidy("mean").alias("mean"), tidy("z").alias("z"), "status")


@query("xo_influence", f"WITH {OUTCOMES}, s AS (SELECT id, e * (1 - e) AS h, e * (1 - e) * (mu1 - mu0) + arm * (1 - e) * (y - mu1) - (1 - arm) * e * (y - mu0) AS v FROM o), t AS (SELECT sum(v) / sum(h) AS est, sum(h) AS den, count(*) AS n FROM s), i AS (SELECT id, (v - est * h) / (den / n) AS f FROM s, t), r AS (SELECT id, f, row_number() OVER (ORDER BY round(abs(f), 6) DESC, id) AS rank FROM i) SELECT id, round(f, 4) AS influence FROM r WHERE rank <= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = K.stabilised_scores(outcomes(spark, d), "y", "arm", "e", "mu0", "mu1")
    return H.influence(scored, "id", 20).select("id", tidy("influence", 4).alias("influence"))


@query("rs_halton", "SELECT c_custkey, round(u1, 9) AS u1, round(u2, 9) AS u2 FROM (SELECT c_custkey, list_sum(list_transform(range(0, 20), lambda k: ((c_custkey // CAST(pow(2, k) AS BIGINT)) % 2) / pow(2, k + 1))) AS u1, list_sum(list_transform(range(0, 14), lambda k: ((c_custkey // CAST(pow(3, k) AS BIGINT)) % 3) / pow(3, k + 1))) AS u2 FROM customer)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return H.halton(table(spark, d, "customer"), "c_custkey").select("c_custkey", tidy("u1", 9).alias("u1"), tidy("u2", 9).alias("u2"))
