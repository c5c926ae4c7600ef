"""The tables at hand in the shapes that the operators work on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject for each order: time, event, arm, propensity e, covariates, cluster, stratum."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        (F.pmod(key * 37, F.lit(1460)) + 1).cast("double").alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("arm"),
        (F.lit(0.1) + F.pmod(cust, F.lit(80)) / F.lit(100.0)).alias("e"),
        F.col("o_totalprice").alias("x1"),
        F.pmod(cust, F.lit(7)).cast("double").alias("x2"),
        F.month("o_orderdate").cast("double").alias("x3"),
        cust.alias("cust"),
        F.col("o_orderpriority").alias("stratum"),
    )


COHORT = """c AS (SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 1460 + 1 AS DOUBLE) AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS arm, 0.1::DOUBLE + (o_custkey % 80) / 100.0::DOUBLE AS e, o_totalprice AS x1,
 CAST(o_custkey % 7 AS DOUBLE) AS x2, CAST(month(o_orderdate) AS DOUBLE) AS x3, o_custkey AS cust, o_orderpriority AS stratum FROM orders)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort with an outcome y, five folds and outcome predictions mu0 and mu1."""
    c = cohort(spark, sf_dir)
    return c.withColumns({"y": F.least("time", F.lit(730.0)), "fold": F.pmod("id", F.lit(5)), "mu0": F.lit(300.0) + F.col("x2") * 10, "mu1": F.lit(320.0) + F.col("x3") * 5})


OUTCOMES = COHORT + """, o AS (SELECT *, least(time, 730.0::DOUBLE) AS y, id % 5 AS fold, 300.0::DOUBLE + x2 * 10 AS mu0, 320.0::DOUBLE + x3 * 5 AS mu1 FROM c)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment records of users from events: family, day since 2024-01-01 (null for a tenth, some before 0)."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient"), "event_id", F.col("event_type").alias("family"), F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit(None)).otherwise(day - F.lit(2.0)).cast("double").alias("day")
    )


RECORDS = """r AS (SELECT user_id AS patient, event_id, event_type AS family, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) - 2.0::DOUBLE END AS day
 FROM events)"""


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort with a day on which treatment starts, null for a third, and an ambiguity flag."""
    c = cohort(spark, sf_dir)
    return c.withColumns({"started": F.when(F.pmod("id", F.lit(3)) != 0, F.pmod(F.col("id") * 13, F.lit(400)).cast("double")), "ambiguous": (F.pmod("id", F.lit(17)) == 0).cast("int")})


STARTS = COHORT + """, s AS (SELECT *, CASE WHEN id % 3 <> 0 THEN CAST((id * 13) % 400 AS DOUBLE) END AS started, CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS ambiguous FROM c)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate estimates: (scenario, method, rep) with estimate, truth, bounds and a success flag, from customers."""
    key = F.col("c_custkey")
    est = F.col("c_acctbal") / 1000.0
    return table(spark, sf_dir, "customer").select(
        F.pmod(key, F.lit(4)).cast("int").alias("scenario"),
        F.col("c_mktsegment").alias("method"),
        (F.floor(key / F.lit(4)) + 1).cast("long").alias("rep"),
        est.alias("estimate"),
        F.lit(4.5).alias("truth"),
        (est - 1.5).alias("low"),
        (est + 1.5).alias("high"),
        (F.pmod(key, F.lit(11)) != 0).cast("int").alias("ok"),
    )


REPLICATES = """p AS (SELECT CAST(c_custkey % 4 AS INTEGER) AS scenario, c_mktsegment AS method, CAST(floor(c_custkey / 4.0) AS BIGINT) + 1 AS rep, c_acctbal / 1000.0::DOUBLE AS estimate, 4.5::DOUBLE AS truth,
 c_acctbal / 1000.0::DOUBLE - 1.5::DOUBLE AS low, c_acctbal / 1000.0::DOUBLE + 1.5::DOUBLE AS high, CASE WHEN c_custkey % 11 <> 0 THEN 1 ELSE 0 END AS ok FROM customer)"""


def hashed_sql(*parts: str) -> str:
    """``resample.hashed`` in DuckDB SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features chosen by (repeat, fold): brand and size of the parts whose quantity over all lines there is above the mean of features."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("-", "p_brand", "p_size").alias("feature"))
    by = li.join(named, "l_partkey").groupBy(F.pmod("l_orderkey", F.lit(3)).cast("int").alias("repeat"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("fold"), "feature").agg(F.sum("l_quantity").alias("q"))
    mean = by.groupBy("repeat", "fold").agg(F.avg("q").alias("mean"))
    return by.join(mean, ["repeat", "fold"]).where("q > mean").select("repeat", "fold", "feature")


SELECTIONS = """sel AS (SELECT repeat, fold, feature FROM (SELECT *, avg(q) OVER (PARTITION BY repeat, fold) AS mean FROM (SELECT CAST(l_orderkey % 3 AS INTEGER) AS repeat, CAST(l_suppkey % 4 AS INTEGER) AS fold, p_brand || '-' || p_size AS feature, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE q > mean)"""
