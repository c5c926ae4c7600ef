"""Queries whose results come from fitted models or seeded draws; SQL has no counterpart; the README says which of them tests hold to plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.columns import tidy
from cohortforge.operators import causal as K
from cohortforge.operators import models as D
from cohortforge.operators import resample as R
from cohortforge.plans.registry import query
from cohortforge.plans.shapes import cohort, outcomes


def scaled(spark: SparkSession, d: str) -> DataFrame:
    """The outcomes with covariates of about unit size."""
    return outcomes(spark, d).withColumns({"z1": F.col("x1") / 100000.0, "z2": F.col("x2") / 7, "z3": F.col("x3") / 12})


_Z = ["z1", "z2", "z3"]


@query("ca_propensity_ml")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.crossfit_propensity(scaled(spark, d), "arm", _Z, "fold", 5).select("id", "fold", tidy("propensity", 4).alias("propensity"))


@query("ca_propensity_mle")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d)
    return D.predict_logistic(s, D.logistic_mle(s, "arm", _Z), _Z).select("id", tidy("propensity").alias("propensity"))


@query("ca_ridge_outcome")
def _(spark: SparkSession, d: str) -> DataFrame:
    fitted = D.crossfit_outcomes(scaled(spark, d).drop("mu0", "mu1"), "y", "arm", _Z, "fold", 5, bounds=(0.0, 730.0))
    e = K.score_estimate(K.stabilised_scores(fitted, "y", "arm", "e", "mu0", "mu1"))
    return e.select("n", *(tidy(c, 3).alias(c) for c in e.columns if c != "n"))


@query("ca_rlearner")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d).withColumn("m", (F.col("mu0") + F.col("mu1")) / 2)
    return D.residual_effect(s, "y", "arm", "m", "e", _Z).select("id", tidy("tau", 3).alias("tau"))


@query("ca_pca")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.principal_components(scaled(spark, d), _Z, 2).select("id", *(tidy(F.abs(F.col("pc")[i]), 4).alias(f"pc{i + 1}") for i in range(2)))


@query("md_cox")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d)
    return D.cox_by_group(s, ["fold"], "time", "event", ["arm", *_Z], 0.001).select("fold", "feature", tidy("coefficient", 5).alias("coefficient"))


@query("md_calibration_slope")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d).withColumn("log_risk", F.col("z1") - F.col("z3"))
    return D.cox_by_group(s, ["arm"], "time", "event", ["log_risk"]).select("arm", tidy("coefficient", 5).alias("slope"))


@query("fs_iamb")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d).withColumns({"target": F.col("z1") + 0.5 * F.col("z3"), "copy": F.col("z3") + F.col("z2")})
    chosen = D.markov_blanket(s, "target", [*_Z, "copy", "e"])
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(chosen)], "place int, feature string")


@query("rs_refit_bootstrap")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d).select("id", "time", "event", "arm", *_Z)
    drawn = R.bootstrap_counts(s, "id", 12).join(s, "id")
    copies = drawn.select("replicate", "time", "event", "arm", *_Z, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_c"))
    return D.cox_by_group(copies, ["replicate"], "time", "event", ["arm", *_Z], 0.001).select("replicate", "feature", tidy("coefficient", 5).alias("coefficient"))


@query("xo_exponential_tilt")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d)
    lam = D.exponential_tilt(s.where("arm = 0"), _Z, list(s.where("arm = 1").agg(*(F.avg(c) for c in _Z)).first()))
    w = F.exp(sum((F.col(c) * float(v) for c, v in zip(_Z, lam, strict=True)), F.lit(0.0)))
    raw = s.where("arm = 0").select("id", w.alias("w"))
    return raw.join(F.broadcast(raw.agg(F.avg("w").alias("m")))).select("id", tidy(F.col("w") / F.col("m")).alias("weight"))


@query("rs_simulate")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = cohort(spark, d).count()
    return D.simulate_cohort(spark, n, 42).groupBy("arm", "time").agg(F.count("*").alias("n"), F.sum("event").alias("events"))
