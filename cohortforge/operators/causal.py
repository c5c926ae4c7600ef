"""Balancing weights, augmented overlap estimators, treatment sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip, ratio
from cohortforge.operators.running import exact_quantiles


def overlap_weight(arm: str, score: str) -> Column:
    """a (1 - e) + (1 - a) e."""
    a, e = F.col(arm), F.col(score)
    return a * (F.lit(1.0) - e) + (F.lit(1.0) - a) * e


def stabilised_weights(df: DataFrame, arm: str, score: str, truncate: float | None = None, trim: tuple[float, float] | None = None) -> DataFrame:
    """Inverse probability weights times the arm's share; optionally rows outside a score range go, and weights are cut at a quantile."""
    if trim:
        df = df.where(F.col(score).between(*trim))
    share = df.agg(F.avg(F.col(arm).cast("double")).alias("_p"))
    out = df.join(F.broadcast(share))  # one row
    out = out.withColumn("iptw", F.when(F.col(arm) == 1, F.col("_p") / F.col(score)).otherwise((1 - F.col("_p")) / (1 - F.col(score)))).drop("_p")
    if truncate is None:
        return out
    limit = exact_quantiles(out, [], "iptw", {"_cap": truncate})
    return out.join(F.broadcast(limit)).withColumn("iptw", F.least("iptw", "_cap")).drop("_cap")


def clipped_scores(df: DataFrame, y: str, arm: str, score: str, mu0: str, mu1: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds h, score_num and the three components of the overlap-weighted augmented estimator with inverse, clipped propensities."""
    e = clip(score, low, high)
    a = F.col(arm)
    h = e * (F.lit(1.0) - e)
    treated, control = h * a / e * (F.col(y) - F.col(mu1)), h * (F.lit(1.0) - a) / (F.lit(1.0) - e) * (F.col(y) - F.col(mu0))
    plugin = h * (F.col(mu1) - F.col(mu0))
    return df.withColumns({"h": h, "plugin": plugin, "treated_residual": treated, "control_residual": -control, "score_num": plugin + treated - control})


def stabilised_scores(df: DataFrame, y: str, arm: str, score: str, mu0: str, mu1: str) -> DataFrame:
    """The same without an inverse of the propensity: a (1 - e) and (1 - a) e weigh the residuals."""
    e, a = F.col(score), F.col(arm)
    h = e * (F.lit(1.0) - e)
    treated, control = a * (F.lit(1.0) - e) * (F.col(y) - F.col(mu1)), (F.lit(1.0) - a) * e * (F.col(y) - F.col(mu0))
    plugin = h * (F.col(mu1) - F.col(mu0))
    return df.withColumns({"h": h, "plugin": plugin, "treated_residual": treated, "control_residual": -control, "score_num": plugin + treated - control})


def score_estimate(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimate sum(score_num) / sum(h), its components, the influence-function standard error and the 95 % interval."""
    part = {c: F.sum(c).alias(f"_{c}") for c in ("score_num", "h", "plugin", "treated_residual", "control_residual")}
    total = scored.groupBy(*by).agg(F.count("*").alias("n"), *part.values())
    total = total.select(*by, "n", ratio("_score_num", "_h").alias("estimate"), (F.col("_h") / F.col("n")).alias("_mean_h"), *(ratio(f"_{c}", "_h").alias(c) for c in ("plugin", "treated_residual", "control_residual")))
    joined = scored.select(*by, "score_num", F.col("h").alias("_h1")).join(total, list(by)) if by else scored.select("score_num", F.col("h").alias("_h1")).join(F.broadcast(total))
    influence = (F.col("score_num") - F.col("estimate") * F.col("_h1")) / F.nullif(F.col("_mean_h"), F.lit(0.0))
    keep = ["n", "estimate", "plugin", "treated_residual", "control_residual"]
    out = joined.groupBy(*by).agg(*(F.first(c).alias(c) for c in keep), F.stddev_samp(influence).alias("_sd"))
    se = F.col("_sd") / F.sqrt("n")
    return out.select(*by, *keep, se.alias("se"), (F.col("estimate") - 1.96 * se).alias("ci_low"), (F.col("estimate") + 1.96 * se).alias("ci_high"))


def crossfit_arm_means(df: DataFrame, y: str, arm: str, fold: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Adds mu0 and mu1: the mean outcome of each arm over all other folds.

    Fold totals are taken once; the mean without a fold is total less fold, so nothing
    is fitted fold by fold.
    """
    sums = df.groupBy(fold).agg(*(x for a in (0, 1) for x in (F.sum(F.when(F.col(arm) == a, F.col(y)).otherwise(0.0)).alias(f"_s{a}"), F.count_if(F.col(arm) == a).alias(f"_n{a}"))))
    every = W.partitionBy(F.lit(1))
    out = sums.select(fold, *(ratio(F.sum(f"_s{a}").over(every) - F.col(f"_s{a}"), F.sum(f"_n{a}").over(every) - F.col(f"_n{a}")).alias(f"mu{a}") for a in (0, 1)))
    if bounds:
        out = out.withColumns({f"mu{a}": clip(f"mu{a}", *bounds) for a in (0, 1)})
    return df.join(F.broadcast(out), fold)  # a row for each fold


def leave_one_group_out(df: DataFrame, group: str, numerator: str = "score_num", denominator: str = "h") -> DataFrame:
    """Estimate without each group, with it alone, and with all."""
    sums = df.groupBy(group).agg(F.sum(numerator).alias("_a"), F.sum(denominator).alias("_b"), F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))  # a row for each group
    a, b = F.sum("_a").over(every), F.sum("_b").over(every)
    return sums.select(group, "n", ratio("_a", "_b").alias("alone"), ratio(a - F.col("_a"), b - F.col("_b")).alias("without"), ratio(a, b).alias("overall"))


def calibration(df: DataFrame, y: str, arm: str, mu0: str, mu1: str) -> DataFrame:
    """Error of the prediction for the arm a subject is in: over all and by arm."""
    p = F.when(F.col(arm) == 1, F.col(mu1)).otherwise(F.col(mu0))
    use = df.withColumns({"_p": p, "_r": F.col(y) - p})
    return use.cube(F.col(arm).alias("_arm")).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("_r").alias("bias"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"), F.avg(F.abs("_r")).alias("mae"), F.avg(y).alias("mean_y"), F.avg("_p").alias("mean_pred")).select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("_arm").cast("string")).alias("arm"), "n", "bias", "rmse", "mae", "mean_y", "mean_pred"
    )


def sequence_registry(records: DataFrame, patient: str, family: str, day: str, families: Mapping[str, str], landmark: float) -> DataFrame:
    """One row per patient: earliest start, any record and any record without a start of each family, then order and category.

    ``families`` maps a family to its short name; the first two are the pair whose
    order is judged at the landmark.
    """
    aggs = []
    for name, short in families.items():
        of = F.col(family) == name
        aggs += [F.min(F.when(of & (F.col(day) >= 0), F.col(day))).alias(f"{short}_start"), F.max(of.cast("int")).alias(f"{short}_any"), F.max((of & F.col(day).isNull()).cast("int")).alias(f"{short}_undated"), F.count_if(of & (F.col(day) < 0)).alias(f"{short}_before")]
    out = records.groupBy(patient).agg(F.count("*").alias("n_records"), *aggs)
    first, second = list(families.values())[:2]
    a, b = F.col(f"{first}_start"), F.col(f"{second}_start")
    order = F.when(a.isNull() & b.isNull(), "neither").when(b.isNull(), f"{first}_only").when(a.isNull(), f"{second}_only").when(a < b, f"{first}_first").when(a > b, f"{second}_first").otherwise("same_day")
    category = F.when(a <= landmark, F.when(b <= landmark, "both_by_landmark").otherwise(f"{first}_by_landmark")).when(b <= landmark, f"{second}_by_landmark").otherwise("none_by_landmark")
    ascertainable = (~((F.col(f"{first}_any") == 1) & a.isNull()) & ~((F.col(f"{second}_any") == 1) & b.isNull())).cast("int")
    return out.withColumns({"sequence_order": order, "landmark_category": category, "ascertainable": ascertainable})
