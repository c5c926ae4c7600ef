"""Weighted moments, balance, profiles, conflict resolution and ratio estimands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import finite, ratio
from cohortforge.operators.running import exact_quantiles


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form: one row for each row and column, values as doubles."""
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(ids), list(columns), name, value)


def weighted_moments(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """n, mean, population variance and effective sample size under weights; rows with a value or weight that is not finite, or a weight below zero, are left out.

    The variance is taken around a first unweighted mean, so that it does not lose
    digits where the mean is large.
    """
    use = df.where(finite(value) & finite(weight) & (F.col(weight) >= 0))
    centre = use.groupBy(*by).agg(F.avg(value).alias("_m"))
    # the keys of a balance table are few: Spark broadcasts them where their size allows
    use = use.join(centre, list(by)) if by else use.join(F.broadcast(centre))
    d = F.col(value) - F.col("_m")
    w = F.col(weight)
    out = use.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wd2"), F.first("_m").alias("m"))
    shift = ratio("wd", "w")
    return out.select(*by, "n", (F.col("m") + shift).alias("mean"), F.greatest(ratio("wd2", "w") - shift * shift, F.lit(0.0)).alias("variance"), ratio(F.col("w") * F.col("w"), "w2").alias("ess"))


def effective_size(weight: str) -> Column:
    """Kish's effective sample size, null for weights that sum to zero."""
    return ratio(F.pow(F.sum(weight), 2), F.sum(F.col(weight) * F.col(weight)))


def smd(m1: Column, m0: Column, v1: Column, v0: Column, flat: str = "null", tiny: float = 1e-12) -> Column:
    """(m1 - m0) over the root of the mean variance.

    Where that root is under ``tiny``: null (``flat="null"``), or zero for equal means
    and infinity otherwise (``flat="inf"``).
    """
    sd = F.sqrt((v1 + v0) / 2)
    value = (m1 - m0) / F.when(sd >= tiny, sd)
    if flat == "null":
        return value
    return F.when(sd >= tiny, value).when(F.abs(m1 - m0) < tiny, F.lit(0.0)).when(m1 > m0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))


def balance_table(df: DataFrame, arm: str, weight: str, features: Sequence[str]) -> DataFrame:
    """Weighted and unweighted mean, variance and standardised difference of each feature between arms 1 and 0."""
    long = unpivot(df, [arm, weight], features)
    raw = weighted_moments(long.withColumn("_one", F.lit(1.0)), ["feature", arm], "value", "_one")
    weighted = weighted_moments(long, ["feature", arm], "value", weight)
    pick = lambda c, a: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = [x.groupBy("feature").agg(*(pick(c, a).alias(f"{p}{c}{a}") for c in ("mean", "variance") for a in (1, 0))) for p, x in (("u_", raw), ("w_", weighted))]
    both = wide[0].join(wide[1], "feature")
    return both.select(
        "feature",
        F.col("u_mean1").alias("mean_treated"),
        F.col("u_mean0").alias("mean_control"),
        smd(F.col("u_mean1"), F.col("u_mean0"), F.col("u_variance1"), F.col("u_variance0")).alias("smd_raw"),
        F.col("w_mean1").alias("w_mean_treated"),
        F.col("w_mean0").alias("w_mean_control"),
        smd(F.col("w_mean1"), F.col("w_mean0"), F.col("w_variance1"), F.col("w_variance0")).alias("smd_weighted"),
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, missing, share missing, approximate-free distinct count, constant flag.

    All columns are profiled in one pass over their text forms.
    """
    columns = list(columns or df.columns)
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    # counts by value first: the distinct count is then a plain count, combined before the shuffle
    by_value = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = by_value.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.count("value").alias("n_distinct"))
    return out.withColumns({"share_missing": F.col("n_missing") / F.col("n_rows"), "is_constant": (F.col("n_distinct") <= 1).cast("int")})


def resolve_conflicts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median of the values of each group, with how many there are and whether they differ."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.expr(f"percentile(cast(`{value}` as double), 0.5)").alias("value"), F.count_distinct(value).alias("n_values"), (F.count_distinct(value) > 1).cast("int").alias("conflict"))


def first_nonempty(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """First non-empty value of each group by ``order``, and the number of distinct ones."""
    text = F.nullif(F.trim(F.col(value).cast("string")), F.lit(""))
    return df.withColumn("_v", text).where("_v is not null").groupBy(*by).agg(F.min_by("_v", order).alias("value"), F.count_distinct("_v").alias("n_values"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of both keys with margins, in long form; ``All`` names a margin."""
    return df.cube(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(
        F.when(F.col("g").bitwiseAND(2) > 0, "All").otherwise(F.col("row")).alias("row_key"), F.when(F.col("g").bitwiseAND(1) > 0, "All").otherwise(F.col("column")).alias("column_key"), "n"
    )


def ratio_estimand(df: DataFrame, unit: str, numerator: str, denominator: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over units of mean numerators, over the sum of mean denominators."""
    each = df.groupBy(*by, unit).agg(F.avg(numerator).alias("num"), F.avg(denominator).alias("den"))
    return each.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("estimate", ratio("num", "den"))


def two_modes(df: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``recovered``: 0 near the lower, 1 near the upper of the two commonest values, null elsewhere."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).count()
    modes = counts.orderBy(F.desc("count"), "_v").limit(2).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    x = F.col(value).cast("double")
    return df.join(F.broadcast(modes)).withColumn("recovered", F.when(F.abs(x - F.col("_lo")) <= tolerance, 0).when(F.abs(x - F.col("_hi")) <= tolerance, 1)).drop("_lo", "_hi")  # one row


def confusion(df: DataFrame, truth: str, derived: str) -> DataFrame:
    """Counts of the four cells, agreement, sensitivity, specificity; rows with a null are left out."""
    use = df.where(F.col(truth).isNotNull() & F.col(derived).isNotNull())
    cell = lambda t, d: F.count_if((F.col(truth) == t) & (F.col(derived) == d))
    c = use.agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    return c.withColumns({"agreement": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "sensitivity": ratio("tp", F.col("tp") + F.col("fn")), "specificity": ratio("tn", F.col("tn") + F.col("fp"))})


def impute_scale(df: DataFrame, train: Column, columns: Sequence[str], fallback: float = 0.0) -> DataFrame:
    """Columns with medians in place of nulls, centred and scaled by population moments; all fitted where ``train`` holds."""
    fitted = df.where(train)
    medians = exact_quantiles(unpivot(fitted, [], columns), ["feature"], "value", {"_md": 0.5})
    wide = medians.agg(*(F.coalesce(F.max(F.when(F.col("feature") == c, F.col("_md"))), F.lit(fallback)).alias(f"_md_{c}") for c in columns))
    filled = df.join(F.broadcast(wide)).withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_md_{c}")) for c in columns})  # one row
    moments = filled.where(train).agg(*(x for c in columns for x in (F.avg(f"_f_{c}").alias(f"_mu_{c}"), F.stddev_pop(f"_f_{c}").alias(f"_sd_{c}"))))
    scaled = filled.join(F.broadcast(moments)).withColumns({c: (F.col(f"_f_{c}") - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") > 1e-12, F.col(f"_sd_{c}")).otherwise(1.0) for c in columns})
    return scaled.select(*df.columns)
