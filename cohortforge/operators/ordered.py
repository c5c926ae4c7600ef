"""Ordered operators: ranks, top-k, keep-last, prefix and block summaries, false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions.columns import normal_quantile
from cohortforge.operators.running import average_ranks, cut_points, exact_quantiles, row_numbers, running, running_sums


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row of the highest ``sequence`` for each key: an aggregation, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns))


def rank_gaussian(df: DataFrame, by: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Each distinct value of a group with the normal quantile of (rank - 1/2) / n, the share held in [1e-6, 1 - 1e-6]."""
    ranks = average_ranks(df, by, value)
    size = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_size"))
    out = ranks.join(size, list(by)) if by else ranks.join(F.broadcast(size))
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("avg_rank") - 0.5) / F.col("_size")))
    return out.withColumn(name, normal_quantile(share)).drop("_size")


def signed_topk(df: DataFrame, by: Sequence[str], score: str, name: str, k: int) -> DataFrame:
    """The k largest positive and k smallest negative scores of each group, ties by name."""
    side = F.when(F.col(score) > 0, "positive").when(F.col(score) < 0, "negative")
    w = W.partitionBy(*by, "side").orderBy(F.desc(F.abs(score)), name)
    return df.withColumn("side", side).where("side is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_summary(df: DataFrame, replicate: str, value: str, prefixes: Sequence[int]) -> DataFrame:
    """Count, mean, sd and quartiles over the first k replicates, for each k."""
    ks = F.filter(F.array(*map(F.lit, prefixes)), lambda k: k >= F.col(replicate))
    q = lambda p: F.expr(f"percentile(cast(`{value}` as double), {p})")
    return df.select(value, F.explode(ks).alias("k")).groupBy("k").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.025).alias("q025"), q(0.5).alias("median"), q(0.975).alias("q975"))


def block_summary(df: DataFrame, replicate: str, value: str, size: int) -> DataFrame:
    """Count, mean and sd over blocks of so many replicates."""
    return df.groupBy(F.floor((F.col(replicate) - 1) / F.lit(size)).cast("long").alias("block")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def bh_adjust(df: DataFrame, by: Sequence[str], p: str, key: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted values of each family of tests."""
    use = df.where(F.col(p).isNotNull())
    sizes = use.groupBy(*by).agg(F.count("*").alias("_n"))
    cuts = cut_points(use, F.col(p).cast("double"))[0]
    ranked = row_numbers(use, by, p, [p, key], "_r", cuts)
    ranked = ranked.join(sizes, list(by)) if by else ranked.join(F.broadcast(sizes))  # without families one row
    least = running(ranked.withColumn("_a", F.col(p) * F.col("_n") / (F.col("_r") + 1)), by, p, {name: ("min", F.col("_a"))}, descending=True, ties=[p, key], cuts=cuts)
    return least.withColumn(name, F.least(F.lit(1.0), name)).drop("_n", "_r", "_a")


def baseline_delta(df: DataFrame, by: Sequence[str], is_base: Column, value: str, name: str = "delta") -> DataFrame:
    """Difference of each row's value from the baseline row of its group."""
    base = F.max(F.when(is_base, F.col(value))).over(W.partitionBy(*by))
    return df.withColumn(name, F.col(value) - base)


def trapezoid(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Area under the points of each group, over the length of its range."""
    w = W.partitionBy(*by).orderBy(x)
    areas = df.withColumns({"_a": (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))})
    return areas.groupBy(*by).agg(F.sum("_a").alias("area"), (F.sum("_a") / F.nullif(F.max(x) - F.min(x), F.lit(0.0))).alias("mean_height"))


def spearman(long: DataFrame, feature: str, value: str, outcome: str) -> DataFrame:
    """Rank correlation of each feature's values with the outcome, average ranks for ties.

    Ranks come from counts of distinct values; features are groups, so their number
    does not widen the plan.
    """
    use = long.where(F.col(value).isNotNull() & F.col(outcome).isNotNull())
    rx = average_ranks(use, [feature], value, "_rx").drop("n")
    ry = average_ranks(use, [feature], outcome, "_ry").drop("n")
    return use.select(feature, value, outcome).join(rx, [feature, value]).join(ry, [feature, outcome]).groupBy(feature).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


__all__ = ["average_ranks", "baseline_delta", "bh_adjust", "block_summary", "exact_quantiles", "keep_last", "prefix_summary", "rank_gaussian", "running_sums", "signed_topk", "spearman", "trapezoid"]
