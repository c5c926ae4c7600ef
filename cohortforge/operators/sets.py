"""Set statistics over memberships: overlap, stability, enrichment, common population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import hypergeometric_tail
from cohortforge.operators.ordered import bh_adjust


def pair_overlaps(members: DataFrame, group: str, element: str, population: int | None = None, most_groups: int = 10_000) -> DataFrame:
    """Size of both sets, intersection, Jaccard index and overlap coefficient of each pair of groups that are named in ``members``.

    Intersections are counted by element, so sets are never gathered; pairs that share
    nothing are added from the groups' sizes.  With ``population``, the overlap beyond
    chance: (O - E) / (min - E).  All pairs of groups are named, so more than
    ``most_groups`` of them are an error.
    """
    m = members.where(F.col(group).isNotNull() & F.col(element).isNotNull()).select(group, element).distinct()
    sizes = m.groupBy(group).agg(F.count("*").alias("n"))
    found = sizes.count()
    if found > most_groups:
        raise ValueError(f"{found} groups; all pairs are named for {most_groups} at most")
    a, b = sizes.select(F.col(group).alias("a"), F.col("n").alias("n_a")), sizes.select(F.col(group).alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # groups are folds, repeats or models: few
    x, y = m.select(F.col(group).alias("a"), element), m.select(F.col(group).alias("b"), element)
    shared = x.join(y, element).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    least = F.least("n_a", "n_b")
    out = out.withColumns({"jaccard": F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), "overlap": F.col("shared") / least})
    if population is not None:
        expected = F.col("n_a") * F.col("n_b") / F.lit(float(population))
        out = out.withColumns({"expected": expected, "beyond_chance": (F.col("shared") - expected) / F.nullif(least - expected, F.lit(0.0))})
    return out


def enrichment(selected: DataFrame, sets: DataFrame, universe: DataFrame, name: str, element: str) -> DataFrame:
    """Over-representation of selected elements in each named set, within the universe, with adjusted values."""
    u = universe.select(element).distinct()
    s = selected.select(element).distinct().join(u, element, "left_semi").withColumn("_hit", F.lit(1))
    inside = sets.select(name, element).distinct().join(u, element, "left_semi")
    totals = u.agg(F.count("*").alias("population")).join(F.broadcast(s.agg(F.count("*").alias("drawn"))))
    counts = inside.join(s, element, "left").groupBy(name).agg(F.count("*").alias("marked"), F.count("_hit").alias("overlap"))
    out = counts.join(F.broadcast(totals))  # one row
    out = out.withColumns({"p": hypergeometric_tail("overlap", "population", "marked", "drawn"), "fold": F.col("overlap") / F.nullif(F.col("marked") * F.col("drawn") / F.col("population"), F.lit(0.0))})
    return bh_adjust(out.withColumn("_f", F.lit(1)), ["_f"], "p", name).drop("_f")


def selection_frequency(selected: DataFrame, repeat: str, fold: str, feature: str, stable: float = 0.5) -> DataFrame:
    """In how many folds a feature is chosen, and in how many repeats in at least the share ``stable`` of the folds."""
    folds = selected.select(repeat, fold).distinct().groupBy(repeat).agg(F.count("*").alias("_folds"))
    per = selected.select(repeat, fold, feature).distinct().groupBy(repeat, feature).agg(F.count("*").alias("_n"))
    return per.join(folds, repeat).groupBy(feature).agg(F.sum("_n").alias("n_folds"), F.count("*").alias("n_repeats"), F.count_if(F.col("_n") >= stable * F.col("_folds")).alias("n_stable"))


def common_population(df: DataFrame, key: str, repeat: str) -> DataFrame:
    """Keys that every repeat has."""
    n = df.select(repeat).distinct().agg(F.count("*").alias("_all"))
    per = df.select(key, repeat).distinct().groupBy(key).agg(F.count("*").alias("n_repeats"))
    return per.join(F.broadcast(n)).where("n_repeats = _all").drop("_all")  # one row


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
