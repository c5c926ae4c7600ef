"""Joins that hold to a stated cardinality, step lookups and interval counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.operators.running import cut_points, running


def guard_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows; a key that comes twice raises an error when the plan runs.

    The check is a window over the key, which shares the shuffle of a join on it.
    Rows with a null in the key are not checked.
    """
    n = F.count("*").over(W.partitionBy(*keys))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    broken = F.when(known & (F.col("_n") > 1), F.raise_error(F.concat(F.lit(f"{what}: key {', '.join(keys)} is not unique: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(True)
    return df.withColumn("_n", n).where(broken).drop("_n")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", cardinality: str = "1:1") -> DataFrame:
    """Equi join that raises unless the keys are unique on the sides that ``cardinality`` says (1:1, m:1, 1:m, m:m)."""
    one_left, one_right = cardinality.split(":")
    if one_left == "1":
        left = guard_unique(left, on, "left side")
    if one_right == "1":
        right = guard_unique(right, on, "right side")
    return left.join(right, list(on), how)


def add_new_columns(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "1:1") -> DataFrame:
    """Join that takes from the right side only columns that the left has not."""
    new = [c for c in right.columns if c in on or c not in left.columns]
    return checked_join(left, right.select(*new), on, how, cardinality)


def full_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer 1:1 join on keys of different names; clashing columns get suffixes, the key is what either has."""
    shared = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    a = guard_unique(left, [left_key], "left side").select(F.col(left_key).alias("_a"), *(F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns if c != left_key))
    b = guard_unique(right, [right_key], "right side").select(F.col(right_key).alias("_b"), *(F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c != right_key))
    return a.join(b, F.col("_a") == F.col("_b"), "full").withColumn(key, F.coalesce("_a", "_b")).drop("_a", "_b")


def anti_report(left: DataFrame, right: DataFrame, on: Sequence[str], names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Distinct keys that only one side has, and which."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit(names[0])).union(b.join(a, list(on), "left_anti").withColumn("side", F.lit(names[1])))


def bridge(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str, least_coverage: float = 0.999) -> DataFrame:
    """Left rows with the right columns, by way of a table of key pairs; raises if too few left rows arrive."""
    joined = left.join(guard_unique(links, [left_key], "links"), left_key, "left").join(guard_unique(right, [right_key], "right side").withColumn("_hit", F.lit(1)), right_key, "left")
    share = joined.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("_share"))
    ok = F.when(F.col("_share") < least_coverage, F.raise_error(F.concat(F.lit("coverage "), F.col("_share").cast("string"))).cast("boolean")).otherwise(True)
    return joined.join(F.broadcast(share)).where(ok).drop("_share", "_hit")  # one row


def step_lookup(points: DataFrame, curve: DataFrame, by: Sequence[str], at: str, time: str, value: str, before: float = 1.0, left_limit: bool = False) -> DataFrame:
    """The curve's last value at each point, or just before it with ``left_limit``; ``before`` ahead of the first step.

    The distinct points and the steps are stacked and values carried forward, inside pieces of the time
    axis and from piece to piece; rows then join their point, so that any share of them may
    stand at one.
    """
    rank = F.lit(0 if left_limit else 1)
    moments = points.groupBy(*by, F.col(at).cast("double").alias("_t")).agg(F.count("*").alias("_n"))
    p = moments.select(*by, "_t", rank.alias("_o"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_point"))
    c = curve.select(*by, F.col(time).cast("double").alias("_t"), (F.lit(1) - rank).alias("_o"), F.col(value).cast("double").alias("_v"), F.lit(False).alias("_point"))
    stacked = p.union(c)
    held = running(stacked, by, "_t", {"_held": ("last", F.col("_v"))}, ties=["_o"]).where("_point")
    held = held.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_t").alias("_of_t"), "_held")
    match = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by), F.col(at).cast("double").eqNullSafe(F.col("_of_t")))
    extra = [c for c in points.columns if c not in (*by, at)]
    return points.join(held, match, "left").select(*by, at, *extra, F.coalesce("_held", F.lit(before)).alias(value))


def at_risk(rows: DataFrame, by: Sequence[str], start: str, stop: str, weight: str, event: str) -> DataFrame:
    """Weight at risk (start < t <= stop) and of events at every stop time t of each group.

    Entries add weight and exits take it away, so the risk set is one running sum over
    the distinct times; rows are never joined to times.
    """
    w = F.col(weight)
    changes = rows.select(*by, F.explode(F.array(F.struct(F.col(start).cast("double").alias("t"), w.alias("enter"), F.lit(0.0).alias("leave"), F.lit(0.0).alias("d"), F.lit(0).alias("stops")), F.struct(F.col(stop).cast("double").alias("t"), F.lit(0.0).alias("enter"), w.alias("leave"), (w * (F.col(event) == 1).cast("double")).alias("d"), F.lit(1).alias("stops")))).alias("x")).select(*by, "x.*")
    by_time = changes.groupBy(*by, "t").agg(*(F.sum(c).alias(c) for c in ("enter", "leave", "d", "stops")))
    return running(by_time, by, "t", {"risk": ("sum", F.col("enter") - F.col("leave"))}, inclusive=False, cuts=cut_points(rows, F.col(stop).cast("double"))[0]).where("stops > 0").select(*by, "t", "risk", F.col("d").alias("events"))


def ordered_lookup(draws: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Table rows in the order and number that ``draws`` (with its place column) asks for; a key that the table has not raises an error.

    The table's key is unique, or that is an error too.  A key that is drawn twice comes twice.
    """
    found = draws.join(guard_unique(table, [key], "table").withColumn("_hit", F.lit(1)), key, "left")
    lost = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"{key} not found: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return found.where(lost).drop("_hit")


def bind_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side by a stable row key; a row that only one side has raises an error.  Names of the right that the left has are left out."""
    a = guard_unique(left, [key], "left side").withColumn("_l", F.lit(1))
    new = [c for c in right.columns if c == key or c not in left.columns]
    b = guard_unique(right.select(*new), [key], "right side").withColumn("_r", F.lit(1))
    lone = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit(f"{key} on one side only: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return a.join(b, key, "full").where(lone).drop("_l", "_r")
