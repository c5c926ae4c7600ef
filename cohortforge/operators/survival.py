"""Person-period rows, weighted survival curves, restricted means and censoring weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip
from cohortforge.operators.joins import at_risk
from cohortforge.operators.running import cut_points, exact_quantiles, running, running_sums


def interval_grid(horizon: float, width: float) -> Column:
    """Array of (interval, start, end): starts at 0, width, ...; the last end is the horizon."""
    n = int(-(-horizon // width))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("interval"), (k * width).cast("double").alias("start"), F.least((k + 1) * width, F.lit(horizon)).cast("double").alias("end")))


def person_period(df: DataFrame, horizon: float, width: float, time: str = "time", event: str = "event") -> DataFrame:
    """A row for each interval that starts by the subject's time.

    ``censor_event`` is 1 where an uncensored time lies in the interval, both ends
    included, so that a time on a border counts in two intervals; ``event_in`` likewise
    for events.
    """
    rows = df.select("*", F.explode(interval_grid(horizon, width)).alias("_i")).select("*", "_i.*").drop("_i").where(F.col(time) >= F.col("start"))
    inside = F.col(time).between(F.col("start"), F.col("end"))
    return rows.withColumns({"censor_event": (inside & (F.col(event) == 0)).cast("int"), "event_in": (inside & (F.col(event) == 1)).cast("int")})


def single_exit_period(df: DataFrame, last_event: str, last_censor: str, intervals: int) -> DataFrame:
    """Rows up to the first of event interval, censoring interval and last interval; only the last row is flagged, the event first."""
    stop = F.least(F.coalesce(F.col(last_event), F.lit(intervals)), F.coalesce(F.col(last_censor), F.lit(intervals)), F.lit(intervals - 1))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), stop)).alias("interval"))
    event = F.coalesce(F.col("interval") == F.col(last_event), F.lit(False))
    return rows.withColumns({"event_in": event.cast("int"), "censor_in": (~event & F.coalesce(F.col("interval") == F.col(last_censor), F.lit(False))).cast("int")})


def weighted_curve(df: DataFrame, by: Sequence[str], time: str, event: str, weight: str) -> DataFrame:
    """Weighted Kaplan-Meier steps: time, risk (weight with time at or after), events, survival, and ``before``, the survival ahead of the step.

    Rows are first summed by distinct time.  The product of steps is a running sum of
    logarithms; a step to zero is carried apart, so that a curve that reaches zero
    stays there.
    """
    w = F.col(weight).cast("double")
    by_time = df.where(F.col(time).isNotNull() & (w > 0)).groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum(w).alias("w"), F.sum(w * (F.col(event) == 1).cast("double")).alias("events"))
    cuts = cut_points(df, F.col(time).cast("double"))[0]
    at = running_sums(by_time, by, "time", {"risk": F.col("w")}, descending=True, cuts=cuts).where("events > 0")
    return _product_of_steps(at, by, "time", cuts)


def _product_of_steps(steps: DataFrame, by: Sequence[str], time: str, cuts: Sequence[float]) -> DataFrame:
    step = F.lit(1.0) - F.col("events") / F.col("risk")
    dead = step <= 1e-12
    own = steps.withColumns({"_own": F.when(dead, 0.0).otherwise(F.ln(F.when(dead, 1.0).otherwise(step))), "_end": dead.cast("double")})
    logs = running_sums(own, by, time, {"_log": F.col("_own"), "_dead": F.col("_end")}, cuts=cuts)
    alive = lambda log, ends: F.when(ends > 0, 0.0).otherwise(F.exp(log))
    return logs.select(*by, F.col(time).alias("time"), "risk", "events", alive(F.col("_log"), F.col("_dead")).alias("survival"), alive(F.col("_log") - F.col("_own"), F.col("_dead") - F.col("_end")).alias("before"))


def restricted_mean(curve: DataFrame, by: Sequence[str], horizon: float, groups: DataFrame | None = None, start: float = 0.0) -> DataFrame:
    """Area under the step curve from ``start`` to ``horizon``, and its value at the horizon.

    ``groups`` are all groups there are: one without a step has survival 1.  The area is
    that of the value at the start less, for each later step, its drop times what is
    left of the range: sums only, no window.  A curve without ``before``, the value ahead
    of each step, gets it from the step that comes ahead.
    """
    if "before" not in curve.columns:
        curve = running(curve, by, "time", {"before": ("last", F.col("survival"))}, inclusive=False).withColumn("before", F.coalesce("before", F.lit(1.0)))
    inside = (F.col("time") > start) & (F.col("time") <= horizon)
    sums = curve.groupBy(*by).agg(
        F.max_by("survival", F.when(F.col("time") <= start, F.col("time"))).alias("_s0"),
        F.max_by("survival", F.when(F.col("time") <= horizon, F.col("time"))).alias("_last"),
        F.sum(F.when(inside, (F.col("before") - F.col("survival")) * (F.lit(horizon) - F.col("time")))).alias("_lost"),
    )
    out = (groups or curve).select(*by).distinct().join(sums, list(by), "left")
    s0 = F.coalesce("_s0", F.lit(1.0))
    return out.select(*by, (s0 * (horizon - start) - F.coalesce("_lost", F.lit(0.0))).alias("rmst"), F.coalesce("_last", s0).alias("survival"))


def arm_contrast(df: DataFrame, arm: str, time: str, event: str, weight: str, horizon: float) -> DataFrame:
    """One row: restricted mean and survival at the horizon in arms 1 and 0, and their differences.

    Times beyond the horizon are cut to it, without an event.
    """
    cut = df.withColumns({"_e": F.when(F.col(time) > horizon, 0).otherwise(F.col(event)), "_t": F.least(F.col(time).cast("double"), F.lit(horizon))})
    each = restricted_mean(weighted_curve(cut, [arm], "_t", "_e", weight), [arm], horizon, df)
    pick = lambda c, a: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = each.agg(*(pick(c, a).alias(f"{c}_{a}") for c in ("rmst", "survival") for a in (1, 0)))
    return wide.withColumns({"rmst_difference": F.col("rmst_1") - F.col("rmst_0"), "survival_difference": F.col("survival_1") - F.col("survival_0")})


def counting_curve(rows: DataFrame, by: Sequence[str], start: str, stop: str, event: str, weight: str) -> DataFrame:
    """Weighted Kaplan-Meier steps of counting-process rows, at risk where start < t <= stop."""
    steps = at_risk(rows, by, start, stop, weight, event).where("events > 0 and risk > 0")
    return _product_of_steps(steps, by, "t", cut_points(rows, F.col(stop).cast("double"))[0])


def running_survival(df: DataFrame, by: Sequence[str], order: str, hazard: str, name: str = "survival_before") -> DataFrame:
    """Product of 1 - hazard over the earlier rows of a subject; 1 for the first."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.product(F.lit(1.0) - F.col(hazard)).over(w), F.lit(1.0)))


def ipcw_pseudo(df: DataFrame, censoring: DataFrame, key: str, time: str, horizon: float, width: float, floor: float) -> DataFrame:
    """Restricted-time pseudo-outcome of each subject: time lived in each interval over the chance to be uncensored at its start.

    ``censoring`` has ``key``, ``interval`` and ``g``.  A subject without time has zero.
    """
    rows = df.select(key, F.col(time).alias("_t"), F.explode(interval_grid(horizon, width)).alias("_i")).select(key, "_t", "_i.*").where(F.col("_t") > F.col("start"))
    lived = F.least(F.col("_t"), F.col("end")) - F.col("start")
    summed = rows.join(censoring, [key, "interval"]).groupBy(key).agg(F.sum(lived / clip("g", floor, 1.0)).alias("pseudo"))
    return df.select(key).join(summed, key, "left").withColumn("pseudo", F.coalesce("pseudo", F.lit(0.0)))


def clone_censor(df: DataFrame, key: str, time: str, event: str, started: str, landmark: float, horizon: float, width: float, keep: Sequence[str] = ()) -> DataFrame:
    """Two clones of each subject, by strategy, over the interval grid; ``keep``: columns of the subject that go along.

    Strategy 0 (not to start) is artificially censored when treatment starts by the
    landmark; strategy 1 (to start) at the landmark if it has not.  A row stands for
    each interval that begins before the clone's end.
    """
    strategies = F.explode(F.array(F.lit(0), F.lit(1))).alias("strategy")
    begun = F.col(started).isNotNull() & (F.col(started) <= landmark)
    clones = df.select("*", strategies).withColumn("_cut", F.when((F.col("strategy") == 0) & begun, F.col(started)).when((F.col("strategy") == 1) & ~begun, F.lit(landmark)).cast("double"))
    cut = F.col("_cut").isNotNull() & (F.col("_cut") < F.col(time))
    clones = clones.withColumns({"_end": F.least(F.when(cut, F.col("_cut")).otherwise(F.col(time)).cast("double"), F.lit(horizon)), "_cutoff": cut})
    rows = clones.select("*", F.explode(interval_grid(horizon, width)).alias("_i")).select("*", "_i.*").where((F.col("start") < F.col("_end")) | ((F.col("start") == 0) & (F.col("_end") == 0)))
    last = (F.col("_end") <= F.col("end")) | (F.col("end") >= horizon)
    within = F.col(time) <= horizon
    return rows.select(
        key,
        "strategy",
        "interval",
        "start",
        F.least("end", "_end").alias("stop"),
        (last & ~F.col("_cutoff") & (F.col(event) == 1) & within).cast("int").alias("event"),
        (last & ~F.col("_cutoff") & (F.col(event) == 0) & within).cast("int").alias("natural_censor"),
        (last & F.col("_cutoff") & (F.col("_cut") <= horizon)).cast("int").alias("artificial_censor"),
        *keep,
    )


def clipped_weights(df: DataFrame, by: Sequence[str], order: str, factor: str, low: float, high: float, name: str = "weight") -> DataFrame:
    """Cumulative product of factors, held between two bounds after every step.

    Clipping at each step is not associative, so the steps of a subject (bounded by
    its intervals) are folded in order.
    """
    steps = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(factor).cast("double").alias("f")))).alias("_s"))
    held = F.aggregate(
        "_s",
        F.struct(F.lit(1.0).alias("w"), F.array().cast("array<struct<o:bigint,w:double>>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(F.lit(low), F.least(F.lit(high), a["w"] * s["f"])).alias("w"),
            F.concat(a["out"], F.array(F.struct(s["o"].cast("bigint").alias("o"), F.greatest(F.lit(low), F.least(F.lit(high), a["w"] * s["f"])).alias("w")))).alias("out"),
        ),
    )
    return steps.select(*by, F.explode(held["out"]).alias("_x")).select(*by, F.col("_x.o").alias(order), F.col("_x.w").alias(name))


def cap_weights(df: DataFrame, weight: str, cap: float | None = None, quantile: float | None = None) -> DataFrame:
    """Weights cut at a fixed cap, or at their exact quantile."""
    if cap is not None:
        return df.withColumn("capped", F.least(F.col(weight), F.lit(cap)))
    limit = exact_quantiles(df, [], weight, {"_cap": quantile})
    return df.join(F.broadcast(limit)).withColumn("capped", F.least(F.col(weight), F.col("_cap"))).drop("_cap")  # one row


def empirical_hazard(rows: DataFrame, by: Sequence[str], interval: str, event: str) -> DataFrame:
    """Smoothed share (s + 1/2) / (n + 1) of rows with the event in each group and interval."""
    return rows.groupBy(*by, interval).agg(F.count("*").alias("n"), F.sum(event).alias("s")).withColumn("hazard", (F.col("s") + 0.5) / (F.col("n") + 1.0))


def landmark_cohort(df: DataFrame, time: str, started: str, ambiguous: str, landmark: float) -> DataFrame:
    """Subjects beyond the landmark with a clear start: exposure by then, time from then on, late starters marked."""
    use = df.where((F.col(time) > landmark) & (F.coalesce(F.col(ambiguous), F.lit(0)) == 0))
    by_then = F.col(started).isNotNull() & F.col(started).between(0, landmark)
    return use.withColumns({"analysis_treatment": by_then.cast("int"), "later_initiator": (F.col(started) > landmark).cast("int"), "analysis_time": F.col(time) - F.lit(landmark)}).withColumn("later_initiator", F.coalesce("later_initiator", F.lit(0)))


def hazard_restricted_mean(hazard: str | Column, intervals: int, width: float) -> Column:
    """width * sum over k = 1..intervals of (1 - hazard)^k."""
    h = F.col(hazard) if isinstance(hazard, str) else hazard
    return F.aggregate(F.sequence(F.lit(1), F.lit(intervals)), F.lit(0.0), lambda a, k: a + F.pow(F.lit(1.0) - h, k)) * width


def event_probability(event_hazard: str, censor_hazard: str, intervals: int) -> Column:
    """Chance of an event in so many intervals where censoring competes: a geometric sum."""
    h, stay = F.col(event_hazard), (F.lit(1.0) - F.col(event_hazard)) * (F.lit(1.0) - F.col(censor_hazard))
    return F.when(stay >= 1.0, F.lit(0.0)).otherwise(h * (F.lit(1.0) - F.pow(stay, intervals)) / F.nullif(F.lit(1.0) - stay, F.lit(0.0)))
