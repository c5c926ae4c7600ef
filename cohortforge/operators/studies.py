"""Audits and harmonisation of studies: imbalance tables, feasible populations, influence by omission, concordance of gene sets, transport roles, targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import binary_smd, col, finite, fisher_exact, hypergeometric_tail, ratio
from cohortforge.operators.models import cox_by_group
from cohortforge.operators.running import cut_points, exact_quantiles, running_sums


def imbalance_audit(df: DataFrame, arm: str, flags: Sequence[str], flag_at: float = 0.1, severe_at: float = 0.25) -> DataFrame:
    """Of each 0/1 column: its share in either arm, risk difference, standardised difference, Fisher's exact p and the marks of a difference that is large."""
    long = df.select(F.col(arm).alias("_a"), *(F.col(c).cast("int").alias(c) for c in flags)).unpivot(["_a"], list(flags), "variable", "value").where("value is not null")
    cell = lambda a, v: F.count_if((F.col("_a") == a) & (F.col("value") == v))
    n = long.groupBy("variable").agg(*(cell(a, v).alias(f"n{a}{v}") for a in (1, 0) for v in (1, 0)))
    share = lambda a: ratio(F.col(f"n{a}1").cast("double"), F.col(f"n{a}1") + F.col(f"n{a}0"))
    out = n.select("variable", share(1).alias("treated_fraction"), share(0).alias("control_fraction"), fisher_exact("n11", "n10", "n01", "n00").alias("fisher_p"))
    out = out.withColumns({"risk_difference": F.col("treated_fraction") - F.col("control_fraction"), "smd": binary_smd("treated_fraction", "control_fraction")})
    return out.withColumns({"flagged": (F.abs("smd") >= flag_at).cast("int"), "severe": (F.abs("smd") >= severe_at).cast("int")})


def feasible_populations(df: DataFrame, arm: str, event: str, masks: Mapping[str, Column], least_arm: int, least_events: int) -> DataFrame:
    """Rows, arms and events of each named population, and whether an effect could be estimated in it; one pass for all."""
    inside = F.array_compact(F.array(*(F.when(m, F.lit(n)) for n, m in masks.items())))
    long = df.select(F.explode(inside).alias("population"), F.col(arm).alias("_a"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("_e"))
    n = long.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("_a") == 1).alias("treated"), F.count_if(F.col("_a") == 0).alias("control"), F.sum("_e").alias("events"))
    every = df.sparkSession.createDataFrame([(k,) for k in masks], "population string").join(n, "population", "left").fillna(0)
    return every.withColumn("feasible", ((F.least("treated", "control") >= least_arm) & (F.col("events") >= least_events)).cast("int"))


def studentised_interval(df: DataFrame, by: Sequence[str], value: str, error: str, point: Column, point_error: Column, level: float = 0.95) -> DataFrame:
    """Bootstrap-t interval: point less the quantiles of (replicate - point) / its error, times the error of the point; replicates without a positive error are left out."""
    use = df.where(finite(value) & finite(error) & (F.col(error) > 0)).withColumns({"_p": point, "_e": point_error})
    t = use.withColumn("_t", (F.col(value) - F.col("_p")) / F.col(error))
    q = exact_quantiles(t, by, "_t", {"_lo": (1 - level) / 2, "_hi": 1 - (1 - level) / 2})
    facts = t.groupBy(*by).agg(F.count("*").alias("n"), F.first("_p").alias("_p"), F.first("_e").alias("_e"))
    joined = facts.join(q, list(by)) if by else facts.join(F.broadcast(q))  # without groups one row
    return joined.select(*by, "n", (F.col("_p") - F.col("_hi") * F.col("_e")).alias("studentised_low"), (F.col("_p") - F.col("_lo") * F.col("_e")).alias("studentised_high"))


def partition_error(df: DataFrame, by: Sequence[str], value: str, explodes_at: float) -> DataFrame:
    """Spread of partition estimates, its Monte Carlo error, and the share of them that are not finite or beyond ``explodes_at`` in size."""
    good = finite(value) & (F.abs(value) <= explodes_at)
    x = F.when(good, F.col(value))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("mcse"), F.avg((~F.coalesce(good, F.lit(False))).cast("double")).alias("exploded"), F.min(x).alias("least"), F.max(x).alias("most"))


def leave_one_out(scored: DataFrame, unit: str, numerator: str = "score_num", denominator: str = "h") -> DataFrame:
    """The estimate sum(numerator) / sum(denominator) again without each unit, and how far it moves: totals less the unit's own, so nothing is fitted anew."""
    sums = scored.groupBy(unit).agg(F.sum(numerator).alias("_a"), F.sum(denominator).alias("_b"))
    total = sums.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    joined = sums.join(F.broadcast(total))  # one row
    out = joined.select(unit, ratio(F.col("_ta") - F.col("_a"), F.col("_tb") - F.col("_b")).alias("estimate_without"), ratio("_ta", "_tb").alias("estimate"))
    return out.withColumn("shift", F.col("estimate_without") - F.col("estimate"))


def pad_selection(selected: DataFrame, screened: DataFrame, target: int) -> DataFrame:
    """place and feature: the selected ones first, then as many of the screened (feature, rho) by falling abs(rho) as the target lacks.

    ``selected`` has place and feature; a selection of at least ``target`` stays as it is.
    """
    chosen = selected.groupBy("feature").agg(F.min("place").alias("place")).select("place", "feature", F.lit(0.0).alias("_r"), F.lit(0).alias("_kind"))
    size = chosen.count()  # a selection
    rest = screened.join(chosen, "feature", "left_anti").select(F.lit(0).alias("place"), "feature", (-F.abs(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)))).alias("_r"), F.lit(1).alias("_kind"))
    rest = rest.orderBy("_r", "feature").limit(max(0, target - size))  # a top-k
    from pyspark.sql import Window as W

    return chosen.union(rest).withColumn("place", F.row_number().over(W.orderBy("_kind", "place", "_r", "feature"))).select("place", "feature")  # target rows


def cox_baseline(df: DataFrame, by: Sequence[str], time: str, event: str, log_risk: str) -> DataFrame:
    """Breslow's cumulative baseline hazard at every event time: the sum over times of events over the risk exp(log_risk) of those still there."""
    by_time = df.groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum(F.exp(log_risk)).alias("_w"), F.count_if(F.col(event) == 1).alias("events"))
    cuts = cut_points(df, F.col(time).cast("double"))[0]
    risk = running_sums(by_time, by, "time", {"risk": F.col("_w")}, descending=True, cuts=cuts).where("events > 0")
    return running_sums(risk, by, "time", {"cumulative_hazard": F.col("events") / F.col("risk")}, cuts=cuts).select(*by, "time", "risk", "events", "cumulative_hazard")


def cox_survival(df: DataFrame, baseline: DataFrame, by: Sequence[str], key: str, log_risk: str, times: Sequence[float]) -> DataFrame:
    """Partial hazard and predicted survival exp(-H(t) exp(log_risk)) of each row at each of a few times."""
    from cohortforge.operators.joins import step_lookup

    points = df.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(float(t)) for t in times))).alias("at")) if by else df.sparkSession.createDataFrame([(float(t),) for t in times], "at double")
    held = step_lookup(points, baseline, by, "at", "time", "cumulative_hazard", before=0.0)
    rows = df.select(*by, key, F.exp(log_risk).alias("partial_hazard"))
    joined = rows.join(F.broadcast(held), list(by)) if by else rows.join(F.broadcast(held))  # a row for each group and time
    return joined.select(*by, key, "at", "partial_hazard", F.exp(-F.col("cumulative_hazard") * F.col("partial_hazard")).alias("survival"))


def nested_cox(df: DataFrame, key: str, time: str, event: str, features: Sequence[str], folds: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Out-of-fold log-risk of each row in each repeat: a Cox model for every (repeat, fold), learned from the other folds of that repeat.

    ``folds`` has key, repeat and fold.  The fits are groups of one pass; a row travels
    once for each fold that it is learned from.
    """
    assigned = df.select(key, time, event, *features).join(folds, key)
    ids = folds.select("repeat", F.col("fold").alias("held")).distinct()
    learned = assigned.join(F.broadcast(ids), "repeat").where("fold <> held").drop("fold").withColumnRenamed("held", "fold")  # a row for each repeat and fold
    fitted = cox_by_group(learned, ["repeat", "fold"], time, event, features, penalty)
    wide = fitted.groupBy("repeat", "fold").agg(*(F.max(F.when(F.col("feature") == c, F.col("coefficient"))).alias(f"_b{i}") for i, c in enumerate(features)))
    risk = sum((F.col(c) * F.col(f"_b{i}") for i, c in enumerate(features)), F.lit(0.0))
    return assigned.join(F.broadcast(wide), ["repeat", "fold"]).select(key, "repeat", "fold", time, event, risk.alias("log_risk"))  # a row for each repeat and fold


def set_concordance(first: DataFrame, second: DataFrame, universe: DataFrame, by: Sequence[str], element: str, least: int = 5) -> DataFrame:
    """Of each group: how far the assayable part of a first selection agrees with a second one.

    Sizes, overlap, Jaccard index and overlap coefficient (1 for empty sets), the upper
    hypergeometric tail in the universe, the assayable share, and whether the assayable
    elements are ``least`` at least.
    """
    key = [*by, element]
    sides = [x.select(*key).where(F.col(element).isNotNull()).distinct().withColumn(n, F.lit(1)) for x, n in ((first, "_a"), (second, "_b"), (universe, "_u"))]
    every = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    on = lambda *names: F.count_if(sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0)) == len(names))
    n = every.groupBy(*by).agg(on("_a").alias("selected"), on("_a", "_u").alias("assayable"), on("_b").alias("other"), on("_u").alias("universe"), on("_a", "_u", "_b").alias("shared"))
    either, small = F.col("assayable") + F.col("other") - F.col("shared"), F.least("assayable", "other")
    return n.select(
        *by, "selected", "assayable", "other", "universe", "shared",
        F.when(either == 0, 1.0).otherwise(F.col("shared") / F.nullif(either, F.lit(0))).alias("jaccard"),
        F.when(small == 0, 1.0).otherwise(F.col("shared") / F.nullif(small, F.lit(0))).alias("overlap"),
        hypergeometric_tail("shared", "universe", "assayable", "other").alias("p"),
        F.coalesce(ratio(F.col("assayable").cast("double"), F.col("selected")), F.lit(0.0)).alias("assayable_share"),
        F.when(F.col("assayable") < least, "insufficient").otherwise("estimable").alias("status"),
    )


def transport_role(status: str | Column, assayed: str | Column, primary: Sequence[str], fallback: Sequence[str]) -> Column:
    """Role of a feature in another cohort, by how its name was mapped and whether it is measured there."""
    s, on = (F.col(x) if isinstance(x, str) else x for x in (status, assayed))
    mapped = s.isin(*primary, *fallback)
    return F.when(s.isin(*primary) & on, "PRIMARY_TRANSPORTABLE").when(s.isin(*fallback) & on, "SENSITIVITY_ONLY_MAPPING_FALLBACK").when(mapped & ~on, "MAPPED_BUT_NOT_ASSAYED").otherwise("EXCLUDED_AMBIGUOUS_OR_UNMAPPED")


def assayability(mapped: DataFrame, available: DataFrame, by: Sequence[str], element: str) -> DataFrame:
    """Of each group: distinct mapped elements, how many are available and how many not, the share, and the missing ones by name."""
    key = [*by, element]
    have = available.select(*key).distinct().withColumn("_hit", F.lit(1))
    each = mapped.select(*key).distinct().join(have, key, "left")
    lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col(element)))), " | ")  # a panel
    return each.groupBy(*by).agg(F.count("*").alias("mapped"), F.count("_hit").alias("available"), (F.count("*") - F.count("_hit")).alias("unavailable"), (F.count("_hit") / F.count("*")).alias("share"), lost.alias("missing"))


def map_by_best_column(annotation: DataFrame, wanted: DataFrame, element: str, names: Sequence[str] = ("gene", "hugo", "symbol"), pattern: str = "^[A-Z][A-Z0-9-]{1,14}$") -> DataFrame:
    """probe and its mapped genes: the probes stand in the column with most hits (the first by name of equals), the genes in columns whose name says so, else in all others."""
    text = annotation.select(*(F.upper(F.trim(F.col(f"`{c}`").cast("string"))).alias(c) for c in annotation.columns))
    want = wanted.select(F.upper(F.col(element)).alias("probe")).distinct()
    hits = text.unpivot([], text.columns, "column", "probe").join(want, "probe").groupBy("column").count().orderBy(F.desc("count"), "column").first()  # a row for each column
    if hits is None:
        return want.limit(0).withColumns({"genes": F.lit(""), "n_genes": F.lit(0).cast("long")})
    at = hits["column"]
    columns = [c for c in text.columns if c != at and any(n in c.lower() for n in names)] or [c for c in text.columns if c != at]
    tokens = F.explode_outer(F.filter(F.split(F.concat_ws(";", *(F.col(f"`{c}`") for c in columns)), r"[;,|/\s]+"), lambda x: x.rlike(pattern)))
    rows = text.withColumnRenamed(at, "probe").join(want, "probe", "left_semi").select("probe", tokens.alias("gene")).distinct()
    return rows.groupBy("probe").agg(F.array_join(F.array_sort(F.collect_list("gene")), " | ").alias("genes"), F.count("gene").alias("n_genes"))


def truths(df: DataFrame, by: Sequence[str], e: str, truth0: str, truth1: str) -> DataFrame:
    """Mean true difference over all, over the treated mix (weights e), the overlap (weights e (1 - e)), and the drift of the last from the first."""
    gap, w = F.col(truth1) - F.col(truth0), F.col(e)
    mean = lambda v: ratio(F.sum(v * gap), F.sum(v))
    return df.groupBy(*by).agg(F.avg(gap).alias("average"), mean(w).alias("treated"), mean(w * (1 - w)).alias("overlap")).withColumn("drift", F.col("overlap") - F.col("average"))


def clone_checks(rows: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Arithmetic that clone rows must keep: two clones a subject, one first row each, at most one end each, no gap between intervals."""
    clones = rows.groupBy(key, "strategy").agg(F.min("interval").alias("lo"), F.max("interval").alias("hi"), F.count("*").alias("n"), F.sum(F.col("event") + F.col("natural_censor") + F.col("artificial_censor")).alias("ends"))
    n = subjects.agg(F.count("*").alias("_n"))
    got = clones.agg(F.count("*").alias("clones"), F.count_if(F.col("lo") == 0).alias("firsts"), F.count_if(F.col("ends") > 1).alias("twice"), F.count_if(F.col("n") != F.col("hi") - F.col("lo") + 1).alias("gaps")).join(F.broadcast(n))  # one row
    checks = {"two_clones_a_subject": ("clones", F.col("_n") * 2), "one_first_row_a_clone": ("firsts", F.col("_n") * 2), "clones_that_end_twice": ("twice", F.lit(0)), "clones_with_gaps": ("gaps", F.lit(0))}
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(o).cast("long").alias("observed"), x.cast("long").alias("expected")) for c, (o, x) in checks.items()))).alias("x")
    return got.select(rows).select("x.*").withColumn("passed", (F.col("observed") == F.col("expected")).cast("int"))


def empirical_targets(df: DataFrame, arm: str, event: str, features: Sequence[str]) -> DataFrame:
    """Targets of a data generator, a row each: share treated, share of events by arm, mean and deviation of the features by arm."""
    a = F.col(arm)
    sums = {"share_treated": F.avg(a.cast("double"))}
    for k in (0, 1):
        of = lambda c: F.when(a == k, F.col(c).cast("double"))  # noqa: B023, E731
        sums[f"event_share_{k}"] = F.avg(of(event))
        for c in features:
            sums |= {f"mean_{c}_{k}": F.avg(of(c)), f"sd_{c}_{k}": F.stddev_samp(of(c))}
    one = df.agg(*(v.alias(n) for n, v in sums.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).alias("value")) for n in sums))).alias("x")).select("x.*")


def mapping_errors(df: DataFrame, published: float, candidates: Mapping[str, tuple[str, str, str, str]], horizon: float) -> DataFrame:
    """Restricted-mean differences under each candidate reading (arm, time, event, weight columns) of a table, and their distance from a published one, nearest first."""
    from cohortforge.operators.survival import arm_contrast

    out = None
    for name, (arm, time, event, weight) in candidates.items():  # a few readings
        one = arm_contrast(df, arm, time, event, weight, horizon).select(F.lit(name).alias("mapping"), F.col("rmst_difference").alias("estimate"))
        out = one if out is None else out.union(one)
    return out.withColumn("error", F.abs(F.col("estimate") - published))


def curve_mappings(df: DataFrame, published: DataFrame, readings: Mapping[str, tuple[str | Column, str | Column, str | Column, str | Column]], horizon: float) -> DataFrame:
    """How near each reading of a table (arm, time, event, weight) comes to published curves (arm, time, survival), the nearest first.

    All readings are stacked, and their weighted curves taken together.  Summed over the arms: ``area`` between the step
    curves up to the horizon, ``mean_error`` of the restricted means, ``end_error`` of survival at the horizon, and
    ``score``, the mean error plus a hundred times the end error; ``gap`` is the largest distance anywhere.  Curves start at 1; times at
    or beyond the horizon are cut to it.
    """
    from cohortforge.operators.running import running
    from cohortforge.operators.survival import weighted_curve

    each = [F.struct(F.lit(name).alias("mapping"), col(a).cast("int").alias("arm"), col(t).cast("double").alias("time"), col(e).cast("int").alias("event"), col(w).cast("double").alias("weight")) for name, (a, t, e, w) in readings.items()]
    curves = weighted_curve(df.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("arm is not null"), ["mapping", "arm"], "time", "event", "weight")
    names = F.explode(F.array(*map(F.lit, readings))).alias("mapping")
    of = published.select(names, F.col("arm").cast("int").alias("arm"), F.col("time").cast("double").alias("time"), F.col("survival").cast("double").alias("_p"))
    start = of.select("mapping", "arm").distinct().select("mapping", "arm", F.lit(0.0).alias("time"))
    points = curves.select("mapping", "arm", "time", F.col("survival").alias("_s")).unionByName(of, allowMissingColumns=True).unionByName(start, allowMissingColumns=True)
    points = points.where((F.col("time") >= 0) & (F.col("time") <= horizon)).groupBy("mapping", "arm", "time").agg(F.min("_s").alias("_s"), F.min("_p").alias("_p"))
    by = ["mapping", "arm"]
    at = running(points, by, "time", {"_s1": ("last", F.col("_s")), "_p1": ("last", F.col("_p"))})
    at = running(at, by, "time", {"_next": ("last", F.col("time"))}, descending=True, inclusive=False)
    off = F.coalesce("_s1", F.lit(1.0)) - F.coalesce("_p1", F.lit(1.0))
    width = F.coalesce("_next", F.lit(float(horizon))) - F.col("time")
    arms = at.groupBy(*by).agg(F.sum(F.abs(off) * width).alias("area"), F.max(F.abs(off)).alias("gap"), F.abs(F.sum(off * width)).alias("mean_error"), F.abs(F.max_by(off, "time")).alias("end_error"))
    out = arms.groupBy("mapping").agg(F.sum("area").alias("area"), F.max("gap").alias("gap"), F.sum("mean_error").alias("mean_error"), F.sum("end_error").alias("end_error"))
    return out.withColumn("score", F.col("mean_error") + 100 * F.col("end_error")).orderBy("area", "mapping")


def clinical_indicators(df: DataFrame, age: str, stage: str, nodes: str, missing_nodes: float | None = None) -> DataFrame:
    """Adds age, stage_II to stage_IV and node_positive as numbers; without a stage all indicators are 0, without nodes node_positive is ``missing_nodes``."""
    s, n = F.col(stage).try_cast("double"), F.col(nodes).try_cast("double")
    level = {f"stage_{r}": F.coalesce((s == k).cast("double"), F.lit(0.0)) for r, k in (("II", 2), ("III", 3), ("IV", 4))}
    return df.withColumns({"age": F.col(age).try_cast("double"), **level, "node_positive": F.when(n.isNull(), F.lit(missing_nodes).cast("double")).otherwise((n > 0).cast("double"))})


def prefixed(names: Sequence[str], prefix: str = "W_", extra: Sequence[str] = ("diagnosis_year", "diagnosis_year_missing")) -> list[str]:
    """Names with the prefix, then the extra ones that are there, each once, in their order."""
    return list(dict.fromkeys([n for n in names if n.startswith(prefix)] + [n for n in extra if n in names]))


def metadata_columns(names: Sequence[str], ids: Sequence[str], tokens: Sequence[str] = ("time", "event", "status", "treat", "age", "stage")) -> list[str]:
    """Columns to keep beside the features: ids first, then those whose name holds a token, each once."""
    return list(dict.fromkeys([n for n in ids if n in names] + [n for n in names if any(t in n.lower() for t in tokens)]))


def earliest_start(records: DataFrame, patient: str, text: str, day: str, pattern: str = "hormone|endocrine", name: str = "start") -> DataFrame:
    """The earliest day, not before zero, of each patient's records whose text fits the pattern; null where none is dated."""
    fits = F.lower(F.coalesce(text, F.lit(""))).rlike(pattern)
    return records.groupBy(patient).agg(F.min(F.when(fits & (F.col(day) >= 0), F.col(day))).alias(name), F.count_if(fits).alias("n_records"))


def rank_sources(profile: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """Candidates with the sum of the scores that fit them, best first, ties by name: a row for each candidate of a profile with a ``column``."""
    total = sum((F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores.values()), F.lit(0.0))
    return profile.withColumn("score", total).orderBy(F.desc("score"), "column")


def repeat_summary(df: DataFrame, by: Sequence[str], repeat: str, value: str) -> DataFrame:
    """Mean of each repeat first, then mean, spread and range over repeats."""
    each = df.groupBy(*by, repeat).agg(F.avg(value).alias("_v"))
    return each.groupBy(*by).agg(F.count("*").alias("n_repeats"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def r_loss(df: DataFrame, y: str, arm: str, m: str, e: str, tau: str) -> DataFrame:
    """R-loss with tau, with its mean effect only, the share that tau gains, a one-sided t statistic of the gain, and, where ``true_tau`` is there, the error of tau."""
    ry, ra = F.col(y) - F.col(m), F.col(arm) - F.col(e)
    flat = df.agg(ratio(F.sum(ry * ra), F.sum(ra * ra)).alias("_c"))
    each = df.join(F.broadcast(flat)).withColumns({"_l": F.pow(ry - F.col(tau) * ra, 2), "_k": F.pow(ry - F.col("_c") * ra, 2)})  # one row
    gain = F.col("_k") - F.col("_l")
    extra = [F.sqrt(F.avg(F.pow(F.col(tau) - F.col("true_tau"), 2))).alias("pehe")] if "true_tau" in df.columns else []
    return each.agg(F.count("*").alias("n"), F.avg("_l").alias("loss"), F.avg("_k").alias("constant_loss"), (1 - F.avg("_l") / F.avg("_k")).alias("improvement"), (F.avg(gain) / (F.stddev_samp(gain) / F.sqrt(F.count("*")))).alias("t"), *extra)


