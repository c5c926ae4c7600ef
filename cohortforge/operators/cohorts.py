"""Cohort flags, covariate matrices, column roles, id pairs, and tables that describe a cohort or an estimate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions.columns import finite, numeric, ratio
from cohortforge.functions.status import level_of
from cohortforge.operators.aggregates import balance_table


def cohort_flags(df: DataFrame, er: str, pr: str, her2: str) -> DataFrame:
    """Adds ``hr_positive`` (ER or PR positive, HER2 negative) and ``triple_negative``; false where a status is unknown."""
    known = F.col(er).isNotNull() & F.col(pr).isNotNull() & F.col(her2).isNotNull()
    on = lambda c: F.col(c) == 1
    off = lambda c: F.col(c) == 0
    sure = lambda c: F.coalesce(known & c, F.lit(False)).cast("int")
    return df.withColumns({"hr_positive": sure((on(er) | on(pr)) & off(her2)), "triple_negative": sure(off(er) & off(pr) & off(her2))})


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, numeric values, least and greatest number, values other than 0 and 1; one pass."""
    long = df.select(*(F.struct(F.lit(c).alias("column"), numeric(c).alias("x")).alias(c) for c in columns)).select(F.explode(F.array(*columns)).alias("e")).select("e.*")
    other = F.count_if(~F.col("x").isin(0.0, 1.0))
    return long.groupBy("column").agg(F.count("*").alias("n"), F.count("x").alias("n_numeric"), F.min("x").alias("low"), F.max("x").alias("high"), other.alias("n_other"))


def prune_columns(df: DataFrame, columns: Sequence[str], least: int = 20, share: float = 0.1) -> DataFrame:
    """column, decision and reason: out if numeric values are too few or all the same."""
    facts = column_facts(df, columns)
    few = F.col("n_numeric") < F.greatest(F.lit(least), F.floor(F.col("n") * share))
    reason = F.when(few, "too_few_numeric_values").when(F.col("low") == F.col("high"), "constant").otherwise("included")
    return facts.select("column", F.when(reason == "included", "include").otherwise("exclude").alias("decision"), reason.alias("reason"))


def column_roles(df: DataFrame, columns: Sequence[str], least_share: float = 0.8) -> DataFrame:
    """column and role by what it holds: binary, propensity (inside 0 and 1), time (at least 0, beyond 1), numeric or text."""
    f = column_facts(df, columns)
    role = (
        F.when(F.col("n_numeric") < least_share * F.col("n"), "text").when(F.col("n_other") == 0, "binary").when((F.col("low") >= 0) & (F.col("high") <= 1), "propensity").when(F.col("low") >= 0, "time").otherwise("numeric")
    )
    return f.select("column", role.alias("role"), "low", "high")


def baseline_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Numbers W_<column> and, where some are missing, W_<column>_missing; columns that are empty or constant are left out."""
    facts = {r["column"]: r for r in column_facts(df, columns).collect()}  # a row per column
    keep = [c for c in columns if facts and facts[c]["n_numeric"] and facts[c]["low"] != facts[c]["high"]]
    gaps = [c for c in keep if facts[c]["n_numeric"] < facts[c]["n"]]
    return df.select(key, *(numeric(c).alias(f"W_{c}") for c in keep), *(numeric(c).isNull().cast("int").alias(f"W_{c}_missing") for c in gaps))


#: The named baseline features: how each is read and the parts of column names that it is taken from; fixed values of the data dictionaries.
#: A number comes from the first column that holds the first part found; a level from all columns of 0/1 flags that hold every part.
NAMED = (
    ("age", "number", ("age_at_index", "age_at_diagnosis", "diagnosis_age", "age.demographic")),
    ("stage", "stage", ("ajcc_pathologic_stage",)),
    ("T", "t", ("ajcc_pathologic_t",)),
    ("N", "n", ("ajcc_pathologic_n",)),
    ("M", "m", ("ajcc_pathologic_m",)),
    ("nodes_positive", "number", ("pathology_details.lymph_nodes_positive", "lymph_nodes_positive")),
    ("nodes_tested", "number", ("pathology_details.lymph_nodes_tested", "lymph_nodes_tested")),
    ("grade", "grade", ("grade",)),
    ("ER", "receptor", ("ER_status",)),
    ("PR", "receptor", ("PR_status",)),
    ("HER2", "receptor", ("HER2_status",)),
)
#: Columns of a level that are none: editions of the staging system, and words with "grade" in them.
_NO_LEVEL = {"grade": ("degrade", "upgrade"), **dict.fromkeys(("stage", "t", "n", "m"), ("staging_system", "edition"))}
#: A grade in one column, read as a number where at least half of its rows are one.
_GRADE_NUMBERS = ("tumor_grade", "histologic_grade", "neoplasm_histologic_grade")


def named_features(df: DataFrame, key: str) -> tuple[DataFrame, list[tuple[str, str, list[str]]]]:
    """The compact baseline matrix: key, W_<feature> and W_<feature>_missing of ``NAMED``, and (name, kind, source columns) of each that stays.

    A level is the greatest among the flags of a row above one half, missing where none names a level.  What is empty or constant
    is left out; of a receptor that is constant the mark of missing values too.  Treatments, outcomes and molecular columns are never read.
    """
    names, quoted = df.columns, lambda c: "`" + c.replace("`", "``") + "`"
    first = lambda parts: next((c for p in parts for c in names if p.lower() in c.lower()), None)
    graded = first(_GRADE_NUMBERS)
    numbers = bool(graded) and (df.agg(F.avg(numeric(F.col(quoted(graded))).isNotNull().cast("double"))).first()[0] or 0.0) >= 0.5
    built: dict[str, Column] = {}
    manifest: list[tuple[str, str, list[str]]] = []
    for name, kind, parts in NAMED:
        if kind == "receptor":
            sources = [c for c in parts if c in names]
        elif kind == "number" or (kind == "grade" and numbers):
            source = graded if kind == "grade" else first(parts)
            sources = [source] if source else []
        else:
            sources = sorted(c for c in names if all(p in c.lower() for p in parts) and not any(p in c.lower() for p in _NO_LEVEL[kind]))
            levels = [(c, level_of(c, kind)) for c in sources]
            flags = [F.when(numeric(F.col(quoted(c))) > 0.5, F.lit(v)) for c, v in levels if v is not None]
            value = F.array_max(F.array(*flags)) if flags else None
        if kind in ("receptor", "number") or (kind == "grade" and numbers):
            value = numeric(F.col(quoted(sources[0]))) if sources else None
        if value is not None:
            built |= {f"W_{name}": value, f"W_{name}_missing": value.isNull().cast("int")}
            manifest += [(f"W_{name}", kind, sources), (f"W_{name}_missing", "missing", sources)]
    if not built:
        return df.select(key), []
    wide = df.select(key, *(v.alias(n) for n, v in built.items()))
    facts = {r["column"]: r for r in column_facts(wide, list(built)).collect()}  # a row per column
    varies = {n for n in built if n in facts and facts[n]["n_numeric"] and facts[n]["low"] != facts[n]["high"]}
    varies -= {f"W_{name}_missing" for name, kind, _ in NAMED if kind == "receptor" and f"W_{name}" not in varies}
    return wide.select(key, *(n for n in built if n in varies)), [m for m in manifest if m[0] in varies]


def frequent_features(long: DataFrame, feature: str, flag: str, least: float, most: int) -> DataFrame:
    """Features whose mean flag reaches ``least``: the ``most`` commonest, by name among equals."""
    share = long.groupBy(feature).agg(F.avg(F.col(flag).cast("double")).alias("frequency")).where(F.col("frequency") >= least)
    return share.orderBy(F.desc("frequency"), feature).limit(most)


def id_pairs(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """For each pair of id columns: shared ids, Jaccard index and share of the smaller side; pairs that share none are left out.

    The best pair is the first by jaccard, then coverage, then name.
    """

    def ids(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        text = [F.upper(F.trim(F.col(c).cast("string"))).alias(c) for c in columns]
        return df.select(*text).unpivot([], list(columns), name, "id").where("id <> ''").distinct()

    a, b = ids(left, left_columns, "left_column"), ids(right, right_columns, "right_column")
    na, nb = a.groupBy("left_column").agg(F.count("*").alias("n_left")), b.groupBy("right_column").agg(F.count("*").alias("n_right"))
    shared = a.join(b, "id").groupBy("left_column", "right_column").agg(F.count("*").alias("shared")).join(na, "left_column").join(nb, "right_column")
    return shared.select(
        "left_column", "right_column", "shared", (F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("n_left", "n_right")).alias("coverage")
    )


def best_id_pair(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str]) -> tuple[str, str] | None:
    best = id_pairs(left, right, left_columns, right_columns).orderBy(F.desc("jaccard"), F.desc("coverage"), "left_column", "right_column").first()
    return (best["left_column"], best["right_column"]) if best else None


def table_one(df: DataFrame, arm: str, weight: str, features: Sequence[str]) -> DataFrame:
    """Means by arm, raw and weighted, standardised differences, and missing values of each feature."""
    facts = column_facts(df, features).select(F.col("column").alias("feature"), (F.col("n") - F.col("n_numeric")).alias("missing"))
    return balance_table(df, arm, weight, features).join(facts, "feature")


def centring(replicates: DataFrame, by: Sequence[str], value: str, point: Column, least: int = 100, threshold: float = 2.0) -> DataFrame:
    """How far the mean of replicates lies from the point estimate, in Monte Carlo errors, and the status of that gate."""
    use = replicates.where(finite(value))
    out = use.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.withColumn("mcse", F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))).withColumn("z", F.abs(F.col("mean") - point) / F.col("mcse"))
    status = F.when(F.col("n") < least, "too_few").when(F.col("z").isNull(), "unassessable").when(F.col("z") <= threshold, "acceptable").otherwise("concern")
    return out.select(*by, "n", "mean", "mcse", "z", status.alias("status"))


def influence(scored: DataFrame, key: str, most: int, numerator: str = "score_num", denominator: str = "h") -> DataFrame:
    """The ``most`` units that move sum(numerator) / sum(denominator) furthest: contribution, influence and rank."""
    total = scored.agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"), F.count("*").alias("n"))
    den, n = total.select("den").scalar(), total.select("n").scalar()
    estimate = total.select(ratio("num", "den")).scalar()
    each = scored.select(key, (F.col(numerator) / den).alias("contribution"), ((F.col(numerator) - estimate * F.col(denominator)) / (den / n)).alias("influence"))
    top = each.orderBy(F.desc(F.abs("influence")), key).limit(most)  # a report
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("influence")), key)))


def halton(df: DataFrame, index: str, bases: Sequence[int] = (2, 3), digits: int = 40) -> DataFrame:
    """Adds quasi-random numbers u1, u2, ... in [0, 1): the digits of the index in each base, mirrored at the point."""
    out = {}
    for k, base in enumerate(bases):
        places = [d for d in range(digits) if base**d < 1 << 40]
        out[f"u{k + 1}"] = sum((F.expr(f"cast(({index} div {base**d}L) % {base} as double)") / float(base ** (d + 1)) for d in places), F.lit(0.0))
    return df.withColumns(out)


def calibrate(residuals: Callable[[np.ndarray], np.ndarray], starts: Sequence[Sequence[float]], low: Sequence[float], high: Sequence[float], steps: int = 40, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Parameters within bounds of the least sum of squared residuals, from several starts, by damped Gauss-Newton steps.

    ``residuals`` maps a few parameters to a few residuals, each call an aggregation
    in Spark over whatever rows it needs.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    best, least = np.clip(np.asarray(starts[0], float), low, high), np.inf
    for start in starts:
        x, damping = np.clip(np.asarray(start, float), low, high), 1e-3
        r = residuals(x)
        loss = float(r @ r)
        for _ in range(steps):
            h = 1e-6 * np.maximum(1.0, np.abs(x))
            h = np.where(x + h > high, -h, h)
            slope = np.stack([(residuals(x + h * e) - r) / h[i] for i, e in enumerate(np.eye(len(x)))], axis=1)
            step = np.linalg.lstsq(slope.T @ slope + damping * np.eye(len(x)), -slope.T @ r, rcond=None)[0]
            new = np.clip(x + step, low, high)
            tried = residuals(new)
            gain = loss - float(tried @ tried)
            if gain > 0:
                x, r, loss, damping = new, tried, float(tried @ tried), damping / 4
            else:
                damping *= 8
            if abs(gain) < tolerance and np.abs(step).max() < 1e-6:
                break
        if loss < least:
            best, least = x, loss
    return best, least
