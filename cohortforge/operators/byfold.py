"""Ridge models, R-learner effects, principal components and boosted trees whose parts are learned from the other folds.

Gram matrices are summed once by fold; those of a training set are the total less the fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip, ratio
from cohortforge.operators.crossfit import RIDGE_PENALTIES
from cohortforge.operators.running import summed


def _checked(c: Column, name: str) -> Column:
    return F.coalesce(c.cast("double"), F.raise_error(F.lit(f"{name} is null; impute it first")).cast("double"))


def _columns(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(p)], axis=1)


def fold_ridge(rows: DataFrame, x: Sequence[Column], y: Column, fold: str, weight: Column | None = None, penalties: Sequence[float] = RIDGE_PENALTIES) -> DataFrame:
    """fold, intercept, slopes and penalty of a weighted ridge regression on the rows of the other folds.

    Features are scaled by the (unweighted) deviations of those rows; the penalty is that of the least
    weighted leave-one-out error, from leverages, the first of equals.
    """
    p = len(x)
    use = rows.select(F.col(fold).cast("int").alias("_f"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"), _checked(y, "the outcome").alias("_y"), *(_checked(c, f"feature {i}").alias(f"_x{i}") for i, c in enumerate(x))).persist()
    folds = [r[0] for r in use.select("_f").distinct().orderBy("_f").collect()]  # a row for each fold
    q = p + 2
    width = 1 + 2 * p + q * q

    def parts(batch):
        f, w, y_ = (batch.column(c).to_numpy() for c in ("_f", "_w", "_y"))
        xs = _columns(batch, p)
        return f, w, y_, xs, np.concatenate((np.ones((len(f), 1)), xs, y_[:, None]), axis=1)

    def gram(batch):
        f, w, _, xs, z = parts(batch)
        out = np.zeros((len(folds), width))
        for k, name in enumerate(folds):
            m = f == name
            out[k] = np.concatenate(([m.sum()], xs[m].sum(axis=0), (xs[m] ** 2).sum(axis=0), (z[m].T @ (z[m] * w[m][:, None])).ravel()))
        return out.ravel()

    sums = summed(use, len(folds) * width, gram).reshape(len(folds), width) if folds else np.zeros((0, width))
    train = sums.sum(axis=0) - sums
    fits = {}
    for k in range(len(folds)):
        n, total, square = train[k, 0], train[k, 1 : 1 + p], train[k, 1 + p : 1 + 2 * p]
        g = train[k, 1 + 2 * p :].reshape(q, q)
        if n < 2 or g[0, 0] <= 0:
            use.unpersist()
            raise ValueError(f"nothing to learn from without fold {folds[k]}")
        sd = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
        sd = np.where(sd > 1e-12, sd, 1.0)
        mean, middle = g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
        xx = (g[1:-1, 1:-1] - g[0, 0] * np.outer(mean, mean)) / np.outer(sd, sd)
        xy = (g[1:-1, -1] - g[0, 0] * mean * middle) / sd
        for c in penalties:
            inverse = np.linalg.inv(xx + c * np.eye(p))
            fits[k, c] = (mean, sd, middle, inverse @ xy, inverse, g[0, 0])

    def errors(batch):
        f, w, y_, xs, _ = parts(batch)
        out = []
        for (k, _), (mean, sd, middle, b, inverse, total) in fits.items():
            m = f != folds[k]
            z = (xs[m] - mean) / sd
            leverage = w[m] * (1 / total + ((z @ inverse) * z).sum(axis=1))
            out.append(float((w[m] * ((y_[m] - middle - z @ b) / np.maximum(1 - leverage, 1e-9)) ** 2).sum()))
        return np.array(out)

    lost = dict(zip(fits, summed(use, len(fits), errors), strict=True)) if fits else {}
    use.unpersist()
    table = []
    for k, name in enumerate(folds):
        c = min(penalties, key=lambda v: lost[k, v])  # noqa: B023
        mean, sd, middle, b, _, _ = fits[k, c]
        slope = b / sd
        table.append((name, float(middle - slope @ mean), slope.tolist(), float(c)))
    return rows.sparkSession.createDataFrame(table, "fold int, intercept double, slopes array<double>, penalty double")


def predicted(x: Sequence[Column]) -> Column:
    """The prediction of a row joined with its fold's ``fold_ridge``."""
    return sum((c.cast("double") * F.col("slopes")[i] for i, c in enumerate(x)), F.col("intercept"))


def _with_fits(df: DataFrame, fits: DataFrame, fold: str) -> DataFrame:
    held = fits.withColumnRenamed("fold", "_f")
    return df.withColumn("_f", F.col(fold).cast("int")).join(F.broadcast(held), "_f").drop("_f")  # a row for each fold


def crossfit_pooled_ridge(df: DataFrame, y: str, arm: str, features: Sequence[str], fold: str, penalties: Sequence[float] = RIDGE_PENALTIES, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Adds mu0 and mu1 from one ridge model of both arms: features, arm, and their products, learned from the other folds."""
    x = [F.col(c).cast("double") for c in features]
    design = lambda a: [*x, a, *(c * a for c in x)]
    df = df.drop("mu0", "mu1")
    joined = _with_fits(df, fold_ridge(df, design(F.col(arm).cast("double")), F.col(y), fold, penalties=penalties), fold)
    value = lambda a: predicted(design(F.lit(float(a))))
    return joined.withColumns({f"mu{a}": clip(value(a), *bounds) if bounds else value(a) for a in (0, 1)}).drop("intercept", "slopes", "penalty")


def crossfit_effect(df: DataFrame, y: str, arm: str, m: str, e: str, features: Sequence[str], fold: str, penalties: Sequence[float] = RIDGE_PENALTIES, floor: float = 0.05) -> DataFrame:
    """Adds tau: the effect of each row by an R-learner that was fitted on the other folds, and tau_constant, the one effect of those folds.

    Outcome residuals over treatment residuals, weighted by the square of the latter, go into a weighted ridge; a treatment
    residual nearer to zero than ``floor`` counts as the floor, with its sign, plus for zero.
    """
    ra = F.col(arm).cast("double") - F.col(e)
    ry = F.col(y) - F.col(m)
    safe = F.when(F.abs(ra) >= floor, ra).when(ra >= 0, floor).otherwise(-floor)
    x = [F.col(c) for c in features]
    sums = df.groupBy(F.col(fold).cast("int").alias("_f")).agg(F.sum(ry * ra).alias("_a"), F.sum(ra * ra).alias("_b"))
    total = sums.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    constant = sums.join(F.broadcast(total)).select("_f", ratio(F.col("_ta") - F.col("_a"), F.col("_tb") - F.col("_b")).alias("tau_constant"))  # one row
    joined = _with_fits(df, fold_ridge(df, x, ry / safe, fold, safe * safe, penalties), fold).withColumn("tau", predicted(x)).drop("intercept", "slopes", "penalty")
    return joined.withColumn("_f", F.col(fold).cast("int")).join(F.broadcast(constant), "_f").drop("_f")  # a row for each fold


def effect_losses(df: DataFrame, y: str, arm: str, m: str, e: str, fold: str, tau: str = "tau", constant: str = "tau_constant") -> DataFrame:
    """By fold, and for all rows with a null fold: mean R-loss of tau and of the constant effect, their difference, and its t."""
    ra, ry = F.col(arm).cast("double") - F.col(e), F.col(y) - F.col(m)
    loss, flat = F.pow(ry - F.col(tau) * ra, 2), F.pow(ry - F.col(constant) * ra, 2)
    use = df.select(F.col(fold).cast("int").alias("fold"), loss.alias("_l"), flat.alias("_c"))
    out = use.rollup("fold").agg(F.count("*").alias("n"), F.avg("_l").alias("loss"), F.avg("_c").alias("constant_loss"), F.avg(F.col("_c") - F.col("_l")).alias("improvement"), F.stddev_samp(F.col("_c") - F.col("_l")).alias("_sd"))
    return out.withColumn("t", ratio("improvement", F.col("_sd") / F.sqrt("n"))).drop("_sd")


def crossfit_components(df: DataFrame, features: Sequence[str], fold: str, k: int, name: str = "pc") -> DataFrame:
    """Adds the first k principal components of each row, as an array, by the correlations of the other folds.

    Features are scaled by the rows of the other folds; the largest loading of a component, the first of
    equals, is positive.  Fewer features than k give as many components.
    """
    p = len(features)
    x = [_checked(F.col(c), c).alias(f"_x{i}") for i, c in enumerate(features)]
    shift = np.array(df.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) for c in features)).first())
    use = df.select(F.col(fold).cast("int").alias("_f"), *x)
    folds = [r[0] for r in use.select("_f").distinct().orderBy("_f").collect()]  # a row for each fold
    width = 1 + p + p * p

    def gram(batch):
        f, z = batch.column("_f").to_numpy(), _columns(batch, p) - shift
        return np.concatenate([np.concatenate(([m.sum()], z[m].sum(axis=0), (z[m].T @ z[m]).ravel())) for name in folds for m in [f == name]])

    sums = summed(use, len(folds) * width, gram).reshape(len(folds), width) if folds else np.zeros((0, width))
    table = []
    for f, train in zip(folds, sums.sum(axis=0) - sums, strict=True):
        n = max(train[0], 1.0)
        mean = train[1 : 1 + p] / n
        cov = train[1 + p :].reshape(p, p) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd = np.where(sd > 1e-12, sd, 1.0)
        _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        loading = vectors[:, ::-1][:, : min(k, p)]
        loading = loading * np.sign(loading[np.abs(loading).argmax(axis=0), np.arange(loading.shape[1])])
        slope = loading / sd[:, None]
        table.append((f, slope.T.tolist(), (-(mean + shift) @ slope).tolist()))
    fits = df.sparkSession.createDataFrame(table, "fold int, _b array<array<double>>, _a array<double>")
    held = [F.col(c).cast("double") for c in features]
    pc = F.array(*(sum((c * F.col("_b")[j][i] for i, c in enumerate(held)), F.col("_a")[j]) for j in range(min(k, p))))
    return _with_fits(df, fits, fold).withColumn(name, pc).drop("_a", "_b")


def crossfit_boosted(df: DataFrame, label: str, features: Sequence[str], fold: str, name: str, classify: bool, where: Column | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.05, least_rows: int = 20, bounds: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """Adds the prediction of boosted trees fitted on the other folds: a probability (of label 1) or a mean.

    Spark's trees, whose histograms are summed over the cluster.  ``where``: which rows are learned from; all are
    predicted.  A training set with fewer than ``least_rows`` rows is an error, one whose labels are all equal gives that value.
    """
    y = F.col(label).cast("double")
    rows = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="error").transform(df.withColumn("_y", y))
    learn = rows.where(where) if where is not None else rows
    facts = {r["_f"]: r for r in learn.groupBy(F.col(fold).cast("int").alias("_f")).agg(F.count("*").alias("n"), F.min("_y").alias("least"), F.max("_y").alias("most")).collect()}  # a row for each fold
    folds = [r[0] for r in df.select(F.col(fold).cast("int")).distinct().orderBy(fold).collect()]  # a row for each fold
    out = None
    for k in folds:
        other = [r for f, r in facts.items() if f != k]
        n = sum(r["n"] for r in other)
        if n < least_rows:
            raise ValueError(f"without fold {k}: {n} rows to learn from, {least_rows} needed")
        part = rows.where(F.col(fold) == k)
        low, high = min(r["least"] for r in other), max(r["most"] for r in other)
        if low == high:
            part = part.withColumn(name, F.lit(low))
        else:
            learner = (GBTClassifier if classify else GBTRegressor)(featuresCol="_v", labelCol="_y", predictionCol="_p", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=least_rows, seed=seed)
            part = learner.fit(learn.where(F.col(fold) != k)).transform(part)
            part = part.withColumn(name, vector_to_array("probability")[1] if classify else F.col("_p"))
        part = part.select(*df.columns, name)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return out.withColumn(name, clip(name, *bounds)) if bounds else out


def crossfit_boosted_outcomes(df: DataFrame, y: str, arm: str, features: Sequence[str], fold: str, bounds: tuple[float, float] | None = None, **trees) -> DataFrame:
    """Adds mu0 and mu1 from boosted trees of either arm, fitted on the other folds."""
    out = df.drop("mu0", "mu1")
    for a in (0, 1):
        out = crossfit_boosted(out, y, features, fold, f"mu{a}", False, F.col(arm) == a, bounds=bounds, **trees)
    return out


def probability_losses(df: DataFrame, label: str, probabilities: Sequence[str], fold: str) -> DataFrame:
    """Log-loss and Brier score of each model by fold, and for all rows with a null fold."""
    y = F.col(label).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in probabilities)))
    rows = df.select(F.col(fold).cast("int").alias("fold"), y.alias("_y"), each.alias("_m")).select("fold", "_y", "_m.*")
    p = clip("p", 1e-12, 1 - 1e-12)
    scored = rows.select("model", "fold", (-(F.col("_y") * F.ln(p) + (1 - F.col("_y")) * F.ln(1 - p))).alias("_l"), F.pow(F.col("_y") - F.col("p"), 2).alias("_b"))
    both = scored.select("model", F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("fold"), "_l", "_b")
    return both.groupBy("model", "fold").agg(F.count("*").alias("n"), F.avg("_l").alias("log_loss"), F.avg("_b").alias("brier"))
