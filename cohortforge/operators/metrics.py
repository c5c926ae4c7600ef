"""Accuracy of risk scores under censoring: concordance, AUC, Brier score.

Pairs are counted, not joined: subjects are first summed in cells of (time, risk).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.columns import clip, ratio
from cohortforge.operators.joins import step_lookup
from cohortforge.operators.ordered import average_ranks
from cohortforge.operators.running import cut_points, running_sums, with_piece
from cohortforge.operators.survival import weighted_curve


def auc(df: DataFrame, by: Sequence[str], label: str, risk: str) -> DataFrame:
    """Area under the ROC curve from average ranks: the Mann-Whitney statistic."""
    use = df.where(F.col(label).isNotNull() & F.col(risk).isNotNull())
    ranks = average_ranks(use, by, risk).drop("n")
    cases = use.groupBy(*by, risk).agg(F.count_if(F.col(label) == 1).alias("_c"), F.count("*").alias("_n"))
    sums = ranks.join(cases, [*by, risk]).groupBy(*by).agg(F.sum(F.col("_c") * F.col("avg_rank")).alias("_r"), F.sum("_c").alias("n_cases"), F.sum(F.col("_n") - F.col("_c")).alias("n_controls"))
    return sums.select(*by, "n_cases", "n_controls", ratio(F.col("_r") - F.col("n_cases") * (F.col("n_cases") + 1) / 2, F.col("n_cases") * F.col("n_controls").cast("double")).alias("auc"))


def auc_at_horizon(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str, horizon: float) -> DataFrame:
    """AUC of events by the horizon against survivors beyond it; those censored before it are left out."""
    label = F.when((F.col(event) == 1) & (F.col(time) <= horizon), 1).when(F.col(time) > horizon, 0)
    return auc(df.withColumn("_label", label), by, "_label", risk)


def censoring_survival(df: DataFrame, by: Sequence[str], time: str, event: str, name: str = "g") -> DataFrame:
    """Kaplan-Meier curve of the censoring times: the event flag turned round."""
    return weighted_curve(df.withColumns({"_c": F.lit(1) - F.col(event), "_one": F.lit(1.0)}), by, time, "_c", "_one").select(*by, "time", F.col("survival").alias(name))


def _cells(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str) -> DataFrame:
    return df.groupBy(*by, F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n"), F.count_if(F.col(event) == 1).alias("d"))


def concordance(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str, weight: Column | None = None) -> DataFrame:
    """Weighted share of pairs (an event, any subject with a later time) in which the event has the higher risk; ties count half.

    Without a weight Harrell's index in the form that compares later times only.  The
    weight is an expression of the cell columns ``t`` and ``_g`` of the event, where
    ``_g`` is the left limit of the censoring curve; 1 / g^2 gives Uno's index.

    Pairs are counted, not built.  Times and risks are cut at quantiles, a cut value being
    a piece of its own.  Pairs that differ in both pieces are counted from the grid of
    pieces; pairs in one piece of time, and those in one piece of risk that differ in
    time, each within one task per piece.  Every cell travels twice, whatever the number
    of pairs.
    """
    bare = _cells(df, by, time, event, risk)
    if weight is not None:
        curve = censoring_survival(df, by, time, event, "_g")
        cells = step_lookup(bare, curve, by, "t", "time", "_g", left_limit=True).withColumn("w", weight * F.col("d"))
    else:
        cells = bare.withColumn("w", F.col("d").cast("double"))
    cells = cells.where("t is not null and r is not null and not isnan(t) and not isnan(r)")
    placed = cells.select(*by, "t", "r", "n", "d", "w")
    for c, cuts in zip("tr", cut_points(df, F.col(time).cast("double"), F.col(risk).cast("double"), least=64, most=CONCORDANCE_PIECES), strict=True):
        for strict in (False, True):
            placed = with_piece(placed, F.col(c), cuts, f"_{c}{int(strict)}", strict)
    placed = placed.select(*by, "t", "r", "n", "d", "w", *((F.col(f"_{c}0") + F.col(f"_{c}1")).alias(f"_p{c}") for c in "tr")).persist()
    kinds = dict(placed.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    out = f"{keys + ', ' if by else ''}_g double, _w double, _p double"

    def row(key: tuple, good: float, weighed: float, pairs: float) -> pd.DataFrame:
        return pd.DataFrame([[*key[: len(by)], good, weighed, pairs]], columns=[*by, "_g", "_w", "_p"])

    def across(key, cells: pd.DataFrame) -> pd.DataFrame:
        """Pairs of cells of the grid in different pieces of time, and of risk or at one value of it."""
        ti, t = np.unique(cells["_pt"], return_inverse=True)
        ri, r = np.unique(cells["_pr"], return_inverse=True)
        n, w, d = (np.zeros((len(ti), len(ri))) for _ in range(3))
        for table, c in ((n, "n"), (w, "w"), (d, "d")):
            np.add.at(table, (t, r), cells[c].to_numpy(float))
        later = n[::-1].cumsum(axis=0)[::-1] - n
        lower = later.cumsum(axis=1) - later
        lows, highs = np.full(len(ri), np.inf), np.full(len(ri), -np.inf)
        np.minimum.at(lows, r, cells["low"].to_numpy(float))
        np.maximum.at(highs, r, cells["high"].to_numpy(float))
        every = later.sum(axis=1, keepdims=True)
        return row(key, float((w * (lower + 0.5 * later * (lows == highs))).sum()), float((w * every).sum()), float((d * every).sum()))

    def within(name: str, later: str) -> DataFrame:
        """Pairs inside the pieces that have more than one value; many pieces of a task are counted at once."""
        side, heads = name[-1], [*by, name]

        def count(batches):
            for cells in whole_pieces(batches, heads):
                group = cells.groupby(heads, sort=False, dropna=False).ngroup().to_numpy()
                sums = _pairs_in_pieces(group, *(cells[c].to_numpy(float) for c in (later, "r", "n", "d", "w")))
                first = cells.groupby(heads, sort=False, dropna=False).head(1)[list(by)].reset_index(drop=True)
                yield first.assign(_g=sums[0], _w=sums[1] if name == "_pt" else 0.0, _p=sums[2] if name == "_pt" else 0.0)

        spread = placed.groupBy(*heads).agg(F.min(side).alias("_lo"), F.max(side).alias("_hi")).where("_lo < _hi").select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col(name).alias("_of"))
        mine = placed.join(spread, reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by), F.col(name) == F.col("_of")), "left_semi")
        return mine.repartition(*heads).sortWithinPartitions(*heads).mapInPandas(count, out)

    grid = placed.groupBy(*by, "_pt", "_pr").agg(*(F.sum(c).cast("double").alias(c) for c in "ndw"), F.min("r").alias("low"), F.max("r").alias("high"))
    each = grid.groupBy(*by).applyInPandas(across, out).union(within("_pt", "t")).union(within("_pr", "_pt"))
    out = each.groupBy(*by).agg(F.sum("_g").alias("_g"), F.sum("_w").alias("_w"), F.sum("_p").cast("long").alias("pairs")).select(*by, "pairs", ratio("_g", "_w").alias("c_index"))
    found = out.collect()  # a row for each group; the cells, which four branches read, are let go
    placed.unpersist()
    return df.sparkSession.createDataFrame(found, out.schema)


#: Pieces of time and of risk, a square; the grid of a group is four times its square at most.
CONCORDANCE_PIECES = 1024


def whole_pieces(frames, heads: Sequence[str], rows: int = 1 << 16):
    """Frames of at least ``rows`` rows (the last may have fewer) that never cut a piece, from rows sorted by ``heads``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        number = frame.groupby(list(heads), sort=False, dropna=False).ngroup().to_numpy()
        cut = int(np.argmax(number == number[-1]))
        if cut:
            yield frame.iloc[:cut]
        held = [frame.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _pairs_in_pieces(group: np.ndarray, later: np.ndarray, risk: np.ndarray, n: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By group: weight of pairs with the event at higher risk (ties half), weight of all pairs and their number, of an event and a greater ``later``.

    Ranks of ``later`` differ first at one bit, so each pair meets once: at each bit, a
    running count of the upper half along the risk serves all events of the lower half.
    """
    groups = int(group.max()) + 1
    order = np.lexsort((later, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (later[order][1:] != later[order][:-1])
    number = np.cumsum(new) - 1
    rank = np.empty(len(order), np.int64)
    first = np.full(groups, len(order))
    np.minimum.at(first, group[order], number)
    rank[order] = number - first[group[order]]
    total = np.bincount(number, weights=n[order])
    upto = np.cumsum(total)
    ends = np.zeros(groups)
    np.maximum.at(ends, group[order], upto[number])
    beyond = np.empty(len(order))
    beyond[order] = ends[group[order]] - upto[number]
    bits = int(rank.max()).bit_length()
    good = np.zeros(groups)
    by_risk = np.argsort(risk, kind="stable")
    for bit in range(bits):
        node_of = (group << bits) | (rank >> (bit + 1))
        order = by_risk[np.argsort(node_of[by_risk], kind="stable")]
        node, r, upper = node_of[order], risk[order], (rank[order] >> bit) & 1 == 1
        count = np.concatenate(([0.0], np.cumsum(np.where(upper, n[order], 0.0))))
        new = np.ones(len(order), bool)
        new[1:] = node[1:] != node[:-1]
        base = count[np.flatnonzero(new)][np.cumsum(new) - 1]
        new[1:] |= r[1:] != r[:-1]
        start = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        below, to = count[start][of], count[np.append(start[1:], len(order))][of]
        good += np.bincount(group[order], weights=np.where(upper, 0.0, w[order]) * ((below + to) / 2 - base), minlength=groups)
    return good, np.bincount(group, weights=w * beyond, minlength=groups), np.bincount(group, weights=d * beyond, minlength=groups)


def uno(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str, floor: float = 1e-6) -> DataFrame:
    g = clip("_g", floor, 1.0)
    return concordance(df, by, time, event, risk, F.lit(1.0) / (g * g))


def dynamic_auc(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str, horizon: float, floor: float = 1e-6) -> DataFrame:
    """AUC at a horizon with events weighted by 1 / G(t-): running counts of survivors over the ranks of risk, no pairs."""
    curve = censoring_survival(df, by, time, event, "_g")
    cells = step_lookup(_cells(df, by, time, event, risk), curve, by, "t", "time", "_g", left_limit=True)
    by_risk = cells.groupBy(*by, "r").agg(F.sum(F.when(F.col("t") <= horizon, F.col("d") / clip("_g", floor, 1.0)).otherwise(0.0)).alias("case_w"), F.sum(F.when(F.col("t") > horizon, F.col("n")).otherwise(0)).cast("double").alias("controls"))
    upto = running_sums(by_risk, by, "r", {"_upto": F.col("controls")}, cuts=cut_points(df, F.col(risk).cast("double"))[0])
    below = F.col("_upto") - F.col("controls") / 2
    total = upto.groupBy(*by).agg(F.sum(F.col("case_w") * below).alias("_u"), F.sum("case_w").alias("_c"), F.sum("controls").alias("_k"))
    return total.select(*by, ratio("_u", F.col("_c") * F.col("_k")).alias("auc"))


def ipcw_brier(df: DataFrame, by: Sequence[str], time: str, event: str, predicted_survival: str, horizons: Sequence[float], floor: float = 1e-6) -> DataFrame:
    """Weighted Brier score of predicted survival at each horizon.

    Events by the horizon weigh 1 / G(t-), survivors 1 / G(horizon), others nothing.
    """
    curve = censoring_survival(df, by, time, event, "_g")
    own = step_lookup(df.select(*by, F.col(time).cast("double").alias("t"), F.col(event).alias("_e"), F.col(predicted_survival).alias("_p")), curve, by, "t", "time", "_g", left_limit=True)
    ends = df.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(float(h)) for h in horizons))).alias("horizon")) if by else df.sparkSession.createDataFrame([(float(h),) for h in horizons], "horizon double")
    ends = step_lookup(ends, curve, by, "horizon", "time", "_g").withColumnRenamed("_g", "_gh")
    both = own.join(F.broadcast(ends), list(by)) if by else own.join(F.broadcast(ends))  # a row per group and horizon
    dead = (F.col("t") <= F.col("horizon")) & (F.col("_e") == 1)
    alive = F.col("t") > F.col("horizon")
    p = F.col("_p")
    score = F.when(dead, p * p / clip("_g", floor, 1.0)).when(alive, (1 - p) * (1 - p) / clip("_gh", floor, 1.0)).otherwise(0.0)
    return both.groupBy(*by, "horizon").agg(F.avg(score).alias("brier"), F.count("*").alias("n"))
