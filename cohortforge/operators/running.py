"""Running sums, extremes, carried values, ranks and exact quantiles over long ordered groups, in two levels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pieces of an order, by the number of rows: squares, so that a value finds its piece in two steps of the root.
#: So many rows go to a piece as far as the pieces go; where one holds all there is no cutting.
PIECES = (64, 256, 1024, 4096)
PIECE_ROWS = 250_000


def cut_points(df: DataFrame, *orders: Column, least: int = 1, most: int = PIECES[-1]) -> list[list[float]]:
    """Approximate quantiles of each order that cut it into pieces, none for a table of up to ``PIECE_ROWS`` rows if ``least`` is 1.

    One job, of which the driver gets a row, and a second for tables that need more than the fewest pieces.
    """
    asked = df.select(*(c.alias(f"c{i}") for i, c in enumerate(orders)))

    def quantiles(pieces: int) -> list:
        at = ", ".join(f"{k / pieces!r}D" for k in range(1, pieces))
        return list(asked.agg(F.count("*"), *(F.expr(f"percentile_approx(c{i}, array({at}), {max(2048, 4 * pieces)})") for i in range(len(orders)))).first())

    n, *cuts = quantiles(PIECES[0])
    if n <= PIECE_ROWS and least == 1:
        return [[] for _ in orders]
    wanted = next((p for p in PIECES if p >= most or n <= p * PIECE_ROWS), most)
    if wanted > PIECES[0]:
        _, *cuts = quantiles(min(wanted, most))
    return [list(c or []) for c in cuts]


def with_piece(df: DataFrame, x: Column, cuts: Sequence[float], name: str, strict: bool = False) -> DataFrame:
    """Adds how many cut points are at most x, or below x if ``strict``: by every side-th cut first, then between two of them."""
    cuts = [c for c in cuts if math.isfinite(c)]
    side = max(1, round((len(cuts) + 1) ** 0.5))
    sign = ">" if strict else ">="
    steps = [f"if(__x {sign} {c!r}D, {side}, 0)" for c in cuts[side - 1 :: side]]
    rest = [f"if(__x {sign} get(__cuts, __coarse + {k}), 1, 0)" for k in range(side - 1)]
    held = F.expr(f"array({', '.join(f'{c!r}D' for c in cuts)})").cast("array<double>")
    out = df.withColumn("__x", x.cast("double")).withColumns({"__cuts": held, "__coarse": F.expr(" + ".join(["0", *steps]))})
    return out.withColumn(name, F.expr(" + ".join(["__coarse", *rest]))).drop("__x", "__coarse", "__cuts")


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, by: Sequence[str], order: str, folds: Mapping[str, tuple[str, Column]], descending: bool = False, inclusive: bool = True, ties: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """Adds running folds along ``order``, a number: kind ``sum``, ``min``, ``max`` or ``last`` (the last value that is not null).

    All rows are cut into pieces at approximate quantiles of ``order``.  Folds of the
    pieces of a group are taken first; a window then runs inside one piece of one group
    only.  So a group of any length and any spread of values is many tasks, where one
    window over it would be one.  Rows of equal ``order`` stand in one piece, in the
    order of ``ties``.  A sum of nothing is zero, any other fold of nothing null.
    ``cuts``: the cut points, where a table nearer to the source, of at least as many rows, has given them already;
    they decide how rows are spread, never the result.  Without any, the table is small: one window over each group.
    """
    key = F.col(order).cast("double")
    sign = -1.0 if descending else 1.0
    cuts = cut_points(df, key)[0] if cuts is None else cuts
    if not cuts:
        whole = W.partitionBy(*(by or [F.lit(1)])).orderBy(key * sign, *(F.desc(t) if descending else F.asc(t) for t in ties)).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        fold = {n: F.last(c, ignorenulls=True).over(whole) if kind == "last" else F.coalesce(F.sum(c.cast("double")).over(whole), F.lit(0.0)) if kind == "sum" else _FOLDS[kind](c).over(whole) for n, (kind, c) in folds.items()}
        return df.withColumns(fold)  # PIECE_ROWS rows at most
    cut = with_piece(df, key, cuts, "_piece").withColumn("_piece", F.col("_piece") * int(sign))
    cut = cut.withColumns({f"_x_{n}": c.cast("double") if kind == "sum" else c for n, (kind, c) in folds.items()})
    place = F.struct(key.alias("_k"), *(F.col(t) for t in ties))
    end_by = F.min_by if descending else F.max_by
    whole = {n: end_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), place)) if kind == "last" else _FOLDS[kind](f"_x_{n}") for n, (kind, _) in folds.items()}
    totals = cut.groupBy(*by, "_piece").agg(*(c.alias(f"_s_{n}") for n, c in whole.items()))
    over = lambda n, kind, column, w: (F.last(column, ignorenulls=True) if kind == "last" else _FOLDS[kind](column)).over(w)
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_piece").alias("_of_piece"), *(over(n, kind, f"_s_{n}", before).alias(f"_b_{n}") for n, (kind, _) in folds.items()))
    inside = W.partitionBy(*by, "_piece").orderBy(key * sign, *(F.desc(t) if descending else F.asc(t) for t in ties)).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    cut = cut.withColumns({f"_w_{n}": over(n, kind, f"_x_{n}", inside) for n, (kind, _) in folds.items()})
    match = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by), F.col("_piece") == F.col("_of_piece"))
    out = cut.join(totals, match)

    def joined(n: str, kind: str) -> Column:
        b, w = F.col(f"_b_{n}"), F.col(f"_w_{n}")
        if kind == "sum":
            return F.coalesce(b, F.lit(0.0)) + F.coalesce(w, F.lit(0.0))
        return F.coalesce(w, b) if kind == "last" else F.least(b, w) if kind == "min" else F.greatest(b, w)

    helpers = ["_piece", "_of_piece", *(f"_of_{b}" for b in by), *(f"_{k}_{n}" for n in folds for k in "xwb")]
    return out.withColumns({n: joined(n, kind) for n, (kind, _) in folds.items()}).drop(*helpers)


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column], descending: bool = False, ties: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """Adds inclusive running sums along ``order``."""
    return running(df, by, order, {n: ("sum", c) for n, c in sums.items()}, descending, ties=ties, cuts=cuts)


def row_numbers(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "row", cuts: Sequence[float] | None = None) -> DataFrame:
    """Adds the place of each row in its group along ``order`` and then ``ties``, from 0."""
    return running_sums(df, by, order, {name: F.lit(1)}, ties=ties, cuts=cuts).withColumn(name, (F.col(name) - 1).cast("long"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Each distinct value of a group with its count ``n`` and average-tie rank; nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = running_sums(counts, by, value, {"_upto": F.col("n")}, cuts=cut_points(df, F.col(value).cast("double"))[0])
    return upto.select(*by, value, "n", (F.col("_upto") - (F.col("n") - 1) / 2.0).alias(name))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], times: str | None = None) -> DataFrame:
    """Linearly interpolated exact quantiles of each group, a column for each name; nulls are left out.

    ``times``: how often a row counts, a whole number.

    Values are counted, the counts summed along the values, and the two neighbouring
    order statistics of each quantile picked out: no buffer holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_n")).where("_n > 0")
    size = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    upto = running_sums(counts, by, "_v", {"_upto": F.col("_n")}, cuts=cut_points(df, F.col(value).cast("double"))[0])
    at = upto.join(size, list(by)) if by else upto.join(F.broadcast(size))  # without groups one row
    holds = lambda p: (p >= F.col("_upto") - F.col("_n")) & (p < F.col("_upto"))
    place = {n: F.lit(q) * (F.col("_size") - 1) for n, q in quantiles.items()}
    near = reduce(lambda a, b: a | b, (holds(F.floor(p)) | holds(F.ceil(p)) for p in place.values()))
    picked = at.where(near).groupBy(*by).agg(
        F.first("_size").alias("_size"),
        *(x for n, p in place.items() for x in (F.max(F.when(holds(F.floor(p)), F.col("_v"))).alias(f"_lo_{n}"), F.max(F.when(holds(F.ceil(p)), F.col("_v"))).alias(f"_hi_{n}"))),
    )
    return picked.select(*by, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (p - F.floor(p))).alias(n) for n, p in place.items()))


def summed(rows: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all batches of the vector of length ``size`` that ``work`` makes of a batch."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    table = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # ``size`` rows at most
    out = np.zeros(size)
    out[table.column("at").to_numpy()] = table.column("v").to_numpy()
    return out
