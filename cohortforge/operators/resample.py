"""Folds, bootstrap multiplicities, intervals and simulation summaries."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortforge.functions.columns import ratio
from cohortforge.operators.running import cut_points, row_numbers


def hashed(*parts: str | Column | int) -> Column:
    """A draw in [0, 2^60): 60 bits of the MD5 of the parts as text with colons between, which any engine repeats."""
    text = F.concat_ws(":", *((F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stratified_folds(df: DataFrame, key: str, strata: Sequence[str], k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds 0 to k - 1, dealt out in turn inside each stratum in the order of a hash of seed and key.

    Places come from two levels of counts, so a stratum of any size is many tasks.
    """
    placed = row_numbers(df.withColumn("_draw", hashed(seed, key)), strata, "_draw", ["_draw", key], "_row")
    return placed.withColumn(name, F.pmod("_row", F.lit(k)).cast("int")).drop("_draw", "_row")


def ladder_folds(df: DataFrame, key: str, ladder: Sequence[Sequence[str]], k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Stratified folds by the first rung of ``ladder`` of which each stratum has at least k rows; without such a rung plain folds.

    The rung is chosen for the whole table, like treatment by event, then treatment
    alone, then event alone.  Adds ``name`` and ``rung``, the columns of the strata
    joined by ``x``.
    """
    for strata in ladder:
        least = df.groupBy(*strata).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
        if least is not None and least >= k:
            return stratified_folds(df, key, strata, k, seed, name).withColumn("rung", F.lit("x".join(strata)))
    return stratified_folds(df, key, [], k, seed, name).withColumn("rung", F.lit("none"))


def grouped_folds(df: DataFrame, group: str, stratum: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of whole groups: a group's stratum is its largest value, all its rows share one fold."""
    groups = df.groupBy(group).agg(F.max(stratum).alias("_s"))
    return df.join(stratified_folds(groups, group, ["_s"], k, seed, name).select(group, name), group)


def dense_positions(keys: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """key and its place, from 0 without a gap, in the order of the keys (numbers); a null or repeated key is an error."""
    counted = keys.groupBy(key).agg(F.count("*").alias("_n"))
    broken = F.when((F.col("_n") > 1) | F.col(key).isNull(), F.raise_error(F.concat(F.lit(f"{key} is null or not unique: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("long"))
    placed = row_numbers(counted, [], key, [key], name, cut_points(keys, F.col(key).cast("double"))[0])
    return placed.select(key, F.coalesce(broken, F.col(name)).alias(name))


def bootstrap_counts(keys: DataFrame, key: str, replicates: int, seed: int = 0, first: int = 0) -> DataFrame:
    """How often each key is drawn in each replicate, numbered from ``first``, of as many draws as there are keys.

    The draw of a place in a replicate is 60 bits of a hash of (seed, replicate, place),
    modulo the number of keys: its bias is below n / 2^60.  Draws are rows, so their
    number is spread; they are counted before they meet the keys, and covariates never
    travel: statistics that are linear in weights take the count as a weight.  Keys get
    dense places here, so none that is drawn is missing.
    """
    placed = dense_positions(keys, key)
    n = keys.agg(F.count("*").alias("_n"))
    draws = placed.join(F.broadcast(n)).select(F.col("pos").alias("_draw"), "_n", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))).alias("replicate"))  # one row
    drawn = draws.select("replicate", F.pmod(hashed(seed, "replicate", "_draw"), F.col("_n")).alias("pos"))
    return drawn.groupBy("replicate", "pos").agg(F.count("*").alias("times")).join(placed, "pos").select("replicate", key, "times")


_SINES = [np.uint32(floor(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
#: Subjects of a bucket of places, and draws of a replicate that a task makes at once.
BUCKET, BLOCK = 1 << 15, 1 << 15


def hashed_many(prefix: str, first: int, count: int) -> np.ndarray:
    """``hashed`` of a prefix and each whole number from ``first`` on: MD5 of one block, all numbers of equal length at once."""
    out = np.empty(count, np.uint64)
    at = first
    while at < first + count:
        digits = len(str(at))
        end = min(first + count, 10**digits)
        number, head = np.arange(at, end, dtype=np.uint64), prefix.encode()
        size = len(head) + digits
        if size > 55:
            raise ValueError("the text of a draw is longer than a block")
        plain = np.frombuffer(head + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), "<u4")
        words = [plain[i : i + 1] for i in range(16)]
        for k in range(digits - 1, -1, -1):
            number, digit = number // np.uint64(10), (number % np.uint64(10)).astype(np.uint32) + np.uint32(48)
            byte = len(head) + k
            words[byte // 4] = words[byte // 4] + (digit << np.uint32(8 * (byte % 4)))
        a0, b0, c0, d0 = (np.full(end - at, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        a, b, c, d = a0, b0, c0, d0
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a
            f += words[g] + _SINES[i]
            a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
        high, low = ((a0 + a).byteswap().astype(np.uint64), (b0 + b).byteswap().astype(np.uint64))
        out[at - first : end - first] = ((high << np.uint64(32)) | low) >> np.uint64(4)
        at = end
    return out


def with_places(df: DataFrame, key: str, name: str = "_pos") -> tuple[DataFrame, int]:
    """Adds the place of each row, from 0 without a gap, in the order of the keys (numbers), and the number of rows; a null or repeated key is an error."""
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
    if distinct < n:
        raise ValueError(f"{key} is null or not unique")
    return row_numbers(df, [], key, [key], name), n


def with_draws(placed: DataFrame, n: int, replicates: Sequence[int], seed: int, pos: str = "_pos", name: str = "_w") -> DataFrame:
    """Adds how often each row is drawn in each of these replicates, an array of short numbers: the draws of ``bootstrap_counts``.

    A task makes the draws of a block of places; they travel as two bytes each, packed by bucket of drawn places,
    and meet the rows of their bucket there, so no row stands for a draw.
    """
    spark, width, bucket, size = placed.sparkSession, len(replicates), BUCKET, BLOCK
    buckets = -(-n // bucket)

    def draw(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                count = min(size, n - block * size)
                for i, r in enumerate(replicates):
                    drawn = (hashed_many(f"{seed}:{r}:", block * size, count) % np.uint64(n)).astype(np.int64)
                    drawn.sort()
                    ends = np.searchsorted(drawn, np.arange(buckets + 1) * bucket).astype(np.int32) * 2
                    data = pa.BinaryArray.from_buffers(pa.binary(), buckets, [None, pa.py_buffer(ends), pa.py_buffer((drawn % bucket).astype(np.uint16))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, i, np.int32)), data], ["_bucket", "_i", "_drawn"])

    blocks = -(-n // size)
    draws = spark.range(0, blocks, 1, max(1, min(blocks, 1024))).mapInArrow(draw, "_bucket int, _i int, _drawn binary").where(F.length("_drawn") > 0)
    columns = [f for f in placed.schema.fields if f.name != pos]

    def count(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        times = np.zeros(bucket * width, np.int64)
        for i, raw in zip(drawn.column("_i").to_pylist(), drawn.column("_drawn").to_pylist(), strict=True):
            own = times[i * bucket : (i + 1) * bucket]
            own += np.bincount(np.frombuffer(raw, np.uint16), minlength=bucket)
        if times.max() > np.iinfo(np.int16).max:
            raise OverflowError("a subject is drawn too often")
        own = np.ascontiguousarray(times.astype(np.int16).reshape(width, bucket).T[rows.column(pos).to_numpy() % bucket])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(own.ravel()))
        own_columns = {f.name: rows.column(f.name) for f in columns}
        own_columns = {c: v.cast(pa.list_(v.type.value_type)) if pa.types.is_list(v.type) else v for c, v in own_columns.items()}  # of any nullability
        return pa.table({**own_columns, name: lists})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), f"`{name}` array<smallint>"])
    own = placed.withColumn("_bucket", F.floor(F.col(pos) / bucket).cast("int"))
    counted = own.groupBy("_bucket").cogroup(draws.groupBy("_bucket")).applyInArrow(count, schema)  # BUCKET rows at most, and their draws
    return counted


def intervals(df: DataFrame, by: Sequence[str], value: str, point: Column, level: float = 0.95) -> DataFrame:
    """Percentile, basic and normal interval of replicate values around a point estimate."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    q = lambda p: F.expr(f"percentile(cast(`{value}` as double), {p})")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(lo).alias("percentile_low"), q(hi).alias("percentile_high"), F.first(point).alias("point"))
    return out.withColumns(
        {
            "basic_low": 2 * F.col("point") - F.col("percentile_high"),
            "basic_high": 2 * F.col("point") - F.col("percentile_low"),
            "normal_low": F.col("point") - 1.96 * F.col("sd"),
            "normal_high": F.col("point") + 1.96 * F.col("sd"),
            "mcse": F.col("sd") / F.sqrt("n"),
            "centering": F.abs(F.col("mean") - F.col("point")) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)),
        }
    )


def simulation_summary(df: DataFrame, by: Sequence[str], estimate: str, truth: str, low: str, high: str, ok: str) -> DataFrame:
    """Bias, its Monte-Carlo error, RMSE, coverage with its error, and failed share, by scenario and method."""
    good = F.col(ok) == 1
    err = F.when(good, F.col(estimate) - F.col(truth))
    covered = F.when(good, (F.col(low) <= F.col(truth)) & (F.col(truth) <= F.col(high))).cast("double")
    excludes = F.when(good, (F.col(low) > 0) | (F.col(high) < 0)).cast("double")
    out = df.groupBy(*by).agg(F.count("*").alias("n_runs"), F.count(err).alias("n_ok"), F.avg(err).alias("bias"), F.stddev_samp(err).alias("_sd"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(covered).alias("coverage"), F.avg(excludes).alias("exclusion"))
    return out.select(*by, "n_runs", "n_ok", "bias", ratio("_sd", F.sqrt("n_ok")).alias("bias_mcse"), "rmse", "coverage", F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("n_ok")).alias("coverage_mcse"), "exclusion", (1 - F.col("n_ok") / F.col("n_runs")).alias("failed"))


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells without a finished run."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def power_gate(df: DataFrame, by: Sequence[str], signal: str, detected: str, least: float = 0.8) -> DataFrame:
    """Detection rate at each signal, and the least signal whose rate reaches ``least``."""
    rates = df.groupBy(*by, signal).agg(F.count("*").alias("n"), F.avg(F.col(detected).cast("double")).alias("rate"))
    return rates.withColumn("minimum_signal", F.min(F.when(F.col("rate") >= least, F.col(signal))).over(W.partitionBy(*by)))
