"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with over this share of all rows are joined by broadcast, so at most its inverse of them are.
HOT_SHARE = 1e-3

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where none is set and the master is local, as in tests, a folder of this
    machine is made and set on the context; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cohortforge-", dir="/tmp"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and return them as a scan.

    The files outlive any executor, and the plan that made them is not run again
    (``checkpoint()`` would run its last stage twice).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _made.append(path)  # first, so that what a write that fails leaves goes with the rest
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete the tables of ``materialise`` that are made inside, also after an error, but those put in the list that it gives."""
    before, kept = set(_made), list(keep)
    try:
        yield kept
    finally:
        stay = {getattr(df, "_shared_path", None) for df in kept}
        for path in [p for p in _made if p not in before and p not in stay]:
            _delete(spark, path)


def join_keys(rows: DataFrame, keys: DataFrame, on: str, count: str) -> DataFrame:
    """Inner join of rows with one row for each of their keys, where a key may hold any share of the rows.

    ``keys`` says in ``count``, which is dropped, how many rows each key has.  The keys
    of over ``HOT_SHARE`` of them, 1,000 at most, are broadcast; the rest is shuffled.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(10_000, int(total * HOT_SHARE))
    few, rest = keys.where(hot).drop(count), keys.where(~hot).drop(count)
    crowd = F.broadcast(few)  # at most 1 / HOT_SHARE keys
    return rows.join(crowd, on).unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(rest, on))


def small_batches(spark: SparkSession, rows: int = 512, octets: int = 4 << 20) -> None:
    """Keep Arrow batches small enough for a Python worker: by bytes, which long texts reach first, and by rows, which short rows do.

    Spark reads the settings when a plan runs, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(octets))


def fold(column, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts
