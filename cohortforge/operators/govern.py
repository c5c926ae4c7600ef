"""Contracts, gates, manifests and checkpoints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.operators.ordered import keep_last


class GateError(ValueError):
    """A gate or contract that does not hold."""


def contract(df: DataFrame, key: str, nonnegative: Sequence[str] = (), binary: Sequence[str] = ()) -> DataFrame:
    """One row of counts: rows, missing keys, repeated keys, negative or missing numbers, values outside {0, 1}."""
    missing = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    sums = [F.count("*").alias("n_rows"), F.count_if(missing).alias("missing_keys")]
    sums += [F.count_if(F.col(c).isNull() | (F.col(c) < 0)).alias(f"bad_{c}") for c in nonnegative]
    sums += [F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(f"bad_{c}") for c in binary]
    repeated = df.where(~missing).groupBy(key).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    return df.agg(*sums).join(F.broadcast(repeated))


def enforce_contract(df: DataFrame, key: str, nonnegative: Sequence[str] = (), binary: Sequence[str] = ()) -> DataFrame:
    """The table itself, or an error that names what is broken."""
    found = contract(df, key, nonnegative, binary).first().asDict()
    broken = {k: v for k, v in found.items() if k != "n_rows" and v}
    if broken or not found["n_rows"]:
        raise GateError(f"contract of {key}: {broken or 'no rows'}")
    return df


def gates(measured: DataFrame, expected: Mapping[str, float], tolerance: float = 0.0) -> DataFrame:
    """A row for each expected quantity of a one-row frame: observed, expected, passed."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).cast("double").alias("observed"), F.lit(float(v)).alias("expected")) for k, v in expected.items()))).alias("x")
    return measured.select(rows).select("x.*").withColumn("passed", F.coalesce((F.abs(F.col("observed") - F.col("expected")) <= tolerance).cast("int"), F.lit(0)))


def enforce_gates(checks: DataFrame) -> None:
    failed = [r.asDict() for r in checks.where("passed = 0").limit(20).collect()]
    if failed:
        raise GateError(f"gates failed: {failed}")


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and an order-free digest of a table: the sum of 60-bit pieces of row hashes."""
    row = F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def manifest(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = table_digest(df).select(F.lit(name).alias("table"), "n_rows", "digest")
        out = row if out is None else out.union(row)
    return out if out is not None else spark.createDataFrame([], "table string, n_rows long, digest string")


def verify_manifest(locked: DataFrame, current: DataFrame) -> DataFrame:
    """Each table of either manifest and its status: ok, changed, missing or new."""
    a, b = locked.select("table", F.col("digest").alias("_a")), current.select("table", F.col("digest").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") == F.col("_b"), "ok").otherwise("changed")
    return a.join(b, "table", "full").select("table", status.alias("status"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file that the path names."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def object_digest(value: Any) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def lock(manifest_rows: DataFrame, path: str) -> None:
    """Write a manifest as a protocol lock; a lock that is there already is never overwritten but raises an error."""
    spark = manifest_rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise GateError(f"{path} is locked already")
    manifest_rows.coalesce(1).write.mode("errorifexists").json(path)  # a row for each table


def enforce_lock(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The status of each table against the lock; an error unless all are as they were locked."""
    found = verify_manifest(spark.read.json(path), manifest(spark, tables))
    broken = {r["table"]: r["status"] for r in found.where("status <> 'ok'").collect()}  # a row for each table
    if broken:
        raise GateError(f"tables differ from {path}: {broken}")
    return found


def checkpoint_identity(spark: SparkSession, path: str, config: Any, tables: Mapping[str, DataFrame]) -> str:
    """Digest of a configuration and its input tables, kept at ``path``: made where there is none, else an error unless it is the same."""
    inputs = {r["table"]: [r["n_rows"], r["digest"]] for r in manifest(spark, tables).collect()}  # a row for each table
    identity = object_digest({"config": config, "inputs": inputs})
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.json(path).first()["identity"]
        if held != identity:
            raise GateError(f"{path} belongs to another configuration or other inputs")
    else:
        spark.createDataFrame([(identity,)], "identity string").coalesce(1).write.json(path)
    return identity


def upsert(held: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Checkpoint rows with new rows put in: of one key the highest sequence wins."""
    return keep_last(held.unionByName(new, allowMissingColumns=True), keys, sequence)


def identity_report(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows on one side only, and the largest difference of each column."""
    left, right = a.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(1).alias("_l")), b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(1).alias("_r"))
    both = left.join(right, list(keys), "full")
    gap = {c: F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))) for c in columns}
    out = both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), *(g.alias(f"gap_{c}") for c, g in gap.items()))
    same = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    for c in columns:
        same = same & (F.coalesce(f"gap_{c}", F.lit(0.0)) <= tolerance)
    return out.withColumn("identical", same.cast("int"))


def interval_status(low: str, high: str, null_value: float = 0.0) -> Column:
    """above, below or unresolved, as an interval lies to a value; missing where an end is null."""
    return F.when(F.col(low).isNull() | F.col(high).isNull(), "missing").when(F.col(low) > null_value, "above").when(F.col(high) < null_value, "below").otherwise("unresolved")


def stale_claims(texts: DataFrame, key: str, text: str, claims: Mapping[str, str]) -> DataFrame:
    """Which stale phrases each text still holds: one pass, phrases are literals."""
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(phrase.lower())), F.lit(name)) for name, phrase in claims.items())))
    return texts.select(key, F.explode(hits).alias("claim"))


def restore_label(label: str, composite: str, pattern: str) -> Column:
    """The label, or where it was lost the part of a composite key that the pattern finds."""
    return F.coalesce(F.nullif(F.col(label), F.lit("")), F.nullif(F.regexp_extract(composite, pattern, 1), F.lit("")))
