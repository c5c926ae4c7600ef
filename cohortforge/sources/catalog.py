"""What lies in a folder: files, their separators, columns and the way round of matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, length and modificationTime of all files below a folder whose name fits; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line that is no comment; empty if there is none."""
    row = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).first()
    return row["value"].lstrip("﻿") if row else ""


def sniff_delimiter(line: str) -> str:
    """Tab, comma or semicolon, whichever stands most often; tab if none does."""
    return max("\t,;", key=lambda c: line.count(c))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def find_by_columns(spark: SparkSession, files: DataFrame, required: Sequence[str], any_of: Sequence[str] = ()) -> list[str]:
    """Paths of a catalog whose header has all required columns and one of ``any_of``; one line is read of each file."""
    found = []
    for row in files.orderBy("path").select("path").toLocalIterator():
        line = first_line(spark, row["path"])
        names = {x.strip().strip('"') for x in line.split(sniff_delimiter(line))}
        if names.issuperset(required) and (not any_of or names & set(any_of)):
            found.append(row["path"])
    return found


def orientation(spark: SparkSession, path: str, ids: DataFrame, id_column: str, least: int = 3, share: float = 0.05) -> str:
    """features_by_samples if enough known ids stand in the header, samples_by_features if enough stand in the first column, else unresolved."""
    line = first_line(spark, path)
    mark = sniff_delimiter(line)
    names = [x.strip().strip('"') for x in line.split(mark)]
    known = ids.select(F.col(id_column).cast("string").alias("id")).distinct()
    header = spark.createDataFrame([(x,) for x in set(names)], "id string")
    n, in_header = known.count(), known.join(F.broadcast(header), "id").count()  # one header
    if in_header >= max(least, int(share * n)):
        return "features_by_samples"
    first = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.trim(F.replace(F.split_part("value", F.lit(mark), F.lit(1)), F.lit('"'), F.lit(""))).alias("id")).distinct()
    return "samples_by_features" if first.join(known, "id").count() >= least else "unresolved"
