"""Writers: Parquet by Spark's commit protocol, JSON without NaN, Markdown and LaTeX rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table: written beside it, then renamed.

    A job that fails leaves the old table as it was.  Between the two renames, which
    move names and no data, readers find no table for a moment; the old one is kept
    until the new one stands, and comes back if the second rename fails.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    home = at(path)
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    beside, old = (at(home.getParent(), f".{home.getName()}.{mark}.{what}") for what in ("new", "old"))
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(beside.toString())
        had = files.exists(home)
        if had and not files.rename(home, old):
            raise OSError(f"{path} could not be moved away")
        if not files.rename(beside, home):
            if had:
                files.rename(old, home)
            raise OSError(f"{path} could not be put in place")
        files.delete(old, True)
    finally:
        files.delete(beside, True)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV at the edge, for small results; ``mark``: a byte order mark before the header, for spreadsheets."""
    if mark and df.columns:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first).coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def split_private(df: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows as they are, for local use, and without identifying columns."""
    return df, df.drop(*ids)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN and infinities are null."""
    safe = [F.when(~F.isnan(f.name) & (F.abs(F.col(f"`{f.name}`")) < float("inf")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))


def _cell(f: T.StructField, digits: int) -> Column:
    c = F.col(f"`{f.name}`")
    text = F.format_string(f"%.{digits}f", c.cast("double")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit(""))


#: Characters that LaTeX reads as commands, and how they are written.
LATEX = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def tex(c: Column) -> Column:
    """Text safe in LaTeX; the braces that an escape brings along stay."""
    out = F.replace(c, F.lit("\\"), F.lit("\x01"))
    for mark, safe in LATEX[1:8]:
        out = F.replace(out, F.lit(mark), F.lit(safe))
    for mark, safe in (("\x01", LATEX[0][1]), *LATEX[8:]):
        out = F.replace(out, F.lit(mark), F.lit(safe))
    return out


def markdown_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    cells = [F.replace(_cell(f, digits), F.lit("|"), F.lit("\\|")) for f in df.schema.fields]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def latex_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    cells = [tex(_cell(f, digits)) for f in df.schema.fields]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def table_frame(df: DataFrame, digits: int = 3, kind: str = "markdown") -> tuple[str, str]:
    """What stands before and after the rows of a Markdown or LaTeX table: header line, rules, environment."""
    names = df.columns
    if kind == "markdown":
        return "| " + " | ".join(n.replace("|", "\\|") for n in names) + " |\n| " + " | ".join("---" for _ in names) + " |", ""
    head = " & ".join(n.replace("_", "\\_") for n in names)
    return "\\begin{tabular}{" + "l" * len(names) + "}\n\\toprule\n" + head + " \\\\\n\\midrule", "\\bottomrule\n\\end{tabular}"
