"""Readers of delimited tables, matrices, gene sets and feature lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.functions.columns import MISSING, numeric
from cohortforge.functions.status import normalise_name


def read_table(spark: SparkSession, path: str, txt_separator: str = "\t", schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """A table by its suffix: csv, tsv, txt or parquet; any other suffix is an error.

    Delimited columns are strings unless a schema is given: types are stated, never
    guessed from the data.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        out = spark.read.parquet(path)
    elif suffix in ("csv", "tsv", "txt"):
        separator = {"csv": ",", "tsv": "\t", "txt": txt_separator}[suffix]
        reader = spark.read.option("header", True).option("sep", separator)
        out = (reader.schema(schema) if schema else reader).csv(path)
    else:
        raise ValueError(f"unknown table suffix: {path}")
    return out if limit is None else out.limit(limit)


def read_commented(spark: SparkSession, path: str, missing: Sequence[str] = MISSING) -> DataFrame:
    """A tab-separated text table with ``#`` comment lines; missing-value texts become null."""
    raw = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    return raw.select(*(F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*missing), F.col(f"`{c}`")).alias(c) for c in raw.columns))


def header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """Column names; no row is read beyond the first line."""
    return spark.read.option("header", True).option("sep", separator).csv(path).columns


def sample_matrix(df: DataFrame, sample: str, prefix: str) -> DataFrame:
    """A samples-by-features table in long form, features prefixed, values as floats."""
    features = [c for c in df.columns if c != sample]
    wide = df.select(sample, *(F.col(f"`{c}`").try_cast("float").alias(f"{prefix}__{c}") for c in features))
    return wide.unpivot([sample], [f"{prefix}__{c}" for c in features], "feature", "value")


def gene_matrix(df: DataFrame, gene: str, prefix: str, ignore: Sequence[str] = ()) -> DataFrame:
    """A genes-by-samples table in long form: the median of rows that share a symbol, turned round by grouping, never transposed."""
    samples = [c for c in df.columns if c != gene and c not in ignore]
    long = df.where(F.col(gene).isNotNull()).select(gene, *(numeric(F.col(f"`{c}`")).alias(c) for c in samples)).unpivot([gene], samples, "sample", "value")
    return long.groupBy("sample", F.concat_ws("__", F.lit(prefix), gene).alias("feature")).agg(F.expr("percentile(value, 0.5)").cast("float").alias("value"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """pathway and gene of a gene-set file: name, id, then genes, by tabs."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("pathway"), F.explode(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("gene"))
    return rows.select("pathway", F.trim("gene").alias("gene")).where("gene <> ''").distinct()


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a ``key: value`` file."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([^:#]+?)\s*:\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*([^:#]+?)\s*:\s*(.*?)\s*$", 2).alias("value"))
    return rows.where("key <> ''")


def feature_list(spark: SparkSession, path: str, headers: Sequence[str] = ("feature", "features", "gene", "genes")) -> DataFrame:
    """Distinct features of a list file in the order of their first place; white space, commas and semicolons separate."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"[\s,;]+")).alias("pos", "feature"))
    first = lines.where((F.col("feature") != "") & ~F.lower("feature").isin(*headers)).groupBy("feature").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos").select("feature", F.row_number().over(W.orderBy("pos")).alias("place"))  # a list of features: small


def resolve_column(names: Sequence[str], candidates: Sequence[str], tokens: Sequence[str] = ()) -> str | None:
    """The first candidate among the names, by exact then case-blind match; else the name with most tokens, the shortest of equals."""
    for c in candidates:
        if c in names:
            return c
    lower = {n.lower(): n for n in reversed(list(names))}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    scored = [(-sum(t.lower() in n.lower() for t in tokens), len(n), n) for n in names]
    best = min(scored, default=None)
    return best[2] if best and best[0] < 0 else None


def choose_column(names: Sequence[str], exact: Sequence[str], contains: Sequence[str] = (), excludes: Sequence[str] = ()) -> str | None:
    """The name of the highest score, the shortest and then the first by name among equals; null if none scores.

    Names are compared as ``normalise_name`` writes them.  A name scores 1,000 less its place among ``exact``, 40 for
    each token of ``contains`` that it holds, and 20 if it begins with any; one that holds a token of ``excludes`` is out.
    """
    tidy = lambda words: [w for w in map(normalise_name, words) if w]
    whole, parts, banned = [normalise_name(x) for x in exact], tidy(contains), tidy(excludes)
    ranked = []
    for name in names:
        n = normalise_name(name)
        score = (1000 - whole.index(n) if n in whole else 0) + 40 * sum(t in n for t in parts) + 20 * n.startswith(tuple(parts))
        if score and not any(t in n for t in banned):
            ranked.append((-score, len(name), name))
    return min(ranked)[2] if ranked else None


def id_column(df: DataFrame, candidates: Sequence[str], pattern: str, least: float = 0.5) -> str | None:
    """The id column: one of the candidates, else the text column whose share of matches is highest and reaches ``least``; one pass."""
    named = resolve_column(df.columns, candidates)
    if named:
        return named
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return None
    shares = df.agg(*(F.avg(F.col(f"`{c}`").rlike(pattern).cast("double")).alias(c) for c in text)).first().asDict()
    best = max(text, key=lambda c: (shares[c] or 0.0, -text.index(c)))
    return best if (shares[best] or 0.0) >= least else None
