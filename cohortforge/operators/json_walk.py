"""Every value of a JSON text with its path, at any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which manifests hold a path and a digest.
PATH_NAMES = ("path", "relative_path", "file", "file_path")
HASH_NAMES = ("sha256", "expected_sha256", "file_sha256")


def _values(value: Any, path: str, parent: str | None) -> Iterator[tuple[str, str | None, str, str | None]]:
    """path, path of the parent, kind and text of a value and of all inside it; texts of objects and arrays are null."""
    stack = [(value, path, parent)]
    while stack:
        v, at, above = stack.pop()
        if isinstance(v, dict):
            yield at, above, "object", None
            inside = [(x, f"{at}.{k}" if k.isidentifier() else f"{at}.{json.dumps(k, ensure_ascii=False)}", at) for k, x in v.items()]
        elif isinstance(v, list):
            yield at, above, "array", None
            inside = [(x, f"{at}[{i}]", at) for i, x in enumerate(v)]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
            yield at, above, kind, v if isinstance(v, str) else None if v is None else json.dumps(v)
            continue
        stack.extend(reversed(inside))


def json_walk(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, path, parent, kind and value of every value in a JSON column, in the order of the text; the root has place 0 and path ``$``.

    Strings have their escapes resolved; of a repeated name the last value stays.  A null has no rows, a text
    that is no JSON one row of kind ``invalid``.
    """
    kind = dict(df.dtypes)[key]
    names = [key, "place", "path", "parent", "kind", "value"]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("_j").to_pylist()):
                if text is None:
                    continue
                try:
                    found = list(_values(json.loads(text), "$", None))
                except (ValueError, RecursionError):
                    found = [("$", None, "invalid", text)]
                at += [i] * len(found)
                rows += [(k, *r) for k, r in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return df.select(key, F.col(column).cast("string").alias("_j")).mapInArrow(run, f"`{key}` {kind}, place int, path string, parent string, kind string, value string")


def manifest_entries(df: DataFrame, key: str, column: str, paths: Sequence[str] = PATH_NAMES, hashes: Sequence[str] = HASH_NAMES) -> DataFrame:
    """key, path and sha256 of every object at any depth that holds both, under any of the names, whatever their case.

    Of several names the first of the list counts; of entries with one path the first in the text.  Paths get forward slashes, digests lower case.
    """
    walked = json_walk(df, key, column).where("parent is not null")
    name = F.lower(F.regexp_extract("path", r'\.(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_][A-Za-z_0-9]*))$', 2))
    rank = lambda names: F.coalesce(*(F.when(name == n, F.lit(i)) for i, n in enumerate(names)))
    first = lambda names: F.min_by("value", F.when(F.col("value").isNotNull(), rank(names)))
    objects = walked.groupBy(key, "parent").agg(F.min("place").alias("_place"), first(paths).alias("path"), first(hashes).alias("sha256")).where("path is not null and sha256 is not null")
    held = objects.select(key, "_place", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.lower("sha256").alias("sha256"))
    return held.groupBy(key, "path").agg(F.min_by("sha256", "_place").alias("sha256"))


def verify_entries(entries: DataFrame, observed: DataFrame) -> DataFrame:
    """Each entry with whether its path is there and its digest is that of ``observed`` (path, sha256)."""
    seen = observed.select("path", F.lower("sha256").alias("observed_sha256"))
    return entries.join(seen, "path", "left").withColumns({"exists": F.col("observed_sha256").isNotNull(), "match": F.coalesce(F.col("observed_sha256") == F.col("sha256"), F.lit(False))})
