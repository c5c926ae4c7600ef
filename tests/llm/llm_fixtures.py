"""Small tables and plain versions that the tests of the text operators share."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Names that operators use inside; a table may hold them too.
CLASHES = ["word", "fp", "rep", "mark", "rest", "gram", "h", "key", "_gone", "score", "node", "component", "component_id", "list", "label", "n", "c"]

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "lu", "mi", "ster", "ven") for b in ("ra", "to", "ni", "shu") for c in ("", "n", "de", "lak")]


def documents(spark, texts, clashes=False):
    """A documents table of (doc_id, text) pairs, or texts numbered from 1."""
    pairs = [t if isinstance(t, tuple) else (i + 1, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in pairs]
    out = spark.createDataFrame(rows, DOCS)
    if clashes:
        from pyspark.sql import functions as F

        out = out.withColumns({c: F.lit("x") for c in CLASHES})
    return out


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts(seed: int = 1):
    """Null, empty, blank, repeated, near-equal, non-ASCII, very long and one-word texts, with tied and repeated ids."""
    rng = random.Random(seed)
    base = prose(rng, 220)
    near = base.split()
    near[100] = "changed"
    long = prose(rng, 30_000)
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "word"),
        (8, "Ünïcode 漢字 текст " + base[:300]),
        (9, long),
        (9, long),
        (10, "a" * 5000),
        (11, base[:150] + " " + prose(rng, 60) + " " + base[:150]),
        (12, prose(rng, 3)),
        (13, "é" * 140 + base[50:260]),
        (14, prose(rng, 80)),
    ]


def least_reachable(ids, linked):
    """Smallest id reachable from each by a depth-first search over all pairs."""
    out = {}
    for start in sorted(set(ids)):
        if start in out:
            continue
        stack = [start]
        out[start] = start
        while stack:
            a = stack.pop()
            for b in ids:
                if b not in out and linked(a, b):
                    out[b] = start
                    stack.append(b)
    return out
