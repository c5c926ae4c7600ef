"""Centroid clustering against the same rounds over all pairs."""

import glob
import hashlib
import math
import os
import random

import numpy as np
import pytest

from cohortforge.llm import centroids
from cohortforge.llm.queries import op12_centroid_clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3):
    """The contract with loops over all pairs, in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)].append(v)
        centres = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else old for o, old in zip(own, centres, strict=True)]
    out = [(i, c := nearest(v), gap(v, centres[c])) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == n) for n in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in out), key=repr)


def vectors(n, seed=3):
    """Few directions, many copies, a hot copy for a third of the rows, ties, and what is left out."""
    rng = random.Random(seed)
    base = [[np.float32(rng.gauss(0, 0.2)).item() for _ in range(64)] for _ in range(12)]
    rows = [(i, list(base[0])) for i in range(n // 3)]
    rows += [(i, [np.float32(x + rng.gauss(0, 0.03)).item() for x in rng.choice(base)]) for i in range(n // 3, n)]
    rows += [(n, rows[5][1]), (n, rows[-1][1]), (None, base[3]), (None, base[4])]
    rows += [(n + 1, None), (n + 2, base[0][:-1]), (n + 3, [*base[0][:-1], None]), (n + 4, [*base[0][:-1], float("nan")]), (n + 5, [float("inf"), *base[0][1:]]), (n + 6, []), (n + 7, [*base[0], 0.0])]
    return rows


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("leaf,tree", [(1, 40), (7, 64), (32, 8192)])
def test_equals_all_pairs(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(centroids, "LEAF_ROWS", leaf)
    monkeypatch.setattr(centroids, "TREE_ROWS", tree)
    rows = vectors(400)
    assert found(centroids.clustered(frame(spark, rows).repartition(3))) == plain(rows)


def test_few_none_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert centroids.clustered(frame(spark, [])).collect() == []
    assert centroids.clustered(frame(spark, [(1, None), (2, [1.0])])).collect() == []
    assert centroids.clustered(frame(spark, [(None, [0.5] * 64)])).collect() == []
    three = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.011] * 64)]
    more = frame(spark, three).withColumns({c: F.lit("x") for c in ("id", "x", "cluster", "distance", "ids", "points", "total")})
    assert found(centroids.clustered(more)) == plain(three)


def test_large_components_are_exact_or_an_error(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-(1 << 19), 1 << 19)) for _ in range(64)]) for i in range(60)]
    assert found(centroids.clustered(frame(spark, rows))) == plain(rows)
    with pytest.raises(Exception, match="bound"):
        centroids.clustered(frame(spark, [(1, [1e9] * 64)]))


def test_whole_nodes_are_assigned():
    """On tight clusters far apart few vectors are looked at one by one, and results are those of all pairs."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-500, 500, (8, 64))
    points = (centre[rng.integers(0, 8, 4000)] + rng.integers(-2, 3, (4000, 64))).astype(np.int32)
    import pyarrow as pa

    tree = centroids.Tree.build(pa.array(range(4000)), points)
    label, counts, sums = tree.assign(centre.astype(np.int64))
    want = ((tree.points[:, None].astype(np.int64) - centre) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == want).all() and (counts == np.bincount(want, minlength=8)).all()
    assert all((sums[c] == tree.points[want == c].sum(axis=0)).all() for c in range(8))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/embeddings.parquet"):
        con.sql(f"create view embeddings as select * from read_parquet('{f}')")
    want = con.sql(centroids.ORACLE_SQL)
    assert want.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(op12_centroid_clustering(spark, sf)) == sorted(want.fetchall(), key=repr)
