"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest
from llm_fixtures import least_reachable
from pyspark.sql import functions as F

from cohortforge.llm import embedding_dedup

KIND = "vec_id long, label int, embedding array<float>"


def plain(rows, threshold=0.98):
    good = [(i, la, np.array(v, dtype=np.float64)) for i, la, v in rows if la is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def cosine(a, b):
        return a @ b / math.sqrt((a @ a) * (b @ b))

    vectors = {i: (la, v) for i, la, v in good}
    links = {i: 0 for i, _, _ in rows}
    linked = set()
    for i, la, v in good:
        for j, lb, w in good:
            if i != j and la == lb and len(v) == len(w) and cosine(v, w) >= threshold:
                links[i] += 1
                linked.add((i, j))
    component = least_reachable(list(vectors), lambda a, b: (a, b) in linked)
    return {i: (links[i], component.get(i, i), component.get(i, i) == i) for i, _, _ in rows}


def clustered(seed, n, width=24):
    """Vectors around a few centres, at cosines on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), width))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(scale=rng.choice([0.02, 0.1, 0.14, 0.2]), size=width)
        out.append((i + 1, int(rng.integers(3)), [float(np.float32(x)) for x in v]))
    return out


@pytest.mark.parametrize("seed, centroids, words", [(1, 8192, 64), (2, 3, 4)])
def test_equals_all_pairs(spark, seed, centroids, words, monkeypatch):
    """The second way has few centroids, so lists are parted by codewords too."""
    monkeypatch.setattr(embedding_dedup, "CENTROIDS", centroids)
    monkeypatch.setattr(embedding_dedup, "CODEWORDS", words)
    monkeypatch.setattr(embedding_dedup, "PER_LIST", 40)  # several lists, and blocks of them, on few rows
    monkeypatch.setattr(embedding_dedup, "BASE_BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "QUERY_BLOCK", 32)
    rows = clustered(seed, 260)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == plain(rows)
    assert len(got) == len(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, 0, v), (2, 0, v), (3, 0, [2.0, 4.0, 6.0]), (4, 1, v), (5, None, v), (6, 0, None), (7, 0, []), (8, 0, [0.0, 0.0, 0.0]),
        (9, 0, [1.0, None, 3.0]), (10, 0, [1.0, float("nan"), 3.0]), (11, 0, [1.0, float("inf"), 3.0]), (12, 0, [1.0, 2.0]), (13, 0, [-1.0, -2.0, -3.0]), (14, 0, [1.0, 2.0]),
    ]
    frame = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("rep", "v", "lab", "list", "code", "kind", "mult")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == plain(rows)


def test_rows_without_an_id_and_repeated_rows(spark):
    v, near, far, other = [1.0, 2.0, 3.0], [1.0, 2.0, 3.05], [3.0, -1.0, 0.5], [-2.0, 0.1, 1.0]
    rows = [(4, 0, v), (4, 0, v), (None, 0, near), (None, 0, far), (None, 0, far), (7, 0, other), (None, None, v)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, KIND)).collect()), key=str)
    want = [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_tables_without_a_usable_vector(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, [1.0]), (2, 0, None)], KIND)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_large_group_of_copies_is_one_node(spark):
    rows = [(i, 0, [1.0, 0.5]) for i in range(1, 401)] + [(500, 0, [1.0, 0.55])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert got[500].n_links == 400 and got[7].n_links == 400 and got[500].component_id == 1
