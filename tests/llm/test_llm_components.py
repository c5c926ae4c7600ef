"""Connected components of long paths, whatever the numbering of their nodes."""

import random

import numpy as np
import pytest

from cohortforge.llm import embedding_dedup
from cohortforge.llm.components import components


def numbered(order):
    if order == "random":
        ids = list(range(500))
        random.Random(1).shuffle(ids)
        return ids
    return [0, *range(499, 0, -1)]


@pytest.mark.parametrize("order", ["random", "falling"])
def test_long_path_settles(spark, order):
    ids = numbered(order)
    edges = [*zip(ids, ids[1:], strict=False), (1000, 1001), (1002, 1001), (1003, 1003), (None, 5)]
    got = components(spark, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(500), 0) | {1000: 1000, 1001: 1000, 1002: 1000}
    assert len(got) == 503


def test_forest_of_a_long_path():
    ids = np.array(numbered("random"))
    forest = embedding_dedup.Forest(ids)
    for part in np.array_split(np.arange(499), 7):
        forest.join(ids[part], ids[part + 1])
    nodes, least = forest.links()
    assert (nodes == np.arange(500)).all() and (least == 0).all()
