"""IAMB: features that become needless only after another one is dropped."""

import numpy as np

from cohortforge.operators import models as D


def test_blanket_is_shrunk_until_no_feature_is_needless(spark):
    rng = np.random.default_rng(745)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 9)) + 0.7 * rng.normal(size=(40, 9))
    names = ["target", *(f"f{j}" for j in range(1, 9))]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    chosen = D.markov_blanket(frame, "target", names[1:])
    at = [names.index(c) for c in chosen]
    corr = np.corrcoef(x.T)
    assert chosen == ["f3", "f4", "f8"]  # one pass keeps f1
    assert all(D.partial_p(corr, 40, 0, j, [k for k in at if k != j]) < 0.05 for j in at)
