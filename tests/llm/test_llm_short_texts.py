"""Language ID of texts of one or two letters."""

import numpy as np
from llm_fixtures import documents
from pyspark.sql import functions as F

from cohortforge.llm import language_id
from cohortforge.llm.arrowtext import utf8


def test_texts_of_one_or_two_letters_are_told_by_their_letters(spark):
    rows = [(i, "a no to we") for i in range(20)] + [(100 + i, "i da du zu") for i in range(20)]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 100, "en").otherwise("de"))
    model = language_id.fit(docs, F.lit(True))
    asked = ["a", "no", "i", "du", "A", "Zu"]
    got = {r.doc_id: r for r in language_id.identify(documents(spark, asked), model).collect()}
    assert [got[k + 1].lang_pred for k in range(6)] == ["en", "en", "de", "de", "en", "de"]
    assert not any(r.ambiguous for r in got.values())


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    texts = ["a", None, "no", "", " x  yz ", "é", "12"]
    gram, share, row = language_id.ngrams(*utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        alone = language_id.ngrams(*utf8(pa.array([t])))[0]
        assert np.array_equal(gram[share[k] : share[k + 1]], alone) and (row[share[k] : share[k + 1]] == k).all()
    assert np.diff(share).tolist() == [1, 0, 2, 0, 3, 2, 0]
