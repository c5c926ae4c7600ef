"""The pipeline's stages, each against a plain version on its own input, and the registered queries."""

import os
import re

import pytest
from llm_fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_on_all_its_predecessor_kept(spark):
    from test_llm_decontamination import plain as leaks
    from test_llm_simhash import plain as groups
    from test_llm_suffix import plain as repeats

    from cohortforge.llm import quality, sentencepiece_codec
    from cohortforge.llm.shared import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [f for _, f in pipeline.STAGES]

    scorer = quality.fit(docs, labels, labels.doc_id.isNotNull())
    score = {r.doc_id: r.score for r in quality.score_quality(docs, scorer).collect()}
    good = materialise(stages[0](spark, docs, SF))
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {i for i, s in score.items() if s >= 0.3}

    single = materialise(stages[1](spark, good, SF))
    want = groups([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}

    stripped = materialise(stages[2](spark, single, SF))
    want = repeats([(r.doc_id, r.text) for r in single.collect()])
    assert stripped.columns == docs.columns
    assert {r.doc_id: r.text for r in stripped.collect()} == {i: w[4].decode("utf-8", "ignore") for i, w in want.items()}

    clean = materialise(stages[3](spark, stripped, SF))
    texts = [(r.doc_id, r.text) for r in stripped.collect()]
    gone = {d for d, *_ in leaks(texts, items)}
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - gone

    encoded = stages[4](spark, clean, SF).collect()
    assert {r.doc_id for r in encoded} == {i for i, _ in texts} - gone
    assert all(r.round_trip for r in encoded)
    assert sentencepiece_codec.decode(stages[4](spark, clean, SF)).count() == len(encoded)

    whole = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == sorted((r.doc_id, r.ids) for r in encoded)


def test_stages_on_odd_rows(spark):
    docs = documents(spark, odd_texts() + [(None, "a row without an id"), (None, None)])
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    empty = documents(spark, [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


@pytest.mark.parametrize("name", ["op3_embedding_near_dedup", "op8_suffix_array_dedup"])
def test_query_equals_sql(spark, name):
    from cohortforge.llm.queries import ORACLE_SQL, QUERIES

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).collect()) == sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_one_query_for_each_number():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_of_a_stage_that_fails_are_deleted(spark):
    from pyspark.errors import PySparkException

    from cohortforge.llm import shared

    before = list(shared._made)
    with shared.scratch(spark) as kept:
        kept.append(shared.materialise(spark.range(5)))
    with pytest.raises(PySparkException), shared.scratch(spark):
        gone = shared.materialise(spark.range(3))
        shared.materialise(spark.range(3).selectExpr("raise_error('no')"))
    assert not os.path.exists(gone._shared_path)
    assert kept[0].count() == 5
    shared.release(kept[0])
    assert shared._made == before
