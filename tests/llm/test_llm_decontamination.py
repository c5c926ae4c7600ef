"""Containment search against sets of shingles."""

import os
import random
import re

import pytest
from llm_fixtures import documents, odd_texts, prose
from pyspark.sql import functions as F

from cohortforge.llm import decontaminate

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs, items, threshold=0.8):
    out = set()
    for i, t in docs:
        own = shingles(t)
        for j, u in items:
            want = shingles(u)
            n = len(own & want)
            if want and n >= threshold * len(want) - 1e-9:
                out.add((i, j, len(want), n))
    return out


def planted(seed=8):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.choice([1, 3, 5, 6, 9, 25, 60, 300]))) for k in range(40)] + [(50, None), (51, ""), (52, "!? ..."), (None, "lost item of some words here")]
    docs = odd_texts()
    for k, text in items:
        if text and k is not None:
            words = text.split()
            docs.append((1000 + k, prose(rng, 400) + "\n" + ", ".join(words).upper() + "! " + prose(rng, 400)))
            for share in (0.95, 0.85, 0.5):
                docs.append((2000 + 100 * k + int(100 * share), prose(rng, 50) + " " + " ".join(words[: max(1, int(len(words) * share))]) + " " + prose(rng, 50)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [16 << 20, 1500])
def test_equals_sets_of_shingles(spark, block_bytes):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontaminate.contaminated(documents(spark, docs, clashes=True), bench, block_bytes=block_bytes).collect()
    want = plain(docs, [i for i in items if i[0] is not None])
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want
    assert {d for d, *_ in want} >= {1000 + k for k, t in items if t and k is not None and len(t.split()) >= 5}


def test_no_document_that_holds_an_item_is_missed_by_the_sketches():
    """Any 0.8 of an item's shingles, whichever are missing, make its document a candidate; the sketch of a class is part of the hashes."""
    import numpy as np
    import pyarrow as pa

    from cohortforge.llm.arrowtext import utf8

    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([5, 7, 14, 30, 60, 200, 500] * 4)]
    index = decontaminate.ItemIndex(items, 5, 0.8)
    assert all(1 <= index.shared[k] <= index.need[k] for k, _ in items)
    sketched = sum(len(keys) for _, keys, _ in index.classes)
    assert sketched < 0.8 * index.count.sum()
    for k, text in items:
        words = text.split()
        for _ in range(6):
            cut = rng.sample(range(len(words)), max(0, len(words) // 30))
            doc = " ".join("gone" if i in cut else w for i, w in enumerate(words))
            want = len(shingles(doc) & shingles(text)) >= 0.8 * len(shingles(text)) - 1e-9
            hits = index.search(*utf8(pa.array([prose(rng, 300) + " " + doc])))
            assert (k in {item for _, item, _ in hits}) == want
    assert np.all(index.shared > 0)


def test_rows_without_an_id_and_repeated_rows(spark):
    item = "one two three four five six seven eight"
    docs = documents(spark, [(None, "so: " + item), (3, item), (3, item), (4, None), (None, None)], clashes=True)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in got) == [("3", 1, 4, 4), ("3", 1, 4, 4), ("None", 1, 4, 4)]
    assert sorted(str(r.doc_id) for r in decontaminate.clean_documents(docs, bench).collect()) == ["4", "None"]


def test_clean_documents_are_the_rest(spark):
    docs, items = planted(9)
    frame = documents(spark, docs, clashes=True)
    kept = decontaminate.clean_documents(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=1500)
    gone = {d for d, *_ in plain(docs, [i for i in items if i[0] is not None])}
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in gone)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, odd_texts())
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.clean_documents(docs, none).count() == len(odd_texts())
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark, []), some).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_equals_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    want = sorted(duckdb.sql(decontaminate.ORACLE_SQL).fetchall())
    got = decontaminate.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert sorted(tuple(r) for r in got) == want
