"""Suffix-array dedup against a dictionary of all strings of 100 bytes; the suffix sort against sorted slices."""

import hashlib
import os
import random

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose

from cohortforge.llm import suffix_dedup
from cohortforge.llm.suffix_sort import adjacent_prefixes, smaller_than_next, suffix_array, words

SF = "/root/testdata/sf0.001"


def plain(rows, length=100):
    """Results by doc_id, from texts of different ids (a repeated row is one document)."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = True
            else:
                seen.add(part)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def compare(spark, rows, partitions=3):
    got = suffix_dedup.remove_repeats(documents(spark, rows, clashes=True).repartition(partitions)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4], r.doc_id


def test_odd_texts(spark):
    compare(spark, odd_texts())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_at_all_rims(spark, seed):
    """Passages of 80 to 400 bytes that repeat in other surroundings, cut short, and next to one another."""
    rng = random.Random(seed)
    passages = [prose(rng, 120)[: rng.choice([80, 99, 100, 101, 130, 131, 132, 168, 200, 400])] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a, b = sorted(rng.choice([0, 0, 1, 7, len(p) - 1, len(p), len(p)]) for _ in range(2))
            parts += [p if rng.random() < 0.6 else p[a:b], "".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 1, 30])))]
        rows.append((i, "".join(parts)))
    compare(spark, rows)


def test_periods_and_runs(spark):
    rows = [(1, "ab" * 300), (2, "ba" * 150), (3, "a" * 99), (4, "a" * 100), (5, "a" * 260), (6, "xyz" * 40 + "a" * 120 + "xyz" * 50), (7, "é" * 49), (8, "é" * 51), (9, "é" * 80)]
    compare(spark, rows)


def test_common_passage_in_many_documents(spark, monkeypatch):
    """Grams that stand in many different stretches are posted window by window."""
    monkeypatch.setattr(suffix_dedup, "CROWDED_IN_TASK", 4)
    rng = random.Random(7)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, 20)[: rng.randint(1, 90)] + passage[: rng.randint(100, len(passage))] + prose(rng, 15)) for i in range(1500)]
    texts = documents(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) & 8388607 as mark")
    assert len(suffix_dedup.crowded_grams(texts)) > 0
    compare(spark, rows)


def test_repeated_rows_ids_and_nulls(spark):
    text = prose(random.Random(2), 60)
    got = suffix_dedup.remove_repeats(documents(spark, [(1, text), (1, text), (None, text), (2, text), (3, None)])).collect()
    removed = sorted((r.doc_id or 0, r.n_removed) for r in got)
    assert removed == [(0, 0), (1, 0), (1, 0), (2, len(text)), (3, 0)]
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []


def test_strip_repeats_leaves_the_rest_as_text(spark):
    rows = [(i, t) for i, t in odd_texts() if i != 9]
    docs = documents(spark, rows, clashes=True)
    got = suffix_dedup.strip_repeats(docs)
    assert got.columns == docs.columns
    want = plain(rows)
    for r in got.collect():
        assert r.text == want[r.doc_id][4].decode("utf-8", "ignore")
        assert r.n_chars == len(r.text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: w[:4] for i, w in want.items()}


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_two_stage_sort(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 3, 50, 400):
        data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(n)), np.uint8)
        raw, depth = data.tobytes(), 108
        order = suffix_array(data, depth)
        assert sorted(order.tolist()) == list(range(n))
        keys = [(raw[i:] + b"\0" * depth)[:depth] for i in order]
        assert keys == sorted(keys)
        assert smaller_than_next(data).tolist() == [raw[i:] < raw[i + 1 :] for i in range(n)]
        common = adjacent_prefixes(words(data, depth), order, 100) == 100
        assert common.tolist() == [k > 0 and keys[k][:100] == keys[k - 1][:100] for k in range(n)]
