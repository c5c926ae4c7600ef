"""Class bigrams: counts and base score against plain ones, the score against the model's own tables, and what it is worth."""

import math
import random
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose
from pyspark.sql import functions as F

from cohortforge.llm import lm_score
from cohortforge.llm.shared import fold

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain(rows):
    """n_tokens, n_known, train_tokens and base_score by (doc_id, text)."""
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
            c[" "] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        own = [*tokens(t), " "]
        out[i] = (len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in own))
    return out


def compare(got, want):
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_counts_and_base_score(spark, head):
    """Words that tasks hold and words that are joined give the same figures."""
    rows = odd_texts()
    got = lm_score.score(documents(spark, rows, clashes=True), fold("doc_id", 7) != 2, head_size=head).collect()
    assert len(got) == len(rows)
    compare(got, plain(rows))


def test_score_does_not_depend_on_the_head(spark):
    """However many words the tasks hold, all the rest included, the scores are the same."""
    rng = random.Random(8)
    rows = [*odd_texts(), *((i, prose(rng, rng.randrange(1, 90))) for i in range(100, 160))]
    docs = documents(spark, rows)
    get = lambda h: {(r.doc_id, r.n_tokens): r.score for r in lm_score.score(docs, fold("doc_id", 7) != 2, head_size=h, n_items=40, classes=8).collect()}
    one = get(1 << 18)
    assert len(one) >= len({i for i, _ in rows}) and all(s < 0 for s in one.values())
    for h in (0, 10, 60):
        other = get(h)
        assert set(one) == set(other) and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_score_from_the_models_tables(spark):
    """Each token: its class behind the class before it, then the word within its class; the words of a class make up one.

    Classes of all words, class bigrams and scores are worked out again by plain loops,
    from the classes of the items, with many words in tasks and few.
    """
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = docs.where(fold("doc_id", 7) != 2)
    counts = lm_score.word_counts(learned).cache()
    c = {r.word.encode(): r.c for r in counts.collect()}
    for size in (lm_score.HEAD, 600):
        items = lm_score.choose_items(counts, lm_score.ITEMS)
        pairs = lm_score.item_bigrams(learned, items)
        cls = lm_score.exchange_clusters(pairs, lm_score.CLASSES, lm_score.SWEEPS)
        k = int(cls.max()) + 1
        texts = {i: [*(x.encode() for x in tokens(t)), lm_score.END] for i, t in rows}
        train = [texts[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]

        def contexts(of, wanted):
            out = {}
            for words in train:
                for left, w, right in zip([lm_score.END, *words], words, words[1:]):
                    if w in wanted:
                        v = out.setdefault(w, np.zeros(2 * k))
                        v[of(right)] += 1
                        v[k + of(left)] += 1
            return out

        def gains(found, g):
            g = g + lm_score.ALPHA
            return {w: np.array([-np.inf] + [sum(x[j] * np.log(g[b, j]) + x[k + j] * np.log(g[j, b]) for j in np.flatnonzero(x[:k] + x[k:])) - 2 * c[w] * np.log(g[b].sum()) for b in range(1, k)]) for w, x in found.items()}

        def bigrams(of):
            g = np.zeros((k, k))
            for words in train:
                for a, b in zip([lm_score.END, *words], words):
                    g[of(a), of(b)] += 1
            return g

        start = {w: int(cls[items.item(w)]) for words in texts.values() for w in words}
        seed = np.zeros((k, k))
        np.add.at(seed, (cls[:, None], cls[None, :]), pairs)
        final = dict(start)
        for w, x in gains(contexts(start.__getitem__, set(c) - set(items.of)), seed).items():
            final[w] = int(x.round(9).argmax())
        trans = bigrams(final.__getitem__) + lm_score.ALPHA
        trans /= trans.sum(axis=1, keepdims=True)
        total = np.zeros(k)
        for w, times in c.items():
            total[final[w]] += times + 1
        mass = np.zeros(k)
        for w, times in c.items():
            mass[final[w]] += (times + 1) / (total[final[w]] + 1)
        assert np.allclose(mass[total > 0] + 1 / (total[total > 0] + 1), 1)
        got = {r.doc_id: r for r in lm_score.score(docs, fold("doc_id", 7) != 2, head_size=size).collect()}
        compare(got.values(), plain(rows))
        for i, words in texts.items():
            want = sum(math.log10(trans[final[a], final[b]]) + math.log10((c.get(b, 0) + 1) / (total[final[b]] + 1)) for a, b in zip([lm_score.END, *words], words))
            assert math.isclose(got[i].score, want, rel_tol=1e-6, abs_tol=1e-6), (size, i)
            assert math.isclose(got[i].perplexity, 10 ** (-got[i].score / got[i].n_tokens), rel_tol=1e-9)
        held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 7 == 2]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes are worth something on texts not learned from


def test_exchange_finds_planted_classes():
    """Words of two kinds that take turns end up in two classes."""
    rng = np.random.default_rng(4)
    m = 22
    pairs = np.zeros((m, m), dtype=np.int64)
    for _ in range(20_000):
        a, b = rng.integers(2, 12), rng.integers(12, m)
        pairs[a, b] += 1
        pairs[b, rng.integers(2, 12)] += 1
    cls = lm_score.exchange_clusters(pairs, 3, 10)
    assert len(set(cls[2:12])) == 1 and len(set(cls[12:])) == 1 and cls[2] != cls[12]


def test_odd_tables(spark):
    assert lm_score.score(documents(spark, []), F.lit(True)).collect() == []
    got = lm_score.score(documents(spark, [(1, "a b"), (None, "c")]), F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, 2, 0, 0), (1, 3, 0, 0)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    rows = [(1, "x y x"), (1, "x y x"), (1, "other text"), (2, None)]
    got = lm_score.score(documents(spark, rows), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 3), (1, 4), (1, 4), (2, 1)]


def test_texts_are_read_twice(spark):
    """Once to count the words and once to number them; all other steps, and the result, read the numbers."""
    rows = [(i, f"some words of text {i}") for i in range(30)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = documents(spark, rows).select("doc_id", "text")
    got = lm_score.score(docs.mapInArrow(seen, docs.schema), F.lit(True), n_items=8, classes=4).collect()
    assert len(got) == len(rows)
    assert read.value == 2 * len(rows)


def test_texts_that_go_over_batches(spark, monkeypatch):
    """Counts that are sent on early, short slices and batches of three rows change nothing."""
    rng = random.Random(5)
    rows = [*odd_texts(), *((i, prose(rng, rng.randrange(1, 90))) for i in range(100, 130))]
    docs = documents(spark, rows)
    docs = docs.union(docs.where("doc_id in (105, 106)"))

    def get():
        found = lm_score.score(docs, fold("doc_id", 7) != 2, head_size=30, n_items=40, classes=8).collect()
        return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=lambda r: (r[:4], r[5]))

    want = get()
    batches = lm_score.small_batches
    monkeypatch.setattr(lm_score, "small_batches", lambda spark, rows: batches(spark, 3))
    monkeypatch.setattr(lm_score, "_COUNTED", 7)
    monkeypatch.setattr(lm_score, "_TEXT", 50)
    monkeypatch.setattr(lm_score, "_NUMBERS", 20)
    monkeypatch.setattr(lm_score, "_PLACES", 30)
    got = get()
    assert len(got) == len(want) == len(rows) + 2
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)
