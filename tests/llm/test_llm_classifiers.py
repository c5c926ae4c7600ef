"""Language ID and quality classifier: held-out accuracy, what they may learn from, and odd rows."""

import os
import zlib

import numpy as np
import pytest
from llm_fixtures import DOCS, documents, odd_texts
from pyspark.sql import functions as F

from cohortforge.llm import language_id, quality
from cohortforge.llm.queries import op4_language_id, op7_quality_classifier
from cohortforge.llm.shared import fold

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@needs_data
def test_language_is_told_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z]")), F.lit(0)).alias("letters"))
    got = op4_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r.held_out and r.lang is not None and r.letters >= 60]
    assert sum(r.lang_pred == r.lang for r in judged) / len(judged) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en", None, 0) for i in range(20)] + [(100 + i, "der schnelle braune fuchs und der faule hund", "de", None, 0) for i in range(20)]
    rows += [(200, None, "en", None, 0), (201, "text without a language", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    asked = documents(spark, [None, "", "12 34 !!", "the fox and the dog", "der hund und der fuchs", "x" * 200_000, "é"], clashes=True)
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert (got[4].lang_pred, got[5].lang_pred) == ("en", "de")
    assert got[6].lang_pred in model.languages and got[7].lang_pred in model.languages
    assert got[7].ambiguous


def test_language_without_anything_to_learn(spark):
    docs = documents(spark, odd_texts()).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit(docs, F.lit(True))
    assert model is None
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), model).collect() == []
    one = language_id.fit(documents(spark, ["only english here"]), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(documents(spark, ["abc"]), one).collect()} == {"en"}


def test_codewords_tell_any_two_languages_apart():
    for n in (2, 4, 7, 12, 40):
        code = language_id.codewords(n)
        gaps = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def test_one_wrong_bit_is_corrected(spark):
    """With the margin of one bit flipped, the nearest codeword is still the right one."""
    rng = np.random.default_rng(2)
    words = {lang: ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)] for lang in "abcdef"}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang, None, 0) for i, lang in enumerate("abcdef" * 10)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    text = np.frombuffer(" ".join(rng.choice(words["d"], 20)).encode(), np.uint8)
    offs = np.array([0, len(text)])
    assert model.predict(text, offs)[0][0] == 3
    for bit in range(model.code.shape[1]):
        model.weights[:, bit] *= -1
        assert model.predict(text, offs)[0][0] == 3
        model.weights[:, bit] *= -1


def plain_language(rows, asked, most=60.0):
    """Fit and prediction by plain loops: language and score of each asked text, best first by loss."""

    def grams(text):
        raw = [32] + [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()] + [32]
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if not (a == b == 32 or b == c == 32):
                yield ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16

    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang, {})
        for g in grams(text):
            own[g] = own.get(g, 0) + 1
    names = sorted(counts)
    code = language_id.codewords(len(names))
    total = {n: sum(counts[n].values()) + 0.5 * language_id.BUCKETS for n in names}
    rate = lambda n, g: (counts[n].get(g, 0) + 0.5) / total[n]
    sides = [([n for n, c in zip(names, bit) if c > 0], [n for n, c in zip(names, bit) if c < 0]) for bit in code.T]
    mean = lambda side, g: sum(rate(n, g) for n in side) / len(side)
    power = []
    for up, down in sides:
        seen = {g for n in names for g in counts[n]}
        p, q = mean(up, -1), mean(down, -1)
        power.append(((language_id.BUCKETS - len(seen)) * (p - q) * np.log(p / q) + sum((mean(up, g) - mean(down, g)) * np.log(mean(up, g) / mean(down, g)) for g in seen)) / 2)
    out = []
    for text in asked:
        own = list(grams(text))
        margin = [sum(np.log(mean(up, g) / mean(down, g)) for g in own) * min(len(own), most) / max(len(own), 1) for up, down in sides]
        loss = [sum(w / sum(power) * np.log1p(np.exp(-m * c)) for w, m, c in zip(power, margin, row)) for row in code]
        share = [np.exp(min(loss) - x) for x in loss]
        out.append((names[int(np.argmin(loss))], max(share) / sum(share)))
    return out


@pytest.mark.parametrize("n", [3, 9])
def test_language_equals_plain_loops(spark, n):
    rng = np.random.default_rng(n)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghé"), 4)) for _ in range(25)] for k in range(n)}
    train = [(" ".join(rng.choice(words[lang], 12)), lang) for lang in sorted(words) for _ in range(4)]
    asked = [" ".join(rng.choice(words[f"l{k % n}"], 1 + 3 * k)) for k in range(14)] + ["A", "zz 12 zz"]
    model = language_id.fit(spark.createDataFrame([(i, t, lang, None, 0) for i, (t, lang) in enumerate(train)], DOCS), F.lit(True))
    got = language_id.identify(documents(spark, asked, clashes=True), model).orderBy("doc_id").collect()
    want = plain_language(train, asked)
    assert [r.lang_pred for r in got] == [lang for lang, _ in want]
    assert np.allclose([r.score for r in got], [s for _, s in want], atol=1e-5)


def test_many_languages(spark, monkeypatch):
    """More languages than a task holds, than fit seven bits, with rows without ids and repeated ones."""
    monkeypatch.setattr(language_id, "HELD_LANGUAGES", 5)
    rng = np.random.default_rng(1)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(120)}
    rows = [(None if i % 7 == 0 else i // 2, " ".join(rng.choice(words[lang], 10)), lang, None, 0) for i, lang in enumerate([*words, *words, *words])]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, F.lit(True))
    assert len(model.languages) == 120 and model.code.shape[1] >= 63
    got = language_id.identify(documents(spark, [(None if k % 3 else 5, " ".join(words[lang])) for k, lang in enumerate(words)]), model).collect()
    assert len(got) == 120 and len({r.lang_pred for r in got}) >= 118


@needs_data
def test_quality_orders_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op7_quality_classifier(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    y = {r.doc_id: r.quality for r in labels.where("quality in (0, 1)").collect()}
    judged = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    score, truth = np.array([s for s, _ in judged]), np.array([t for _, t in judged])
    assert auc(score, truth) > 0.8
    assert abs(score.mean() - truth.mean()) < 0.2  # calibrated


@needs_data
def test_quality_scores_depend_on_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = quality.fit(docs, labels, fold("doc_id", 5) != 0)
    swapped = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 10**9})
    one = {r.doc_id: r.score for r in quality.score_quality(docs, scorer).collect()}
    other = {r.doc_id - 10**9: r.score for r in quality.score_quality(swapped, scorer).collect()}
    assert one == other
    kept = {r.doc_id for r in quality.keep_good(docs, scorer).collect()}
    assert kept == {i for i, s in one.items() if s >= 0.3}


def plain_vectors(texts):
    """Context vectors of the words of all texts by plain loops: sums of the neighbours' index vectors, centred, of length one."""
    import re

    at, sign = quality.index_vectors()
    sums, bucket = {}, {}

    def words_of(text):
        return re.findall(r"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+", (text or "").encode().decode("latin-1"))

    for text in texts:
        words = words_of(text)
        for w in words:
            if w not in bucket:
                raw = np.frombuffer(w.encode("latin-1"), np.uint8)
                bucket[w] = int(quality.tokens(raw, np.array([0, len(raw)]))[0][0])
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if i != j:
                    v = sums.setdefault(bucket[w], np.zeros(quality.DIMS))
                    b = bucket[words[j]]
                    for k in range(quality.NONZERO):
                        v[at[b, k]] += sign[b, k]
    sums = {b: v for b, v in sums.items() if v.any()}
    raw = np.array([v / np.linalg.norm(v) for v in sums.values()])
    raw -= raw.mean(axis=0)
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    held = dict(zip(sums, raw, strict=True))
    return words_of, bucket, held


def test_quality_equals_plain_loops(spark):
    """Word vectors, pooled features and the network's output, each worked out by plain loops."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "12", "!!", "dé", "omega"], rng.integers(1, 30))) for _ in range(60)] + ["", None, "solo"]
    docs = documents(spark, [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(7, texts[7])], clashes=True)
    words_of, bucket, held = plain_vectors([*texts, texts[7]])
    vectors = quality.word_vectors(docs)
    assert set(np.flatnonzero(vectors.any(axis=1))) == set(held)
    assert all(np.allclose(vectors[b], v, atol=1e-5) for b, v in held.items())
    zero = np.zeros(quality.DIMS)
    want = np.zeros((len(texts), quality.FEATURES))
    for row, text in enumerate(texts):
        each = [held.get(bucket[w], zero) for w in words_of(text)]
        if each:
            want[row, : quality.DIMS] = np.mean(each, axis=0)
            want[row, quality.DIMS : -2] = np.std(each, axis=0)
            want[row, -2] = np.log1p(len(each)) / 8
            want[row, -1] = sum(float(((b - a) ** 2).sum()) for a, b in zip(each, each[1:])) / max(len(each) - 1, 1)
    assert np.allclose(quality.pooled(pa.array(texts), vectors), want, atol=1e-3)  # roots of differences of 32-bit sums
    labels = spark.createDataFrame([(i, int("alpha" in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    scorer = quality.fit(docs, labels, F.lit(True))
    net = scorer.network
    got = quality.score_quality(docs, scorer).collect()
    assert len(got) == len(texts) + 1 and sum(r.doc_id is None for r in got) == 1
    by = {r.doc_id: r.score for r in got}
    for row in [i for i in range(len(texts)) if i != 5]:
        hidden = [np.tanh(sum((want[row, f] - net.mean[f]) / net.scale[f] * net.weights[0][f, u] for f in range(quality.FEATURES)) + net.weights[1][u]) for u in range(len(net.weights[1]))]
        logit = (sum(h * w for h, w in zip(hidden, net.weights[2])) + net.weights[3][0]) / net.temperature
        assert abs(by[row] - 1 / (1 + np.exp(-logit))) < 1e-3


def test_network_gradient_is_that_of_the_loss():
    """One step from given weights goes where numerical differences of the loss say; separable rows are told apart."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] > 0).astype(float)
    net = quality.Network(x, y)
    assert auc(net.scores(x), y) > 0.95
    assert 0.1 < net.temperature < 8 and abs(net.scores(x).mean() - y.mean()) < 0.1


def test_quality_of_odd_tables(spark):
    kind = "doc_id long, quality int, toxic int, text string"
    docs = documents(spark, odd_texts(), clashes=True)
    none = spark.createDataFrame([(1, None, 0, "x"), (None, 1, 0, "x"), (2, 7, 0, "x"), (99, 1, 0, "x")], kind)
    assert {r.score for r in quality.score_quality(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x")], kind)
    assert {round(r.score, 6) for r in quality.score_quality(docs, quality.fit(docs, one, F.lit(True))).collect()} == {0.75}
    two = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (9, 1, 0, "x"), (4, 0, 0, "x"), (5, 0, 0, "x"), (14, 1, 0, "x")], kind)
    scorer = quality.fit(docs, two, F.lit(True))
    got = quality.score_quality(docs, scorer).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[4] == by[5] == by[6] and all(len(s) == 1 for s in by.values())
    assert quality.keep_good(docs, scorer).columns == docs.columns
    empty = documents(spark, [])
    assert quality.score_quality(empty, quality.fit(empty, two.limit(0), F.lit(True))).collect() == []
