"""The codec against the model's own encoder, and exact round trips."""

import os
import random

import pytest
from llm_fixtures import documents, odd_texts, prose

from cohortforge.llm import sentencepiece_codec as codec

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(codec.MODEL_FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_FILE)


def test_ids_are_those_of_the_models_encoder(spark, own):
    rng = random.Random(3)
    texts = [t for _, t in odd_texts()] + ["double  space", " lead", "trail ", "tab\tand\nline\n\nend", "1234567890", "http://a.b/c?d=e#f", "…—“quoted”", "👩‍👩‍👧 family", "aaaaaaaa bbbbbbbb", "ﬁ ligature"]
    texts += ["".join(rng.choice("ab c\n.é漢1") for _ in range(60)) for _ in range(60)]
    got = {r.doc_id: r for r in codec.encode(documents(spark, [(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == (own.encode(t) if t else []), repr(t[:80])
        assert got[i].n_tokens == len(got[i].ids)
        assert got[i].round_trip


def test_decode_gives_the_texts_back(spark):
    docs = documents(spark, odd_texts(), clashes=True)
    back = codec.decode(codec.encode(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in odd_texts())


def test_the_mark_itself_decodes_to_a_space(spark):
    (row,) = codec.encode(documents(spark, ["a▁b"])).collect()
    assert not row.round_trip


def test_null_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [10**6, None, -4])], "doc_id long, ids array<int>")
    assert [r.text for r in codec.decode(rows).orderBy("doc_id").collect()] == [None, "", ""]


def test_empty_table_and_null_id(spark):
    assert codec.encode(documents(spark, [])).collect() == []
    assert [r.doc_id for r in codec.encode(documents(spark, [(None, "a b")])).collect()] == [None]


def test_unigram_viterbi_against_all_ways_to_cut():
    """With a unigram vocabulary the trie walk takes the cut of the highest score."""
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca"]
    rng = random.Random(5)
    ids = {p: i for i, p in enumerate(pieces)}
    scores = {i: -rng.uniform(1, 6) for i in ids.values()}
    coder = codec.Codec(codec.Vocabulary(ids, scores, {}, len(pieces), merges=False))

    def best(text):
        if not text:
            return 0.0, []
        options = [(scores[ids[text[:k]]] + best(text[k:])[0], [ids[text[:k]]] + best(text[k:])[1]) for k in range(1, len(text) + 1) if text[:k] in ids]
        return max(options)

    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert coder.encode([word])[0] == best("▁" + word)[1]


def test_words_sorted_into_the_trie_share_prefixes(own):
    rng = random.Random(9)
    coder = codec.Codec(codec.Vocabulary.load())
    text = prose(rng, 400) + " " + " ".join(w + s for w in ("inter", "internal", "international") for s in ("", "ly", "ised", "ity"))
    assert coder.encode([text])[0] == own.encode(text)
    assert coder.encode([text])[0] == own.encode(text)  # from memory
