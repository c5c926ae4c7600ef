"""Packing: every id of every document in one piece, sequences without gaps, little padding."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose

from cohortforge.llm import packing, word_ids


def tokens(text, file=None):
    from tokenizers import Tokenizer

    if file not in tokens.held:
        tokens.held[file] = Tokenizer.from_file(file or packing.default_tokenizer())
    return tokens.held[file].encode(text or "", add_special_tokens=False).ids


tokens.held = {}

HARD = [
    "Don't STOP, we'll; they'RE 'tis 'd ''s don'ts x'", "ÀÉÎ straße ŸÿÖ µm ª º ² ½ 3²4 1/2 10,000", "“curly” — dash… œuvre €5 Ünï İstanbul ΣΑΣ",
    "é ä combininǵ ́start", "a\xa0b\x85c\x1cd\x1fe f", "漢字 かな текст عربى", "<|endoftext|> a<|startoftext|>b <|END|> x<|endoftext|>",
    "a\t\tb\n\n c\x0b\x0cd", "", " \n ", "x" * 3000, "!?" * 500, "😀👍🏽 ok", "\x00\x01 nul", "ﬁ ligature Ǆ ǆ ß ẞ",
]


def test_ids_are_those_of_the_library(monkeypatch):
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        words = word_ids.WordIds(f.read())
    assert words.by_words
    rng = random.Random(3)
    texts = [*HARD, *(t for _, t in odd_texts()), *("".join(rng.choice([*"abcDE'.,! 12é\xa0ß²\x85—œ\n", "'ll", " the "]) for _ in range(60)) for _ in range(300))]
    want = [tokens(t) for t in texts]
    assert [i.tolist() for i in words.encode(texts)] == want
    assert [i.tolist() for i in words.encode(texts[::-1])] == want[::-1]
    monkeypatch.setattr(word_ids, "REMEMBER", 40)  # forgets between the calls
    for t, w in zip(texts, want, strict=True):
        assert words.encode([t])[0].tolist() == w
    assert len(words.index) < 2000


def test_other_definitions_go_to_the_library_whole():
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        words = word_ids.WordIds(f.read())
    assert not words.by_words
    assert [i.tolist() for i in words.encode(HARD)] == [tokens(t, file) for t in HARD]


def held_to_contract(pieces, texts, size):
    """Pieces against the documents; returns the lengths of the sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        whole = [*tokens(text), 2]
        times = sum(j == i for j, _ in texts)
        assert all(p.doc_tokens == len(whole) for p in by_doc[i])
        count = np.zeros(len(whole), int)
        for p in by_doc[i]:
            part = np.array(whole[p.start : p.start + p.length], "<u4")
            assert p.length == len(part) > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32
            count[p.start : p.start + p.length] += 1
        assert (count == times).all()
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return [sum(p.length for p in s) for s in by_sequence.values()]


def padding(lengths, size):
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths)


@pytest.mark.parametrize("size,windows,slack,merge,parts", [(4096, 64, 16, 16, 3), (64, 4, 4, 2, 9), (64, 1, 0, 2, 5)])
def test_contract(spark, monkeypatch, size, windows, slack, merge, parts):
    monkeypatch.setattr(packing, "MERGE", merge)
    rng = random.Random(5)
    texts = [*odd_texts(), *enumerate(HARD, 50), *((i, prose(rng, rng.randrange(1, 60))) for i in range(100, 300)), (None, "no id")]
    packed = packing.pack(documents(spark, texts, clashes=True).repartition(parts), size=size, open_windows=windows, slack=slack).cache()
    lengths = held_to_contract(packing.digests(packed).collect(), texts, size)
    assert padding(lengths, size) <= slack * len(lengths)
    short = [n for n in lengths if n < size - slack]
    assert len(short) == len(set(short)) and all(n & (n - 1) == 0 for n in short)  # the last ones only
    rows = packing.sequences(packed, size, 7).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(lengths) and sum(r.n_padding for r in rows) == padding(lengths, size)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens + r.n_padding and (ids[r.n_tokens :] == 7).all()
    packed.unpersist()


def test_empty_table(spark):
    packed = packing.pack(documents(spark, []))
    assert packing.digests(packed).collect() == [] and packing.sequences(packed).collect() == []


def test_best_fit_keeps_documents_whole():
    rng = random.Random(2)
    packer = packing.Packer(0, 1000, 32, 16)
    n = 3000
    for i in range(n):
        packer.add((i, 0, bytes(4 * rng.randrange(1, 400)), 0))
    packer.finish()
    assert len(packer.rows) < 1.15 * n
    assert json.dumps(sorted({r[4] for r in packer.rows})) == json.dumps(list(range(packer.next_id)))
