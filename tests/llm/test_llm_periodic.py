"""Periodic runs against the definition, read word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose

from cohortforge.llm import periodic_runs as P


def smallest_period(w):
    """By the failure function of the stretch."""
    f = [0] * len(w)
    for i in range(1, len(w)):
        k = f[i - 1]
        while k and w[i] != w[k]:
            k = f[k - 1]
        f[i] = k + (w[i] == w[k])
    return len(w) - f[-1]


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and smallest_period(w[s:e]) == q:
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w):
    return [tuple(r) for r in P.find_runs(np.unique(np.array(w), return_inverse=True)[1] if len(w) else np.zeros(0, np.int64)).tolist()]


def sequences(seed, n=150):
    """Random words of small alphabets with planted repetitions, some inside others, some of one word."""
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        while len(w) < rng.choice([5, 30, 90, 300]):
            kind = rng.random()
            block = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 25]))]
            if kind < 0.4:
                w += block
            elif kind < 0.8:
                w += block * rng.randrange(2, 9) + block[: rng.randrange(len(block) + 1)]
            else:
                w += (block * 4 + [rng.randrange(40)]) * 4
        yield w


@pytest.mark.parametrize("base", [8, 16, 512])
@pytest.mark.parametrize("heavy", [None, "all", "none"])
def test_equals_the_definition(monkeypatch, base, heavy):
    monkeypatch.setattr(P, "BASE", base)
    if heavy:
        monkeypatch.setattr(P, "is_heavy", lambda c, n: np.full(len(c), heavy == "all") & (c > 0))
    for w in sequences(base):
        assert found(w) == plain_runs(w)


def test_lag_counts_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 5000):
        ids = np.minimum(rng.geometric(0.2, n), 30)
        top = max(1, n // 3)
        got = P.lag_counts(ids, top)
        assert got.tolist() == [0] + [int((ids[:-p] == ids[p:]).sum()) if p < n else 0 for p in range(1, top + 1)]


def test_long_texts_of_one_word_and_of_long_periods():
    assert found([0] * 200_000) == [(0, 200_000, 1)]
    rng = random.Random(4)
    block = [rng.randrange(3000) for _ in range(9000)]
    w = [rng.randrange(3000) for _ in range(20_000)] + block * 4 + [rng.randrange(3000) for _ in range(700)]
    start = next(20_000 - i for i in range(9000) if w[20_000 - i - 1] != w[29_000 - i - 1])
    assert [(s, p) for s, _, p in found(w)] == [(start, 9000)]


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_rows_of_the_contract(spark):
    rng = random.Random(7)
    texts = [(i, t if i != 9 else prose(rng, 900)) for i, t in odd_texts()]
    for i in range(100, 220):  # a tenth becomes periodic by its id
        base = prose(rng, rng.randrange(1, 160))
        texts.append((i, base if i % 3 else f"{base} {' '.join([prose(rng, rng.randrange(1, 9))] * rng.randrange(3, 30))}\n x {base}"))
    texts += [(None, " ".join(["no id"] * 40)), (100, texts[-1][1]), (100, texts[-1][1])]
    got = P.digests(P.periodic_runs(documents(spark, texts, clashes=True).repartition(3), P.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(i, t) for i, t in texts]
    assert any(w[1] > 1 for w in want)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_real_output_and_empty_table(spark):
    row = P.periodic_runs(documents(spark, ["start here " + "again and " * 20 + "end"])).first()
    assert row.n_words == 43 and [tuple(r) for r in row.runs] == [(2, 40, 2)] and row.collapsed == "start here again and end"
    assert P.digests(P.periodic_runs(documents(spark, []), P.planted)).collect() == []
