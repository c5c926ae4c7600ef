"""SimHash groups against all pairs, and the inverted index against them too."""

import random
import re

import pytest
import xxhash
from llm_fixtures import documents, least_reachable, odd_texts, prose

from cohortforge.llm import simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, bits=4):
    marks = {i: fingerprint(t) for i, t in rows}
    component = least_reachable(list(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= bits)
    return {i: (f"{marks[i]:016x}", component[i]) for i in marks}


def texts(seed=4):
    rng = random.Random(seed)
    out = odd_texts()
    for k in range(25):
        words = prose(rng, 200).split()
        for v in range(3):
            w = list(words)
            for _ in range(v):
                w[rng.randrange(len(w))] = "other"
            out.append((100 + 10 * k + v, ("  \t" if v else " ").join(w).upper() if v == 2 else " ".join(w)))
    return out


def test_equals_all_pairs(spark):
    rows = texts()
    got = simhash.near_duplicates(documents(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == plain(rows)


@pytest.mark.parametrize("block, key_bytes", [(4096, 3), (8, 3), (8, 4)])
def test_index_finds_every_link(spark, block, key_bytes):
    """Chains of fingerprints a few bits apart, in lists that are whole or dealt out in blocks."""
    rng = random.Random(block)
    marks = set()
    while len(marks) < 300:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            marks.add(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    at = {m: i for i, m in enumerate(signed)}
    edges = [(at[r.a], at[r.b]) for r in simhash.link_edges(spark.createDataFrame([(m,) for m in signed], "fp long"), 4, key_bytes, block).collect()]
    assert all((marks[a] ^ marks[b]).bit_count() <= 4 for a, b in edges)
    both = {*edges, *((b, a) for a, b in edges)}
    ids = list(range(len(marks)))
    assert least_reachable(ids, lambda a, b: (a, b) in both) == least_reachable(ids, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 4)


def test_position_sets_cover_all_shared_positions():
    from itertools import combinations

    for size in (3, 4):
        sets = simhash.position_sets(4, size)
        assert all(any(set(s) <= set(n) for s in sets) for n in combinations(range(8), 4))


def test_one_of_each_keeps_the_smallest_id(spark):
    rows = texts()
    want = plain(rows)
    docs = documents(spark, rows, clashes=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if want[i][1] == i)


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    kept = simhash.one_of_each(documents(spark, [(None, "a b c d"), (1, "a b c d"), (2, "a b c d")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_rows_without_an_id_link_and_name_no_group(spark):
    """Two near fingerprints, a third whose only holder has no id between or beside them, repeated rows, and one alone."""
    rng = random.Random(3)
    base = prose(rng, 300).split()
    near = list(base)
    near[7] = "changed"
    far = prose(rng, 300)
    rows = [(5, " ".join(base)), (5, " ".join(base)), (None, " ".join(near)), (None, far), (None, far), (8, "")]
    want = {t: fingerprint(t) for _, t in rows}
    assert (want[rows[0][1]] ^ want[rows[2][1]]).bit_count() <= 4
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows, clashes=True)).collect()), key=str)
    assert got == sorted(((i, f"{want[t]:016x}", {rows[0][1]: 5, rows[2][1]: 5, far: None, "": 8}[t]) for i, t in rows), key=str)


def test_a_fingerprint_of_most_rows(spark, monkeypatch):
    """Keys of a large share of the rows are joined by broadcast, the others by a shuffle, with the same rows."""
    from cohortforge.llm import shared

    rows = [(i, "") for i in range(1, 61)] + [(100 + i, prose(random.Random(i), 50)) for i in range(20)]
    monkeypatch.setattr(shared, "HOT_SHARE", 0.2)
    monkeypatch.setattr(shared, "max", lambda a, b: b, raising=False)  # without the floor of 10,000 rows
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == plain(rows)


def test_long_text_majority_is_exact():
    import numpy as np

    h = np.array([xxhash.xxh64_intdigest(str(i % 977).encode(), seed=42) for i in range(140_000)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.majority(h) == want
