"""ZIP members, first lines, digests, JSON values, and tails of distributions against plain versions."""

import hashlib
import json
import math
import zipfile

import pytest

from cohortforge.functions import columns as C
from cohortforge.operators import json_walk as J
from cohortforge.sources import files as S


def test_zip_members_and_gene_sets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("sets/Reactome.GMT", "﻿P1\tid\tabl1\tBRCA2\t\nshort\tid\nP2\tid\tTP53\tREACTOME\n")
        z.writestr("notes.txt", "one\r\ntwo\n")
        z.writestr("empty/", "")
    got = sorted((r.member, r.length) for r in S.zip_members(spark, str(tmp_path)).collect())
    assert [m for m, _ in got] == ["notes.txt", "sets/Reactome.GMT"] and got[0][1] == 9
    lines = S.zip_lines(spark, f"{tmp_path}/a.zip", "*.txt").orderBy("place").collect()
    assert [(r.place, r.value) for r in lines] == [(0, "one"), (1, "two")]
    sets = S.gene_sets(S.zip_lines(spark, f"{tmp_path}/a.zip", "*.gmt"), skip=["REACTOME"])
    assert sorted(map(tuple, sets.collect())) == [("P1", "ABL1"), ("P1", "BRCA2"), ("P2", "TP53")]


def test_headers_of_a_thousand_files_in_one_job(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"f{i:04d}.csv").write_text(("﻿# comment\n\n" if i % 2 else "") + ("id;treated;x\n1;0;2\n" if i % 3 else '"id","Event"\n1,2\n'))
    spark.sparkContext.setJobGroup("headers", "headers")
    found = S.ranked_files(S.headers(S.first_lines(spark, str(tmp_path))), ["id", "treated"], ["treat"], ["f0001"]).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 4  # stages of one adaptive query, not a job a file
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 1000 and found[0].path.endswith("f0001.csv") and found[0].score == 126
    assert {r.n_required for r in found if int(r.path[-8:-4]) % 3 == 0} == {1}


def test_digests_of_small_and_very_large_files(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    with open(tmp_path / "large", "wb") as f:  # sparse: over 2 GB
        f.write(b"head")
        f.seek((2 << 30) + 100)
        f.write(b"tail")
    whole = {r.path.rsplit("/", 1)[1]: r.sha256 for r in S.large_file_digests(spark, str(tmp_path)).collect()}
    for name in ("small", "large"):
        with open(tmp_path / name, "rb") as f:
            assert whole[name] == hashlib.file_digest(f, "sha256").hexdigest()
    ends = {r.path.rsplit("/", 1)[1]: r.sha256 for r in S.fingerprints(spark, str(tmp_path), block=1000).collect()}
    assert ends["small"] == hashlib.sha256(b"3abc").hexdigest()
    assert ends["large"] == hashlib.sha256(str((2 << 30) + 104).encode() + b"head" + bytes(996) + bytes(996) + b"tail").hexdigest()


TEXTS = ['{"k":", yes","b":"x"}', '{"a":["p, q",{"b":"\\u00e9\\n\\"]"}], "c" : 1}', '"alone"', '["\\ud83d\\ude00", ":", "a\\\\", {"x:": "y:"}]', "{}", "12", '{"k": ""}']


def strings(v):
    if isinstance(v, str):
        return [v]
    return [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in strings(x)]


def test_json_strings_and_walk(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (90, None), (91, "{not")], "id int, t string")
    got = {r.id: r.s for r in df.select("id", C.json_strings("t").alias("s")).collect()}
    walked = J.json_walk(df, "id", "t").orderBy("id", "place").collect()
    for i, t in enumerate(TEXTS):
        assert got[i] == strings(json.loads(t))
        assert [r.value for r in walked if r.id == i and r.kind == "string"] == strings(json.loads(t))
    assert [(r.path, r.kind, r.value) for r in walked if r.id == 1] == [("$", "object", None), ("$.a", "array", None), ("$.a[0]", "string", "p, q"), ("$.a[1]", "object", None), ("$.a[1].b", "string", 'é\n"]'), ("$.c", "number", "1")]
    assert [(r.id, r.kind) for r in walked if r.id >= 90] == [(91, "invalid")]


def test_manifest_entries(spark):
    text = json.dumps({"files": [{"Path": "a\\b.csv", "SHA256": "AB"}, {"in": {"file": "c", "file_sha256": "d", "path": "e"}}], "path": "only", "x": [{"relative_path": "e", "sha256": "later"}]})
    df = spark.createDataFrame([(1, text)], "id int, t string")
    entries = J.manifest_entries(df, "id", "t")
    assert sorted((r.path, r.sha256) for r in entries.collect()) == [("a/b.csv", "ab"), ("e", "d")]
    seen = spark.createDataFrame([("e", "D")], "path string, sha256 string")
    assert {r.path: (r.exists, r.match) for r in J.verify_entries(entries, seen).collect()} == {"a/b.csv": (False, False), "e": (True, True)}


def choose(n, k):
    return math.comb(n, k) if 0 <= k <= n else 0


def test_tails_without_long_arrays(spark):
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 2, 3, 15), (1, 0, 0, 1), (7, 7, 7, 7), (0, 0, 3, 4), (40, 60, 55, 45), (2, 30, 1, 90), (12, 0, 0, 300), (500, 400, 450, 480)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    got = [r.p for r in df.select(C.fisher_exact("a", "b", "c", "d").alias("p")).collect()]
    tail = [r.p for r in df.selectExpr("a", "a + b + c + d as n", "a + c as m", "a + b as k").select(C.hypergeometric_tail("a", "n", "m", "k").alias("p")).collect()]
    for (a, b, c, d), p, q in zip(tables, got, tail, strict=True):
        n, row, column = a + b + c + d, a + b, a + c
        w = [choose(row, i) * choose(n - row, column - i) for i in range(column + 1)]
        total = choose(n, column)
        assert q == pytest.approx(sum(w[a:]) / total, rel=1e-8)
        if row:
            assert p == pytest.approx(sum(x for x in w if x * 10**7 <= w[a] * (10**7 + 1)) / total, rel=1e-8)
    large = spark.createDataFrame([(30_010_000, 69_990_000, 29_990_000, 70_010_000)], "a int, b int, c int, d int").select(C.fisher_exact("a", "b", "c", "d").alias("p")).first().p
    z = (30_010_000 - 0.5 - 30_000_000) / math.sqrt(1e8 * 0.3 * 0.7 / 2)
    assert large == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_t_tail_against_closed_forms_and_published_quantiles(spark):
    # Two-sided 5 % quantiles of Student's t, and one of the normal distribution.
    published = [(1, 12.706204736432095), (2, 4.302652729696142), (5, 2.570581835636314), (10, 2.2281388519649385), (30, 2.0422724563012373), (100, 1.9839715184496334)]
    rows = [(t, float(n)) for n, t in published] + [(0.0, 4.0), (-3.0, 1.0), (1.5, 2.0), (25.0, 2.0), (2.0, 4.0), (40.0, 200.0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, n double").select(C.t_two_sided("t", "n").alias("p")).collect()]
    assert got[:6] == pytest.approx([0.05] * 6, abs=1e-9)
    four = lambda t: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t))
    two = lambda t: 1 - t / math.sqrt(2 + t * t)
    assert got[6:11] == pytest.approx([1.0, 1 - 2 * math.atan(3) / math.pi, two(1.5), two(25.0), four(2.0)], rel=1e-9)
    assert 0 <= got[11] < 1e-90
    from cohortforge.operators.models import _log_beta_tail

    p = spark.createDataFrame([(0.3, 50), (1.0, 9), (0.2, 2)], "r double, n int").select(C.correlation_p("r", "n").alias("p")).collect()
    assert p[0].p == pytest.approx(_log_beta_tail(0.3 * math.sqrt(48 / 0.91), 48), rel=1e-9) and p[1].p == 0 and p[2].p is None
