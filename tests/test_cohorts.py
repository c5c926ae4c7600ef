"""Coded names, column-level decisions, covariate matrices, catalogs and calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions import status as T
from cohortforge.operators import cohorts as H
from cohortforge.sources import catalog as C


@pytest.mark.parametrize(
    ("name", "kind", "level"),
    [
        ("stage_Stage IIA", "stage", 2.0), ("x_stage iv", "stage", 4.0), ("stage_Stage X", "stage", None), ("path_T2", "t", 2.0), ("path_t1c_x", "t", 1.0), ("path_Tis", "t", 0.0), ("path_TX", "t", None), ("ajcc_N0 (i+)", "n", 0.0),
        ("ajcc_n3b", "n", 3.0), ("ajcc_M1", "m", 1.0), ("ajcc_MX", "m", None), ("tumor_grade_G3", "grade", 3.0), ("grade 2", "grade", 2.0), ("other", "t", None),
    ],
)
def test_levels_of_coded_names(name, kind, level):
    assert T.level_of(name, kind) == level


def test_normalise_name():
    assert T.normalise_name(" days to.death (min)") == "DAYS_TO_DEATH_MIN"


def test_whether_a_column_is_numeric_is_decided_for_the_whole_column(spark):
    df = spark.createDataFrame([("0.7",), ("yes",), ("0.2",), (None,)], "v string")
    assert [r.event for r in T.event_flag(df, "v").collect()] == [1, None, 0, None]
    text = spark.createDataFrame([("yes",), ("No",), ("maybe",), (None,)], "v string")
    assert [r.event for r in T.event_flag(text, "v").collect()] == [1, 0, None, None]
    assert [r.event for r in T.event_flag(text, "v", least_share=0.8).collect()] == [1, 0, 0, 0]
    mostly = spark.createDataFrame([("0.1",), ("2",), ("0",), ("3",), ("death",)], "v string")
    assert [r.event for r in T.event_flag(mostly, "v", least_share=0.8).collect()] == [1, 1, 0, 1, 0]
    assert T.event_flag(df.limit(0), "v").collect() == []


def test_baseline_matrix_drops_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "3", "1", None, "a"), (2, None, "1", None, "b"), (3, "5", "1", None, "c")], "id long, x string, one string, none string, text string")
    got = H.baseline_matrix(df, "id", ["x", "one", "none", "text"])
    assert got.columns == ["id", "W_x", "W_x_missing"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 3.0, 0), (2, None, 1), (3, 5.0, 0)]
    assert H.baseline_matrix(df.limit(0), "id", ["x"]).columns == ["id"]


def test_best_id_pair(spark):
    a = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", None)], "pid string, other string")
    b = spark.createDataFrame([("P1 ", "p9"), ("P2", "p1"), ("P3", "p8")], "k string, z string")
    assert H.best_id_pair(a, b, ["pid", "other"], ["k", "z"]) == ("pid", "k")
    assert H.best_id_pair(a, b, ["other"], ["k"]) is None


def test_cohort_flags_are_false_where_a_status_is_unknown(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 0, 0), (None, 1, 0), (0, 0, None), (1, 1, 1)], "er int, pr int, her2 int")
    assert [(r.hr_positive, r.triple_negative) for r in H.cohort_flags(df, "er", "pr", "her2").collect()] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0)]


def test_centring_states(spark):
    rows = [("few", 1.0)] * 3 + [("flat", 2.0)] * 10 + [("off", 5.0 + i % 2) for i in range(10)] + [("near", i % 2 - 0.5) for i in range(10)] + [("near", float("nan"))]
    got = {r.g: r.status for r in H.centring(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", F.lit(0.0), 5).collect()}
    assert got == {"few": "too_few", "flat": "unassessable", "off": "concern", "near": "acceptable"}


def test_halton(spark):
    rows = H.halton(spark.range(1, 9), "id").orderBy("id").collect()
    assert [r.u1 for r in rows] == [0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625]
    assert [round(r.u2 * 9) for r in rows[:8]] == [3, 6, 1, 4, 7, 2, 5, 8]


def test_calibrate_finds_bounded_parameters(spark):
    rows = spark.range(200).select((F.col("id") / 100.0).alias("x")).cache()

    def residuals(p):
        r = rows.agg(F.avg(F.exp(F.lit(float(p[0])) * F.col("x"))).alias("m"), F.avg(F.lit(float(p[1])) * F.col("x")).alias("s")).first()
        return np.array([r.m - goal[0], r.s - goal[1]])

    goal = (0.0, 0.0)
    goal = tuple(residuals(np.array([0.5, -1.0])))
    found, loss = H.calibrate(residuals, [[0.0, 0.0]], [-2, -2], [2, 2], steps=8)
    assert np.allclose(found, [0.5, -1.0], atol=1e-4) and loss < 1e-8
    found, _ = H.calibrate(lambda p: np.array([p[0] - 3.0]), [[0.0], [1.0]], [-1], [2])
    assert found[0] == 2.0


def test_catalog_and_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("id,time,event\n1,2,3\n")
    (tmp_path / "sub" / "b.tsv").write_text("# note\n\"id\"\tother\n1\t2\n")
    (tmp_path / "m.tsv").write_text("gene\tS1\tS2\tS3\nG1\t1\t2\t3\n")
    (tmp_path / "t.tsv").write_text("sample\tG1\nS1\t1\nS2\t2\nS3\t3\n")
    files = C.catalog(spark, str(tmp_path), "*.[ct]sv")
    assert files.count() == 4 and C.catalog(spark, str(tmp_path), "*.csv", most_bytes=3).count() == 0
    assert [p.rsplit("/", 1)[1] for p in C.find_by_columns(spark, files, ["id"])] == ["a.csv", "b.tsv"]
    assert [p.rsplit("/", 1)[1] for p in C.find_by_columns(spark, files, ["id"], ["event", "status"])] == ["a.csv"]
    ids = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "id string")
    assert C.orientation(spark, str(tmp_path / "m.tsv"), ids, "id") == "features_by_samples"
    assert C.orientation(spark, str(tmp_path / "t.tsv"), ids, "id") == "samples_by_features"
    assert C.orientation(spark, str(tmp_path / "a.csv"), ids, "id") == "unresolved"
    assert (C.sniff_delimiter("a;b;c,d"), C.sniff_delimiter("ab"), C.line_count(spark, str(tmp_path / "t.tsv"))) == (";", "\t", 4)
