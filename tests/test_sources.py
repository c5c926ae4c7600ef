"""Readers, writers and streaming additions."""

import pytest
from pyspark.sql import functions as F

from cohortforge.sources import readers, sinks
from cohortforge.streaming import windows


def test_read_table_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,\n")
    (tmp_path / "b.txt").write_text("id\tv\n1\tx,y\n")
    assert readers.read_table(spark, str(tmp_path / "a.csv")).collect()[1].v is None
    assert readers.read_table(spark, str(tmp_path / "b.txt")).first().v == "x,y"
    assert readers.read_table(spark, str(tmp_path / "b.txt"), txt_separator=",").columns == ["id\tv"]
    assert readers.header(spark, str(tmp_path / "a.csv")) == ["id", "v"]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")


def test_commented_table_and_lists(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("#note\nPATIENT\tAGE\nP1\tNA\nP2\t50\nP3\t[Not Available]\n")
    assert [r.AGE for r in readers.read_commented(spark, str(tmp_path / "c.tsv")).collect()] == [None, "50", None]
    (tmp_path / "f.txt").write_text("gene\nB; A,B\nC A\n")
    assert [r.feature for r in readers.feature_list(spark, str(tmp_path / "f.txt")).orderBy("place").collect()] == ["B", "A", "C"]
    (tmp_path / "s.gmt").write_text("P1\tid\tA\tB\tB\nP2\tid\tC\n\n")
    assert sorted(map(tuple, readers.read_gmt(spark, str(tmp_path / "s.gmt")).collect())) == [("P1", "A"), ("P1", "B"), ("P2", "C")]
    (tmp_path / "p.txt").write_text("stable_id: panel \n# x\ngene_list: A B\n")
    assert {r.key: r.value for r in readers.read_panel(spark, str(tmp_path / "p.txt")).collect()} == {"stable_id": "panel", "gene_list": "A B"}


def test_matrices(spark):
    g = spark.createDataFrame([("A", "1", "4"), ("A", "3", "x"), ("B", "5", "6")], "gene string, s1 string, s2 string")
    got = {(r.sample, r.feature): r.value for r in readers.gene_matrix(g, "gene", "RNA").collect()}
    assert got == {("s1", "RNA__A"): 2.0, ("s2", "RNA__A"): 4.0, ("s1", "RNA__B"): 5.0, ("s2", "RNA__B"): 6.0}
    s = spark.createDataFrame([("s1", "1.5"), ("s2", "bad")], "sample string, A string")
    assert {r["sample"]: r.value for r in readers.sample_matrix(s, "sample", "CNA").collect()} == {"s1": 1.5, "s2": None}


def test_columns_are_resolved(spark):
    assert readers.resolve_column(["Patient_ID", "x"], ["patient_id"]) == "Patient_ID"
    assert readers.resolve_column(["os_months_total", "os_months"], ["t"], ["months"]) == "os_months"
    df = spark.createDataFrame([("a", "TCGA-01"), ("b", "TCGA-02")], "n string, code string")
    assert readers.id_column(df, ["id"], "^TCGA-") == "code"
    assert readers.id_column(df, ["id"], "^X-") is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", float("nan")), ("c_d\\", 1.5), (None, None)], "n string, v double")
    assert sinks.json_rows(df).first().json == '{"n":"a|b","v":null}'
    assert [r.line for r in sinks.markdown_rows(df.where("v = 1.5")).collect()] == ["| c_d\\ | 1.500 |"]
    assert [r.line for r in sinks.latex_rows(df.where("v = 1.5")).collect()] == ["c\\_d\\textbackslash{} & 1.500 \\\\"]
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t.parquet"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 3
    assert sinks.split_private(df, ["n"])[1].columns == ["v"]


def test_streaming_windows(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{m:02d}:00", "a") for k, m in enumerate((1, 2, 7, 8, 40))]
    spark.createDataFrame(rows, "id int, t string, kind string").select("id", F.to_timestamp("t").alias("ts"), "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    for name, out in (("w", windows.windowed_counts(stream, "ts", ["kind"], "5 minutes", "10 minutes", value="id")), ("s", windows.sessions(stream, "ts", "kind", "10 minutes", "10 minutes")), ("d", windows.deduplicated(stream, "ts", "kind", "1 hour"))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [2, 2]
    assert [r.n for r in spark.table("s").collect()] == [4]
    assert spark.table("d").count() == 1
