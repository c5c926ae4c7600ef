"""Ties that an order leaves open go by the key, as in SQL over rows in the order of their keys."""

import pytest

from cohortforge.plans import QUERIES, SQL


def test_equal_balances_go_by_the_smallest_key(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    copies = [(k + 4 * c, f"n{k}", k % 2, v) for c in range(6) for k, v in enumerate((5.0, -1.5, 5.0, None))]
    rows = [*copies, (90, "n", 3, None), (91, "n", 4, float("nan")), (92, "n", 4, 1.0)]
    frame = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")
    frame.orderBy("c_custkey", ascending=False).repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet') order by c_custkey")
    want = sorted(con.execute(SQL["tk_argmin"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["tk_argmin"](spark, str(tmp_path)).collect()) == want
