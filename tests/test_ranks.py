import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import ranks as N
from brindle.plans.queries import QUERIES

SQL = """SELECT i, k, a, b, row_number() OVER v AS rn, ntile(4) OVER v AS q, dense_rank() OVER (PARTITION BY k ORDER BY b) AS dr, cume_dist() OVER w AS cd, percent_rank() OVER w AS pr
FROM df WINDOW w AS (PARTITION BY k ORDER BY a), v AS (PARTITION BY k ORDER BY a, b)"""


def lineitem(spark, rows, path):
    """Rows whose keys have 1,000 rows each."""
    df = spark.range(rows).selectExpr("id as l_orderkey", "1 as l_linenumber", "id div 1000 as l_suppkey", "cast(id % 50 as double) as l_quantity", "timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(id % 2500 as int)) as l_shipdate")
    df.write.parquet(f"{path}/lineitem.parquet")


def test_window_ranks_has_tasks_as_rows_need(spark, tmp_path):
    lineitem(spark, 4_000_000, tmp_path)
    got = QUERIES["window_ranks"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).head()
    assert got[1] == 4_000_000 and got[0] <= 1.4 * N.MOST


@pytest.mark.parametrize("quantities", [(9.0, 3.0), (3.0, 9.0)])
def test_window_ranks_numbers_equal_rows_the_same_way(spark, tmp_path, quantities):
    rows = [(1, 1, 5, q) for q in quantities]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double").withColumn("l_shipdate", F.expr("timestamp_ntz'1995-01-01'")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.rn, r.q, r.dr, r.cd, r.pr) for r in QUERIES["window_ranks"](spark, str(tmp_path)).collect()) == [(1, 1, 1, 1.0, 0.0), (2, 2, 2, 1.0, 0.0)]


@pytest.mark.parametrize("most", [7, 100, 10_000])
def test_large_keys_are_cut_and_ranked_as_a_whole(spark, most):
    # key 1 and the null key are large; a and b hold repeats; small keys of every size up to 12
    rows = [(i, 1, (i * 7919) % 97, (i * 31) % 23) for i in range(400)]
    rows += [(1000 + i, None, (i * 7919) % 211, (i * 31) % 19) for i in range(301)]
    rows += [(2000 + 20 * k + i, k, i // 2, i % 3) for k in range(2, 14) for i in range(k - 1)]
    df = pd.DataFrame({"i": [r[0] for r in rows], "k": pd.array([r[1] for r in rows], "Int64"), "a": [r[2] for r in rows], "b": [r[3] for r in rows]})
    got = N.key_ranks(spark.createDataFrame(rows, "i bigint, k bigint, a bigint, b bigint"), "k", ["a"], "b", 4, most)
    # i tells rows apart that are equal in all else, whose numbers the order leaves open
    want = sorted(map(repr, (r[1:] for r in duckdb.sql(SQL).fetchall())))
    assert sorted(repr(tuple(r)[1:]) for r in got.collect()) == want


def test_no_task_holds_a_large_key(spark):
    df = spark.range(4000).selectExpr("id as i", "1 as k", "id % 1000 as a", "id % 7 as b")
    got = N.key_ranks(df, "k", ["a"], "b", 4, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most <= 1500


def test_ranks_of_an_empty_table(spark):
    assert N.key_ranks(spark.range(0).selectExpr("id as k", "id as a", "id as b"), "k", ["a"], "b", 4).collect() == []


def test_no_more_tasks_than_rows_are_dealt_to_directly():
    m = N.MOST
    assert [N.tasks(n, m) for n in (0, 1, m, m + 1, 200 * m, 432 * m, 600 * m, 900 * m)] == [1, 1, 1, 2, 200, 200, 200, 300]
