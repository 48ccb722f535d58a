import datetime as dt
import decimal
import graphlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.operators import cache as H
from brindle.operators import columns as K
from brindle.operators import compose as C
from brindle.operators import joins as J
from brindle.operators import reshape as R
from brindle.functions import scalar
from brindle.plans.frame import Request, disable_optimizations
from brindle.plans.queries import ORACLE, QUERIES
from brindle.sources import delta_log, logical, remote, synthetic
from brindle.testing import PredicateTracker, io_source_assert

D = dt.datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (None, 30), (2, 25)], "x bigint, y bigint")
    b = spark.createDataFrame([(1, "p", 1), (2, "q", 2), (3, "r", 3), (None, "s", 4)], "x bigint, z string, y bigint")
    return a, b


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("cond", ["y >= 20", "x = 2", "y > 1000", "z = 'q' or z is null", "y_right = 2"])
@pytest.mark.parametrize("harvest", [0, 10])
def test_filtered_join_equals_naive(sides, how, cond, harvest):
    f = J.filtered_join(*sides, on="x", how=how, harvest=harvest, least=0).filter(cond)
    assert rows(f.to_df()) == rows(f.naive())
    assert f.columns == ["x", "y", "z", "y_right"]


def test_filtered_join_arguments(sides):
    for bad in ({"on": "x", "left_on": "x"}, {}, {"left_on": ["x"], "right_on": ["x", "y"]}, {"on": "x", "nulls_equal": True}, {"on": "x", "how": "outer"}):
        with pytest.raises(ValueError):
            J.filtered_join(*sides, **bad)


def test_harvest_reaches_the_scan(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "big"))
    small = spark.createDataFrame([(3, "a"), (4, "b")], "id bigint, s string")
    f = J.filtered_join(small, spark.read.parquet(str(tmp_path / "big")), on="id", least=0).filter("s = 'a'")
    assert "EqualTo(id,3)" in plan(f.to_df()).replace(" ", "") or "In(id,[3])" in plan(f.to_df()).replace(" ", "")
    assert rows(f.to_df()) == [(3, "a", 6)]


def test_repeated_use_does_not_accumulate(sides):
    f = J.filtered_join(*sides, on="x")
    assert rows(f.filter("x = 1").to_df()) and rows(f.filter("x = 2").to_df()) and len(rows(f.to_df())) == 3


@pytest.fixture(scope="module")
def ticks(spark):
    left = [(D(2024, 1, 1, h, m), k, h) for h in range(0, 24, 3) for m in (0, 30) for k in ("a", "b", None)] + [(None, "a", -1)]
    right = [(D(2024, 1, 1, h, 5 * (h % 7)), k, h * 10) for h in range(0, 24, 2) for k in ("a", "b", None) if (h, k) != (4, "a")]
    return spark.createDataFrame(left, "t timestamp_ntz, k string, n int"), spark.createDataFrame(right, "t timestamp_ntz, k string, q int"), left, right


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, dt.timedelta(minutes=40)])
@pytest.mark.parametrize("by", [None, "ranges", "k"])
def test_asof_equals_brute_force(ticks, strategy, tolerance, by, monkeypatch):
    a, b, left, right = ticks
    if by == "ranges":  # too many times to look up
        monkeypatch.setattr(J, "LOOKUP", 0)
        by = None
    right_one = right if by else [r for r in right if r[1] == "a"]
    frame = b if by else b.where("k = 'a'")
    f = J.filtered_join_asof(a, frame, on="t", by=by, strategy=strategy, tolerance=tolerance).filter(F.col("t") >= F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
    want = []
    for t, k, n in left:
        if t is None or t < D(2024, 1, 1, 6):
            continue
        cand = [r for r in right_one if (not by or k is not None and r[1] == k)]
        cand = [r for r in cand if strategy == "nearest" or (r[0] <= t if strategy == "backward" else r[0] >= t)]
        best = min(cand, key=lambda r: (abs(r[0] - t), r[0])) if cand else None
        if best and tolerance and abs(best[0] - t) > tolerance:
            best = None
        want.append((t, k, n, best[2] if best else None))
    assert rows(f.to_df().select("t", "k", "n", "q")) == sorted(want, key=repr)
    assert rows(f.to_df()) == rows(f.naive())


def test_asof_without_keys_has_no_single_task(ticks, monkeypatch):
    f = J.filtered_join_asof(ticks[0], ticks[1], on="t")
    assert "Window" not in plan(f.to_df()) and "BroadcastHashJoin" in plan(f.to_df())
    monkeypatch.setattr(J, "LOOKUP", 0)
    assert "windowspecdefinition(_r#" in plan(f.to_df()).replace(" ", "")


def test_join_between_takes_the_latest_start_only(spark):
    p = spark.createDataFrame([(5, "a"), (12, "a"), (30, "a")], "x int, id string")
    w = spark.createDataFrame([("long", 1, 40), ("short", 4, 6), ("late", 12, 12)], "id string, s int, e int")
    got = {r.x: r.id_right for r in J.join_between(p, w, "x", "s", "e").to_df().collect()}
    assert got == {5: "short", 12: "late", 30: None}
    assert J.join_between(p, w, "x", "s", "e", how="inner").to_df().count() == 2


def test_concat_named(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    f = C.concat_named({("a", 1): df, ("b", 2): df}, ["s", "n"])
    assert rows(f.filter("s = 'b' and v = 1").to_df()) == [("b", 2, 1)]
    assert f.filter("s = 'zzz'").to_df().count() == 0
    with pytest.raises(ValueError):
        C.concat_named({}, "s")
    with pytest.raises(ValueError):
        C.concat_named({("a", 1): df}, "s")


def test_unmapped_value_is_not_pushed(spark):
    df = spark.createDataFrame([("F", 1), ("O", 2)], "c string, v int")
    f = C.pushdown_combine({"s": df}, lambda x: x["s"].select(F.when(F.col("c") == "F", "done").otherwise("open").alias("state"), "v"), {"s": {"state": C.FilterSpec("c", value_mapping={"done": "F"})}})
    assert rows(f.filter("state in ('done', 'open')").to_df()) == [("done", 1), ("open", 2)]
    assert rows(f.filter("state = 'done'").to_df()) == [("done", 1)]


def test_lookback_bounds_cumulative_values(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(dt.date(2024, 1, i), i * 10) for i in range(1, 6)], "d date, v int")
    f = C.ts_with_columns(df, {"c": F.sum("v").over(Window.orderBy("d"))}, "d", lookback=dt.timedelta(days=1)).filter(F.col("d") >= F.lit(dt.date(2024, 1, 4)))
    assert rows(f.to_df().select("c")) == [(120,), (70,)]
    with pytest.raises(TypeError):
        C.ts_with_columns(df, {}, "v")


def test_pivot(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "b", 3), (None, "a", 4)], "i string, o string, v int")
    f = R.pushdown_pivot(df, "o", ["a", "b"], index="i", values="v")
    assert rows(f.to_df()) == rows(f.naive()) == [("x", 1, 2), ("y", None, 3), (None, 4, None)]
    assert rows(f.select("i", "a").to_df()) == [("x", 1), ("y", None), (None, 4)]
    assert rows(R.pushdown_pivot(df, "o", ["a", "b"], index="i", values="v", dense_on=True).select("i", "a").to_df()) == [("x", 1), (None, 4)]
    with pytest.raises(Exception, match="two rows"):
        R.pushdown_pivot(df.union(df), "o", ["a"], index="i", values="v").to_df().collect()
    with pytest.raises(NotImplementedError):
        R.pushdown_pivot(df, "o", ["a"], index="i", values="v", aggregate_function="sum")


def test_unpivot_reads_only_the_asked_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3.5), (4, 5, 6.5)], "i int, a int, b double").write.parquet(str(tmp_path / "t"))
    f = R.pushdown_unpivot(spark.read.parquet(str(tmp_path / "t")), index="i")
    got = f.filter("variable = 'a'")
    assert rows(got.to_df()) == rows(got.naive()) == [(1, "a", 2.0), (4, "a", 5.0)]
    assert "b:double" not in plan(got.to_df()).split("ReadSchema")[1]
    assert f.filter("variable = 'zzz'").to_df().count() == 0


def test_barrier(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = K.filter_no_pushdown(spark.read.parquet(str(tmp_path / "t")), F.col("id") > 90)
    assert df.count() == 9 and "PushedFilters: []" in plan(df)


def test_topo(spark):
    df = spark.range(3)
    assert rows(K.with_columns_topo(df, {"c": F.col("b") + 1, "b": F.col("a") * 2, "a": F.col("id") + 1}).select("c")) == [(3,), (5,), (7,)]
    with pytest.raises(graphlib.CycleError):
        K.with_columns_topo(df, {"a": F.col("b"), "b": F.col("a")})


def test_iter_rows_and_debug(spark):
    said = []
    f = K.debug(spark.range(5), sink=said.append).filter("id > 2")
    assert [r["id"] for r in K.iter_rows(f, named=True)] == [3, 4] and "id" in said[0]


def test_naive_switch_nests(sides):
    f = J.filtered_join(*sides, on="x").filter("x = 1")
    with disable_optimizations():
        with disable_optimizations():
            pass
        assert rows(f.to_df()) == [(1, 10, "p", 1)]


def test_column_cache(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0)], "i int, p string, v double")
    store = {}
    f = H.cache(df, store, order_by="i", partition_cols=["p"])
    assert rows(f.filter("p = 'a'").to_df()) == [(1, "a", 1.0), (3, "a", 3.0)]
    blocks = len(store)
    f.filter("p = 'a' and v > 2").to_df()
    assert len(store) == blocks
    with pytest.raises(ValueError):
        H.cache(df, order_by="p").to_df()
    with pytest.raises(ValueError):
        H.cache(df, order_by="i", cache_mode="zzz")


def test_period_cache(spark, tmp_path):
    df = spark.createDataFrame([(D(2024, m, 5), m) for m in (1, 2, 4)], "t timestamp_ntz, v int")
    c = H.ParquetCache(lambda: df, str(tmp_path / "c"), "t")
    f = c.frame(spark)
    span = lambda a, b: (F.col("t") >= F.lit(a).cast("timestamp_ntz")) & (F.col("t") < F.lit(b).cast("timestamp_ntz"))
    assert [r.v for r in f.filter(span("2024-01-03", "2024-02-10")).to_df().orderBy("v").collect()] == [1, 2]
    assert f.filter(span("2024-02-01", "2024-05-01")).to_df().count() == 2
    assert f.filter(span("2024-03-01", "2024-04-01")).to_df().count() == 0
    assert c.queried == [["2024-01", "2024-02"], ["2024-03", "2024-04"]]
    assert f.filter(span("2024-05-01", "2024-01-01")).to_df().count() == 0 and len(c.queried) == 2
    kept = H.ParquetCache(lambda: 1 / 0, str(tmp_path / "c"), "t", schema=df.schema).frame(spark)
    assert kept.filter(span("2024-01-01", "2024-05-01")).to_df().count() == 3
    again = H.ParquetCache(lambda: df, str(tmp_path / "c"), "t", cache_mode="rebuild")
    assert again.frame(spark).filter(span("2024-01-01", "2024-02-01")).to_df().count() == 1 and again.queried == [["2024-01"]]
    with pytest.raises(ValueError):
        H.ParquetCache(lambda: df, "x", "t", partition_format="$year")


def test_period_cache_keeps_null_dates(spark, tmp_path):
    df = spark.createDataFrame([(D(2024, 1, 5), 1), (None, 2)], "t timestamp_ntz, v int")
    for ask in ("v > 0", "t is null", "t is null or t < timestamp_ntz'2024-02-01'", "t >= timestamp_ntz'2024-01-01'"):
        f = H.ParquetCache(lambda: df, str(tmp_path / "c"), "t").frame(spark).filter(ask)
        assert rows(f.to_df()) == rows(f.naive()) == rows(df.where(ask))


def test_period_cache_answers_only_its_own(spark, tmp_path):
    df = spark.createDataFrame([(D(2024, 1, 5), v) for v in (1, 2, 3)], "t timestamp_ntz, v int")
    at = str(tmp_path / "c")
    make = lambda up=df, **more: H.ParquetCache(lambda: up, at, "t", **more).frame(spark)
    assert make(bounding="v > 1").to_df().count() == 2 and make(bounding="v > 1").to_df().count() == 2
    assert make().to_df().count() == 3 and make(version="b").to_df().count() == 3
    wider = df.withColumn("w", F.lit("x"))
    assert make(wider).to_df().columns == ["t", "v", "w"] and make(wider).to_df().where("w = 'x'").count() == 3


def test_naive_reads_rows_of_every_source(spark, tmp_path):
    import pyarrow as pa

    df = spark.createDataFrame([(D(2024, 1, d), d) for d in range(1, 6)], "t timestamp_ntz, v int")
    delta_log.sink_delta(df, str(tmp_path / "d"))
    sent = []

    def transport(sql):
        sent.append(sql)
        return iter([pa.RecordBatch.from_pydict({"v": pa.array([1, 2, 3, 4, 5], pa.int32())})])

    metric = lambda q, a, b: [{"metric": q, "points": [[86_400_000 * 19723, 1.5], [86_400_000 * 19724, 2.5]]}]
    frames = {
        "delta": delta_log.scan_delta(spark, str(tmp_path / "d")).filter("v > 2"),
        "cache": H.cache_parquet(df, str(tmp_path / "c"), "t").filter("v > 2"),
        "memory": H.cache(df, order_by="v").filter("v > 2"),
        "http": remote.scan_http_sql(spark, "select v from x", transport).filter("v > 2"),
        "metrics": remote.scan_metrics(spark, "m", metric).filter("timestamp >= timestamp_ntz'2024-01-01' and timestamp < timestamp_ntz'2024-01-03'"),
        "by_period": H.execute_by_period(df, "t").filter("t >= timestamp_ntz'2024-01-03' and t < timestamp_ntz'2024-02-01'"),
    }
    for name, f in frames.items():
        assert len(rows(f.naive())) == (2 if name == "metrics" else 3), name
        assert rows(f.to_df()) == rows(f.naive()), name


def test_tracker_records_what_reaches_the_source(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (None, "c", 1.5)], "x bigint, y string, z double")
    t = PredicateTracker(df)
    assert t.frame.filter("x in (1, 2) and z is not null").select("y").to_df().count() == 1
    t.assert_pushed("x", "z")
    t.assert_read("x", "y", "z")
    assert t.values("x") == {1, 2}
    t.frame.limit(2).to_df()
    t.assert_nothing_pushed()
    assert t.last.limit == 2
    with pytest.raises(AssertionError):
        t.assert_pushed("x")
    J.filtered_join(spark.createDataFrame([(2, 9)], "x bigint, n int"), t.frame, on="x").to_df()
    assert t.values("x") == {2}
    io_source_assert(lambda: PredicateTracker(df).frame, df, ["x > 1", "x is null or y = 'a'", "false"], [("y",), ("z", "x")])
    with pytest.raises(AssertionError):
        io_source_assert(lambda: PredicateTracker(df.limit(1)).frame, df)


def test_limit_reaches_the_query_text():
    assert remote.wrap_query("select 1 as x", Request(limit=5)) == "SELECT * FROM (select 1 as x) AS q LIMIT 5"


def test_by_period(spark):
    df = spark.createDataFrame([(D(2024, m, 5), m) for m in range(1, 7)], "t timestamp_ntz, v int")
    f = H.execute_by_period(df, "t")
    with pytest.raises(ValueError):
        f.filter("v > 1").to_df()
    span = (F.col("t") >= F.lit("2024-02-01").cast("timestamp_ntz")) & (F.col("t") < F.lit("2024-05-01").cast("timestamp_ntz"))
    assert [r.v for r in f.filter(span).to_df().toLocalIterator()] == [2, 3, 4]


def test_table_log(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "A"), (2, None)], "x bigint, p string")
    assert delta_log.sink_delta(a, path, partition_by=["p"]) == 0
    assert delta_log.sink_delta(a.where("x = 1").withColumn("x", F.lit(7).cast("bigint")), path, mode="append") == 1
    f = delta_log.scan_delta(spark, path)
    assert rows(f.filter("p = 'A'").to_df()) == [(1, "A"), (7, "A")] and rows(f.filter("p is null").to_df()) == [(2, None)]
    assert delta_log.sink_delta(a, path, mode="ignore") is None
    with pytest.raises(FileExistsError):
        delta_log.sink_delta(a, path)
    delta_log.sink_delta(a.where("x = 2"), path, mode="overwrite")
    assert rows(delta_log.scan_delta(spark, path).to_df()) == [(2, None)] and delta_log.scan_delta(spark, path, version=1).to_df().count() == 3


def test_table_log_partition_values(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, decimal.Decimal("1.5"), "a b/c%"), (2, decimal.Decimal("2.5"), "ü=x")], "x bigint, d decimal(5,2), s string")
    delta_log.sink_delta(a, path, partition_by=["d", "s"])
    f = delta_log.scan_delta(spark, path)
    assert rows(f.filter("d in (1.5, 2.5)").to_df()) == rows(a) == rows(f.naive())
    assert rows(f.filter("d = 1.5").to_df()) == rows(a.where("x = 1")) and rows(f.filter("s = 'ü=x'").to_df()) == rows(a.where("x = 2"))


def test_table_log_merge_rewrites_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "t")
    delta_log.sink_delta(spark.range(0, 10, 1, 1).withColumn("v", F.lit("a")), path)
    delta_log.sink_delta(spark.range(10, 20, 1, 1).withColumn("v", F.lit("a")), path, mode="append")
    delta_log.sink_delta(spark.range(15, 22, 1, 1).withColumn("v", F.lit("b")), path, mode="merge", merge_on=["id"])
    removed = [line for line in (tmp_path / "t/_delta_log" / f"{2:020d}.json").read_text().splitlines() if "remove" in json.loads(line)]
    assert len(removed) == 1
    assert rows(delta_log.scan_delta(spark, path).to_df()) == sorted([(i, "a" if i < 15 else "b") for i in range(22)], key=repr)


def test_table_log_checkpoints_stats_and_refusals(spark, tmp_path):
    path = str(tmp_path / "t")
    log = tmp_path / "t/_delta_log"
    for k in range(3):
        delta_log.sink_delta(spark.range(10 * k, 10 * k + 10, 1, 1), path, mode="append")
    live, meta = delta_log.live_files(spark, path)
    kept = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {**meta, "format": {"provider": "parquet"}, "configuration": None}}]
    kept += [{"add": {**a, "partitionValues": {}, "stats": json.dumps({"minValues": {"id": 10 * k}, "maxValues": {"id": 10 * k + 9}})}} for k, a in enumerate(live.values())]
    shape = "add struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,dataChange:boolean,stats:string>, metaData struct<id:string,schemaString:string,partitionColumns:array<string>>, protocol struct<minReaderVersion:int,minWriterVersion:int>"
    spark.read.schema(shape).json(spark.createDataFrame([(json.dumps(x),) for x in kept], "value string").rdd.map(lambda r: r[0])).coalesce(1).write.parquet(str(tmp_path / "cp"))
    next((tmp_path / "cp").glob("part-*.parquet")).rename(log / f"{2:020d}.checkpoint.parquet")
    (log / f"{0:020d}.json").unlink()
    f = delta_log.scan_delta(spark, path)
    assert f.to_df().count() == 30
    assert len(f.filter("id between 12 and 15").to_df().inputFiles()) == 1 and f.filter("id between 12 and 15").to_df().count() == 4
    assert delta_log.sink_delta(spark.range(30, 40, 1, 1), path, mode="append") == 3 and delta_log.scan_delta(spark, path).to_df().count() == 40
    with pytest.raises(FileNotFoundError):
        delta_log.scan_delta(spark, path, version=1)
    (log / f"{4:020d}.json").write_text(json.dumps({"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"]}}))
    with pytest.raises(ValueError):
        delta_log.scan_delta(spark, path)


def test_logical_types(spark):
    df = logical.encode(spark.createDataFrame([(dt.timedelta(milliseconds=i),) for i in (1, 5, 9)], "d interval day to second"), "d", "duration", "ms")
    assert logical.mapping(df) == {"d": ("duration", "ms")}
    assert rows(df.where(logical.compare(df, "d", ">", dt.timedelta(microseconds=4500)))) == [(5,), (9,)]
    assert rows(df.where(logical.compare(df, "d", "=", dt.timedelta(microseconds=4500)))) == []


def test_http_sink_and_slices(spark, tmp_path):
    at = str(tmp_path)

    def send(sql, body):
        import pathlib
        import uuid

        pathlib.Path(at, uuid.uuid4().hex).write_bytes(body)

    remote.sink_http_sql(spark.range(10).coalesce(1), "t", send, chunk_size=4)
    import pyarrow as pa

    got = sorted(x for p in tmp_path.iterdir() for x in pa.ipc.open_stream(p.read_bytes()).read_all()["id"].to_pylist())
    assert got == list(range(10)) and len(list(tmp_path.iterdir())) == 3
    assert remote.time_slices(D(2024, 1, 1), D(2024, 1, 2, 12), dt.timedelta(days=1)) == [(D(2024, 1, 1), D(2024, 1, 2)), (D(2024, 1, 2), D(2024, 1, 2, 12))]
    with pytest.raises(ValueError):
        remote.scan_metrics(spark, "q", lambda *a: []).filter("value > 1").to_df()


def test_synthetic_is_partition_independent(spark):
    a = synthetic.scan_synthetic_regression(spark, 500, 2, use_weights=True, chunk_key="c", n_chunks=5, seed=3)
    b = synthetic.scan_synthetic_regression(spark, 500, 2, use_weights=True, chunk_key="c", n_chunks=5, seed=3).repartition(7)
    assert rows(a) == rows(b) and a.select("c").distinct().count() == 5


def test_panel_steps_and_groups(spark):
    day = dt.date(2024, 3, 1)  # a Friday
    n = {f: synthetic.scan_synthetic_panel(spark, day, day + dt.timedelta(days=3), 5, freq=f).count() for f in ("B", "D", "h")}
    assert n == {"B": 2 * 5, "D": 4 * 5, "h": 96 * 5}
    p = synthetic.scan_synthetic_panel(spark, day, day, 300, 1, 1, freq="h", categories=["g"], group_by="g", group_betas=[[[1.0]], [[5.0]], [[-2.0]]], epsilon_scale=0.0)
    assert p.select("timestamp").distinct().count() == 24 and p.where("cast(timestamp as date) <> date").count() == 0
    slopes = {r.g: (r.lo, r.hi) for r in p.groupBy("g").agg(F.round(F.min(F.col("y0") / F.col("x0")), 6).alias("lo"), F.round(F.max(F.col("y0") / F.col("x0")), 6).alias("hi")).collect()}
    assert slopes == {"g0": (1.0, 1.0), "g1": (5.0, 5.0), "g2": (-2.0, -2.0)}
    with pytest.raises(ValueError):
        synthetic.scan_synthetic_panel(spark, day, day, 1, freq="w")


def test_cache_modes():
    assert [H.CacheMode.of(x) for x in ("REBUILD", 1, 2, H.CacheMode.CACHE)] == [H.CacheMode.REBUILD, H.CacheMode.CACHE, H.CacheMode.IGNORE, H.CacheMode.CACHE]
    with pytest.raises(ValueError):
        H.CacheMode.of(7)


def test_floor_division_of_large_numbers(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, 1), (-big, 2), (7, -2), (-7, -2), (5, 0), (-6, 3)], "a bigint, b bigint")
    got = [r.q for r in df.select(scalar.floor_div(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got == [big, -big // 2, -4, 3, None, -2]
    assert spark.range(1).select(scalar.floor_div(F.lit(-7.5), F.lit(2)).alias("q")).head().q == -4


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
