"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cache as H
from ..operators import columns as K
from ..operators import compose as C
from ..operators import joins as J
from ..operators import ranks as N
from ..operators import reshape as R
from ..sources import delta_log, embedded, logical, remote, synthetic
from ..sources.workspace import workspace
from . import predicate as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts(text: str):
    return lit(text).cast("timestamp_ntz")


DAY = dt.timedelta(days=1)


# ---- time series ---------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-13')
SELECT event_id, user_id, ts, round(running, 4) AS running FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM w)
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
def ts_cumsum_lookback(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    f = C.ts_with_columns(t(spark, sf, "events"), {"running": F.sum("value").over(w)}, "ts", lookback=2 * DAY)
    f = f.filter((col("ts") >= ts("2024-01-10")) & (col("ts") < ts("2024-01-13")))
    return f.to_df().select("event_id", "user_id", "ts", F.round("running", 4).alias("running"))


@query("""
WITH w AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-17')
SELECT event_id, day, prev, nxt, rnk FROM (SELECT *, lag(event_type) OVER o AS prev, lead(event_type) OVER o AS nxt, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS BIGINT) AS rnk FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE day = DATE '2024-01-15'""")
def ts_linked_lookahead(spark, sf):
    events = t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = C.ts_with_columns(events, lambda df: df.withColumns({"prev": F.lag("event_type").over(o), "nxt": F.lead("event_type").over(o), "rnk": F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).cast("bigint")}), "ts", linked_cols=["day"], lookback=DAY, lookahead=DAY)
    return f.filter(col("day") == lit(dt.date(2024, 1, 15))).select("event_id", "day", "prev", "nxt", "rnk").to_df()


@query("""
WITH w AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-13')
SELECT event_id, last_paid, round(mean3, 6) AS mean3 FROM (SELECT *, last_value(paid IGNORE NULLS) OVER o AS last_paid, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS mean3 FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
def ts_fill_and_roll(spark, sf):
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    paid = F.when(col("event_type") == "purchase", col("value"))
    f = C.ts_with_columns(t(spark, sf, "events"), {"last_paid": F.last(paid, True).over(o.rowsBetween(Window.unboundedPreceding, 0)), "mean3": F.avg("value").over(o.rowsBetween(-2, 0))}, "ts", lookback=DAY)
    f = f.filter((col("ts") >= ts("2024-01-10")) & (col("ts") < ts("2024-01-13")))
    return f.to_df().select("event_id", "last_paid", F.round("mean3", 6).alias("mean3"))


# ---- joins ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def filtered_join_inner(spark, sf):
    f = J.filtered_join(t(spark, sf, "customer"), t(spark, sf, "orders"), left_on="c_custkey", right_on="o_custkey")
    f = f.filter((col("c_mktsegment") == "BUILDING") & (col("c_acctbal") > 9000))
    return f.to_df().select("o_orderkey", col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "o_totalprice")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON s_nationkey = n_nationkey WHERE s_acctbal < 5000")
def filtered_join_left(spark, sf):
    f = J.filtered_join(t(spark, sf, "supplier"), t(spark, sf, "nation").where("n_nationkey < 12"), left_on="s_nationkey", right_on="n_nationkey", how="left")
    return f.filter("s_acctbal < 5000").select("s_suppkey", "s_name", "n_name").to_df()


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS l_quantity_right FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
WHERE a.l_shipdate >= TIMESTAMP '1998-03-01' AND a.l_shipdate < TIMESTAMP '1998-04-01'""")
def filtered_join_many_keys(spark, sf):
    li = t(spark, sf, "lineitem")
    f = J.filtered_join(li, li.select("l_orderkey", "l_linenumber", "l_quantity"), on=["l_orderkey", "l_linenumber"], harvest=500)
    f = f.filter((col("l_shipdate") >= ts("1998-03-01")) & (col("l_shipdate") < ts("1998-04-01")))
    return f.select("l_orderkey", "l_linenumber", "l_quantity", "l_quantity_right").to_df()


_BUY = "(SELECT user_id, ts, event_id AS buy_id, value AS paid FROM events WHERE event_type = 'purchase')"


def _buys(spark, sf) -> DataFrame:
    return t(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "ts", col("event_id").alias("buy_id"), col("value").alias("paid"))


@query(f"""SELECT e.event_id, e.ts, b.buy_id, b.paid FROM events e ASOF LEFT JOIN {_BUY} b ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.ts >= TIMESTAMP '2024-01-10'""")
def asof_backward(spark, sf):
    f = J.filtered_join_asof(t(spark, sf, "events"), _buys(spark, sf), on="ts", by="user_id")
    return f.filter(col("ts") >= ts("2024-01-10")).select("event_id", "ts", "buy_id", "paid").to_df()


@query(f"""WITH j AS (SELECT e.event_id, e.ts, b.ts AS b_at, b.buy_id FROM events e ASOF LEFT JOIN {_BUY} b ON e.user_id = b.user_id AND e.ts <= b.ts WHERE e.ts < TIMESTAMP '2024-01-20')
SELECT event_id, CASE WHEN b_at <= ts + INTERVAL 6 HOUR THEN buy_id END AS buy_id FROM j""")
def asof_forward_tolerance(spark, sf):
    f = J.filtered_join_asof(t(spark, sf, "events"), _buys(spark, sf), on="ts", by="user_id", strategy="forward", tolerance=dt.timedelta(hours=6))
    return f.filter(col("ts") < ts("2024-01-20")).select("event_id", "buy_id").to_df()


@query(f"""WITH x AS (SELECT e.event_id, e.ts, b.ts AS b_at, b.buy_id FROM events e ASOF LEFT JOIN {_BUY} b ON e.user_id = b.user_id AND e.ts >= b.ts),
y AS (SELECT e.event_id, b.ts AS b_at, b.buy_id FROM events e ASOF LEFT JOIN {_BUY} b ON e.user_id = b.user_id AND e.ts <= b.ts),
m AS (SELECT event_id, x.ts, CASE WHEN y.b_at IS NULL OR x.ts - x.b_at <= y.b_at - x.ts THEN x.b_at ELSE y.b_at END AS b_at, CASE WHEN y.b_at IS NULL OR x.ts - x.b_at <= y.b_at - x.ts THEN x.buy_id ELSE y.buy_id END AS buy_id FROM x JOIN y USING (event_id))
SELECT event_id, CASE WHEN greatest(ts - b_at, b_at - ts) <= INTERVAL 12 HOUR THEN buy_id END AS buy_id FROM m WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'""")
def asof_nearest_tolerance(spark, sf):
    f = J.filtered_join_asof(t(spark, sf, "events"), _buys(spark, sf), on="ts", by="user_id", strategy="nearest", tolerance=dt.timedelta(hours=12))
    return f.filter((col("ts") >= ts("2024-01-05")) & (col("ts") < ts("2024-01-25"))).select("event_id", "buy_id").to_df()


_ANY_BUY = "(SELECT ts, max(event_id) AS buy_id FROM events WHERE event_type = 'purchase' GROUP BY ts)"


@query(f"SELECT e.event_id, b.buy_id FROM events e ASOF LEFT JOIN {_ANY_BUY} b ON e.ts >= b.ts")
def asof_without_keys(spark, sf):
    e = t(spark, sf, "events")
    any_buy = e.where("event_type = 'purchase'").groupBy("ts").agg(F.max("event_id").alias("buy_id"))
    return J.filtered_join_asof(e, any_buy, on="ts").select("event_id", "buy_id").to_df()


@query("SELECT e.event_id, b.buyer, b.at AS bought_at FROM events e ASOF LEFT JOIN (SELECT user_id AS buyer, ts AS at FROM events WHERE event_type = 'purchase') b ON e.user_id = b.buyer AND e.ts >= b.at WHERE e.user_id < 300")
def asof_renamed_keys(spark, sf):
    b = _buys(spark, sf).select(col("user_id").alias("buyer"), col("ts").alias("at"), col("user_id").alias("who"))
    f = J.filtered_join_asof(t(spark, sf, "events"), b, left_on="ts", right_on="at", by_left="user_id", by_right="buyer")
    return f.filter("user_id < 300").select("event_id", "who", "at").to_df().withColumnsRenamed({"who": "buyer", "at": "bought_at"})


_WINDOWS = "(SELECT * FROM (VALUES ('a', TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31'), ('b', TIMESTAMP '1996-06-01', TIMESTAMP '1996-07-15'), ('c', TIMESTAMP '1997-02-01', TIMESTAMP '1997-02-28')) AS w(period, start_at, end_at))"


def _windows(spark) -> DataFrame:
    d = dt.datetime
    return spark.createDataFrame([("a", d(1996, 1, 1), d(1996, 12, 31)), ("b", d(1996, 6, 1), d(1996, 7, 15)), ("c", d(1997, 2, 1), d(1997, 2, 28))], "period string, start_at timestamp_ntz, end_at timestamp_ntz")


_BETWEEN = f"WITH j AS (SELECT o_orderkey, o_orderdate, w.period, w.end_at FROM orders ASOF LEFT JOIN {_WINDOWS} w ON o_orderdate >= w.start_at WHERE o_orderstatus = 'F')"


@query(_BETWEEN + " SELECT o_orderkey, CASE WHEN o_orderdate <= end_at THEN period END AS period FROM j")
def join_between_left(spark, sf):
    f = J.join_between(t(spark, sf, "orders"), _windows(spark), "o_orderdate", "start_at", "end_at")
    return f.filter("o_orderstatus = 'F'").select("o_orderkey", "period").to_df()


@query(_BETWEEN + " SELECT o_orderkey, period FROM j WHERE o_orderdate <= end_at")
def join_between_inner(spark, sf):
    f = J.join_between(t(spark, sf, "orders"), _windows(spark), "o_orderdate", "start_at", "end_at", how="inner")
    return f.filter("o_orderstatus = 'F'").select("o_orderkey", "period").to_df()


@query(f"SELECT o_orderkey, w.period FROM orders JOIN {_WINDOWS} w ON o_orderdate BETWEEN w.start_at AND w.end_at")
def join_interval_many(spark, sf):
    w = _windows(spark)
    return t(spark, sf, "orders").join(F.broadcast(w), col("o_orderdate").between(col("start_at"), col("end_at"))).select("o_orderkey", "period")


@query("""SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'full', count(*) FROM (SELECT * FROM customer WHERE c_nationkey < 10) c FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON c_nationkey = s_nationkey""")
def join_kinds(spark, sf):
    c, o, s = t(spark, sf, "customer"), t(spark, sf, "orders"), t(spark, sf, "supplier")
    n = F.count("*").alias("n")
    semi = c.join(o, c.c_custkey == o.o_custkey, "left_semi").agg(n).select(lit("semi").alias("kind"), "n")
    anti = c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(n).select(lit("anti").alias("kind"), "n")
    full = c.where("c_nationkey < 10").join(s.where("s_nationkey > 5"), col("c_nationkey") == col("s_nationkey"), "full").agg(n).select(lit("full").alias("kind"), "n")
    return semi.union(anti).union(full)


# ---- composition ---------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS status, o_orderdate, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-03-31' GROUP BY ALL""")
def combine_two_sources(spark, sf):
    names = {"done": "F", "open": "O", "part": "P"}

    def combine(x):
        o = x["orders"].withColumn("status", F.when(col("o_orderstatus") == "F", "done").when(col("o_orderstatus") == "O", "open").otherwise("part"))
        li = x["lineitem"].where((col("l_shipdate") < ts("1996-03-31")) & (col("l_shipdate") >= ts("1996-01-01")))
        return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey", "status", "o_orderdate").agg(F.sum("l_quantity").alias("qty"))

    f = C.pushdown_combine(
        {"orders": t(spark, sf, "orders"), "lineitem": t(spark, sf, "lineitem")}, combine,
        {"orders": {"status": C.FilterSpec("o_orderstatus", value_mapping=names), "o_orderdate": C.FilterSpec("o_orderdate")}, "lineitem": {"o_orderdate": C.FilterSpec("l_shipdate", lookahead=30 * DAY)}},
    )
    return f.filter((col("status") == "done") & (col("o_orderdate") >= ts("1996-01-01")) & (col("o_orderdate") < ts("1996-03-01"))).to_df()


@query("SELECT r_name AS region, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey > 3")
def concat_tagged(spark, sf):
    n = t(spark, sf, "nation")
    names = {r.r_regionkey: r.r_name for r in t(spark, sf, "region").collect()}  # five rows by definition
    f = C.concat_named({v: n.where(col("n_regionkey") == k).select("n_nationkey", "n_name") for k, v in names.items()}, "region")
    return f.filter(col("region").isin("ASIA", "EUROPE") & (col("n_nationkey") > 3)).to_df()


@query("SELECT 'x' AS tag, n_name FROM nation WHERE false")
def concat_tagged_none(spark, sf):
    n = t(spark, sf, "nation").select("n_name")
    return C.concat_named({"a": n, "b": n}, "tag").filter("tag = 'c'").to_df()


# ---- reshape -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem WHERE l_orderkey < 5000 UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE l_orderkey < 5000")
def unpivot_measures(spark, sf):
    f = R.pushdown_unpivot(t(spark, sf, "lineitem"), index=["l_orderkey", "l_linenumber"], on=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], variable_name="measure", value_name="amount")
    return f.filter(col("measure").isin("l_quantity", "l_tax") & (col("l_orderkey") < 5000)).to_df()


_CELLS = "(SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)"


@query(f"SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase FROM {_CELLS} WHERE user_id < 400 GROUP BY user_id")
def pivot_sparse(spark, sf):
    cells = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    f = R.pushdown_pivot(cells, "event_type", ["click", "view", "purchase", "signup", "error"], index="user_id", values="n")
    return f.filter("user_id < 400").select("user_id", "click", "purchase").to_df()


@query(f"SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS click FROM {_CELLS} WHERE event_type = 'click' GROUP BY user_id")
def pivot_dense(spark, sf):
    cells = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.pushdown_pivot(cells, "event_type", ["click", "view", "purchase", "signup", "error"], index="user_id", values="n", dense_on=True).select("user_id", "click").to_df()


# ---- columns, limits -----------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25 AND p_retailprice < 1500")
def filter_barrier(spark, sf):
    return K.filter_no_pushdown(t(spark, sf, "part"), [col("p_size") > 25, col("p_retailprice") < 1500]).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem WHERE l_linenumber = 1")
def columns_in_order(spark, sf):
    df = K.with_columns_topo(t(spark, sf, "lineitem").where("l_linenumber = 1"), {"gross": F.round(col("raw") * (1 + col("l_tax")), 7), "net": F.round("raw", 6), "raw": col("l_extendedprice") * (1 - col("l_discount"))})
    return df.select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey >= 5")
def debug_scan(spark, sf):
    return K.debug(t(spark, sf, "nation")).filter("n_nationkey >= 5").select("n_name", "n_regionkey").to_df()


# ---- caches, periods -----------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey IN (3, 7)")
def cache_columns(spark, sf):
    store: dict = {}
    f = H.cache(t(spark, sf, "supplier"), store, order_by="s_suppkey", partition_cols=["s_nationkey"])
    f.filter("s_nationkey = 3").select("s_suppkey", "s_name").to_df()
    return f.filter("s_nationkey IN (3, 7)").select("s_suppkey", "s_name", "s_acctbal").to_df()


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-10' AND o_orderdate < TIMESTAMP '1996-05-20'")
def cache_by_period(spark, sf):
    src = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    path = workspace(spark, "period-cache")
    first = H.cache_parquet(src, path, "o_orderdate").filter((col("o_orderdate") >= ts("1996-03-05")) & (col("o_orderdate") < ts("1996-03-09")))
    first.to_df()
    again = H.cache_parquet(src, path, "o_orderdate").filter((col("o_orderdate") >= ts("1996-02-10")) & (col("o_orderdate") < ts("1996-05-20")))
    return again.to_df()


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'")
def by_period(spark, sf):
    f = H.execute_by_period(t(spark, sf, "events"), "ts", time_unit="daily")
    return f.filter((col("ts") >= ts("2024-01-03")) & (col("ts") < ts("2024-01-09"))).to_df().select("event_id", "ts")


# ---- predicate kernel ----------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES (1, 'values', '1,2'), (2, 'values', 'none'), (3, 'restrict', '1'), (4, 'contradiction', 'true'), (5, 'contradiction', 'false'), (6, 'dnf', '4'), (7, 'values', '1,2'), (8, 'restrict', 'none'), (9, 'contradiction', 'true')) AS x(id, kind, result)""")
def predicate_battery(spark, sf):
    df = spark.createDataFrame([], "x bigint, y bigint, d date, s string")

    def show(v) -> str:
        return "none" if v is None else ",".join(map(str, sorted(v)))

    p = lambda text: P.parse(df, text)
    rows = [
        (1, "values", show(P.values(p("x in (1, 2, 3) and x < 3"), "x"))),
        (2, "values", show(P.values(p("x = 1 or y = 2"), "x"))),
        (3, "restrict", str(len([r for r in (P.restrict(p("x = 1 and upper(s) = 'A'"), ["x"]),) if r is not None]))),
        (4, "contradiction", str(P.contradictory(p("x > 5 and x < 3"))).lower()),
        (5, "contradiction", str(P.contradictory(p("x > 5 and y < 3"))).lower()),
        (6, "dnf", str(len(P.dnf(p("(x = 1 or x = 2) and (y = 1 or y = 2)"))))),
        (7, "values", show(P.values(p("x in (1, 2) and not (x = 1 and y = 2)"), "x"))),
        (8, "restrict", show(None if P.restrict(p("x = 1 or y = 2"), ["x"]) is None else [1])),
        (9, "contradiction", str(P.contradictory(p("d >= date'2024-02-01' and d < date'2024-01-01'"))).lower()),
    ]
    return spark.createDataFrame(rows, "id int, kind string, result string")


@query("""SELECT event_id, value IS NOT DISTINCT FROM nullif(value, 0) AS same, value IS DISTINCT FROM nullif(user_id, 5) AS differs FROM events WHERE NOT (user_id = 5 AND event_type = 'view') AND event_type <> 'error'""")
def null_safe_filters(spark, sf):
    e = t(spark, sf, "events").where("not (user_id = 5 and event_type = 'view') and event_type <> 'error'")
    return e.select("event_id", S.eq_missing(col("value"), F.nullif(col("value"), lit(0.0))).alias("same"), S.ne_missing(col("value"), F.nullif("user_id", lit(5)).cast("double")).alias("differs"))


# ---- sources and sinks ---------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def delta_round_trip(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", "l_returnflag")
    path = workspace(spark, "table")
    delta_log.sink_delta(li.where("l_orderkey % 2 = 0"), path, partition_by=["l_returnflag"])
    delta_log.sink_delta(li.where("l_orderkey % 2 = 1"), path, mode="append")
    f = delta_log.scan_delta(spark, path).filter(col("l_returnflag").isin("A", "R"))
    return f.to_df().groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT s_suppkey, s_acctbal + CASE WHEN s_suppkey <= 5 THEN 1 ELSE 0 END AS s_acctbal FROM supplier")
def delta_merge(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    path = workspace(spark, "table")
    delta_log.sink_delta(s, path)
    delta_log.sink_delta(s.where("s_suppkey <= 5").select("s_suppkey", (col("s_acctbal") + 1).alias("s_acctbal")), path, mode="merge", merge_on=["s_suppkey"])
    return delta_log.scan_delta(spark, path).to_df()


@query("SELECT * FROM (VALUES (2, 'b'), (3, 'c')) AS x(ID, NAME)")
def jdbc_scan(spark, sf):
    url = embedded.database(spark, "CREATE TABLE T (ID INT, NAME VARCHAR(10))", "INSERT INTO T VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    return remote.scan_db(spark, "SELECT * FROM T", url, driver=embedded.DRIVER).where("ID > 1")


@query("SELECT CAST(k AS BIGINT) AS k, 'v' || k AS v FROM range(0, 20) AS r(k) WHERE k IN (3, 11)")
def http_sql_scan(spark, sf):
    def transport(sql: str):
        import duckdb

        c = duckdb.connect()
        c.execute("CREATE TABLE src AS SELECT CAST(k AS BIGINT) AS k, 'v' || k AS v FROM range(0, 20) AS r(k)")
        rows = c.execute(sql.replace("FROM (src)", "FROM src")).fetchall()
        names = [d[0] for d in c.description]
        kinds = {"k": pa.int64(), "v": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=names)

    return remote.scan_http_sql(spark, "SELECT * FROM src", transport).filter(col("k").isin(3, 11)).to_df()


@query("SELECT TIMESTAMP '2024-01-01' + INTERVAL (i * 6) HOUR AS timestamp, CAST(i AS DOUBLE) AS value, 'a' AS host FROM range(2, 9) AS r(i)")
def metrics_scan(spark, sf):
    def transport(_: str, start: dt.datetime, end: dt.datetime) -> list[dict]:
        zero = dt.datetime(1970, 1, 1)
        day = dt.datetime(2024, 1, 1)
        points = [[int((day + dt.timedelta(hours=6 * i) - zero).total_seconds() * 1000), None if i == 9 else i] for i in range(12)]
        return [{"metric": "m", "tags": ["host:a"], "points": [p for p in points if start <= zero + dt.timedelta(milliseconds=p[0]) < end]}]

    f = remote.scan_metrics(spark, "m", transport, tags=["host"])
    return f.filter((col("timestamp") >= ts("2024-01-01 12:00:00")) & (col("timestamp") < ts("2024-01-03 12:00:00"))).select("timestamp", "value", "host").to_df()


@query("SELECT i AS id, i * 1.5 AS x FROM range(0, 5) AS r(i)")
def foreign_frame(spark, sf):
    return remote.from_foreign(spark, pa.table({"id": pa.array(range(5), pa.int64()), "x": pa.array([i * 1.5 for i in range(5)])}))


@query("SELECT 20000 AS n, true AS slope_0, true AS slope_1")
def synthetic_regression(spark, sf):
    df = synthetic.scan_synthetic_regression(spark, 20_000, 2, betas=[[2.0], [-3.0]], seed=7)
    return df.agg(F.count("*").cast("int").alias("n"), (F.abs(F.regr_slope("y0", "x0") - 2.0) < 0.1).alias("slope_0"), (F.abs(F.regr_slope("y0", "x1") + 3.0) < 0.1).alias("slope_1"))


@query("SELECT CAST(d AS DATE) AS date, CAST(4 AS BIGINT) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY) AS g(d) WHERE isodow(d) < 6")
def synthetic_panel(spark, sf):
    df = synthetic.scan_synthetic_panel(spark, dt.date(2024, 1, 1), dt.date(2024, 2, 15), 4, 2, categories=["sector"])
    return df.groupBy("date").agg(F.count_distinct("symbol").alias("n"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def logical_types(spark, sf):
    df = logical.encode(t(spark, sf, "events").select("event_id", "ts"), "ts", "datetime", "ms")
    return df.where(logical.compare(df, "ts", ">=", dt.datetime(2024, 1, 20)))


# ---- aggregation, windows, sets ------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(DISTINCT l_suppkey) AS supps FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def group_by_agg(spark, sf):
    li = t(spark, sf, "lineitem").where(col("l_shipdate") <= ts("2000-09-02"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count_distinct("l_suppkey").alias("supps"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_agg(spark, sf):
    return t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT p_brand, p_type, sum(p_size) AS size FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_agg(spark, sf):
    return t(spark, sf, "part").rollup("p_brand", "p_type").agg(F.sum("p_size").alias("size"))


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(ntile(4) OVER w AS BIGINT) AS q, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS BIGINT) AS dr,
round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)""")
def window_ranks(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    f = N.key_ranks(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], dense="l_quantity", tiles=4)
    return f.select("l_orderkey", "l_linenumber", "rn", "q", "dr", F.round("cd", 9).alias("cd"), F.round("pr", 9).alias("pr"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS mean_day FROM events")
def window_range(spark, sf):
    return t(spark, sf, "events").selectExpr("event_id", "round(avg(value) over (partition by user_id order by ts range between interval 1 day preceding and current row), 6) as mean_day")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, sf):
    a = t(spark, sf, "customer").select(col("c_nationkey").alias("k"))
    return a.intersect(t(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey")).subtract(t(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey"))


# ---- scalar vocabulary ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS fd, l_orderkey % 7 AS md, (l_quantity > 20) <> (l_discount > 0.05) AS x, l_quantity BETWEEN 5 AND 10 AS b, l_quantity >= 5 AND l_quantity < 10 AS bl, coalesce(nullif(l_linenumber, 1), 99) AS f FROM lineitem WHERE l_orderkey < 3000")
def scalar_operators(spark, sf):
    q = col("l_quantity")
    return t(spark, sf, "lineitem").where("l_orderkey < 3000").select(
        "l_orderkey", "l_linenumber", S.floor_div(col("l_orderkey"), lit(7)).alias("fd"), S.modulo(col("l_orderkey"), lit(7)).alias("md"), S.xor(q > 20, col("l_discount") > 0.05).alias("x"),
        S.is_between(q, 5, 10).alias("b"), S.is_between(q, 5, 10, "left").alias("bl"), S.BOOLEAN["fill_null"](F.nullif("l_linenumber", lit(1)), 99).alias("f"),
    )


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, reverse(p_brand) AS rv, length(p_name) AS n, strlen(p_name) AS nb, contains(p_type, 'A') AS c, starts_with(p_type, 'S') AS sw, left(p_name, 3) AS h, right(p_name, 3) AS tl,
CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS vowels, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, replace(p_type, 'A', '4') AS rep, lpad(CAST(p_size AS VARCHAR), CAST(greatest(4, length(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS z, split_part(p_type, ' ', 1) AS first, lower(hex(encode(p_brand))) AS hx FROM part""")
def scalar_strings(spark, sf):
    n, b, ty = col("p_name"), col("p_brand"), col("p_type")
    f = S.STRING
    return t(spark, sf, "part").select(
        "p_partkey", f["lower"](n).alias("lo"), f["upper"](b).alias("up"), f["reverse"](b).alias("rv"), f["len_chars"](n).cast("bigint").alias("n"), f["len_bytes"](n).cast("bigint").alias("nb"), f["contains"](ty, "A").alias("c"), f["starts_with"](ty, "S").alias("sw"),
        f["head"](n, 3).alias("h"), f["tail"](n, 3).alias("tl"), f["count_matches"](n, "[aeiou]").alias("vowels"), f["extract"](b, "([0-9]+)").alias("digits"), f["replace_literal"](ty, "A", "4").alias("rep"), f["zfill"](col("p_size").cast("string"), 4).alias("z"),
        F.get(f["split"](ty, " "), lit(0)).alias("first"), f["hex_encode"](b).alias("hx"),
    )


@query("""SELECT event_id, year(ts) AS y, CAST(quarter(ts) AS BIGINT) AS q, month(ts) AS m, week(ts) AS w, isodow(ts) AS wd, day(ts) AS d, dayofyear(ts) AS od, hour(ts) AS h, minute(ts) AS mi, CAST(ts AS DATE) AS dd, date_trunc('hour', ts) AS th, last_day(CAST(ts AS DATE)) AS me, epoch_us(ts) AS us, ts + INTERVAL 90 MINUTE AS o FROM events""")
def scalar_temporal(spark, sf):
    x, f = col("ts"), S.TEMPORAL
    return t(spark, sf, "events").select(
        "event_id", f["year"](x).cast("bigint").alias("y"), f["quarter"](x).cast("bigint").alias("q"), f["month"](x).cast("bigint").alias("m"), f["week"](x).cast("bigint").alias("w"), f["weekday"](x).cast("bigint").alias("wd"), f["day"](x).cast("bigint").alias("d"), f["ordinal_day"](x).cast("bigint").alias("od"),
        f["hour"](x).cast("bigint").alias("h"), f["minute"](x).cast("bigint").alias("mi"), f["date"](x).alias("dd"), S.truncate(x, 3_600_000_000).alias("th"), f["month_end"](f["date"](x)).alias("me"), f["timestamp"](x).alias("us"), f["offset_by"](x, mins=90).alias("o"),
    )


@query("""WITH a AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS p, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(len(p) AS INTEGER) AS n, list_min(p) AS lo, list_max(p) AS hi, round(list_sum(p), 2) AS sm, round(list_aggregate(p, 'median'), 4) AS md, round(list_aggregate(p, 'stddev_samp'), 4) AS sd, CAST(len(list_distinct(s)) AS INTEGER) AS u, array_to_string(list_reverse(s), '-') AS r, list_contains(s, 'P') AS has, list_position(p, list_max(p)) - 1 AS am FROM a""")
def scalar_lists(spark, sf):
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus")))
    a = t(spark, sf, "orders").groupBy("o_custkey").agg(pairs.alias("x")).select("o_custkey", col("x.o_totalprice").alias("p"), col("x.o_orderstatus").alias("s"))
    p, s, f = col("p"), col("s"), S.LIST
    return a.select(
        "o_custkey", f["len"](p).alias("n"), f["min"](p).alias("lo"), f["max"](p).alias("hi"), F.round(f["sum"](p), 2).alias("sm"), F.round(f["median"](p), 4).alias("md"), F.round(f["std"](p), 4).alias("sd"), f["n_unique"](s).alias("u"), f["join"](f["reverse"](s), "-").alias("r"),
        f["contains"](s, "P").alias("has"), f["arg_max"](p).cast("int").alias("am"),
    )


@query("SELECT c_custkey, bit_count(c_custkey) AS ones, round(sin(c_acctbal), 9) AS s, round(atan(c_acctbal), 9) AS a, round(degrees(c_nationkey), 6) AS d, round(tanh(c_nationkey), 9) AS th, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM customer JOIN events ON event_id = c_custkey")
def scalar_numeric_json(spark, sf):
    f = S.TRIGONOMETRIC
    e = t(spark, sf, "events").select("event_id", "props")
    c = t(spark, sf, "customer").join(e, col("event_id") == col("c_custkey"))
    return c.select("c_custkey", S.BITWISE["count_ones"](col("c_custkey")).alias("ones"), F.round(f["sin"](col("c_acctbal")), 9).alias("s"), F.round(f["arctan"](col("c_acctbal")), 9).alias("a"), F.round(f["degrees"](col("c_nationkey")), 6).alias("d"), F.round(f["tanh"](col("c_nationkey")), 9).alias("th"), S.STRING["json_path_match"](col("props"), "$.k").cast("bigint").alias("k"))


@query("""SELECT c_custkey, c_name AS nm, c_nationkey + 1 AS nk, octet_length(encode(c_name)) AS size, lower(hex(encode(c_name))) AS hx, base64(encode(c_name)) AS b64, contains(c_name, '00') AS has, starts_with(c_name, 'Cust') AS st FROM customer""")
def scalar_structs_and_bytes(spark, sf):
    s = F.struct(col("c_name").alias("a"), col("c_nationkey").alias("b"))
    s = S.STRUCT["rename_fields"](S.STRUCT["with_field"](s, "b", col("c_nationkey") + 1), ["a", "b"], ["x", "y"])
    y, f = F.encode(col("c_name"), "UTF-8"), S.BINARY
    return t(spark, sf, "customer").select(
        "c_custkey", S.STRUCT["field"](s, "x").alias("nm"), S.STRUCT["field"](s, "y").alias("nk"), f["size"](y).cast("bigint").alias("size"), f["hex_encode"](y).alias("hx"), f["base64_encode"](y).alias("b64"),
        f["contains"](y, F.encode(lit("00"), "UTF-8")).alias("has"), f["starts_with"](y, F.encode(lit("Cust"), "UTF-8")).alias("st"),
    )


@query("""SELECT event_id, CAST(ceil(year(ts) / 100.0) AS BIGINT) AS ce, (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 AS leap, CAST(isoyear(ts) AS BIGINT) AS iy, second(ts) AS sec, CAST(microsecond(ts) % 1000000 AS BIGINT) AS us, strftime(ts, '%Y/%m/%d %H') AS txt,
CAST(date_trunc('month', ts) AS DATE) AS ms, CAST(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts) AS BIGINT) // 86400000000 AS days, CAST(ts + INTERVAL 2 MONTH AS DATE) AS later FROM events""")
def scalar_calendar(spark, sf):
    x, f = col("ts"), S.TEMPORAL
    return t(spark, sf, "events").select(
        "event_id", f["century"](x).cast("bigint").alias("ce"), f["is_leap_year"](x).alias("leap"), f["iso_year"](x).cast("bigint").alias("iy"), f["second"](x).cast("bigint").alias("sec"), f["microsecond"](x).cast("bigint").alias("us"), f["to_string"](x, "yyyy/MM/dd HH").alias("txt"),
        f["month_start"](x).alias("ms"), f["total_days"](x, ts("2024-06-01")).cast("bigint").alias("days"), f["date"](f["offset_months"](x, 2)).alias("later"),
    )


@query("""SELECT p_partkey, bit_count(p_size) AS ones, 32 - bit_count(p_size) AS zeros, CAST(p_size & 12 AS INTEGER) AS a, round(cos(p_size), 9) AS c, round(sqrt(p_size) / 8, 9) AS s8, round(asin(p_size / 64), 9) AS asn, round(acos(p_size / 64), 9) AS acs, round(sinh(p_size / 10), 6) AS sh, round(radians(p_size), 9) AS r,
p_size IN (1, 5, 9) AS isin, CAST(count(*) OVER (PARTITION BY p_type) = 1 AS BOOLEAN) AS uniq, (p_size > 10 AND p_retailprice > 1000) AS al, (p_size > 10 OR p_retailprice > 1000) AS an FROM part""")
def scalar_bits_angles_booleans(spark, sf):
    n, g, b = col("p_size"), S.TRIGONOMETRIC, S.BOOLEAN
    many = [n > 10, col("p_retailprice") > 1000]
    return t(spark, sf, "part").select(
        "p_partkey", S.BITWISE["count_ones"](n).cast("bigint").alias("ones"), S.BITWISE["count_zeros"](n, 32).cast("bigint").alias("zeros"), n.bitwiseAND(12).alias("a"), F.round(g["cos"](n), 9).alias("c"), F.round(F.sqrt(n) / 8, 9).alias("s8"), F.round(g["arcsin"](n / 64), 9).alias("asn"),
        F.round(g["arccos"](n / 64), 9).alias("acs"), F.round(g["sinh"](n / 10), 6).alias("sh"), F.round(g["radians"](n), 9).alias("r"), b["is_in"](n, [1, 5, 9]).alias("isin"), b["is_unique"](col("p_type")).alias("uniq"), b["all_horizontal"](*many).alias("al"), b["any_horizontal"](*many).alias("an"),
    )
