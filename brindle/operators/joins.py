"""Joins that carry filters across: key harvest, as-of, interval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import predicate as P
from ..plans.frame import PushFrame, Request, is_naive, narrowed, plain, size_of

Frame = DataFrame | PushFrame
#: Distinct key values up to which a harvested list is pushed; beyond, a range and a semi join.
HARVEST = 10_000
#: Estimated bytes below which a right DataFrame is read whole: a harvest would cost more than it saves.
LEAST = 64 << 20
#: Right rows up to which a join in time without keys looks their times up in one array.
LOOKUP = 1_000


def join_keys(on, left_on, right_on) -> tuple[list[str], list[str]]:
    """Exactly one of ``on`` and the pair; equal, non-zero lengths."""

    def names(x) -> list[str]:
        return [x] if isinstance(x, str) else list(x)

    if (on is None) == (left_on is None and right_on is None):
        raise ValueError("give either on or both left_on and right_on")
    if on is not None:
        return names(on), names(on)
    if left_on is None or right_on is None:
        raise ValueError("left_on and right_on go together")
    a, b = names(left_on), names(right_on)
    if len(a) != len(b) or not a:
        raise ValueError("left_on and right_on must name equally many columns")
    return a, b


def _output(left_cols: list[str], right_cols: list[str], keys: list[str], suffix: str) -> dict[str, str]:
    """Right column -> output name; the right side's keys are not repeated."""
    return {c: f"{c}{suffix}" if c in left_cols else c for c in right_cols if c not in keys}


def filtered_join(left: Frame, right: Frame, on=None, how: str = "inner", *, left_on=None, right_on=None, nulls_equal: bool = False, suffix: str = "_right", harvest: int = HARVEST, least: int = LEAST) -> PushFrame:
    """Join whose right side is read only for the keys the filtered left side holds.

    The distinct keys are harvested from the left side (under that part of the filter that concerns it) in
    one pass for all key columns.  Up to ``harvest`` of them they become an ``IN`` filter per column that
    reaches the right scan; beyond, a range filter and a semi join, at the cost of a second pass.  An empty
    left side leaves the right unread.  A right DataFrame of less than ``least`` estimated bytes is read
    whole; other frames (databases, caches, ...) never are.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if nulls_equal:
        raise ValueError("null keys never match")
    lk, rk = join_keys(on, left_on, right_on)
    names = _output(left.columns, right.columns, rk, suffix)

    def build(r: Request) -> DataFrame:
        mine = P.restrict(r.predicate, left.columns)
        need = None if r.columns is None else (*r.columns, *lk)
        a = narrowed(left, None if mine is None else P.to_column(mine), need)
        wanted = list(names) if r.columns is None else [c for c in names if names[c] in r.columns]
        cond = None
        if not is_naive() and (isinstance(right, PushFrame) or size_of(right) >= least):
            cond, exact = _harvested(a, lk, rk, harvest)
        b = narrowed(right, cond, (*rk, *wanted))
        if cond is not None and not exact:
            distinct = a.select(*(F.col(f"`{x}`").alias(f"_k{i}") for i, x in enumerate(lk))).distinct()
            b = b.join(distinct, [F.col(f"`{y}`") == F.col(f"_k{i}") for i, y in enumerate(rk)], "left_semi")
        b = b.select(*(F.col(f"`{y}`").alias(f"_r{i}") for i, y in enumerate(rk)), *(F.col(f"`{c}`").alias(names[c]) for c in wanted))
        out = a.join(b, [F.col(f"`{x}`") == F.col(f"_r{i}") for i, x in enumerate(lk)], how)
        return out.drop(*(f"_r{i}" for i in range(len(rk))))

    return PushFrame(build, "filtered_join")


def _harvested(a: DataFrame, lk: list[str], rk: list[str], limit: int) -> tuple[Column, bool]:
    """A filter on the right keys, one column at a time (a superset for several), and whether lists sufficed."""
    names = [f"k{i}" for i in range(len(lk))]
    keys = a.select(*(F.col(f"`{x}`").alias(k) for x, k in zip(lk, names))).dropna()
    got = keys.distinct().limit(limit + 1).collect()
    out = F.lit(True)
    if len(got) <= limit:
        for y, k in zip(rk, names):
            values = list(dict.fromkeys(r[k] for r in got))
            out = out & (F.col(f"`{y}`").isin(values) if values else F.lit(False))
        return out, True
    ends = keys.agg(*(F.min(k).alias(f"{k}_low") for k in names), *(F.max(k).alias(f"{k}_high") for k in names)).head()
    for y, k in zip(rk, names):
        out = out & F.col(f"`{y}`").between(ends[f"{k}_low"], ends[f"{k}_high"])
    return out, False


def _asof(a: DataFrame, b: DataFrame, lt: str, rt: str, by_left: list[str], by_right: list[str], strategy: str, tolerance, right_cols: dict[str, str]) -> DataFrame:
    """For each left row the right row last in time up to it (first from it on, or the nearer of the two).

    Rows of equal time match; among right rows of equal time the one that is largest as a struct of all
    its columns wins; of two equally near rows the earlier.  With keys, the union of both sides is sorted
    once per key and direction.  Without, few right times are looked up in an array (no sort, no shuffle of the
    left side); many are cut into ranges of time that hand their last row on to the next.
    """
    kind = a.schema[lt].dataType
    by = [f"_b{i}" for i in range(len(by_left))]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(a.columns)))
    payload = F.struct(F.col(f"`{rt}`").cast(kind).alias("_t"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(right_cols)))
    left = a.select(*(F.col(f"`{x}`").alias(n) for x, n in zip(by_left, by)), F.col(f"`{lt}`").alias("_t"), row.alias("_l"))
    right = b.select(*(F.col(f"`{x}`").alias(n) for x, n in zip(by_right, by)), F.col(f"`{rt}`").cast(kind).alias("_t"), payload.alias("_p"))
    right = right.where("_t is not null")
    for n in by:
        right = right.where(F.col(n).isNotNull())
    ways = {"backward": ["_x"], "forward": ["_y"], "nearest": ["_x", "_y"]}[strategy]
    if by or is_naive():
        out = _by_window(left, right, by, ways)
    else:
        # stops early on a large right side
        few = right.select("_t").limit(LOOKUP + 1).collect()
        out = _by_lookup(left, right, sorted({r[0] for r in few}), ways) if len(few) <= LOOKUP else _by_ranges(left, right, ways)
    if strategy == "nearest":
        dx, dy = F.abs(_diff(F.col("_t"), F.col("_x._t"), kind)), F.abs(_diff(F.col("_t"), F.col("_y._t"), kind))
        m = F.when(F.col("_y").isNull() | (dx <= dy), F.col("_x")).otherwise(F.col("_y"))
    else:
        m = F.col(ways[0])
    out = out.withColumn("_m", m)
    ok = F.col("_m").isNotNull() & F.col("_t").isNotNull()
    for n in by:
        ok = ok & F.col(n).isNotNull()
    if tolerance is not None:
        most = tolerance / dt.timedelta(microseconds=1) if isinstance(tolerance, dt.timedelta) else tolerance
        ok = ok & (F.abs(_diff(F.col("_t"), F.col("_m._t"), kind)) <= F.lit(most))
    out = out.withColumn("_m", F.when(ok, F.col("_m")))
    return out.select(*(F.col(f"_l.c{i}").alias(c) for i, c in enumerate(a.columns)), *(F.col(f"_m.c{i}").alias(n) for i, n in enumerate(right_cols.values())))


def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides under each other; ``_s`` is 1 on the left."""
    return left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(0)), allowMissingColumns=True)


def _seen(group, way: str) -> Column:
    """The last right row so far, in time (``_x``) or against it (``_y``)."""
    order = F.col("_t") if way == "_x" else F.desc("_t")
    return F.last("_p", True).over(group.orderBy(order, "_s", "_p").rowsBetween(Window.unboundedPreceding, 0))


def _by_window(left: DataFrame, right: DataFrame, by: list[str], ways: list[str]) -> DataFrame:
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = _merged(left, right)
    for way in ways:
        out = out.withColumn(way, _seen(group, way))
    return out.where("_s = 1")


def _place(t: str, bounds: list, kind: T.DataType, below: str) -> Column:
    """How many of the sorted ``bounds`` are ``below`` (``<`` or ``<=``) the time: a binary search."""
    array = F.array(*(F.lit(x).cast(kind) for x in bounds))
    steps = max(1, len(bounds).bit_length())
    last = F.lit(len(bounds))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        goes = F.coalesce(F.get(array, mid) <= F.col(t) if below == "<=" else F.get(array, mid) < F.col(t), F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & goes, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~goes, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), last.alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def _by_lookup(left: DataFrame, right: DataFrame, times: list, ways: list[str]) -> DataFrame:
    """At most ``LOOKUP`` right times: the left side looks up its place among them and gets that row by a broadcast join."""
    kind = right.schema["_t"].dataType
    if not times:
        return left.withColumns({way: F.lit(None).cast(right.schema["_p"].dataType) for way in ways})
    best = right.groupBy("_t").agg(F.max("_p").alias("_p")).withColumn("_i", _place("_t", times, kind, "<"))
    out = left
    for way in ways:
        at = F.when(F.col("_t").isNotNull(), _place("_t", times, kind, "<=") - 1 if way == "_x" else _place("_t", times, kind, "<"))
        out = out.withColumn("_at", at).join(F.broadcast(best.select(F.col("_i").alias("_at"), F.col("_p").alias(way))), "_at", "left").drop("_at")
    return out


def _by_ranges(left: DataFrame, right: DataFrame, ways: list[str]) -> DataFrame:
    """Ranges of time of about equal size, sorted each on its own; what a range has not seen comes from its neighbours' last row.

    The neighbours' rows are one per range, so their table is small whatever the sides hold.  A time that a large share of all rows
    has is one range.
    """
    spark = left.sparkSession
    kind = right.schema["_t"].dataType
    both = _merged(left, right)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = _micros(F.col("_t"), kind) if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else F.unix_date("_t") if isinstance(kind, T.DateType) else F.col("_t")
    cuts = both.select(F.percentile_approx(number, [i / n for i in range(1, n)], 10 * n)).head()[0] or []
    both = both.withColumn("_k", number)
    both = both.withColumn("_r", F.coalesce(_place("_k", sorted(set(cuts)), both.schema["_k"].dataType, "<="), F.lit(0)) if cuts else F.lit(0))
    group, whole = Window.partitionBy("_r"), Window.partitionBy(F.lit(0))
    ends = right.withColumn("_k", number)
    ends = ends.withColumn("_r", _place("_k", sorted(set(cuts)), both.schema["_k"].dataType, "<=") if cuts else F.lit(0))
    out = both
    for way in ways:
        order, top = ("_r", F.max_by("_p", F.struct("_t", "_p"))) if way == "_x" else (F.desc("_r"), F.max("_p"))
        if way == "_y":  # the earliest time, and there the largest row
            first = ends.join(ends.groupBy("_r").agg(F.min("_t").alias("_t")), ["_r", "_t"])
        else:
            first = ends
        rows = first.groupBy("_r").agg(top.alias("_e"))
        known = spark.range(len(set(cuts)) + 1).select(F.col("id").cast("int").alias("_r")).join(rows, "_r", "left")
        hand = known.withColumn("_h", F.last("_e", True).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).select("_r", "_h")
        out = out.withColumn(way, _seen(group, way)).join(F.broadcast(hand), "_r", "left").withColumn(way, F.coalesce(way, "_h")).drop("_h")
    return out.where("_s = 1")


def _micros(x: Column, kind: T.DataType) -> Column:
    """Microseconds of a time, by its own fields where it has no zone, so that they rise with it in every session zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    second = (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("bigint")
    return F.unix_date(F.to_date(x)).cast("bigint") * 86_400_000_000 + F.hour(x) * F.lit(3_600_000_000).cast("bigint") + F.minute(x) * F.lit(60_000_000).cast("bigint") + second


def _diff(x: Column, y: Column, kind: T.DataType) -> Column:
    """A distance: microseconds between times, days as microseconds between dates, else the difference."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _micros(x, kind) - _micros(y, kind)
    if isinstance(kind, T.DateType):
        return F.datediff(x, y).cast("bigint") * 86_400_000_000
    return x - y


def filtered_join_asof(left: Frame, right: Frame, *, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by=None, by_left=None, by_right=None, strategy: str = "backward", tolerance=None, suffix: str = "_right") -> PushFrame:
    """As-of left join.  A filter on the left time, widened by the tolerance, also narrows the right side.

    Null times and null ``by`` keys match nothing.  With different time columns the right one stays.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    (lt,), (rt,) = join_keys(on, left_on, right_on)
    bl, br = join_keys(by, by_left, by_right) if by is not None or by_left is not None or by_right is not None else ([], [])
    skip = [*br, rt] if lt == rt else br
    names = _output(left.columns, right.columns, skip, suffix)

    def build(r: Request) -> DataFrame:
        mine = P.restrict(r.predicate, left.columns)
        a = narrowed(left, None if mine is None else P.to_column(mine), None if r.columns is None else (*r.columns, lt, *bl))
        wanted = {c: n for c, n in names.items() if r.columns is None or n in r.columns}
        cond = None
        if r.predicate is not None:
            cond = _by_filter(r.predicate, bl, br)
            span = P.ranges(r.predicate, lt)
            temporal = isinstance(plain(left).schema[lt].dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)) if not span.is_universe() else False
            if temporal:
                span = span.to_datetimes()
                wide = tolerance if isinstance(tolerance, dt.timedelta) else None
                if wide is not None or tolerance is None:
                    back = wide if strategy in ("backward", "nearest") else None
                    ahead = wide if strategy in ("forward", "nearest") else None
                    span = span.shift(back, ahead).whole_days()
                    if wide is None:  # without tolerance one side of the range is open
                        span = P.IntervalSet([P.Interval(None if strategy != "forward" else p.low, None if strategy != "backward" else p.high, p.low_open, p.high_open) for p in span.parts])
                    if isinstance(plain(right).schema[rt].dataType, T.DateType):
                        span = span.to_dates()
                    c = P.interval_filter(span, rt)
                    cond = c if cond is None else cond if c is None else cond & c
        b = narrowed(right, cond, (rt, *br, *wanted))
        return _asof(a, b, lt, rt, bl, br, strategy, tolerance, wanted)

    return PushFrame(build, "filtered_join_asof")


def _by_filter(p: P.Predicate, bl: list[str], br: list[str]) -> Column | None:
    """The part of a filter that concerns the ``by`` keys, in the right side's names; opaque leaves only under equal names."""
    part = P.restrict(p, bl)
    if part is None:
        return None
    if bl != br and _opaque(part):
        return None
    return P.to_column(part, dict(zip(bl, br)))


def _opaque(p: P.Predicate) -> bool:
    return p.op == "opaque" if isinstance(p, P.Leaf) else any(map(_opaque, p.parts))


def join_between(left: Frame, right: Frame, left_on: str, right_on_start: str, right_on_end: str, by=None, how: str = "left", suffix: str = "_right") -> PushFrame:
    """The interval with the latest start not after the point, if the point is not after its end (both ends included).

    At most one match: an earlier interval that also holds the point does not count.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    names = _output(left.columns, right.columns, keys, suffix)

    def build(r: Request) -> DataFrame:
        mine = P.restrict(r.predicate, left.columns)
        a = narrowed(left, None if mine is None else P.to_column(mine))
        cond = None if r.predicate is None else _by_filter(r.predicate, keys, keys)
        b = narrowed(right, cond)
        out = _asof(a, b, left_on, right_on_start, keys, keys, "backward", None, names)
        start, end = names[right_on_start], names[right_on_end]
        held = F.col(f"`{left_on}`") <= F.col(f"`{end}`")
        if how == "inner":
            return out.where(held)
        return out.select(*(F.col(f"`{c}`") for c in a.columns), *(F.when(held, F.col(f"`{n}`")).alias(n) for n in names.values()))

    return PushFrame(build, "join_between")
