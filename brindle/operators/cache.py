"""In-memory column and partition cache, and a Parquet cache by calendar period."""

from __future__ import annotations

import datetime as dt
import enum
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import predicate as P
from ..plans.frame import PushFrame, Request, is_naive, narrowed, plain
from ..sources.files import delete, exists, read_text, write_text


class CacheMode(enum.Enum):
    """CACHE uses what is there and adds what is missing; IGNORE neither reads nor writes; REBUILD writes anew."""

    CACHE = "cache"
    IGNORE = "ignore"
    REBUILD = "rebuild"

    @classmethod
    def of(cls, mode: CacheMode | str | int) -> CacheMode:
        """From a name in any case, or a place in the order above, from 1."""
        try:
            return mode if isinstance(mode, cls) else list(cls)[range(1, 4).index(mode)] if isinstance(mode, int) else cls(str(mode).lower())
        except ValueError:
            raise ValueError(f"cache_mode must be one of {[m.value for m in cls]}") from None


def cache(frame: DataFrame | PushFrame, store: dict | None = None, *, order_by: str | Sequence[str], partition_cols: Sequence[str] = (), cache_mode: CacheMode | str = "cache", validate: bool = True) -> PushFrame:
    """Persist what was read, by plan, columns and partition; later requests read only what is missing.

    Blocks of columns are joined on ``order_by``, which must be unique (checked per block if
    ``validate``).  A filter that fixes finitely many values of the single partition column reads those
    partitions; otherwise everything is one block.
    """
    mode = CacheMode.of(cache_mode)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    parts = list(partition_cols)
    if not keys:
        raise ValueError("order_by names no column")
    if missing := [c for c in (*keys, *parts) if c not in frame.columns]:
        raise ValueError(f"no such columns: {missing}")
    store = {} if store is None else store
    base = plain(frame)
    plan = base.semanticHash()

    def block(where: tuple, columns: list[str]) -> DataFrame:
        """Columns of one partition (or of all), from the blocks at hand and at most one new read."""
        at = (plan, tuple(keys), where)
        have: list[DataFrame] = store.setdefault(at, []) if mode is CacheMode.CACHE else store.update({at: []}) or store[at]
        known = {c for b in have for c in b.columns}
        if lacking := [c for c in columns if c not in known]:
            df = base
            for c, v in where:
                df = df.filter(F.col(f"`{c}`").isNull() if v is None else F.col(f"`{c}`") == P.literal(v))
            new = df.select(*dict.fromkeys([*keys, *lacking])).persist()
            if validate and new.groupBy(*keys).count().where("count > 1").head(1):
                new.unpersist()
                raise ValueError(f"order_by {keys} is not unique")
            have.append(new)
        used = [b for b in have if set(b.columns) & (set(columns) | set(keys))]
        out = used[0]
        for b in used[1:]:
            more = [c for c in b.columns if c not in out.columns]
            if more:
                out = out.join(b.select(*keys, *more), keys)
        return out.select(*columns)

    def build(r: Request) -> DataFrame:
        if mode is CacheMode.IGNORE or is_naive():
            return base
        columns = list(dict.fromkeys([*(r.columns or base.columns)]))
        values = P.values(r.predicate, parts[0]) if len(parts) == 1 else None
        if values is None:
            return block((), columns)
        blocks = [block(((parts[0], v),), columns) for v in sorted(values, key=repr)]
        return reduce(DataFrame.unionAll, blocks) if blocks else base.select(*columns).limit(0)

    return PushFrame(build, "cache", shape=base)


#: The period of rows with a null date.
UNKNOWN = "unknown"
UNITS = {"daily": ("$year", "$month", "$day"), "monthly": ("$year", "$month"), "yearly": ("$year",)}
FORMATS = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}


def period_of(day: dt.date, unit: str) -> str:
    return day.strftime({"daily": "%Y-%m-%d", "monthly": "%Y-%m", "yearly": "%Y"}[unit])


def period_bounds(period: str, unit: str) -> tuple[dt.date, dt.date]:
    """First day, and first day after."""
    n = [int(x) for x in period.split("-")]
    start = dt.date(n[0], n[1] if len(n) > 1 else 1, n[2] if len(n) > 2 else 1)
    if unit == "daily":
        return start, start + dt.timedelta(days=1)
    if unit == "yearly":
        return start, dt.date(start.year + 1, 1, 1)
    return start, dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)


def periods_in(p: P.Predicate | None, column: str, unit: str, most: int = 100_000) -> list[str] | None:
    """The periods a filter can touch; None if they are not finitely many.  A contradiction touches none."""
    span = P.ranges(p, column).to_datetimes()
    out: dict[str, None] = {}
    for i in span.parts:
        if i.low is None or i.high is None:
            return None
        at = i.low.date()
        last = (i.high - dt.timedelta(microseconds=1)).date() if i.high_open else i.high.date()
        while at <= last:
            name = period_of(at, unit)
            out[name] = None
            at = period_bounds(name, unit)[1]
            if len(out) > most:
                return None
    return list(out)


class ParquetCache:
    """Periods of an upstream as Parquet directories with a manifest.

    The manifest names the periods that are complete, empty ones included; it is replaced after the data
    are written, so a failed write leaves the cache as it was.  Rows with a null date are a period of their
    own, ``unknown``.  A manifest written with another unit, column, bounding, schema or ``version`` (the
    caller's name for the state of the upstream) answers nothing: its periods are written anew.
    """

    def __init__(self, upstream: DataFrame | PushFrame | Callable[[], DataFrame], path: str, date_column: str, *, time_unit: str = "monthly", partition_format: str | None = None, cache_mode: CacheMode | str = "cache", bounding: str | None = None, extra_partition_cols: Sequence[str] = (), schema: T.StructType | None = None, version: str | None = None):
        if time_unit not in UNITS:
            raise ValueError(f"time_unit must be one of {list(UNITS)}")
        if partition_format is not None:
            used = {w for w in UNITS["daily"] if w in partition_format}
            if used != set(UNITS[time_unit]):
                raise ValueError(f"partition_format must use exactly {UNITS[time_unit]}")
        self.upstream, self.path, self.column, self.unit = upstream, path.rstrip("/"), date_column, time_unit
        self.mode, self.bounding, self.extra, self._schema, self.version = CacheMode.of(cache_mode), bounding, list(extra_partition_cols), schema, version
        self.queried: list[list[str] | None] = []

    def _up(self) -> DataFrame | PushFrame:
        if callable(self.upstream):
            self.upstream = self.upstream()
        return self.upstream

    def manifest(self, spark) -> dict:
        text = read_text(spark, f"{self.path}/_manifest.json")
        return json.loads(text) if text else {"periods": []}

    def _identity(self, schema: T.StructType) -> dict:
        return {"unit": self.unit, "column": self.column, "bounding": self.bounding, "schema": schema.simpleString(), "version": self.version}

    def _known(self, spark, schema: T.StructType) -> set[str]:
        """The complete periods of a manifest that is this cache's."""
        have = self.manifest(spark)
        return set(have["periods"]) if {k: v for k, v in have.items() if k != "periods"} == self._identity(schema) else set()

    def _period(self) -> Column:
        return F.coalesce(F.date_format(F.col(f"`{self.column}`"), FORMATS[self.unit]), F.lit(UNKNOWN))

    def frame(self, spark) -> PushFrame:
        shape = spark.createDataFrame([], self._schema) if self._schema is not None else plain(self._up()).limit(0)

        def build(r: Request) -> DataFrame:
            if self.mode is CacheMode.IGNORE or is_naive():
                return narrowed(self._up(), None if r.predicate is None else P.to_column(r.predicate))
            known = self._known(spark, shape.schema)
            wanted = periods_in(r.predicate, self.column, self.unit)
            if wanted is None:  # open range: what upstream has in it
                span = P.interval_filter(P.ranges(r.predicate, self.column), self.column)
                df = narrowed(self._up(), span)
                wanted = sorted(x.p for x in df.select(self._period().alias("p")).distinct().collect())
            missing = [p for p in wanted if p not in known or self.mode is CacheMode.REBUILD]
            if missing:
                self._write(spark, shape.schema, missing, known)
            if not wanted:
                return shape
            df = spark.read.schema(T.StructType([*shape.schema, T.StructField("_period", T.StringType())])).option("basePath", self.path).parquet(*[p for p in (f"{self.path}/_period={x}" for x in wanted) if exists(spark, p)] or [self._empty(spark, shape)])
            return df.drop("_period")

        return PushFrame(build, "parquet_cache", shape=shape)

    def _empty(self, spark, shape: DataFrame) -> str:
        path = f"{self.path}/_period=none"
        if not exists(spark, path):
            shape.write.mode("overwrite").parquet(path)
        return path

    def _write(self, spark, schema: T.StructType, missing: list[str], known: set[str]) -> None:
        """Whole missing periods, not the caller's filter; neighbouring ones are one range."""
        self.queried.append(list(missing))
        spans: list[list] = []
        for start, end in sorted(period_bounds(p, self.unit) for p in missing if p != UNKNOWN):
            if spans and spans[-1][1] == start:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        when = F.col(f"`{self.column}`")
        keep = reduce(lambda a, b: a | b, [*([when.isNull()] if UNKNOWN in missing else []), *((when >= F.lit(a)) & (when < F.lit(b)) for a, b in spans)])
        if self.bounding:
            keep = keep & F.expr(self.bounding)
        df = narrowed(self._up(), keep)
        for p in missing:
            delete(spark, f"{self.path}/_period={p}")
        df = df.withColumn("_period", self._period())
        # several tasks share a large period, however few dates it has; most files hold one period
        df = df.repartitionByRange("_period", *(f"`{c}`" for c in self.extra), when, F.xxhash64(*(F.col(f"`{c}`") for c in schema.names)))
        df.write.mode("append").partitionBy("_period").parquet(self.path)
        write_text(spark, f"{self.path}/_manifest.json", json.dumps({"periods": sorted(known | set(missing)), **self._identity(schema)}))


def cache_parquet(upstream, path: str, date_column: str, *, spark=None, **options) -> PushFrame:
    """A ``ParquetCache`` as a frame."""
    if spark is None:
        spark = plain(upstream).sparkSession
    return ParquetCache(upstream, path, date_column, **options).frame(spark)


def execute_by_period(frame: DataFrame | PushFrame, date_column: str, *, time_unit: str = "monthly") -> PushFrame:
    """Rows dealt by calendar period and sorted in time inside each; needs a filter that bounds the column."""

    def build(r: Request) -> DataFrame:
        if not is_naive():
            if r.predicate is None or not (names := periods_in(r.predicate, date_column, time_unit)):
                raise ValueError(f"a filter must bound {date_column} on both sides")
            df = narrowed(frame, P.to_column(r.predicate))
            unit = {"daily": "day", "monthly": "month", "yearly": "year"}[time_unit]
            return df.repartitionByRange(len(names), F.date_trunc(unit, F.col(date_column))).sortWithinPartitions(date_column)
        return plain(frame)

    return PushFrame(build, "execute_by_period", shape=plain(frame))
