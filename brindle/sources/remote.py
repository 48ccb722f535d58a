"""Systems behind a query text: JDBC databases, SQL over HTTP with Arrow streams, metrics over HTTP, foreign frames.

Transports are plain callables, so tests need no network.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..plans import predicate as P
from ..plans.frame import PushFrame, Request, plain


def scan_db(spark: SparkSession, query: str, url: str, *, fetch_size: int = 10_000, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A database query over JDBC.  Spark wraps it as a subquery and pushes filters, columns and limits; dialects are Spark's.

    ``split`` (column, low, high, tasks) reads in so many tasks by ranges of a number or time; rows outside
    of it and nulls are read as well.
    """
    if split is not None:
        column, low, high, tasks = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
        return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", fetchsize=str(fetch_size), **options).load()
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch_size), **options).load()


def wrap_query(query: str, r: Request, quote: str = '"', columns: Sequence[str] | None = None, limit: int | None = None) -> str:
    """``query`` as a subquery under what of the request translates to SQL."""
    if limit == 0:
        return f"SELECT * FROM ({query}) AS q LIMIT 0"
    wanted = ", ".join(f"{quote}{c}{quote}" for c in columns) if columns else "*"
    sql = f"SELECT {wanted} FROM ({query}) AS q"
    where = P.to_sql(r.predicate, quote) if r.predicate is not None else None
    sql = f"{sql} WHERE {where}" if where else sql
    return sql if r.limit is None or r.predicate is not None else f"{sql} LIMIT {r.limit}"


def scan_http_sql(spark: SparkSession, query: str, transport: Callable[[str], Iterator[pa.RecordBatch]], *, quote: str = '"', schema: T.StructType | None = None) -> PushFrame:
    """A query over HTTP whose ``transport`` (called on an executor) turns SQL text into Arrow batches.

    Without ``schema`` one ``LIMIT 0`` request on the driver finds it.
    """
    if schema is None:
        batches = list(transport(wrap_query(query, Request(), quote, limit=0)))
        schema = from_arrow_schema(batches[0].schema, prefer_timestamp_ntz=True)

    def build(r: Request) -> DataFrame:
        columns = list(r.columns) if r.columns is not None else schema.names
        out = T.StructType([schema[c] for c in columns])
        sql = wrap_query(query, r, quote, columns)
        arrow = to_arrow_schema(out, timestamp_utc=False)

        def fetch(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in transport(sql):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in arrow], schema=arrow)

        return spark.range(0, 1, 1, 1).mapInArrow(fetch, out)

    return PushFrame(build, "scan_http_sql", shape=spark.createDataFrame([], schema))


def sink_http_sql(frame: DataFrame | PushFrame, table: str, transport: Callable[[str, bytes], None], *, chunk_size: int = 10_000) -> None:
    """``INSERT`` Arrow streams of at most ``chunk_size`` rows, from the executors; not transactional.

    Intervals go as integers of microseconds.
    """
    df = plain(frame)
    for f in df.schema:
        if isinstance(f.dataType, T.DayTimeIntervalType):
            df = df.withColumn(f.name, F.expr(f"cast(extract(second from `{f.name}`) * 1000000 as bigint) + cast(extract(minute from `{f.name}`) as bigint) * 60000000 + cast(extract(hour from `{f.name}`) as bigint) * 3600000000 + cast(extract(day from `{f.name}`) as bigint) * 86400000000"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_size):
                part = batch.slice(at, chunk_size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                transport(f"INSERT INTO {table} FORMAT ArrowStream", sink.getvalue().to_pybytes())
                sent += part.num_rows
        yield pa.RecordBatch.from_pydict({"sent": [sent]})

    df.mapInArrow(send, "sent bigint").agg(F.sum("sent")).collect()


def time_slices(start: dt.datetime, end: dt.datetime, most: dt.timedelta) -> list[tuple[dt.datetime, dt.datetime]]:
    """Consecutive slices [from, to) of at most ``most``."""
    if most <= dt.timedelta(0):
        raise ValueError("slices need a positive length")
    out = []
    while start < end:
        out.append((start, min(end, start + most)))
        start += most
    return out


#: Fixed columns of a metrics answer; absent ones are null.
METRIC_FIELDS = "timestamp timestamp_ntz, value double, unit string, query_index bigint, aggr string, metric string, expression string, scope string, interval bigint, length bigint, start timestamp_ntz, end timestamp_ntz, display_name string"


def scan_metrics(spark: SparkSession, query: str, transport: Callable[[str, dt.datetime, dt.datetime], list[dict]], *, tags: Sequence[str] = (), slice_seconds: int = 86_400, now: Callable[[], dt.datetime] | None = None) -> PushFrame:
    """Points of a metrics query.  The filter must bound ``timestamp`` from below; the range is cut into slices, one task each.

    ``transport(query, from, to)`` returns series: dicts with ``points`` ([time in ms, value]), ``tags``
    ("key:value") and any fixed field.  Points without value are left out.  Without an upper bound the
    range ends now.
    """
    spark_schema = T._parse_datatype_string(METRIC_FIELDS)
    for t in tags:
        spark_schema = spark_schema.add(t, "string")

    def build(r: Request) -> DataFrame:
        span = P.ranges(r.predicate, "timestamp").to_datetimes()
        if span.is_empty():
            return spark.createDataFrame([], spark_schema)
        if any(p.low is None for p in span.parts):
            raise ValueError("the filter must bound timestamp from below")
        end = (now or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))()
        pieces = [s for p in span.parts for s in time_slices(p.low, (p.high if p.high_open else p.high + dt.timedelta(microseconds=1)) if p.high is not None else end, dt.timedelta(seconds=slice_seconds))]
        if not pieces:
            return spark.createDataFrame([], spark_schema)
        arrow = to_arrow_schema(spark_schema, timestamp_utc=False)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    rows = []
                    for series in transport(query, *pieces[i]):
                        own = dict(x.split(":", 1) for x in series.get("tags", ()) if ":" in x)
                        for ms, value in series["points"]:
                            at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
                            if value is not None and pieces[i][0] <= at < pieces[i][1]:
                                rows.append({**{f.name: series.get(f.name, own.get(f.name)) for f in arrow}, "timestamp": at, "value": float(value)})
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return spark.range(0, len(pieces), 1, len(pieces)).mapInArrow(fetch, spark_schema)

    return PushFrame(build, "scan_metrics", shape=spark.createDataFrame([], spark_schema), bounded=True)


def from_foreign(spark: SparkSession, obj) -> DataFrame:
    """A DataFrame from pandas, an Arrow table or reader, or an object with ``to_arrow_table``; Spark's own passes through."""
    if isinstance(obj, DataFrame):
        return obj
    if isinstance(obj, PushFrame):
        return obj.to_df()
    if hasattr(obj, "to_arrow_table"):
        obj = obj.to_arrow_table()
    if isinstance(obj, pa.RecordBatchReader):
        obj = obj.read_all()
    return spark.createDataFrame(obj)
