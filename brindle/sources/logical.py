"""Logical types that Spark lacks, kept as integers with the type in column metadata.

A duration, or a time or timestamp finer than microseconds, is a bigint whose metadata names the kind and
the unit.  Filters written against the logical value are rewritten to compare the stored integers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "brindle.logical"
PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def encode(df: DataFrame, column: str, kind: str, unit: str = "us") -> DataFrame:
    """Store an interval or timestamp column as integers of ``unit``."""
    if kind not in ("duration", "datetime") or unit not in PER_SECOND:
        raise ValueError("kind is duration or datetime; unit s, ms, us or ns")
    c = F.col(f"`{column}`")
    micros = F.unix_micros(c.cast("timestamp")) if kind == "datetime" else (F.expr(f"cast(extract(day from `{column}`) as bigint) * 86400000000 + cast(extract(hour from `{column}`) as bigint) * 3600000000 + cast(extract(minute from `{column}`) as bigint) * 60000000 + cast(extract(second from `{column}`) * 1000000 as bigint)"))
    per = PER_SECOND[unit]
    stored = micros * (per // 1_000_000) if per >= 1_000_000 else F.floor(micros / (1_000_000 // per))
    return df.withColumn(column, stored.cast("bigint").alias(column, metadata={KEY: {"kind": kind, "unit": unit}}))


def mapping(df: DataFrame) -> dict[str, tuple[str, str]]:
    """Column -> (kind, unit) for the logical columns of ``df``."""
    return {f.name: (f.metadata[KEY]["kind"], f.metadata[KEY]["unit"]) for f in df.schema if KEY in f.metadata}


def stored(value: dt.timedelta | dt.datetime, unit: str) -> float:
    """The integer (or fraction) that stands for a logical value."""
    delta = value if isinstance(value, dt.timedelta) else value - dt.datetime(1970, 1, 1)
    micros = delta // dt.timedelta(microseconds=1)
    per = PER_SECOND[unit]
    return micros * (per // 1_000_000) if per >= 1_000_000 else micros / (1_000_000 // per)


def compare(df: DataFrame, column: str, op: str, value: dt.timedelta | dt.datetime) -> Column:
    """A pushable filter ``column op value`` on the stored integers."""
    v = stored(value, mapping(df)[column][1])
    c = F.col(f"`{column}`")
    whole = int(v) if float(v).is_integer() else None
    if whole is None:  # between two storable values
        low = int(v // 1)
        return {"=": c.isNotNull() & F.lit(False), "!=": c.isNotNull(), "<": c <= low, "<=": c <= low, ">": c > low, ">=": c > low}[op]
    return {"=": c == whole, "!=": c != whole, "<": c < whole, "<=": c <= whole, ">": c > whole, ">=": c >= whole}[op]
