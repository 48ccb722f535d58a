"""Compositions that hand a filter down to their sources: combine, tagged union, time-series columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import predicate as P
from ..plans.frame import PushFrame, Request, is_naive, narrowed, plain

Frame = DataFrame | PushFrame
TEMPORAL = (T.DateType, T.TimestampNTZType, T.TimestampType)


@dataclass(frozen=True)
class FilterSpec:
    """How a filter on an output column concerns a source.

    ``source_col``: its name there.  ``lookback`` / ``lookahead`` widen ranges of times.
    ``value_mapping`` (dict or callable) translates equality values; if one has no translation the
    filter is not pushed.
    """

    source_col: str
    lookback: dt.timedelta | None = None
    lookahead: dt.timedelta | None = None
    value_mapping: Mapping | Callable | None = None

    def mapped(self, values) -> list | None:
        out = []
        for v in values:
            if self.value_mapping is None:
                m = v
            elif callable(self.value_mapping):
                m = self.value_mapping(v)
            else:
                m = self.value_mapping.get(v)
            if m is None:
                return None
            out += m if isinstance(m, (list, tuple, set)) else [m]
        return out


def source_filter(p: P.Predicate | None, schema: T.StructType, specs: Mapping[str, FilterSpec | Sequence[FilterSpec]]) -> Column | None:
    """The conjunction of what ``specs`` (output column -> spec) make of ``p`` for a source with ``schema``."""
    out = None
    for column, many in specs.items():
        for spec in [many] if isinstance(many, FilterSpec) else many:
            if spec.source_col not in schema.names:
                continue
            kind = schema[spec.source_col].dataType
            c = None
            if isinstance(kind, TEMPORAL):
                span = P.ranges(p, column)
                if not span.is_universe():
                    span = span.to_datetimes().shift(spec.lookback, spec.lookahead)
                    if isinstance(kind, T.DateType):
                        span = span.to_dates()
                    c = P.interval_filter(span, spec.source_col)
            else:
                values = P.values(p, column)
                mapped = None if values is None else spec.mapped(sorted(values, key=repr))
                if mapped is not None:
                    c = F.col(f"`{spec.source_col}`").isin([P.literal(v) for v in mapped]) if mapped else F.lit(False)
                elif spec.value_mapping is None:
                    c = P.interval_filter(P.ranges(p, column), spec.source_col)
            if c is not None:
                out = c if out is None else out & c
    return out


def pushdown_combine(sources: Mapping[str, Frame], combine: Callable, specs: Mapping[str, Mapping[str, FilterSpec | Sequence[FilterSpec]]], *, combine_kwargs: Mapping | None = None, sources_as_kwargs: bool = False) -> PushFrame:
    """``combine`` over sources that are filtered as ``specs`` (source -> output column -> FilterSpec) allow.

    ``combine`` gets the dict of frames, or them as keywords.  With lookbacks its windows see the widened
    rows; the caller's filter follows.
    """
    unknown = set(specs) - set(sources)
    if unknown:
        raise ValueError(f"specs for unknown sources: {sorted(unknown)}")

    def build(r: Request) -> DataFrame:
        frames = {}
        for name, frame in sources.items():
            c = None if r.predicate is None else source_filter(r.predicate, frame.schema, specs.get(name, {}))
            frames[name] = narrowed(frame, c)
        return combine(**frames, **(combine_kwargs or {})) if sources_as_kwargs else combine(frames, **(combine_kwargs or {}))

    return PushFrame(build, "pushdown_combine")


def concat_named(frames: Mapping, identifier_cols: str | Sequence[str], *, casts: Mapping[str, str] | None = None) -> PushFrame:
    """UNION ALL of frames keyed by identifier values that become literal columns.

    Branches whose identifiers cannot satisfy the filter are left out; if none can, the result is empty.
    """
    ids = [identifier_cols] if isinstance(identifier_cols, str) else list(identifier_cols)
    if not frames:
        raise ValueError("nothing to concatenate")
    keyed = {k if isinstance(k, tuple) else (k,): f for k, f in frames.items()}
    if any(len(k) != len(ids) for k in keyed):
        raise ValueError("each key needs one value per identifier column")

    def tag(v, name: str) -> Column:
        c = P.literal(v)
        return (c.cast(casts[name]) if casts and name in casts else c).alias(name)

    def build(r: Request) -> DataFrame:
        parts = []
        for key, frame in keyed.items():
            possible = r.predicate is None or casts or is_naive() or P.possible(r.predicate, dict(zip(ids, key)))
            rest = P.restrict(r.predicate, [c for c in frame.columns if c not in ids])
            df = narrowed(frame, None if rest is None else P.to_column(rest))
            df = df.select(*(tag(v, n) for n, v in zip(ids, key)), *(F.col(f"`{c}`") for c in df.columns if c not in ids))
            if possible:
                parts.append(df)
        if not parts:
            return df.limit(0)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return PushFrame(build, "concat_named")


def ts_with_columns(frame: Frame, exprs: Mapping[str, Column] | Callable[[DataFrame], DataFrame], index_col: str, *, linked_cols: Sequence[str] = (), lookback: dt.timedelta | None = None, lookahead: dt.timedelta | None = None) -> PushFrame:
    """Columns computed over the filtered time range, widened by lookback and lookahead; then the filter.

    Filters on the index and on linked columns bound the index.  A cumulative value therefore sees the
    rows of the widened range only, by definition.
    """
    if not isinstance(frame.schema[index_col].dataType, TEMPORAL):
        raise TypeError(f"{index_col} is neither a date nor a timestamp")
    spec = FilterSpec(index_col, lookback, lookahead)
    specs = {c: spec for c in (index_col, *linked_cols)}

    def build(r: Request) -> DataFrame:
        c = None if r.predicate is None else source_filter(r.predicate, frame.schema, specs)
        df = narrowed(frame, c)
        return exprs(df) if callable(exprs) and not isinstance(exprs, Mapping) else df.withColumns(dict(exprs))

    return PushFrame(build, "ts_with_columns", shape=None)
