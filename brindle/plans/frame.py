"""A frame that remembers the filter, columns and limit asked of it, and builds its plan when they are known."""

from __future__ import annotations

import contextlib
import contextvars
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicate as P

_naive = contextvars.ContextVar("brindle_naive", default=False)
log = logging.getLogger("brindle")


@contextlib.contextmanager
def disable_optimizations():
    """Inside, frames build the straightforward plan.  May be nested."""
    token = _naive.set(True)
    try:
        yield
    finally:
        _naive.reset(token)


@dataclass(frozen=True)
class Request:
    """What is asked of an operator: a predicate over its output, the columns needed (None: all), and how many rows do (None: all; only without a predicate)."""

    predicate: P.Predicate | None = None
    columns: tuple[str, ...] | None = None
    limit: int | None = None


class PushFrame:
    """``build(request)`` returns a DataFrame that holds at least the rows and columns asked for.

    The frame applies the caller's own filters, columns and limit afterwards, so results equal the plain
    query's whatever ``build`` narrowed.  ``shape`` gives the schema where building the whole plan would be
    costly; it is never read for rows.  ``bounded``: ``build`` cannot do without the predicate, so the naive
    plan passes it on too.
    """

    def __init__(self, build: Callable[[Request], DataFrame], name: str = "frame", conditions: tuple = (), wanted: tuple[str, ...] | None = None, most: int | None = None, shape: DataFrame | None = None, bounded: bool = False):
        self._build, self._name, self._conditions, self._wanted, self._most, self._shape, self._bounded = build, name, conditions, wanted, most, shape, bounded

    def shape(self) -> DataFrame:
        """The unfiltered plan, for its schema; analysis only."""
        if self._shape is None:
            token = _naive.set(True)
            try:
                self._shape = self._build(Request())
            finally:
                _naive.reset(token)
        return self._shape

    @property
    def columns(self) -> list[str]:
        return list(self._wanted or self.shape().columns)

    @property
    def schema(self):
        return self.shape().select(*self.columns).schema

    def _with(self, **changes) -> PushFrame:
        have = {"conditions": self._conditions, "wanted": self._wanted, "most": self._most, "shape": self._shape, "bounded": self._bounded}
        return PushFrame(self._build, self._name, **(have | changes))

    def filter(self, condition: Column | str) -> PushFrame:
        if self._most is not None:
            limited = self.to_df()
            return PushFrame(lambda r: limited, self._name, (condition,), self._wanted)
        return self._with(conditions=(*self._conditions, condition))

    where = filter

    def select(self, *columns: str) -> PushFrame:
        return self._with(wanted=tuple(columns))

    def limit(self, n: int) -> PushFrame:
        return self._with(most=n if self._most is None else min(n, self._most))

    def request(self) -> Request:
        whole = None
        for c in self._conditions:
            whole = P.both(whole, P.parse(self.shape(), c))
        wanted = None
        if self._wanted is not None:
            wanted = tuple(dict.fromkeys([*self._wanted, *(whole.columns() if whole else ())]))
        return Request(whole, wanted, None if self._conditions else self._most)

    def to_df(self) -> DataFrame:
        if _naive.get():
            return self._finish(self._build(Request(self.request().predicate) if self._bounded else Request()))
        r = self.request()
        log.debug("%s: %s", self._name, r)
        if r.predicate is not None and P.contradictory(r.predicate):
            return self._finish(self.shape().limit(0), filtered=True)
        return self._finish(self._build(r))

    def naive(self) -> DataFrame:
        """The same result by the straightforward plan."""
        with disable_optimizations():
            return self.to_df()

    def _finish(self, df: DataFrame, filtered: bool = False) -> DataFrame:
        for c in () if filtered else self._conditions:
            df = df.filter(c)
        if self._wanted is not None:
            df = df.select(*(F.col(f"`{c}`") for c in self._wanted))
        return df if self._most is None else df.limit(self._most)

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)


def plain(frame: DataFrame | PushFrame) -> DataFrame:
    return frame.to_df() if isinstance(frame, PushFrame) else frame


def narrowed(frame: DataFrame | PushFrame, condition: Column | None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``frame`` under a filter and with those of ``columns`` it has, passed on to a PushFrame's own builder."""
    if condition is not None:
        frame = frame.filter(condition)
    if columns is not None:
        have = [c for c in frame.columns if c in columns]
        frame = frame.select(*have) if have else frame
    return plain(frame)


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes; analysis only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_naive() -> bool:
    return _naive.get()
