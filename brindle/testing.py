"""Helpers for tests of sources and operators: what reached a source, and whether pushing it changed a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import predicate as P
from .plans.frame import PushFrame, Request


class PredicateTracker:
    """A source over a DataFrame that keeps every request made of it, newest last.

    ``frame`` is the source; it applies what it is asked for, like a source that can push everything down.
    """

    def __init__(self, df: DataFrame):
        self.df, self.requests = df, []
        self.frame = PushFrame(self._build, "tracked", shape=df.limit(0))

    def _build(self, r: Request) -> DataFrame:
        self.requests.append(r)
        out = self.df if r.predicate is None else self.df.filter(P.to_column(r.predicate))
        out = out if r.columns is None else out.select(*(F.col(f"`{c}`") for c in r.columns))
        return out if r.limit is None else out.limit(r.limit)

    @property
    def last(self) -> Request:
        if not self.requests:
            raise AssertionError("nothing reached the source")
        return self.requests[-1]

    def reset(self) -> None:
        self.requests.clear()

    def values(self, column: str) -> frozenset | None:
        """The values that the last predicate leaves ``column``, None if not finitely many."""
        return P.values(self.last.predicate, column)

    def ranges(self, column: str):
        return P.ranges(self.last.predicate, column)

    def assert_pushed(self, *columns: str) -> None:
        """The last predicate constrains each of ``columns``."""
        got = self.last.predicate.columns() if self.last.predicate is not None else frozenset()
        if missing := set(columns) - got:
            raise AssertionError(f"no filter on {sorted(missing)} reached the source, only on {sorted(got)}")

    def assert_nothing_pushed(self) -> None:
        if self.last.predicate is not None:
            raise AssertionError(f"a filter on {sorted(self.last.predicate.columns())} reached the source")

    def assert_read(self, *columns: str) -> None:
        """Just these columns were asked of the source."""
        if self.last.columns is None or set(self.last.columns) != set(columns):
            raise AssertionError(f"asked for {self.last.columns}, not {columns}")


def _rows(df: DataFrame) -> list[str]:
    return sorted(map(repr, df.collect()))


def io_source_assert(make: Callable[[], PushFrame], expected: DataFrame, conditions=(), columns=()) -> None:
    """A source gives ``expected`` whole, under each of ``conditions``, with each tuple of ``columns``, and limited; optimised and naive."""
    asks = [lambda f: f, *((lambda f, c=c: f.filter(c)) for c in conditions), *((lambda f, n=n: f.select(*n)) for n in columns)]
    asks += [(lambda f, c=c, n=n: f.filter(c).select(*n)) for c in conditions for n in columns]
    for ask in asks:
        want = _rows(ask(expected))
        frame = ask(make())
        for got in (frame.to_df(), frame.naive()):
            if _rows(got) != want:
                raise AssertionError(f"{len(want)} rows expected, {got.count()} found, or other values")
    total = expected.count()
    for n in (0, 1, total + 1):
        if make().limit(n).to_df().count() != min(n, total):
            raise AssertionError(f"limit {n} gives another number of rows")
