"""Column helpers: pushdown barrier, dependency-ordered columns, row iterator, debug scan."""

from __future__ import annotations

import contextlib
import graphlib
import io
import logging
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frame import PushFrame, Request, is_naive, narrowed, plain
from ..plans import predicate as P

log = logging.getLogger("brindle")


def filter_no_pushdown(df: DataFrame, conditions: Column | Sequence[Column]) -> DataFrame:
    """Rows that satisfy all conditions, tested after the scan.  Null counts as false; no condition leaves ``df`` as it is."""
    many = [conditions] if isinstance(conditions, Column) else list(conditions)
    for c in many:
        # a nondeterministic alternative that is never true keeps the optimiser from moving the filter
        df = df.filter(c) if is_naive() else df.filter(F.coalesce(c, F.rand() < 0))
    return df


def with_columns_topo(df: DataFrame, exprs: Mapping[str, Column] | Sequence[tuple[str, Column]]) -> DataFrame:
    """Columns that may refer to each other, in as few projections as their dependencies allow.

    The last of several columns of one name holds.  A cycle raises ``graphlib.CycleError``.
    """
    named = dict(exprs)
    graph = {n: {r for r in references(c) if r in named and r != n or r == n and n not in df.columns} for n, c in named.items()}
    order = graphlib.TopologicalSorter(graph)
    order.prepare()
    while order.is_active():
        level = order.get_ready()
        df = df.withColumns({n: named[n] for n in level})
        order.done(*level)
    return df


def references(column: Column) -> set[str]:
    """Names of the columns an unresolved expression mentions."""
    found, stack = set(), [column._jc.node()]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            found.add(node.nameParts().last())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return found


def iter_rows(frame: DataFrame | PushFrame, *, named: bool = False, buffer_size: int = 512, maintain_order: bool = True) -> Iterator:
    """Rows as tuples or dicts, in the frame's order.

    They arrive by partition, one ahead of what is read unless ``buffer_size`` is 0.  ``maintain_order`` is part of the
    interface only: partitions are read one after the other, which costs nothing more.
    """
    for row in plain(frame).toLocalIterator(prefetchPartitions=buffer_size > 0):
        yield row.asDict() if named else tuple(row)


def debug(frame: DataFrame | PushFrame, name: str = "debug", sink=log.info) -> PushFrame:
    """Pass-through that reports the filter and columns asked for, and the plan."""

    def build(r: Request) -> DataFrame:
        df = narrowed(frame, None if r.predicate is None else P.to_column(r.predicate), r.columns)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("formatted")
        sink(f"{name}: columns={r.columns} predicate={r.predicate}\n{text.getvalue()}")
        return df

    return PushFrame(build, name)
