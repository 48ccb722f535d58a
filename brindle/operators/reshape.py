"""Pivot and unpivot that turn a choice of output columns or names into a narrower read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import predicate as P
from ..plans.frame import PushFrame, Request, is_naive, narrowed, plain

Frame = DataFrame | PushFrame


def pushdown_pivot(source: Frame, on: str, on_columns: Sequence, *, index, values, aggregate_function=None, separator: str = "_", column_naming: str = "auto", dense_on: bool = False) -> PushFrame:
    """One row per index, one column per (value, name in ``on_columns``).

    If only some outputs are asked for, only their names are read.  ``dense_on=False`` keeps index rows
    that have none of them; True says every index has every name, and skips that.  Two rows for one cell
    are an error.
    """
    if aggregate_function is not None:
        raise NotImplementedError("cells hold single values")
    if not isinstance(on, str):
        raise ValueError("on must be one column")
    if column_naming not in ("auto", "combine"):
        raise ValueError("column_naming must be auto or combine")
    idx = [index] if isinstance(index, str) else list(index)
    vals = [values] if isinstance(values, str) else list(values)
    short = len(vals) == 1 and column_naming == "auto"
    cells = {(str(n) if short else f"{v}{separator}{n}"): (v, n) for v in vals for n in on_columns}

    def build(r: Request) -> DataFrame:
        mine = P.restrict(r.predicate, idx)
        df = narrowed(source, None if mine is None else P.to_column(mine))
        wanted = {c: vn for c, vn in cells.items() if r.columns is None or c in r.columns}
        names = list(dict.fromkeys(n for _, n in wanted.values()))
        keep = df.select(*idx, on, *dict.fromkeys(v for v, _ in wanted.values()))
        some = r.columns is not None and len(names) < len(set(on_columns)) and not is_naive()
        if some and dense_on:
            keep = keep.where(F.col(f"`{on}`").isin(names) if names else F.lit(False))

        def cell(v: str, n, alias: str):
            hit = F.col(f"`{on}`") == P.literal(n)
            return F.when(F.count_if(hit) > 1, F.raise_error(F.lit(f"two rows for one cell of {n}"))).otherwise(F.max(F.when(hit, F.col(f"`{v}`")))).alias(alias)

        # without dense_on every index row counts; conditional aggregation over the pruned columns keeps them in one pass
        aggs = [cell(v, n, c) for c, (v, n) in wanted.items()]
        grouped = keep.groupBy(*idx)
        return grouped.agg(*aggs) if aggs else keep.select(*idx).distinct()

    return PushFrame(build, "pushdown_pivot")


def pushdown_unpivot(source: Frame, *, index, on: Sequence[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> PushFrame:
    """One row per input row and column of ``on``; a filter on the variable leaves out columns it excludes."""
    idx = [index] if isinstance(index, str) else list(index)
    cols = list(on) if on is not None else [c for c in source.columns if c not in idx]

    def build(r: Request) -> DataFrame:
        kind = plain(source).select(*cols).limit(0).unpivot([], cols, variable_name, value_name).schema[value_name].dataType
        allowed = P.values(r.predicate, variable_name) if not is_naive() else None
        kept = [c for c in cols if allowed is None or c in allowed]
        mine = P.restrict(r.predicate, idx)
        df = narrowed(source, None if mine is None else P.to_column(mine))
        if not kept:
            return df.select(*idx, *cols).unpivot(idx, cols, variable_name, value_name).limit(0)
        out = df.select(*idx, *kept).unpivot(idx, kept, variable_name, value_name)
        return out.withColumn(value_name, F.col(value_name).cast(kind))

    return PushFrame(build, "pushdown_unpivot")
