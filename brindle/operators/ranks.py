"""Ranks within keys, in tasks whose rows do not grow with the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import workspace

#: Rows that one task sorts, about; a key of more is cut into ranges of its order.
MOST = 500_000
#: Tasks up to which Spark deals rows out as they come; for more, each reading task first gathers its whole share in memory.
DIRECT = 200


def key_ranks(df: DataFrame, by: str, order: Sequence[str], dense: str, tiles: int, most: int = MOST) -> DataFrame:
    """``df`` with the ranks of each row in its key: ``rn``, ``q`` (of ``tiles``), ``cd`` and ``pr`` by ``order``, ``dr`` (dense) by ``dense``.

    ``rn`` and ``q`` take rows of equal order by ``dense``, so that they do not hang on the way the rows came.  One pass counts the keys' rows.  Then rows are dealt by key to as many tasks as they need.  Keys of more than ``most`` rows are
    left to ``_cut``; there are at most rows / ``most`` of them.  A null key is a key.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    large = F.when(F.col("n") > most, F.struct(F.col("n"), F.col(by).alias("k")))
    total, hot = counts.agg(F.sum("n"), F.collect_list(large)).head()
    if not hot:
        return _plain(df, by, order, dense, tiles, total or 0, most)
    keys = [r.k for r in hot if r.k is not None]
    is_hot = F.coalesce(F.col(by).isin(keys), F.lit(len(keys) < len(hot)))
    many = sum(r.n for r in hot)
    return _plain(df.where(~is_hot), by, order, dense, tiles, total - many, most).unionByName(_cut(df.where(is_hot), by, order, dense, tiles, many, most))


def tasks(rows: int, most: int) -> int:
    """Tasks of ``most`` rows; between ``DIRECT`` of them and three times their rows so many, as long as that lasts."""
    return max(1, min(-(-rows // most), max(DIRECT, -(-rows // (3 * most)))))


def _plain(df: DataFrame, by: str, order: Sequence[str], dense: str, tiles: int, rows: int, most: int) -> DataFrame:
    w, full = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by).orderBy(*order, dense)
    # adaptive execution leaves a given number alone; by its own measure, bytes as shuffled, a task would get six times as many rows
    dealt = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks(rows, most)), by)
    dealt = dealt.select("*", F.row_number().over(full).cast("bigint").alias("rn"), F.ntile(tiles).over(full).cast("bigint").alias("q"))
    dealt = dealt.select("*", F.cume_dist().over(w).alias("cd"), F.percent_rank().over(w).alias("pr"))  # in the same sort
    return dealt.select(*df.columns, "rn", "q", F.dense_rank().over(Window.partitionBy(by).orderBy(dense)).cast("bigint").alias("dr"), "cd", "pr")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str], how: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Inner join on equal or equally null columns, kept once."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in names})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return a.join(how(b), on).drop(*(f"_{c}" for c in names))


def _placed(df: DataFrame, by: str, order: Sequence[str], n: int, then: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_rn`` (equals by ``then``), ``_rank`` and ``_upto`` (rows up to and with its equals) in its key and ``_n``, the key's rows.

    The rows are dealt by ranges of (key, order), in which equal rows share a range, and written, so that a row's range is fixed.  Each is
    counted from its range's start; what the key has in earlier ranges comes from a table with a row per range and key.
    """
    spark = df.sparkSession
    path = workspace(spark, "ranks")
    df.repartitionByRange(n, by, *order).withColumn("_piece", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    w, full = (Window.partitionBy("_piece", by).orderBy(*x) for x in (order, [*order, *then]))
    key = Window.partitionBy(by)
    held = cut.groupBy("_piece", by).agg(F.count("*").alias("_m"))
    held = held.withColumns({"_n": F.sum("_m").over(key), "_before": F.coalesce(F.sum("_m").over(key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = cut.repartition(n, "_piece", by).withColumn("_rn", F.row_number().over(full).cast("bigint")).withColumns({"_rank": F.rank().over(w).cast("bigint"), "_upto": F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    out = _same(out, held.drop("_m"), ["_piece", by], F.broadcast)
    return out.withColumns({c: F.col(c) + F.col("_before") for c in ("_rn", "_rank", "_upto")}).drop("_piece", "_before")


def _tile(rn: Column, n: Column, tiles: int) -> Column:
    """Tiles of equal size, the first ``n`` mod ``tiles`` of them one larger."""
    size, more = F.floor(n / tiles), n % tiles
    edge = more * (size + 1)
    return F.when(rn <= edge, F.floor((rn - 1) / (size + 1)) + 1).otherwise(more + F.floor((rn - 1 - edge) / size) + 1).cast("bigint")


def _cut(df: DataFrame, by: str, order: Sequence[str], dense: str, tiles: int, rows: int, most: int) -> DataFrame:
    n = max(2, tasks(2 * rows, most))
    names = df.columns
    values = df.select(by, dense).distinct()
    values = _placed(values, by, [dense], n).select(by, dense, F.col("_rn").alias("dr"))
    out = _same(_placed(df, by, order, n, [dense]), values, [by, dense])
    rn, size = F.col("_rn"), F.col("_n")
    return out.select(*names, rn.alias("rn"), _tile(rn, size, tiles).alias("q"), "dr", (F.col("_upto") / size).alias("cd"), F.when(size > 1, (F.col("_rank") - 1) / (size - 1)).otherwise(0.0).alias("pr"))
