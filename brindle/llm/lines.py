"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

The index is a set of runs: tables of (128-bit key hash, owner), dealt into buckets by hash and sorted by
it in each, one file a bucket.  A new batch's keys, sorted alike, are merged against every run as they lie,
without shuffling or sorting the runs again: keys that a run already holds belong to the run's owner, the
others become the batch's own run at level 0.  When a level has ``fanout`` runs they are merged, bucket by
bucket, into one run of the next level, so a key is rewritten once per level.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lowered.  Keys of at
least ``least`` code points that two documents hold lose their lines in all but the owner: the smallest
id of the first batch that holds the key.  Feed batches in ascending order of id to make the owner the
smallest id of all.  Null and empty texts are one empty line.  Rows of one id are one document that holds
the lines of all of them: what only they share stays.  Rows with a null id are left as they are and own no
line.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, partitions

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def version_of(text: Column) -> Column:
    return F.xxhash64(text)


def keyed_lines(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, version, line, ha, hb`` of every line whose key is long enough; ``version`` tells texts of one id apart."""
    lines = docs.select("doc_id", version_of(F.col("text")).alias("version"), F.posexplode(split_lines(F.col("text"))).alias("line", "t"))
    lines = lines.where(F.octet_length("t") >= least).select("doc_id", "version", "line", key_of(F.col("t")).alias("key")).where(F.char_length("key") >= least)
    return lines.select("doc_id", "version", "line", F.xxhash64("key").alias("ha"), F.xxhash64(F.lit("second"), F.col("key")).alias("hb"))


class LineIndex:
    """Levelled runs of line keys in the shared folder: bucketed external tables of the session's catalog."""

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least, fanout
        # as many buckets as shuffle partitions: a batch's keys then lie as the runs do
        self.buckets = buckets or partitions(spark)
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket of one file is read as sorted
        self.scratch = Scratch(spark)
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        """``ha, hb, owner``, lowest level first; no key is in two of them."""
        return [r for level in self.levels for _, r in level]

    def _sorted(self, df: DataFrame, name: str) -> tuple[str, str]:
        """Write buckets; the name of the table, and its folder."""
        table, path = f"brindle_{uuid.uuid4().hex}", self.scratch.path(name)
        df.write.bucketBy(self.buckets, "ha", "hb").sortBy("ha", "hb").option("compression", "zstd").option("path", path).saveAsTable(table)
        self.paths[table] = path
        return table, path

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        self.scratch.remove(self.paths.pop(table))

    def compact(self) -> None:
        """Merge full levels upward."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                self.levels[level] = []
                table, out = runs[0]
                for other, r in runs[1:]:
                    r = r.withColumnRenamed("owner", "other").hint("merge")
                    merged, _ = self._sorted(out.join(r, ["ha", "hb"], "full").select("ha", "hb", F.coalesce("owner", "other").alias("owner")), f"run{level + 1}")
                    self._drop(table)
                    self._drop(other)
                    table, out = merged, self.spark.table(merged)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append((table, out))
            level += 1

    def add(self, docs: DataFrame) -> DataFrame:
        """Take a batch (``doc_id``, ``text``) in; returns ``doc_id, version, line`` (numbers from 0) of its lines to drop."""
        lines = keyed_lines(docs, self.least)
        own = lines.groupBy("ha", "hb").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        known = F.lit(None).cast("bigint")
        for i, run in enumerate(self.runs()):
            own = own.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), ["ha", "hb"], "left")
            known = F.coalesce(known, F.col(f"owner{i}"))
        own = own.select("ha", "hb", known.alias("known"), "first", "last").repartition(self.buckets, "ha", "hb")
        table, path = self._sorted(own, "batch")
        self.levels[0].append((table, self.spark.table(table).where("known is null").select("ha", "hb", F.col("first").alias("owner"))))
        # read as plain files: the join below then shuffles both sides and can split the partition of a very common line
        shared = self.spark.read.schema(own.schema).parquet(path).where("known is not null or first <> last").select("ha", "hb", F.coalesce("known", "first").alias("owner"))
        drops = lines.join(shared, ["ha", "hb"]).where("doc_id <> owner").select("doc_id", "version", "line")
        drops = self.scratch.table(drops, "drops")
        self.compact()
        return drops

    def close(self) -> None:
        """Forget all runs."""
        for level in self.levels:
            for table, _ in level:
                self._drop(table)
        self.levels = [[]]


def cut_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the remaining text).

    Per document the dropped line numbers travel as bitmaps of 64 lines.
    """
    bits = drops.groupBy("doc_id", "version", F.shiftright("line", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, line & 63)")).alias("bits"))
    bits = bits.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))
    out = docs.withColumn("version", version_of(F.col("text"))).join(bits.hint("merge"), ["doc_id", "version"], "left").withColumn("all_lines", split_lines(F.col("text")))
    kept = F.expr("filter(all_lines, (x, i) -> (shiftright(coalesce(gone[shiftright(i, 6)], 0L), i & 63) & 1L) = 0L)")
    out = out.withColumn("left_lines", F.when(F.col("gone").isNull(), F.col("all_lines")).otherwise(kept))
    return (
        out.withColumn("n_lines", F.size("all_lines").cast("bigint"))
        .withColumn("n_dropped", (F.size("all_lines") - F.size("left_lines")).cast("bigint"))
        .withColumn("kept", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("left_lines", "\n")))
        .drop("version", "gone", "all_lines", "left_lines")
    )


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 3, batch_rows: int = 50_000_000, fanout: int = 2, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept`` for every row: the table goes through a ``LineIndex`` in batches of ascending id.

    There are ``batches`` of them, and more where they would hold over ``batch_rows`` rows.  ``carry``: columns to hand on
    unchanged, as ``carried`` (a struct, so that no name clashes).
    """
    more = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more)
    index = LineIndex(docs.sparkSession, least, fanout)
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).head()
    drops = None
    if low is not None:
        step = max(1, -(-(high - low + 1) // max(batches, -(-rows // batch_rows))))
        for start in range(low, high + 1, step):
            part = index.add(docs.select("doc_id", "text").where(F.col("doc_id").between(start, start + step - 1)))
            drops = part if drops is None else drops.unionAll(part)
    index.close()
    if drops is None:
        drops = docs.sparkSession.createDataFrame([], "doc_id bigint, version bigint, line int")
    return cut_lines(docs, drops)
