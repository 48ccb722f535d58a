"""Shared plumbing: intermediate tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, in a local session (tests) a new temporary one, then kept."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = getattr(spark.sparkContext, "_brindle_shared", None)
        if not known:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            known = "file://" + tempfile.mkdtemp(prefix="brindle-")
            spark.sparkContext._brindle_shared = known
    return known.rstrip("/")


FILE_ROWS = 100_000  # rows of a file where their number is known to be small


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts lineage and survives lost executors.  ``drop`` removes what no later plan
    reads; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
        atexit.register(self.remove, self.root)

    def remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the shared folder is the cluster's to clean
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """Write ``df`` and read it back.  Afterwards the JVM may free the shuffle files that only it needed.

        Known to hold ``most`` rows at most, it has a file for every ``FILE_ROWS`` of them, however many shuffle
        partitions there are: in a local folder Hadoop starts a ``chmod`` for each file, without its native library.
        """
        if most is not None:
            df = df.coalesce(max(1, -(-most // FILE_ROWS)))
        path = self.path(name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(path)
        out._brindle_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._brindle_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    ``edges`` has bigint columns ``a`` and ``b``; loops and repeats are allowed, nulls are ignored.
    Returns ``id, component`` (the smallest id reachable) for every id that is not its own component
    head.  Each step takes minima with map-side combining and rejoins them; a hot centre is a skewed
    join that adaptive execution splits.  Iterations are written tables, so no lineage grows.
    """
    now = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if tuple(mark) == before or mark.n == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = tuple(mark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "large", mark.n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        small = scratch.table(small, "small", 2 * mark.n)
        scratch.drop(now, large)
        now = small


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
