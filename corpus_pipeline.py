"""A training-data pipeline: each stage takes the documents its predecessor kept and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import lines, near, packing, pii, quality
from brindle.llm._spark import Scratch
from brindle.llm.queries import SECRET, quality_bands, tune, vocabularies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _replaced(new: DataFrame, text: str) -> DataFrame:
    """The documents an operator has ``carried``, with its column ``text`` for their text; lengths follow, null texts stay null."""
    out = new.select("carried.*", F.col(text).alias("new"))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("new"))).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; rows with a null id or an id of another row are judged like any."""
    tune(spark)
    return quality.quality(docs, vocabularies(), by_lang=quality_bands(spark, docs, sf_dir), carry=COLUMNS).where("kept").select("carried.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the document stays with what is left.  Rows with a null id stay as they are."""
    return _replaced(lines.dedup_lines(docs, carry=COLUMNS), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.  Rows with a null id stay."""
    tune(spark)
    gone = near.near_duplicates(docs.where("doc_id is not null")).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced."""
    return _replaced(pii.pseudonymise(docs, key=SECRET, carry=COLUMNS), "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: which words of which document go into which bin."""
    tune(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", surrogates), ("packing", packed)]
#: SQL cannot express tokeniser fertility, keyed surrogates or best-fit packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_brindle_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
