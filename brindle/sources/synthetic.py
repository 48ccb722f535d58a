"""Generated regression data and panels.  Each value is a hash of seed, column and row, so it depends on nothing else."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, name: str, row: Column) -> Column:
    """In (0, 1), with 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), row), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def normal(seed: int, name: str, row: Column) -> Column:
    """Standard normal by Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, name + "/r", row))) * F.cos(2 * F.pi() * uniform(seed, name + "/a", row))


def _responses(df: DataFrame, row: Column, betas: Sequence[Sequence[float]], seed: int, loc: float, scale: float, weight: Column | None) -> DataFrame:
    out = {}
    for j in range(len(betas[0]) if betas else 0):
        noise = F.lit(loc) + F.lit(scale) * normal(seed, f"e{j}", row) / (F.sqrt(weight) if weight is not None else F.lit(1.0))
        out[f"y{j}"] = sum((F.col(f"x{i}") * F.lit(float(b[j])) for i, b in enumerate(betas)), F.lit(0.0)) + noise
    return df.withColumns(out) if out else df


def scan_synthetic_regression(spark: SparkSession, n_samples: int, n_features: int, n_responses: int = 1, *, betas: Sequence[Sequence[float]] | None = None, use_weights: bool = False, weights_low: float = 0.5, weights_high: float = 2.0, epsilon_loc: float = 0.0, epsilon_scale: float = 1.0, chunk_key: str | None = None, n_chunks: int = 1, seed: int = 0) -> DataFrame:
    """``Y = X B + E``: columns x0.., y0.., a weight (noise falls with its root) and a rising chunk key if asked for."""
    if betas is None:
        betas = [[float((i + 1) * (-1) ** j) for j in range(n_responses)] for i in range(n_features)]
    row = F.col("_id")
    df = spark.range(n_samples).withColumnRenamed("id", "_id").withColumns({f"x{i}": normal(seed, f"x{i}", row) for i in range(n_features)})
    weight = None
    if use_weights:
        df = df.withColumn("weight", F.lit(weights_low) + F.lit(weights_high - weights_low) * uniform(seed, "weight", row))
        weight = F.col("weight")
    df = _responses(df, row, betas, seed, epsilon_loc, epsilon_scale, weight)
    if chunk_key:
        df = df.withColumn(chunk_key, F.expr(f"_id * {n_chunks} div {max(n_samples, 1)}"))
    return df.drop("_id")


#: Steps of a panel's time: name -> rows a day (below 1: every so many days), and whether weekends are left out.
STEPS = {"B": (1, True), "D": (1, False), "h": (24, False), "min": (1440, False)}


def scan_synthetic_panel(
    spark: SparkSession, start_date: dt.date, end_date: dt.date, n_symbols: int, n_features: int = 1, n_responses: int = 1, *, freq: str = "B", betas: Sequence[Sequence[float]] | None = None,
    categories: Sequence[str] = (), n_levels: int = 3, group_by: str | None = None, group_betas: Sequence[Sequence[Sequence[float]]] | None = None, epsilon_scale: float = 1.0, seed: int = 0,
) -> DataFrame:
    """A row per step of time and symbol: symbol, date, timestamp, x0.., y0.. and categories of ``n_levels`` levels.

    ``freq``: business days (B), days (D), hours (h) or minutes (min).  With ``group_by`` (one of ``categories``) the rows of a
    level have coefficients of their own: ``group_betas`` by level, by default ``betas`` times the level's number from 1.
    """
    if freq not in STEPS:
        raise ValueError(f"freq must be one of {list(STEPS)}")
    if group_by is not None and group_by not in categories:
        raise ValueError(f"{group_by} is no category")
    if betas is None:
        betas = [[float(i + 1) for _ in range(n_responses)] for i in range(n_features)]
    per_day, working = STEPS[freq]
    steps = max((end_date - start_date).days + 1, 0) * per_day
    # the row number encodes time and symbol, so no join is needed
    df = spark.range(steps * n_symbols).withColumn("_step", F.expr(f"id div {n_symbols}")).withColumn("date", F.date_add(F.lit(start_date), F.expr(f"int(_step div {per_day})")))
    if working:
        df = df.where(F.weekday("date") < 5)
    df = df.withColumn("symbol", F.format_string("S%05d", F.expr(f"id % {n_symbols}")))
    df = df.withColumn("timestamp", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.expr(f"int((_step % {per_day}) * {1440 // per_day})")))
    df = df.withColumns({f"x{i}": normal(seed, f"x{i}", F.col("id")) for i in range(n_features)})
    level = {c: F.expr(f"pmod(xxhash64({seed}, '{c}', symbol), {n_levels})") for c in categories}
    if categories:
        df = df.withColumns({c: F.concat(F.lit(c), x.cast("string")) for c, x in level.items()})
    if group_by is None:
        df = _responses(df, F.col("id"), betas, seed, 0.0, epsilon_scale, None)
    else:
        of = group_betas or [[[b * (k + 1) for b in row] for row in betas] for k in range(n_levels)]
        df = df.withColumn("_level", level[group_by])
        for j in range(n_responses):
            mean = F.lit(0.0)
            for i in range(n_features):
                mean = mean + F.col(f"x{i}") * F.get(F.array(*(F.lit(float(b[i][j])) for b in of)), F.col("_level").cast("int"))
            df = df.withColumn(f"y{j}", mean + F.lit(epsilon_scale) * normal(seed, f"e{j}", F.col("id")))
    return df.select("symbol", "date", "timestamp", *categories, *(f"x{i}" for i in range(n_features)), *(f"y{j}" for j in range(n_responses)))
