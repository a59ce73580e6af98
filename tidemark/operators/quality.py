"""Quality of a close panel: gaps, jumps and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panels import by_asset


def stale_runs(panel: DataFrame) -> DataFrame:
    """(panel, asset, longest_stale): the longest run of missing closes, for assets that have any."""
    gaps = panel.where("close is null").withColumn("island", F.col("bar_idx") - F.row_number().over(by_asset()))
    return gaps.groupBy("panel", "asset", "island").agg(F.count("*").alias("n")).groupBy("panel", "asset").agg(F.max("n").alias("longest_stale"))


def jump_counts(panel: DataFrame, z: float = 5.0, prices: int = 20, moves: int = 10) -> DataFrame:
    """(panel, asset, jumps): log returns over z deviations from the mean of all; 0 for too few prices or returns."""
    known = panel.where("close is not null").withColumn("x", F.log(F.col("close") / F.lag("close").over(by_asset())))
    w = Window.partitionBy("panel", "asset")
    far = known.withColumn("far", F.abs((F.col("x") - F.avg("x").over(w)) / F.stddev_samp("x").over(w)) > z)
    return far.groupBy("panel", "asset").agg(F.when((F.count("*") >= prices) & (F.count("x") >= moves), F.coalesce(F.sum(F.col("far").cast("int")), F.lit(0))).otherwise(0).alias("jumps"))


def columns(panel: DataFrame) -> DataFrame:
    """(panel, asset, first_valid, last_valid, missing_frac, longest_stale, jumps)."""
    seen = F.when(F.col("close").isNotNull(), F.col("bar_date"))
    base = panel.groupBy("panel", "asset").agg(F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"), F.avg(F.col("close").isNull().cast("int")).alias("missing_frac"))
    return base.join(stale_runs(panel), ["panel", "asset"], "left").join(jump_counts(panel), ["panel", "asset"], "left").fillna(0, ["longest_stale", "jumps"])


def summary(panel: DataFrame, least_bars: int = 150, least_assets: int = 3) -> DataFrame:
    """(panel, bars, overlap, dropped_frac, assets, ok) of listwise deletion."""
    bars = panel.groupBy("panel", "bar_idx").agg(F.sum(F.col("close").isNull().cast("int")).alias("missing"), F.count("*").alias("k"))
    full = F.sum((F.col("missing") == 0).cast("int"))
    return bars.groupBy("panel").agg(F.count("*").alias("bars"), full.alias("overlap"), (1 - full / F.count("*")).alias("dropped_frac"), F.max("k").alias("assets"), ((full >= least_bars) & (F.max("k") >= least_assets)).alias("ok"))


def warnings(panel: DataFrame, missing: float = 0.05, stale: int = 5) -> DataFrame:
    """(panel, asset, warnings): what is wrong with a column, as an array."""
    c = columns(panel)
    found = F.array_compact(F.array(F.when(F.col("missing_frac") > missing, "missing"), F.when(F.col("longest_stale") > stale, "stale"), F.when(F.col("jumps") > 0, "jumps")))
    return c.select("panel", "asset", found.alias("warnings")).where(F.size("warnings") > 0)


def demand(panel: DataFrame) -> None:
    """Raise ValueError if a panel's overlap or width is too small."""
    bad = [r.panel for r in summary(panel).where("not ok").select("panel").limit(20).collect()]
    if bad:
        raise ValueError(f"panels of poor quality: {bad}")

