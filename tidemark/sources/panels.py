"""Close panels, long: (panel, bar_date, bar_idx, asset, close).

`raw` daily prices come from lineitem: the asset is return flag and line status,
the price is revenue over quantity. `smooth` is the price of the trailing 60
bars. `weekly` is a short panel for smoke tests. A missing price is a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMOOTH_BARS = 60
FILL_BARS = 3


def by_asset(*more: str) -> Window:
    return Window.partitionBy("panel", "asset", *more).orderBy("bar_idx")


def trailing(bars: int) -> Window:
    """The last `bars` bars of an asset, this one included."""
    return by_asset().rowsBetween(-(bars - 1), 0)


def bar_axis(bars: DataFrame) -> DataFrame:
    """(panel, bar_date, bar_idx) from 1 on, for the distinct dates of a panel."""
    return bars.select("panel", "bar_date").distinct().withColumn("bar_idx", F.row_number().over(Window.partitionBy("panel").orderBy("bar_date")))


def traded(spark: SparkSession, sf_dir: str, panel: str, bar: Column) -> DataFrame:
    """(panel, bar_date, asset, revenue, quantity) of the bars that have trades."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate is not null")
    grouped = lines.groupBy(bar.alias("bar_date"), F.concat("l_returnflag", "l_linestatus").alias("asset"))
    return grouped.agg(F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("quantity")).select(F.lit(panel).alias("panel"), "*")


def dense(bars: DataFrame) -> DataFrame:
    """Every bar of every asset of a panel: (panel, bar_date, bar_idx, asset, ...)."""
    axis, assets = bar_axis(bars), bars.select("panel", "asset").distinct()
    return axis.join(assets, "panel").join(bars, ["panel", "bar_date", "asset"], "left")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = dense(traded(spark, sf_dir, "raw", F.to_date("l_shipdate")))
    return grid.select("panel", "bar_date", "bar_idx", "asset", (F.col("revenue") / F.col("quantity")).alias("close"))


def smooth(spark: SparkSession, sf_dir: str, bars: int = SMOOTH_BARS) -> DataFrame:
    grid = dense(traded(spark, sf_dir, "smooth", F.to_date("l_shipdate")))
    priced = grid.withColumn("close", F.sum("revenue").over(trailing(bars)) / F.sum("quantity").over(trailing(bars)))
    return priced.where(F.col("bar_idx") >= bars).select("panel", "bar_date", (F.col("bar_idx") - (bars - 1)).alias("bar_idx"), "asset", "close")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = dense(traded(spark, sf_dir, "weekly", F.to_date(F.date_trunc("week", "l_shipdate"))))
    return filled(grid.select("panel", "bar_date", "bar_idx", "asset", (F.col("revenue") / F.col("quantity")).alias("close")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of event types by hours: close is the mean value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    bars = events.groupBy(F.date_trunc("hour", "ts").alias("bar_date"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("close"))
    return dense(bars.select(F.lit("hourly").alias("panel"), "*")).select("panel", "bar_date", "bar_idx", "asset", "close")


def filled(panel: DataFrame, bars: int = FILL_BARS) -> DataFrame:
    """Gaps filled from up to `bars` bars before, then from up to `bars` bars behind."""
    before = F.last("close", ignorenulls=True).over(by_asset().rowsBetween(-bars, 0))
    behind = F.first("close", ignorenulls=True).over(by_asset().rowsBetween(0, bars))
    return panel.withColumn("close", before).withColumn("close", behind)


def complete(panel: DataFrame) -> DataFrame:
    """The bars at which every asset of the panel has a price (listwise deletion)."""
    whole = Window.partitionBy("panel", "bar_date")
    return panel.withColumn("__missing", F.sum(F.col("close").isNull().cast("int")).over(whole)).where("__missing = 0").drop("__missing")


def staleness(panel: DataFrame, days: int = 2) -> DataFrame:
    """(panel, asset, last_date, gap_days, stale): how long before the calendar's end an asset's last price is, and whether by more than `days`."""
    end = F.max("bar_date").over(Window.partitionBy("panel"))
    last = panel.withColumn("__end", end).where("close is not null").groupBy("panel", "asset").agg(F.max("bar_date").alias("last_date"), F.first("__end").alias("__end"))
    return last.select("panel", "asset", "last_date", F.datediff("__end", "last_date").alias("gap_days"), (F.datediff("__end", "last_date") > days).alias("stale"))


def gaps(panel: DataFrame, days: int = 2) -> DataFrame:
    """(panel, asset, begin, end, bars, days): runs of bars without a price that span more than `days` days.

    The days are counted from the price before to the price after, or to the calendar's edge.
    """
    run = Window.partitionBy("panel", "asset")
    known = F.when(F.col("close").isNotNull(), F.col("bar_date"))
    marked = panel.withColumns({
        "__before": F.coalesce(F.last(known, ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0)), F.min("bar_date").over(run)),
        "__after": F.coalesce(F.first(known, ignorenulls=True).over(by_asset().rowsBetween(0, Window.unboundedFollowing)), F.max("bar_date").over(run)),
    }).where("close is null")
    runs = marked.groupBy("panel", "asset", "__before", "__after").agg(F.min("bar_date").alias("begin"), F.max("bar_date").alias("end"), F.count("*").alias("bars"))
    out = runs.withColumn("days", F.datediff("__after", "__before"))
    return out.where(F.col("days") > days).select("panel", "asset", "begin", "end", "bars", "days")


def aligned(panel: DataFrame, least: int = 3, bars: int = FILL_BARS, days: int = 2) -> DataFrame:
    """(panel, bar_date, bar_idx, asset, close, stale): the union calendar's bars at which every asset has a price.

    Gaps are filled from up to `bars` bars before, then behind; assets without any price go, and a panel of fewer than
    `least` others has no rows. bar_idx stays that of the union calendar; stale says that the asset's filled prices end over `days` days before it does.
    """
    known = panel.where("close is not null").select("panel", "asset").distinct().withColumn("__n", F.count("*").over(Window.partitionBy("panel"))).where(F.col("__n") >= least).drop("__n")
    whole = filled(panel.join(known, ["panel", "asset"], "left_semi"), bars)
    ends = staleness(whole, days).select("panel", "asset", "stale")
    return complete(whole).join(ends, ["panel", "asset"]).select("panel", "bar_date", "bar_idx", "asset", "close", "stale")


def trimmed(panel: DataFrame) -> DataFrame:
    """From the first bar at which all assets have had a price, complete bars only."""
    begin = panel.where("close is not null").groupBy("panel", "asset").agg(F.min("bar_date").alias("since")).groupBy("panel").agg(F.max("since").alias("since"))
    return complete(panel.join(begin, "panel").where(F.col("bar_date") >= F.col("since")).drop("since"))


def wide(panel: DataFrame, assets: list[str]) -> DataFrame:
    """One column for each of the given assets, for exchange with matrix code."""
    return panel.groupBy("panel", "bar_date", "bar_idx").pivot("asset", assets).agg(F.first("close"))


def from_wide(frame: DataFrame, panel: str, date: str = "bar_date") -> DataFrame:
    """A long panel from a frame with a date column and one column an asset."""
    assets = [c for c in frame.columns if c != date]
    long = frame.select(F.col(date).cast("date").alias("bar_date"), *assets).unpivot("bar_date", assets, "asset", "close")
    long = long.select(F.lit(panel).alias("panel"), "bar_date", "asset", F.when(~F.isnan("close"), F.col("close")).alias("close"))
    return long.join(bar_axis(long), ["panel", "bar_date"]).select("panel", "bar_date", "bar_idx", "asset", "close")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel: Parquet, or else CSV; empty if there is neither."""
    schema = "panel string, bar_date date, bar_idx int, asset string, close double"
    for kind in ("parquet", "csv"):
        try:
            found = spark.read.schema(schema).format(kind).option("header", True).load(path)
            if not found.isEmpty():
                return found
        except Exception as e:  # noqa: BLE001 - Spark's analysis errors share no narrower public class
            if "PATH_NOT_FOUND" not in str(e) and "CANNOT_READ_FILE" not in str(e) and "is not a Parquet file" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def write(panel: DataFrame, path: str) -> None:
    """Parquet by year, so that ranges of dates read only their part."""
    panel.withColumn("year", F.year("bar_date")).write.mode("overwrite").partitionBy("year").parquet(path)


def metadata(panel: DataFrame, source: str) -> DataFrame:
    """One row: where a panel comes from and what its gaps were treated with, as JSON."""
    firsts = panel.where("close is not null").groupBy("asset").agg(F.min("bar_date").alias("d"))
    found = firsts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", F.col("d").cast("string"))))).alias("first_valid"))
    return found.select(F.to_json(F.struct(F.lit(source).alias("source"), F.lit(f"forward and back {FILL_BARS} bars").alias("fill_policy"), F.lit("listwise").alias("missing_policy"), "first_valid")).alias("metadata"))


def ohlcv_outliers(bars: DataFrame, z: float = 5.0, most: int = 20) -> DataFrame:
    """(asset, bar_date, z): up to `most` log returns an asset beyond z deviations, where there are over 10.

    Raises ValueError if one of open, high, low, close, volume is missing.
    """
    if lacking := {"open", "high", "low", "close", "volume"} - set(bars.columns):
        raise ValueError(f"columns missing: {sorted(lacking)}")
    order, whole = Window.partitionBy("asset").orderBy("bar_date"), Window.partitionBy("asset")
    r = bars.select("asset", "bar_date", F.log(F.col("close") / F.lag("close").over(order)).alias("r")).where("r is not null")
    scored = r.select("asset", "bar_date", ((F.col("r") - F.avg("r").over(whole)) / F.stddev_samp("r").over(whole)).alias("z"), F.count("*").over(whole).alias("n"))
    far = scored.where((F.col("n") > 10) & (F.abs("z") > z))
    return far.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("asset", "bar_date", "z")


def replayed(panel: DataFrame, cursor: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """The bars up to a cursor, as a simulated feed shows them, with optional lognormal noise."""
    part = panel.where(F.col("bar_idx") <= cursor)
    return part.withColumn("close", F.col("close") * F.exp(F.randn(seed) * noise)) if noise else part


def synthetic(spark: SparkSession, bars: int = 400, assets: int = 6, seed: int = 42, drift: float = 0.00028, vol: float = 0.01) -> DataFrame:
    """A seeded random walk on business days from 2020-01-01: a fixture of `bars` times `assets` numbers."""
    import numpy as np
    import pandas as pd

    steps = np.random.default_rng(seed).standard_normal((bars, assets)) * vol + drift
    days = pd.bdate_range("2020-01-01", periods=bars)
    frame = pd.DataFrame(100 * np.exp(steps.cumsum(0)), columns=[f"AS{i}" for i in range(assets)])
    frame.insert(0, "bar_date", days.date)
    return from_wide(spark.createDataFrame(frame), "synthetic")


def universe(spark: SparkSession, sf_dir: str, profile: str = "core") -> DataFrame:
    """(asset, asset_class): parts as instruments; `core` leaves out the classes that are too volatile."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("asset"), F.col("p_brand").alias("asset_class"), "p_partkey")
    volatile = parts.groupBy("asset_class").agg(F.max("p_partkey").alias("m")).where("m % 5 = 0").select("asset_class")
    return parts if profile == "full" else parts.join(volatile, "asset_class", "left_anti").select(*parts.columns)
