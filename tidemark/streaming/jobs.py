"""Streams: windowed and session counts of events, CUSUM state, and the risk cycle over new bars.

A source is replayed as files in the order of its event time, a bounded number
of them a trigger. Each micro-batch writes a folder of its own and overwrites it
when it is done again, so every row is there exactly once, also after a restart
from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..config import DEFAULT, Settings
from ..functions import kernels
from ..plans.scratch import new_folder, setting, stored
from ..sources import panels

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sliced(df: DataFrame, path: str, by: str, parts: int, first: int = 0) -> None:
    """Write df as files that follow one another in `by` and in time of writing: folders slice=first and on."""
    place = F.col(by).cast("double") if dict(df.dtypes)[by] != "timestamp_ntz" else F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    cuts = df.select(place.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    nth = F.lit(0)
    for cut in sorted(set(cuts)):
        nth = nth + (place > cut).cast("int")
    numbered = stored(df.withColumn("__nth", F.coalesce(nth, F.lit(0))), "slices")
    for i in range(len(set(cuts)) + 1):
        numbered.where(F.col("__nth") == i).drop("__nth").coalesce(1).write.mode("overwrite").parquet(f"{path}/slice={first + i:04d}")


def files_of(spark: SparkSession, path: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A stream of the slices below a path, `files` of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/slice=*")


class Run(NamedTuple):
    """What a stream has written, its micro-batches, and how many rows came after the watermark.

    Before an aggregation late rows of a task and key are one, as they are summed up first.
    """

    rows: DataFrame
    batches: int
    dropped: int


def run_once(stream: DataFrame, mode: str, name: str, path: str | None = None) -> Run:
    """Run a stream over all that is there now; another run on the same path goes on where this one ended."""
    spark = stream.sparkSession
    path = path or new_folder(spark, name)
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = q.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in seen for op in p["stateOperators"])
    return Run(spark.read.schema(schema).parquet(f"{path}/out/batch=*"), len(seen), late)


def event_source(spark: SparkSession, sf_dir: str, parts: int = 6, by: str = "ts") -> DataFrame:
    """The events table as a stream of files that follow one another in `by`."""
    path = new_folder(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sliced(events, path, by, parts)
    return files_of(spark, path, events.schema)


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and event-time window; rows behind the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n) of each user's bursts of events."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def _shown(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type, from the stream, days that are still open included."""
    out = run_once(windowed(event_source(spark, sf_dir)), "update", "daily-events").rows
    last = out.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return last.select(F.to_date("w.start").cast("string").alias("day"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


def sliding_events(spark: SparkSession, sf_dir: str, length: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Counts by event type in sliding windows, each written once, when the watermark has passed its end."""
    out = run_once(windowed(event_source(spark, sf_dir), length, slide), "append", "sliding-events").rows
    return _shown(out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "event_type", "n", F.round("total", 4).alias("total")), "begin", "end")


def event_sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours") -> DataFrame:
    """Each user's bursts of events, written once, when the watermark has passed their end."""
    return _shown(run_once(sessions(event_source(spark, sf_dir), gap), "append", "event-sessions").rows, "begin", "end")


class Cusum(StatefulProcessor):
    """A two-sided CUSUM by key over standardised values, whose state outlives a micro-batch."""

    def __init__(self, k: float, h: float):
        self.k, self.h = k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cusum", StructType([StructField("up", DoubleType()), StructField("down", DoubleType()), StructField("n", LongType()), StructField("mean", DoubleType()), StructField("m2", DoubleType()), StructField("alarms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        up, down, n, mean, m2, alarms = self.state.get() if self.state.exists() else (0.0, 0.0, 0, 0.0, 0.0, 0)
        part = pd.concat(list(rows)).sort_values("event_id")  # one slice's rows of a key
        for x in part["value"].to_numpy():
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            if n > 30 and sd > 0:
                z = (x - mean) / sd
                up, down = max(0.0, up + z - self.k), max(0.0, down - z - self.k)
                if up > self.h or down > self.h:
                    alarms, up, down = alarms + 1, 0.0, 0.0
        self.state.update((up, down, n, mean, m2, alarms))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "alarms": [alarms], "up": [up], "down": [down]})

    def close(self) -> None:
        pass


def cusum_alarms(spark: SparkSession, sf_dir: str, s: Settings = DEFAULT, parts: int = 6) -> DataFrame:
    """(event_type, n, alarms, up, down) after all of the events' values, from a stateful stream over slices by event_id."""
    events = event_source(spark, sf_dir, parts, "event_id").where("value is not null").select("event_type", "event_id", "value")
    out = "event_type string, n long, alarms long, up double, down double"
    with setting(spark, _STORE, _ROCKS):
        stream = events.groupBy("event_type").transformWithStateInPandas(Cusum(s.anomaly.cusum_k_sigma, s.anomaly.cusum_h_sigma), out, "update", "none")
        found = run_once(stream, "update", "cusum").rows
    last = found.groupBy("event_type").agg(F.max_by(F.struct("n", "alarms", "up", "down"), "n").alias("x")).select("event_type", "x.*")
    return last.select("event_type", "n", "alarms", F.round("up", 4).alias("up"), F.round("down", 4).alias("down"))


# ---- the risk cycle ----

PANEL = StructType([StructField("panel", StringType()), StructField("bar_date", DateType()), StructField("bar_idx", IntegerType()), StructField("asset", StringType()), StructField("close", DoubleType())])
_BAR_STATE = StructType([StructField("bar_idx", IntegerType()), StructField("closes", ArrayType(DoubleType()))])
_TICK = StructType([
    StructField("bar_date", DateType()), StructField("bar_idx", IntegerType()), StructField("value", DoubleType()), StructField("drawdown", DoubleType()), StructField("ann_vol", DoubleType()), StructField("avg_corr", DoubleType()), StructField("corr_z", DoubleType()),
    StructField("bucket", StringType()), StructField("var_99", DoubleType()), StructField("breach", IntegerType()), StructField("breaches_30", LongType()), StructField("regime", StringType()), StructField("event", StringType()), StructField("duration", LongType()),
])
_SUMS = StructType([StructField("assets", ArrayType(StringType())), StructField("first", ArrayType(DoubleType())), StructField("peak", DoubleType()), StructField("late", LongType())])
TICK = StructType([StructField("panel", StringType()), *_TICK, StructField("history", IntegerType()), StructField("late", LongType())])


class RiskCycle(StatefulProcessor):
    """One tick a bar and panel from capped state: the ring of closes, and the ticks before.

    A bar is its complete cross-section of the panel's assets, those of the first bar; a bar that is not
    after the last one comes late: it is left out and counted. Windows are those of the batch operators, so ticks equal their rows:
    correlations and deviations over the last returns with the bar, VaR over those before it.
    """

    def __init__(self, s: Settings, least_corr: int, least_var: int, most: int):
        self.s, self.least_corr, self.least_var, self.most = s, least_corr, least_var, most
        self.z = -kernels.normal_quantile(0.01)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _BAR_STATE)
        self.ticks = handle.getListState("ticks", _TICK)
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = [(int(i), list(c)) for i, c in self.ring.get()] if self.ring.exists() else []
        ticks = [tuple(t) for t in self.ticks.get()] if self.ticks.exists() else []
        assets, first, peak, late = self.sums.get() if self.sums.exists() else (None, None, 0.0, 0)
        made, keep = [], self.s.corr.cov_window + 2
        part = pd.concat(list(rows)).sort_values(["bar_idx", "asset"])  # one slice's bars of a panel
        for bar, own in part.groupby("bar_idx", sort=True):
            if ring and bar <= ring[-1][0]:
                late += 1
                continue
            closes = dict(zip(own["asset"], own["close"]))
            assets = list(assets or sorted(closes))
            now = [float(closes.get(a, np.nan)) for a in assets]
            first = list(first or now)
            ring = [*ring, (int(bar), now)][-keep:]
            value = float((np.array(now) / np.array(first)).mean())
            peak = max(peak, value)
            tick = self.tick(own["bar_date"].iloc[0], int(bar), value, value / peak - 1, np.array([c for _, c in ring]), ticks)
            ticks = [*ticks, tick][-self.most :]
            made.append((key[0], *tick, len(ticks), late))
        self.ring.put(ring)
        self.ticks.put(ticks)
        self.sums.update((assets, first, peak, late))
        yield pd.DataFrame(made, columns=TICK.names)

    def tick(self, date, bar: int, value: float, drawdown: float, closes: np.ndarray, before: list[tuple]) -> tuple:
        names = _TICK.names
        last = dict(zip(names, before[-1])) if before else None
        r = np.diff(np.log(closes), axis=0)
        pr, r = r.mean(1), r[-self.s.corr.cov_window :]
        vol = corr = z = bucket = var = breach = breaches = regime = event = duration = None
        if len(r) >= 2:
            vol = float((np.sqrt(np.median(r.var(axis=0, ddof=1))) + 1e-8) * np.sqrt(252))
        if len(r) >= self.least_corr:
            rho = np.corrcoef(r, rowvar=False)
            corr = float(rho[np.triu_indices(len(rho), 1)].mean())
            past = [dict(zip(names, t))["avg_corr"] for t in before[-(self.s.corr.window - 1) :]]
            x = np.array([c for c in past if c is not None] + [corr])
            sd = float(x.std(ddof=1)) if len(x) > 1 else None
            sd = (1.0 if sd is None else sd) if len(x) < 10 else sd + self.s.corr.eps
            z = (corr - float(x.mean())) / sd if sd > 0 else 0.0
            bucket = "crisis_spike" if z > self.s.corr.z_high else "diversification" if z < self.s.corr.z_low else "normal"
            g = self.s.regime
            regime = "STRESSED" if corr > g.stressed_corr else "TRANSITION" if corr > g.transition_corr or vol > g.transition_vol or drawdown < g.transition_drawdown else "CALM"
            same = last is not None and last["regime"] == regime
            event = "init" if last is None or last["regime"] is None else "no_change" if same else "changed"
            duration = last["duration"] + 1 if same else 1
        if len(pr) > self.least_var:  # the bar's own return is judged by those before it
            own = pr[:-1][-self.s.corr.cov_window :]
            var = float(self.z * own.std(ddof=1) - own.mean())
            breach = int(pr[-1] < -var)
            breaches = sum(dict(zip(names, t))["breach"] or 0 for t in before[-29:]) + breach
        return (date, bar, value, drawdown, vol, corr, z, bucket, var, breach, breaches, regime, event, duration)

    def close(self) -> None:
        pass


def risk_cycle(bars: DataFrame, name: str = "risk-cycle", path: str | None = None, s: Settings = DEFAULT, least_corr: int = 130, least_var: int = 60, most: int = 2000) -> Run:
    """Ticks of a stream of panel rows; on the same path it goes on from its checkpoint."""
    with setting(bars.sparkSession, _STORE, _ROCKS):
        stream = bars.groupBy("panel").transformWithStateInPandas(RiskCycle(s, least_corr, least_var, most), TICK, "append", "none")
        return run_once(stream, "append", name, path)


def replayed_cycle(spark: SparkSession, panel: DataFrame, parts: int = 8) -> Run:
    """The ticks of a panel whose bars come in slices, a micro-batch each."""
    path = new_folder(spark, "bars")
    sliced(panel.select(*PANEL.names), path, "bar_idx", parts)
    return risk_cycle(files_of(spark, path, PANEL))


def cycle(spark: SparkSession, source: str, store: str, judge: Callable[[DataFrame], DataFrame], look_back: int = 504) -> None:
    """For each batch of new bars: append them to the panel's table, judge the last bars and store the rows by bar.

    source: a folder of Parquet panel rows; store: where `panel` and `snapshot`
    tables are kept. `judge` makes rows with panel and bar_idx from a panel.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/panel/batch={number}")
        panel = spark.read.schema(PANEL).parquet(f"{store}/panel/batch=*").dropDuplicates(["panel", "bar_idx", "asset"])
        newest = panel.groupBy("panel").agg(F.max("bar_idx").alias("__m"))
        recent = panel.join(newest, "panel").where(F.col("bar_idx") > F.col("__m") - look_back).drop("__m")
        fresh = batch.select("panel", "bar_idx").distinct()
        judge(recent).join(fresh, ["panel", "bar_idx"], "left_semi").write.mode("overwrite").parquet(f"{store}/snapshot/batch={number}")

    stream = spark.readStream.schema(PANEL).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start().awaitTermination()


SOURCES = {"raw": panels.raw, "smooth": panels.smooth, "weekly": panels.weekly, "hourly": panels.hourly}
