"""Scenarios, reverse stress, shocks to a market state, and what screens show."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..config import DEFAULT, Settings
from ..functions import kernels
from ..plans.scratch import small
from . import decide
from .features import both_ways, whole

#: Scenario shocks by asset (fixed values).
SHOCKS = {
    "rates_shock_200bps": {"SHY": -0.02, "IEF": -0.08, "TLT": -0.15, "HYG": -0.12, "EMB": -0.10, "SPY": -0.10, "QQQ": -0.12, "GLD": 0.03},
    "equity_crash": {"SPY": -0.28, "QQQ": -0.32, "IWM": -0.30, "^VIX": 1.8, "UVXY": 0.5, "TLT": 0.06},
    "credit_crisis": {"HYG": -0.35, "EMB": -0.25, "SPY": -0.22, "IEF": 0.06},
    "usd_surge": {"UUP": 0.12, "EMB": -0.15, "BTC-USD": -0.08, "GLD": -0.05, "PDBC": -0.10},
    "oil_spike": {"USO": 0.22, "XLE": 0.15, "XOM": 0.12, "CVX": 0.10, "SPY": -0.05},
    "crypto_contagion": {"BTC-USD": -0.60, "ETH-USD": -0.65, "SOL-USD": -0.70, "BNB-USD": -0.55, "SPY": -0.08, "QQQ": -0.08},
    "stagflation": {"SPY": -0.25, "TLT": -0.15, "GLD": 0.08, "USO": 0.05, "PDBC": 0.12},
}
#: The correlation that crises tend to, and what illiquid positions cost more then (fixed values).
CRISIS_CORRELATION, LIQUIDITY_MULTIPLIER = 0.85, 1.5


def shock_table(spark: SparkSession) -> DataFrame:
    """(scenario, asset, shock) of the built-in scenarios."""
    return spark.createDataFrame([(s, a, float(x)) for s, m in SHOCKS.items() for a, x in m.items()], "scenario string, asset string, shock double")


def normalized_weights(weights: DataFrame) -> DataFrame:
    total = F.sum("w").over(whole())
    return weights.withColumn("w", F.when(total != 0, F.col("w") / total).otherwise(F.col("w")))


def scenario_pnl(weights: DataFrame, shocks: DataFrame, cov: DataFrame, vol_multiple: float = 1.0, corr_shift: float = 0.02) -> DataFrame:
    """(panel, scenario, direct, correlation_effect, vol_effect, total).

    The correlation effect uses the mean covariance beside the diagonal, under
    the name of a correlation, as results depend on it. Assets without a shock
    stand still; shocks may be listed without a leading caret.
    """
    w = normalized_weights(weights)
    n = w.groupBy("panel").agg(F.count("*").alias("n"))
    mean_cov = cov.where("a != b").groupBy("panel").agg(F.sum("cov").alias("c")).join(n, "panel", "right").select("panel", (2 * F.coalesce("c", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) + 1e-9)).alias("mean_cov"))
    names = shocks.select("scenario").distinct()
    hit = w.withColumn("name", F.translate("asset", "^", "")).join(shocks.withColumn("name", F.translate("asset", "^", "")).select("scenario", "name", "shock"), "name").groupBy("panel", "scenario").agg(F.sum(F.col("w") * F.col("shock")).alias("direct"))
    # one row for each panel and scenario; the names come from a table of shocks
    every = n.select("panel").crossJoin(small(names))
    out = every.join(hit, ["panel", "scenario"], "left").fillna(0.0, ["direct"]).join(mean_cov, "panel")
    out = out.withColumn("correlation_effect", corr_shift * F.col("mean_cov") * F.col("direct")).withColumn("vol_effect", (vol_multiple - 1.0) * F.col("direct"))
    return out.select("panel", "scenario", "direct", "correlation_effect", "vol_effect", (F.col("direct") + F.col("correlation_effect") + F.col("vol_effect")).alias("total"))


def reverse_stress(weights: DataFrame, cov: DataFrame, target: float, bound: float = 0.99, ridge: float = 1e-8) -> DataFrame:
    """(panel, asset, shock, distance_sq, binding): the likeliest returns within +-bound that lose `target`.

    Without bounds the shock is cov w target / (w' cov w), which is all there is to it in most panels. Those
    where it would leave the bounds are solved by themselves; `binding` marks the assets that end at one. A target that no
    returns within bounds reach gives nulls.
    """
    w = normalized_weights(weights)
    held = cov.withColumn("cov", F.col("cov") + F.when(F.col("a") == F.col("b"), ridge).otherwise(0.0))
    m = both_ways(held).join(w.select("panel", F.col("asset").alias("other"), F.col("w").alias("wo")), ["panel", "other"]).groupBy("panel", "asset").agg(F.sum(F.col("cov") * F.col("wo")).alias("m")).join(w, ["panel", "asset"])
    v = F.sum(F.col("w") * F.col("m")).over(whole())
    free = m.withColumn("shock", F.col("m") * target / v).withColumn("distance_sq", F.lit(target * target) / v).withColumn("__over", F.max(F.abs("shock")).over(whole()) > bound)
    inside = free.where("not __over").select("panel", "asset", "shock", "distance_sq", F.lit(False).alias("binding"))
    over = free.where("__over").select("panel", "asset", "w")
    # the lower half of a panel's covariance, and its weights on the diagonal
    wa = over.withColumnRenamed("asset", "a")
    rows = held.join(wa, ["panel", "a"]).select("panel", "a", "b", "cov", F.when(F.col("a") == F.col("b"), F.col("w")).alias("w"))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.loc[rows["a"] == rows["b"]].sort_values("a")
        names = own["a"].tolist()
        at = {a: i for i, a in enumerate(names)}
        i, j = rows["a"].map(at).to_numpy(), rows["b"].map(at).to_numpy()
        sigma = np.zeros((len(names), len(names)))
        sigma[i, j] = sigma[j, i] = rows["cov"]
        x = kernels.least_shock(sigma, own["w"].to_numpy(), target, bound)
        if x is None:
            return pd.DataFrame({"panel": key[0], "asset": names, "shock": None, "distance_sq": None, "binding": True})
        return pd.DataFrame({"panel": key[0], "asset": names, "shock": x, "distance_sq": float(x @ np.linalg.solve(sigma, x)), "binding": np.abs(x) >= bound * (1 - 1e-9)})

    return inside.unionByName(rows.groupBy("panel").applyInPandas(solve, "panel string, asset string, shock double, distance_sq double, binding boolean"))


def crisis_blend(rho: DataFrame, share: float, crisis: float = CRISIS_CORRELATION) -> DataFrame:
    """Correlations moved towards a crisis's by a share; the diagonal stays."""
    return rho.withColumn("rho", F.when(F.col("a") == F.col("b"), 1.0).otherwise((1 - share) * F.col("rho") + share * crisis))


def shocked(bars: DataFrame, vol: float = 1.0, corr_z: float = 0.0, tail: float = 1.0, fall: float = 0.0) -> DataFrame:
    """bars (vol_ann, corr_z, tail, drawdown) after multiplicative and additive shocks."""
    return bars.withColumns({"vol_ann": F.col("vol_ann") * vol, "corr_z": F.col("corr_z") + corr_z, "tail": F.col("tail") * tail, "drawdown": F.col("drawdown") + fall})


def difference(base: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, base, shocked) of the fields that differ; rows on one side only have nulls on the other."""
    long = lambda df, name: df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(keys, fields, "field", name)
    joined = long(base, "base").join(long(other, "shocked"), [*keys, "field"], "full")
    return joined.where(~F.col("base").eqNullSafe(F.col("shocked")))


def overridden(bars: DataFrame, exposure: float | None = None, hedge: bool | None = None, suppress: bool | None = None, priority: str | None = None) -> DataFrame:
    """Decided bars with parts of the decision replaced."""
    given = {"exposure": exposure, "hedge": hedge, "suppress": suppress, "priority": priority}
    return bars.withColumns({k: F.lit(v) for k, v in given.items() if v is not None})


def without_anomalies(bars: DataFrame) -> DataFrame:
    """What a bar would be had no detector fired."""
    return bars.withColumns({"anomalies": F.lit(0).cast("long"), "note": F.lit("anomaly_count_forced_zero")})


# ---- what screens show ----


def islands(bars: DataFrame, label: str) -> DataFrame:
    """(panel, label, begin, end, bars): runs of equal labels."""
    w = Window.partitionBy("panel").orderBy("bar_idx")
    runs = bars.withColumn("__c", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("panel", "island", F.col(label).alias("label")).agg(F.min("bar_idx").alias("begin"), F.max("bar_idx").alias("end"), F.count("*").alias("bars")).drop("island")


def downsampled(bars: DataFrame, most: int = 3500) -> DataFrame:
    """Every n-th bar, so that at most about `most` are left; non-finite z count as 0."""
    n = F.count("*").over(whole())
    k = F.row_number().over(Window.partitionBy("panel").orderBy("bar_idx")) - 1
    step = F.greatest(F.lit(1), F.floor(n / most))
    return bars.withColumn("__k", k).withColumn("__s", step).where(F.col("__k") % F.col("__s") == 0).drop("__k", "__s").withColumn("corr_z", F.when(F.col("corr_z").isNull() | F.isnan("corr_z"), 0.0).otherwise(F.col("corr_z")))


def tail_rows(bars: DataFrame, last: int = 5000) -> DataFrame:
    return bars.withColumn("__k", F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("bar_idx")))).where(F.col("__k") <= last).drop("__k")


def var_grid(grid: DataFrame) -> DataFrame:
    """One row a horizon and alpha, a column a method, in per cent. grid: (panel, method, horizon, alpha, var)."""
    return grid.groupBy("panel", "horizon", "alpha").pivot("method", ["hs", "mc"]).agg(F.round(F.first("var") * 100, 6))


def histogram(draws: DataFrame, value: str = "x", bins: int = 55) -> DataFrame:
    """(panel, bin, low, n) of finite values between their extremes."""
    known = draws.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = known.groupBy("panel").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)), F.lit(bins - 1))
    return known.join(ends, "panel").withColumn("bin", b.cast("int")).groupBy("panel", "bin").agg(F.count("*").alias("n"), F.min(value).alias("low"))


def correlation_matrix(rho: DataFrame, assets: list[str]) -> DataFrame:
    """A row an asset, a column an asset."""
    both = rho.select("panel", "a", "b", "rho").unionByName(rho.where("a != b").select("panel", F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    return both.groupBy("panel", "a").pivot("b", assets).agg(F.first("rho"))


def weights_drift(now: DataFrame, target: DataFrame, top: int = 18) -> DataFrame:
    """(panel, asset, now, target, drift): the assets of the largest weights on either side."""
    j = now.withColumnRenamed("w", "now").join(target.withColumnRenamed("w", "target"), ["panel", "asset"], "full").fillna(0.0, ["now", "target"])
    k = F.row_number().over(Window.partitionBy("panel").orderBy(F.greatest(F.abs("now"), F.abs("target")).desc(), "asset"))
    return j.withColumn("k", k).where(F.col("k") <= top).select("panel", "asset", "now", "target", (F.col("now") - F.col("target")).alias("drift"))


def largest(rows: DataFrame, value: str, top: int) -> DataFrame:
    """The rows of the largest absolute values of each panel."""
    k = F.row_number().over(Window.partitionBy("panel").orderBy(F.abs(value).desc(), "asset"))
    return rows.withColumn("__k", k).where(F.col("__k") <= top).drop("__k")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "WARNING", 1).when(severity == "WATCH", 2).otherwise(9)


def feed(events: DataFrame, top: int = 12) -> DataFrame:
    """The latest bar's events, gravest first."""
    now = events.withColumn("__last", F.max("bar_idx").over(whole())).where(F.col("bar_idx") == F.col("__last")).drop("__last")
    k = F.row_number().over(Window.partitionBy("panel").orderBy(severity_rank(F.col("severity")), F.desc("metric"), "asset", "layer"))
    return now.withColumn("rank", k).where(F.col("rank") <= top)


def arrow(move: Column, dead: float = 0.05) -> Column:
    return F.when(move > dead, "up").when(move < -dead, "down").otherwise("flat")


def context_chips(bars: DataFrame) -> DataFrame:
    """bars (avg_corr, percentile, breaches_30, trend) with the short texts of a header."""
    d = 1 - F.col("avg_corr")
    return bars.withColumn("chips", F.array(
        F.when(d > 0.6, "diversified").when(d > 0.35, "partly diversified").otherwise("concentrated"), F.when(F.col("percentile") >= 90, "VaR extreme").when(F.col("percentile") >= 70, "VaR elevated").otherwise("VaR usual"),
        F.when(F.col("breaches_30") >= 3, "breaches clustered").otherwise("breaches few"), F.concat(F.lit("VaR "), F.col("trend")),
    ))


def daily_pct(panel: DataFrame) -> DataFrame:
    """(panel, bar_idx, asset, pct): simple change in per cent."""
    w = Window.partitionBy("panel", "asset").orderBy("bar_idx")
    return panel.select("panel", "bar_idx", "asset", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("pct"))


def disagreement(grid: DataFrame, share: float) -> DataFrame:
    """grid (hs, mc) with disagree: whether historical and model values are apart by more than a share of the latter."""
    return grid.withColumn("disagree", F.abs(F.col("hs") - F.col("mc")) / F.greatest(F.abs("mc"), F.lit(1e-8)) > share)


def finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as nulls, inside structs, arrays and maps too, as JSON has neither."""

    def clean(value: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        if isinstance(kind, StructType):
            return F.when(value.isNotNull(), F.struct(*[clean(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, x: clean(x, kind.valueType))
        return value

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


#: What a snapshot has at its top (fixed values).
SECTIONS = ("meta", "market_state", "decision", "narrative", "risk", "portfolio", "recent_changes", "timeline", "analogs", "research_links", "schema_version")


def snapshot(bars: DataFrame, tail: DataFrame, weights: DataFrame, runs: DataFrame, near: DataFrame, profile: str = "full", s: Settings = DEFAULT) -> DataFrame:
    """(panel, snapshot): a panel's last bar as one struct of sections, in which doubles are finite or null.

    bars: (panel, bar_date, bar_idx, regime, corr_z, bucket, avg_corr, vol_ann, drawdown, anomalies, var_99); tail: risk.tail_block;
    weights: (panel, asset, w); runs: detect.timeline; near: decide.analogs. A section that its table has no rows for is null.
    """
    traced = decide.trace(bars, s)
    known = decide.narrated(traced.withColumns({"priority": F.col("trace.priority"), "exposure": F.col("trace.multiplier"), "hedge": F.col("trace.hedge")}), s).withColumnRenamed("lines", "story")
    last = lambda df: df.withColumn("__last", F.max("bar_idx").over(whole())).where(F.col("bar_idx") == F.col("__last")).drop("__last")
    told = decide.recent_changes(decide.decided(bars, s))
    gathered = lambda df, name: df.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "panel"]))).alias(name))
    out = last(known).join(last(told).select("panel", F.struct(*[c for c in told.columns if c not in ("panel", "bar_idx")]).alias("recent_changes")), "panel", "left")
    out = out.join(tail.select("panel", F.struct(*[c for c in tail.columns if c != "panel"]).alias("tail")), "panel", "left").join(gathered(weights, "portfolio"), "panel", "left").join(gathered(runs, "timeline"), "panel", "left").join(gathered(near, "analogs"), "panel", "left")
    sections = {
        "meta": F.struct(F.lit("live_snapshot_v1").alias("schema_version"), F.col("bar_date").cast("string").alias("as_of"), F.col("bar_idx").alias("cycle"), F.lit(profile).alias("universe_profile")),
        "market_state": F.struct("regime", "corr_z", "bucket", "avg_corr", "vol_ann", "drawdown", "anomalies", "var_99"),
        "decision": F.struct("trace.priority", "trace.multiplier", "trace.rule", "trace.signal", "trace.hedge", "trace.suppress"), "narrative": F.struct("headline", F.col("story").alias("lines")), "risk": F.struct("tail", "trace"),
        "portfolio": F.col("portfolio"), "recent_changes": F.col("recent_changes"), "timeline": F.col("timeline"), "analogs": F.col("analogs"), "research_links": F.array().cast("array<string>"), "schema_version": F.lit("live_snapshot_v1"),
    }
    return finite(out.select("panel", F.struct(*[sections[n].alias(n) for n in SECTIONS]).alias("snapshot")))
