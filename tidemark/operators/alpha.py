"""Alpha sleeves at every bar of a panel, their combination and gating."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import kernels
from ..sources.panels import by_asset, trailing
from .features import ewm_moments, returns, series

KEY = ["panel", "bar_date", "bar_idx", "asset"]
#: Tickers by how their price moves with rates (fixed values).
HIGH_DURATION = ("TLT", "LTPZ", "EDV", "VGLT")
INTERMEDIATE = ("IEF", "VGIT", "IEI", "SPTL", "SCHR", "GOVT")
CASHLIKE = ("SHY", "BIL", "SGOV", "GBIL", "MINT", "JPST")


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def momentum(panel: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(KEY, momentum): mean of horizons' summed returns over their exponentially weighted volatility, each within 3.

    A horizon's volatility has a floor: the 10 % quantile of the asset's own
    volatilities over the horizons.
    """
    a = s.alpha
    r = returns(panel).where("lr is not null")
    for w in a.mom_windows:
        r = r.withColumn(f"v{w}", ewm_moments("lr", a.ewma_lambda, w)).withColumn(f"s{w}", F.sum("lr").over(trailing(w))).withColumn(f"n{w}", F.count("lr").over(trailing(w)))
    vols = F.array_sort(F.filter(F.array(*[F.col(f"v{w}") for w in a.mom_windows]), lambda v: v > 0))
    place = (F.size(vols) - 1) * a.vol_floor_quantile
    low = F.floor(place).cast("int")
    floor = F.get(vols, low) + (place - low) * (F.coalesce(F.get(vols, low + 1), F.get(vols, low)) - F.get(vols, low))
    r = r.withColumn("floor", F.greatest(F.coalesce(floor, F.lit(1e-8)), F.lit(1e-8)))
    total = F.lit(0.0)
    for w in a.mom_windows:
        score = clipped(F.col(f"s{w}") / (F.greatest(F.coalesce(F.col(f"v{w}"), F.col("floor")), F.col("floor")) * F.sqrt(F.lit(float(w)))), -3.0, 3.0)
        total = total + F.when(F.col(f"n{w}") < max(2, min(3, w // 2)), 0.0).otherwise(score)
    return r.select(*KEY, (total / len(a.mom_windows)).alias("momentum"))


def mean_reversion(panel: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(KEY, reversion): the last few returns less the slow drift, over their volatility, reversed and within 3; 0 at first."""
    a = s.alpha
    w, slow = a.mr_window, max(a.mr_slow, a.mr_window + 1)
    r = returns(panel).where("lr is not null").withColumn("v", ewm_moments("lr", a.ewma_lambda, w))
    rest = F.sum("lr").over(trailing(w)) - F.avg("lr").over(trailing(slow)) * w
    z = -(rest / F.greatest(F.col("v"), F.lit(1e-8)) / F.sqrt(F.lit(float(w))))
    return r.select(*KEY, F.when(F.count("lr").over(trailing(slow)) < slow, 0.0).otherwise(clipped(z, -3.0, 3.0)).alias("reversion"))


def carry_tier(asset: Column) -> Column:
    up = F.upper(asset)
    return F.when(up.isin(*HIGH_DURATION), 1.0).when(up.isin(*INTERMEDIATE), 0.72).when(up.isin(*CASHLIKE), 0.35).otherwise(0.45)


def carry(panel: DataFrame, long: str = "TLT", short: str = "SHY", s: Settings = DEFAULT) -> DataFrame:
    """(KEY, carry): level and change of the long asset over the short one, squashed, by the asset's tier; 0 without both."""
    a = s.alpha
    legs = panel.where(F.col("asset").isin(long, short)).groupBy("panel", "bar_idx").agg(F.max(F.when(F.col("asset") == long, F.col("close"))).alias("l"), F.max(F.when(F.col("asset") == short, F.col("close"))).alias("k"))
    level = legs.withColumn("level", F.when((F.col("l") > 0) & (F.col("k") > 0), F.log(F.col("l") / F.col("k"))))
    change = F.coalesce(F.col("level") - F.lag("level", a.carry_bars).over(series()), F.lit(0.0))
    base = level.select("panel", "bar_idx", F.tanh(a.carry_scale * (a.carry_level * F.col("level") + a.carry_change * change)).alias("base"))
    return panel.join(base, ["panel", "bar_idx"], "left").select(*KEY, (F.coalesce("base", F.lit(0.0)) * carry_tier(F.col("asset"))).alias("carry"))


def normal_scores(u: Column) -> Column:
    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        # ranks have few distinct shares
        values, at = np.unique(p.to_numpy(), return_inverse=True)
        return pd.Series(np.array([kernels.normal_quantile(v) for v in values])[at])

    return quantile(u)


def cross_section(mom: DataFrame, value: str = "momentum") -> DataFrame:
    """mom with rank_mean, u and cross: the average rank within the bar, its share, and the normal score within 2.5."""
    bar = Window.partitionBy("panel", "bar_idx")
    ties = F.count("*").over(Window.partitionBy("panel", "bar_idx", value))
    rank = F.rank().over(bar.orderBy(value)) + (ties - 1) / 2
    n = F.count("*").over(bar)
    out = mom.withColumn("rank_mean", rank).withColumn("u", clipped((F.col("rank_mean") - 0.5) / n, 0.001, 0.999))
    return out.withColumn("cross", F.when(n < 2, 0.0).otherwise(clipped(normal_scores(F.col("u")), -2.5, 2.5)))


def quantile_flags(mom: DataFrame, q: float = 0.2, long_only: bool = True, value: str = "momentum") -> DataFrame:
    """mom with flag: 1 for the top share of a bar's ranks, -1 for the bottom (if shorts are allowed)."""
    bar = Window.partitionBy("panel", "bar_idx")
    pct = (F.rank().over(bar.orderBy(value)) + (F.count("*").over(Window.partitionBy("panel", "bar_idx", value)) - 1) / 2) / F.count("*").over(bar)
    low = F.lit(False) if long_only else pct <= q
    return mom.withColumn("pct", pct).withColumn("flag", F.when(low, -1.0).when(pct >= 1 - q, 1.0).otherwise(0.0))


#: How regimes of correlation change the sleeves' weights (momentum, reversion, cross-section, carry).
MULTIPLIERS = {"crisis_spike": (0.78, 1.12, 0.92, 1.0), "diversification": (1.1, 0.88, 1.08, 1.02), "normal": (1.0, 1.0, 1.0, 1.0)}


def sleeve_weights(bucket: Column, s: Settings = DEFAULT) -> list[Column]:
    """The four sleeves' weights in a bucket, which add to what the base weights add to."""
    a = s.alpha
    base = (a.w_momentum, a.w_reversion, a.w_cross, a.w_carry)
    by = {}
    for name, m in MULTIPLIERS.items():
        v = [x * y for x, y in zip(base, m)]
        by[name] = [x * sum(base) / sum(v) for x in v]
    return [F.when(bucket == "crisis_spike", by["crisis_spike"][i]).when(bucket == "diversification", by["diversification"][i]).otherwise(by["normal"][i]) for i in range(4)]


def tilt(bucket: Column, s: Settings = DEFAULT) -> Column:
    return F.when(bucket == "crisis_spike", -s.alpha.w_corr).when(bucket == "diversification", s.alpha.w_corr).otherwise(0.0)


def sleeves(panel: DataFrame, s: Settings = DEFAULT, long: str = "TLT", short: str = "SHY") -> DataFrame:
    """(KEY, momentum, reversion, cross, carry)."""
    return cross_section(momentum(panel, s)).drop("rank_mean", "u").join(mean_reversion(panel, s), KEY).join(carry(panel, long, short, s), KEY)


def combined(parts: DataFrame, path: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(KEY, bucket, signal): weighted sleeves, standardised within the bar, tilted by the correlation bucket."""
    joined = parts.join(path.select("panel", "bar_idx", "bucket"), ["panel", "bar_idx"])
    wm, wr, wx, wc = sleeve_weights(F.col("bucket"), s)
    raw = joined.withColumn("raw", wm * F.col("momentum") + wr * F.col("reversion") + wx * F.col("cross") + wc * F.col("carry"))
    bar = Window.partitionBy("panel", "bar_idx")
    sd = F.stddev_samp("raw").over(bar)
    return raw.select(*KEY, "bucket", (F.when(sd > 1e-10, (F.col("raw") - F.avg("raw").over(bar)) / sd).otherwise(F.col("raw")) + tilt(F.col("bucket"), s)).alias("signal"))


def correlation_only(panel: DataFrame, path: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return panel.join(path.select("panel", "bar_idx", "bucket"), ["panel", "bar_idx"]).select(*KEY, "bucket", tilt(F.col("bucket"), s).alias("signal"))


def gate(regime: Column, anomalies: Column, by_regime: bool = True, by_anomaly: bool = True, count: int = 3) -> Column:
    """What signals are multiplied by in a regime and under many anomalies."""
    a = F.when(regime == "STRESSED", 0.35).when(regime == "TRANSITION", 0.7).otherwise(1.0) if by_regime else F.lit(1.0)
    b = F.when(anomalies >= count, 0.5).otherwise(1.0) if by_anomaly else F.lit(1.0)
    return a * b


def signal_attribution(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """(panel, asset, pnl): the sum of each asset's signal at a bar times its return to the next."""
    r = returns(panel).select("panel", "bar_idx", "asset", "lr")
    joined = signals.join(r, ["panel", "bar_idx", "asset"]).withColumn("held", F.lag("signal").over(by_asset()))
    return joined.groupBy("panel", "asset").agg(F.sum(F.col("held") * F.col("lr")).alias("pnl"))
