"""Returns, covariances, volatility, drawdowns and the correlation-stress signal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..sources.panels import by_asset, trailing

YEAR = 252
PAIR = ["panel", "a", "b"]


def whole(*keys: str) -> Window:
    return Window.partitionBy("panel", *keys)


def series(*keys: str) -> Window:
    """One value a bar: a panel's bars in order."""
    return Window.partitionBy("panel", *keys).orderBy("bar_idx")


def returns(panel: DataFrame) -> DataFrame:
    """panel with lr, the log return from the bar before."""
    return panel.withColumn("lr", F.log(F.col("close") / F.lag("close").over(by_asset())))


def returns_10d(panel: DataFrame, bars: int = 10) -> DataFrame:
    """(panel, bar_date, bar_idx, asset, lr10): overlapping sums of `bars` returns, where all are known."""
    r = returns(panel)
    summed = F.when(F.count("lr").over(trailing(bars)) == bars, F.sum("lr").over(trailing(bars)))
    return r.select("panel", "bar_date", "bar_idx", "asset", "lr", summed.alias("lr10"))


def last_bars(df: DataFrame, bars: int) -> DataFrame:
    """The rows of a panel's last bars."""
    return df.withColumn("__last", F.max("bar_idx").over(whole())).where(F.col("bar_idx") > F.col("__last") - bars).drop("__last")


def skip_recent(df: DataFrame, bars: int) -> DataFrame:
    return df.withColumn("__last", F.max("bar_idx").over(whole())).where(F.col("bar_idx") <= F.col("__last") - bars).drop("__last")


def pairs(r: DataFrame, strict: bool = True) -> DataFrame:
    """(panel, bar_date, bar_idx, a, b, ra, rb) of assets a < b (or a <= b) at each bar."""
    a = r.select("panel", "bar_date", "bar_idx", F.col("asset").alias("a"), F.col("lr").alias("ra"))
    b = r.select("panel", "bar_idx", F.col("asset").alias("b"), F.col("lr").alias("rb"))
    return a.join(b, ["panel", "bar_idx"]).where(F.col("a") < F.col("b") if strict else F.col("a") <= F.col("b"))


def sample_covariance(panel: DataFrame, window: int = YEAR) -> DataFrame:
    """(panel, a, b, cov, n) of the last `window` bars; pairs of known returns only."""
    recent = last_bars(returns(panel), window).where("lr is not null")
    return pairs(recent, False).groupBy(*PAIR).agg(F.covar_samp("ra", "rb").alias("cov"), F.count("*").alias("n"))


def both_ways(cov: DataFrame) -> DataFrame:
    """(panel, asset, other, ...) of pair rows a <= b: each off-diagonal pair in both directions."""
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("asset"), F.col("b").alias("other")))).otherwise(F.array(F.struct(F.col("a").alias("asset"), F.col("b").alias("other")), F.struct(F.col("b").alias("asset"), F.col("a").alias("other"))))
    return cov.withColumn("way", F.explode(ways)).select("*", "way.asset", "way.other").drop("way")


def ewma_covariance(panel: DataFrame, window: int = YEAR, lam: float = 0.94) -> DataFrame:
    """(panel, a, b, cov) with weights 1, (1-l), (1-l)l, (1-l)l^2... from the last bar back, about weighted means."""
    r = last_bars(returns(panel), window).where("lr is not null")
    both = pairs(r, False).withColumn("k", F.max("bar_idx").over(Window.partitionBy(*PAIR)) - F.col("bar_idx"))
    w = F.when(F.col("k") == 0, 1.0).otherwise((1 - lam) * F.pow(F.lit(lam), F.col("k") - 1))
    sums = both.withColumn("w", w).groupBy(*PAIR).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * v).alias(n) for n, v in (("x", F.col("ra")), ("y", F.col("rb")), ("xy", F.col("ra") * F.col("rb")))])
    return sums.select(*PAIR, (F.col("xy") / F.col("w") - F.col("x") * F.col("y") / F.pow("w", 2)).alias("cov"))


def beta(panel: DataFrame, benchmark: str, window: int = YEAR) -> DataFrame:
    """(panel, asset, beta): slope on the benchmark's returns over the last `window` common bars; 0 without benchmark."""
    r = returns(panel).where("lr is not null")
    market = r.where(F.col("asset") == benchmark).select("panel", "bar_idx", F.col("lr").alias("m"))
    recent = last_bars(r.join(market, ["panel", "bar_idx"], "left"), window)
    slope = F.when(F.col("asset") == benchmark, 1.0).when(F.count("m") == 0, 0.0).when(F.count("m") >= 2, F.regr_slope("lr", "m"))
    return recent.groupBy("panel", "asset").agg(slope.alias("beta"))


def sharpe(panel: DataFrame, s: Settings = DEFAULT, window: int = YEAR) -> DataFrame:
    """(panel, asset, sharpe) over the last `window` known returns, of 10 at least."""
    r = returns(panel).where("lr is not null").withColumn("k", F.row_number().over(Window.partitionBy("panel", "asset").orderBy(F.desc("bar_idx")))).where(F.col("k") <= window)
    value = F.when((F.count("lr") >= 10) & (F.stddev_samp("lr") > 0), F.sqrt(F.lit(float(YEAR))) * (F.avg("lr") - s.daily_rf) / F.stddev_samp("lr"))
    return r.groupBy("panel", "asset").agg(value.alias("sharpe"))


def drawdown(panel: DataFrame) -> DataFrame:
    """panel with drawdown, the close over its running maximum less one."""
    return panel.withColumn("drawdown", F.col("close") / F.max("close").over(by_asset().rowsBetween(Window.unboundedPreceding, 0)) - 1)


def equal_weights(panel: DataFrame) -> DataFrame:
    """(panel, asset, w) of one over the number of assets."""
    assets = panel.select("panel", "asset").distinct()
    return assets.withColumn("w", 1.0 / F.count("*").over(whole()))


def portfolio_drawdown(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel, bar_date, bar_idx, value, drawdown) of a basket bought at the first bar."""
    first = F.first("close").over(by_asset().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    value = panel.withColumn("rebased", F.col("close") / first).join(weights, ["panel", "asset"]).groupBy("panel", "bar_date", "bar_idx").agg(F.sum(F.col("w") * F.col("rebased")).alias("value"))
    return value.withColumn("drawdown", F.col("value") / F.max("value").over(series().rowsBetween(Window.unboundedPreceding, 0)) - 1)


def portfolio_returns(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel, bar_date, bar_idx, pr): weighted log returns, unknown ones as nought; from the second bar."""
    r = returns(panel).where("bar_idx > 1").join(weights, ["panel", "asset"])
    return r.groupBy("panel", "bar_date", "bar_idx").agg(F.sum(F.coalesce(F.col("lr") * F.col("w"), F.lit(0.0))).alias("pr"))


def portfolio_sharpe(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, sharpe) over the whole history."""
    return portfolio_returns(panel, weights).groupBy("panel").agg((F.sqrt(F.lit(float(YEAR))) * (F.avg("pr") - s.daily_rf) / F.stddev_samp("pr")).alias("sharpe"))


def rolling_vol(panel: DataFrame, window: int = 21, least: int = 5, otherwise: float = 0.2) -> DataFrame:
    """panel's returns with vol, annualised over trailing bars; `otherwise` where there are few."""
    r = returns(panel)
    w = trailing(window)
    return r.withColumn("vol", F.when(F.count("lr").over(w) >= least, F.stddev_samp("lr").over(w) * F.sqrt(F.lit(float(YEAR)))).otherwise(otherwise))


def autocorrelation(panel: DataFrame, window: int = 60) -> DataFrame:
    """(panel, asset, autocorr): of the last returns with the ones before them; 0 if fewer than 10."""
    r = last_bars(returns(panel).where("lr is not null"), window)
    both = r.withColumn("before", F.lag("lr").over(by_asset()))
    return both.groupBy("panel", "asset").agg(F.when(F.count("*") >= 10, F.corr("lr", "before")).otherwise(0.0).alias("autocorr"))


def ewm_moments(values: str, lam: float, window: int) -> Column:
    """Bias-corrected exponentially weighted deviation of the trailing `window` values, over an asset's bars.

    Weights are l^(n-1) for the oldest and (1-l) l^(n-1-i) for the others; the
    weighted variance is scaled by S^2 / (S^2 - sum of squares).
    """
    kept = F.collect_list(values).over(trailing(window))
    n = F.size(kept)
    w = F.transform(kept, lambda x, i: F.struct(x.alias("x"), F.when(i == 0, F.pow(F.lit(lam), n - 1)).otherwise((1 - lam) * F.pow(F.lit(lam), n - 1 - i)).alias("w")))

    def total(f) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda acc, e: acc + f(e))

    s, q, m1, m2 = total(lambda e: e.w), total(lambda e: e.w * e.w), total(lambda e: e.w * e.x), total(lambda e: e.w * e.x * e.x)
    variance = (m2 / s - F.pow(m1 / s, 2)) * s * s / (s * s - q)
    return F.when(n >= 2, F.sqrt(F.greatest(variance, F.lit(0.0))))


def coverage_aligned(panel: DataFrame, window: int = YEAR, share: float = 0.97, least: int = 5) -> DataFrame:
    """Returns of the assets that are known on `share` of the last bars in both horizons (all, if fewer than `least` are)."""
    r = returns_10d(panel)
    recent = last_bars(r, window).groupBy("panel", "asset").agg((F.least(F.avg(F.col("lr").isNotNull().cast("double")), F.avg(F.col("lr10").isNotNull().cast("double"))) >= share).alias("good"))
    chosen = recent.withColumn("enough", F.sum(F.col("good").cast("int")).over(whole()) >= least).where("good or not enough").select("panel", "asset")
    kept = r.join(chosen, ["panel", "asset"], "left_semi")
    missing = F.sum((F.col("lr").isNull() | F.col("lr10").isNull()).cast("int")).over(whole("bar_idx"))
    return kept.withColumn("__missing", missing).where("__missing = 0").drop("__missing")


def average_correlation(panel: DataFrame, s: Settings = DEFAULT, warmup: int | None = None) -> DataFrame:
    """(panel, bar_date, bar_idx, avg_corr, n_pairs): mean of all pairs' rolling correlations, once `warmup` returns are known, and of how many."""
    warmup = s.backtest.warmup if warmup is None else warmup
    r = returns(panel).where("lr is not null")
    w = Window.partitionBy(*PAIR).orderBy("bar_idx").rowsBetween(-(s.corr.cov_window - 1), 0)
    rolled = pairs(r).select("panel", "bar_date", "bar_idx", F.corr("ra", "rb").over(w).alias("rho"), F.count("*").over(w).alias("n"))
    return rolled.where(F.col("n") >= min(warmup, s.corr.cov_window)).groupBy("panel", "bar_date", "bar_idx").agg(F.avg("rho").alias("avg_corr"), F.count("*").alias("n_pairs"))


def corr_z(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """bars (with avg_corr) with corr_mean, corr_std, corr_z and bucket over a trailing window that holds the bar itself."""
    w = series().rowsBetween(-(s.corr.window - 1), 0)
    n = F.count("avg_corr").over(w)
    sd = F.coalesce(F.stddev_samp("avg_corr").over(w), F.lit(1.0))
    out = bars.withColumn("corr_mean", F.avg("avg_corr").over(w)).withColumn("corr_std", F.when(n < 10, sd).otherwise(sd + s.corr.eps))
    out = out.withColumn("corr_z", F.when(F.col("corr_std") > 0, (F.col("avg_corr") - F.col("corr_mean")) / F.col("corr_std")).otherwise(0.0))
    return out.withColumn("bucket", bucket(F.col("corr_z"), s))


def bucket(z: Column, s: Settings = DEFAULT) -> Column:
    return F.when(z > s.corr.z_high, "crisis_spike").when(z < s.corr.z_low, "diversification").otherwise("normal")


def neutral(bars: DataFrame) -> DataFrame:
    """bars of a corr_z path with a correlation signal that says nothing: no deviation, and always the normal bucket."""
    return bars.withColumns({"corr_mean": F.col("avg_corr"), "corr_std": F.lit(1.0), "corr_z": F.lit(0.0), "bucket": F.lit("normal")})


def corr_z_path(panel: DataFrame, s: Settings = DEFAULT, warmup: int | None = None) -> DataFrame:
    """Is correlation stress elevated? (panel, bar_date, bar_idx, avg_corr, corr_mean, corr_std, corr_z, bucket)."""
    return corr_z(average_correlation(panel, s, warmup).drop("n_pairs"), s)


def return_lines(panel: DataFrame) -> DataFrame:
    """(panel, bar_idx, names, lr, next, whole, whole_10): one row a bar.

    names are the panel's assets in order; lr and next hold each one's return to the bar and from it to the next
    one, NaN where unknown; whole and whole_10 say whether all assets have theirs over 1 and 10 bars.
    """
    names = panel.groupBy("panel").agg(F.array_sort(F.collect_set("asset")).alias("names"))
    r = returns_10d(panel).withColumn("next", F.lead("lr").over(by_asset()))
    rows = r.groupBy("panel", "bar_idx").agg(F.map_from_entries(F.collect_list(F.struct("asset", F.struct("lr", "next")))).alias("x"), F.count("lr").alias("n"), F.count("lr10").alias("n10")).join(names, "panel")
    each = lambda c: F.transform("names", lambda a: F.coalesce(F.element_at("x", a)[c], F.lit(float("nan"))))
    whole = F.col("n") == F.size("names")
    return rows.select("panel", "bar_idx", "names", each("lr").alias("lr"), each("next").alias("next"), whole.alias("whole"), (whole & (F.col("n10") == F.size("names"))).alias("whole_10"))


def strided_correlation(panel: DataFrame, window: int = YEAR, most: int = 2500, block: int = 512) -> DataFrame:
    """(panel, bar_date, bar_idx, avg_corr) of bars where all returns are known: the mean of all pairs' correlations before a bar.

    It is measured at every k-th bar, so that a panel has at most `most` such bars, over the `window` bars before it, and at
    the last bar over the window that ends there; between them it goes by time, and before and after them it stays. Fewer
    bars than `window` give no rows.

    No pair of assets is ever made: with returns standardised over the window, the
    sum of all correlations is that of the squared sums over assets, divided by the
    bars less one. A task gets the lines of `block` bars and of the window before them.
    """
    whole_lines = return_lines(panel).where("whole").select("panel", "bar_idx", "lr")
    numbered = whole_lines.withColumn("t", F.row_number().over(series()) - 1).withColumn("n", F.count("*").over(whole())).where(F.col("n") >= window)
    stride = F.greatest(F.lit(1), F.ceil((F.col("n") - window) / most))
    due = (F.col("t") >= window) & ((F.col("t") - window) % stride == 0) & (F.col("t") < F.col("n") - 1)
    rows = numbered.withColumn("due", due)
    nth = lambda x: F.floor(x / block)
    spread = rows.select("panel", "bar_idx", "t", "due", "lr", F.explode(F.sequence(nth(F.col("t")), nth(F.least(F.col("t") + window, F.col("n") - 1)))).alias("block"))
    # the last window is a block of its own
    last = rows.where(F.col("t") >= F.col("n") - window).select("panel", "bar_idx", "t", (F.col("t") == F.col("n") - 1).alias("due"), "lr", F.lit(-1).cast("long").alias("block"))

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x, t = np.array(rows["lr"].tolist()), rows["t"].to_numpy()
        out = []
        for i in np.flatnonzero(rows["due"].to_numpy()):
            if key[1] >= 0 and t[i] // block != key[1]:
                continue
            own = x[i - window : i] if key[1] >= 0 else x
            sd = own.std(0, ddof=1)
            n = own.shape[1]
            if n > 1 and (sd > 0).all():
                z = ((own - own.mean(0)) / sd).sum(1)
                out.append((key[0], int(rows["bar_idx"].iloc[i]), float((z @ z / (len(own) - 1) - n) / (n * (n - 1)))))
        return pd.DataFrame(out, columns=["panel", "bar_idx", "avg_corr"])

    known = spread.unionByName(last).groupBy("panel", "block").applyInPandas(measure, "panel string, bar_idx int, avg_corr double")
    dates = panel.select("panel", "bar_date", "bar_idx").distinct()
    return interpolated(dates.join(numbered.select("panel", "bar_idx"), ["panel", "bar_idx"]).join(known, ["panel", "bar_idx"], "left"), "avg_corr").select("panel", "bar_date", "bar_idx", "avg_corr")


def overlay(panel: DataFrame, s: Settings = DEFAULT, most: int = 2500) -> DataFrame:
    """(panel, bar_date, bar_idx, drawdown_pct, corr_z, label) along the whole span, under the strided correlation."""
    z = F.col("corr_z")
    label = F.when(z > s.corr.z_high, "STRESSED").when(z < s.corr.z_low, "CALM").otherwise("NORMAL")
    falls = portfolio_drawdown(panel, equal_weights(panel)).select("panel", "bar_idx", (F.col("drawdown") * 100).alias("drawdown_pct"))
    path = corr_z(strided_correlation(panel, s.corr.cov_window, most), s)
    return path.join(falls, ["panel", "bar_idx"]).select("panel", "bar_date", "bar_idx", "drawdown_pct", "corr_z", label.alias("label"))


def interpolated(bars: DataFrame, value: str) -> DataFrame:
    """bars with gaps of `value` filled by time between the known neighbours, and from the nearest one at the ends."""
    past, future = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col(value).isNotNull(), F.col(c))
    v0, d0 = F.last(value, ignorenulls=True).over(past), F.last(known("bar_date"), ignorenulls=True).over(past)
    v1, d1 = F.first(value, ignorenulls=True).over(future), F.first(known("bar_date"), ignorenulls=True).over(future)
    out = bars.withColumns({"__v0": v0, "__d0": d0, "__v1": v1, "__d1": d1})
    share = F.datediff("bar_date", "__d0") / F.nullif(F.datediff("__d1", "__d0"), F.lit(0))
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share
    return out.withColumn(value, F.coalesce(F.col(value), between, "__v1", "__v0")).drop("__v0", "__d0", "__v1", "__d1")


def regime_summary(log: DataFrame, value: str = "pnl") -> DataFrame:
    """(panel, regime, mean, sd, n) of a value by regime."""
    return log.groupBy("panel", "regime").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
