"""VaR and CVaR, their tests, risk contributions and covariance models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import kernels
from .features import PAIR, YEAR, both_ways, equal_weights, last_bars, pairs, portfolio_returns, returns, returns_10d, sample_covariance, series, whole


def cornish_fisher(z: Column, skew: Column, kurt: Column) -> Column:
    """The quantile z corrected for skewness and excess kurtosis."""
    z2, z3 = z * z, z * z * z
    return z + (z2 - 1) * skew / 6 + (z3 - 3 * z) * kurt / 24 - (2 * z3 - 5 * z) * skew * skew / 36


def tail_shape(pr: DataFrame, value: str = "pr", alpha: float = 0.99) -> DataFrame:
    """(panel, skew, kurt, z_cf, multiplier): population moments, and how much the corrected quantile exceeds the normal one."""
    z = F.lit(kernels.normal_quantile(alpha))
    m = pr.groupBy("panel").agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    return m.withColumn("z_cf", cornish_fisher(z, F.col("skew"), F.col("kurt"))).withColumn("multiplier", F.abs(F.col("z_cf") / z))


def historical(values: DataFrame, keys: list[str], value: str, alphas: tuple) -> DataFrame:
    """(keys, alpha, var, cvar): quantile losses by linear interpolation, mean loss beyond; noughts for fewer than 5 values."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    cuts = [F.percentile(value, F.lit(1 - a)).alias(f"q{i}") for i, a in enumerate(alphas)]
    q = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(*cuts, F.count("*").alias("n"))
    at = F.lit(None).cast("double")
    for i, a in enumerate(alphas):
        at = F.when(F.col("alpha") == a, F.col(f"q{i}")).otherwise(at)
    beyond = rows.join(q, keys).withColumn("q", at).groupBy(*keys, "alpha").agg(F.first("q").alias("q"), F.first("n").alias("n"), F.avg(F.when(F.col(value) <= F.col("q"), F.col(value))).alias("tail"))
    var = F.when(F.col("n") < 5, 0.0).otherwise(-F.col("q"))
    return beyond.select(*keys, "alpha", var.alias("var"), F.when(F.col("n") < 5, 0.0).otherwise(F.greatest(-F.col("tail"), -F.col("q"))).alias("cvar"))


def adjusted(values: DataFrame, keys: list[str], value: str, alphas: tuple) -> DataFrame:
    """(keys, alpha, var, cvar, cf_cvar, multiplier): historical, and the mean loss times how far skew and tails move the quantile.

    values: portfolio returns, whether of history or drawn.
    """
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    shape = known.groupBy(*keys).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    z = F.lit(None).cast("double")
    for a in alphas:
        z = F.when(F.col("alpha") == a, F.lit(kernels.normal_quantile(a))).otherwise(z)
    out = historical(values, keys, value, alphas).join(shape, keys).withColumn("z", z)
    moved = F.abs(cornish_fisher(F.col("z"), F.col("skew"), F.col("kurt")) / F.col("z"))
    multiplier = F.when(F.abs("z") > 1e-8, F.coalesce(F.nanvl(moved, F.lit(1.0)), F.lit(1.0))).otherwise(1.0)
    out = out.withColumn("cf_cvar", F.col("cvar") * multiplier).withColumn("multiplier", F.when(F.col("cvar") > 1e-12, multiplier).otherwise(1.0))
    return out.select(*keys, "alpha", "var", "cvar", "cf_cvar", "multiplier")


def tail_block(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, hs_var_99, hs_cvar_99, mc_var_99, mc_cvar_99, cf_cvar_99, tail_multiplier, trend, breaches_30, breach_today, clustered) of the last bar.

    The first six are over one bar; the last four are var_block's, of the VaR path, with at least five bars of it for clustered.
    """
    one = adjusted(portfolio_horizons(panel, weights).where("horizon = 1"), ["panel"], "x", (0.99,))
    normal = monte_carlo_analytic(panel, weights, s).where("horizon = 1 and abs(alpha - 0.99) < 1e-9").select("panel", F.col("var").alias("mc_var_99"), F.col("cvar").alias("mc_cvar_99"))
    path = rolling_var(portfolio_returns(panel, weights))
    few = path.groupBy("panel").agg(F.count("*").alias("n"))
    block = var_block(path).join(few, "panel").select("panel", "trend", "breaches_30", F.col("breach").alias("breach_today"), (F.col("clustered") & (F.col("n") >= 5)).alias("clustered"))
    return one.select("panel", F.col("var").alias("hs_var_99"), F.col("cvar").alias("hs_cvar_99"), F.col("cf_cvar").alias("cf_cvar_99"), F.col("multiplier").alias("tail_multiplier")).join(normal, "panel").join(block, "panel")


def portfolio_horizons(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel, horizon, bar_idx, x): portfolio returns of 1 and 10 bars where all assets have both."""
    r = returns_10d(panel).withColumn("__missing", F.sum((F.col("lr").isNull() | F.col("lr10").isNull()).cast("int")).over(whole("bar_idx"))).where("__missing = 0")
    sums = r.join(weights, ["panel", "asset"]).groupBy("panel", "bar_idx").agg(F.sum(F.col("w") * F.col("lr")).alias("x1"), F.sum(F.col("w") * F.col("lr10")).alias("x10"))
    return sums.select("panel", "bar_idx", F.explode(F.array(F.struct(F.lit(1).alias("horizon"), F.col("x1").alias("x")), F.struct(F.lit(10).alias("horizon"), F.col("x10").alias("x")))).alias("e")).select("panel", "bar_idx", "e.*")


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel, variance) of w' S w from pair rows a <= b."""
    wa, wb = weights.select("panel", F.col("asset").alias("a"), F.col("w").alias("wa")), weights.select("panel", F.col("asset").alias("b"), F.col("w").alias("wb"))
    term = F.col("wa") * F.col("wb") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return cov.join(wa, ["panel", "a"]).join(wb, ["panel", "b"]).groupBy("panel").agg(F.sum(term).alias("variance"))


def monte_carlo_analytic(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT, window: int = YEAR) -> DataFrame:
    """(panel, alpha, horizon, mu, sigma, var, cvar) of what normal draws of the assets tend to.

    A weighted sum of jointly normal returns is normal, so that quantile and
    tail mean are known. Ten bars use ten times the covariance and the mean of
    ten-bar sums.
    """
    var = portfolio_variance(sample_covariance(panel, window), weights)
    mu = portfolio_horizons(last_bars(panel, window + 10), weights).groupBy("panel", "horizon").agg(F.avg("x").alias("mu"))
    grid = mu.join(var, "panel").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in s.var_alphas])))
    z, d = F.lit(None).cast("double"), F.lit(None).cast("double")
    for a in s.var_alphas:
        q = kernels.normal_quantile(1 - a)
        z = F.when(F.col("alpha") == a, F.lit(q)).otherwise(z)
        d = F.when(F.col("alpha") == a, F.lit(kernels.NORMAL.pdf(q) / (1 - a))).otherwise(d)
    sigma = F.sqrt(F.col("variance") * F.col("horizon"))
    return grid.select("panel", "alpha", "horizon", "mu", sigma.alias("sigma"), (-(F.col("mu") + z * sigma)).alias("var"), (d * sigma - F.col("mu")).alias("cvar"))


def monte_carlo_sampled(panel: DataFrame, weights: DataFrame, sims: int = 10_000, s: Settings = DEFAULT) -> DataFrame:
    """(panel, horizon, sim, x): seeded draws of portfolio returns, dealt over tasks; horizons and panels draw independently."""
    law = monte_carlo_analytic(panel, weights, s).where(F.col("alpha") == s.var_alphas[0]).select("panel", "horizon", "mu", "sigma")
    parts = 16
    # each law is dealt over its draws in two steps, so that no task makes all of them
    dealt = law.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition("panel", "horizon", "part")
    draws = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-sims // parts) - 1))).alias("i")).withColumn("sim", (F.col("i") * parts + F.col("part")).cast("bigint")).where(F.col("sim") < sims)
    # uniform numbers from hashes, independent for each panel, horizon and draw, and the same in every run
    uniform = lambda n: (F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), F.lit(n), "panel", "horizon", "sim"), 11) + 0.5) / float(1 << 53)
    z = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    return draws.select("panel", "horizon", "sim", (F.col("mu") + F.col("sigma") * z).alias("x"))


def drawn_returns(cov: DataFrame, means: DataFrame, draws: int = 10_000, s: Settings = DEFAULT, parts: int = 16, keys: tuple = ("panel",)) -> DataFrame:
    """(keys, sim, asset, r): seeded normal draws of all assets together, under the covariances (keys, a, b, cov) and means (keys, asset, mu).

    A covariance that isn't semidefinite is repaired to the nearest that is. Draws are dealt over `parts`
    tasks for each key, each of which has its own seed, so they are the same in every run.
    """
    cells = cov.select(*keys, F.struct("a", "b", F.col("cov").alias("v")).alias("c")).groupBy(*keys).agg(F.collect_list("c").alias("cells"))
    mu = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("asset", "mu"))).alias("mu"))
    dealt = cells.join(mu, list(keys)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("seed", F.xxhash64(F.lit(s.seed), *keys, "part")).repartition(*keys, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                names, sigma = _matrix(row.cells)
                mean = dict(row.mu) if not isinstance(row.mu, dict) else row.mu
                sims = np.arange(row.part, draws, parts)
                z = np.random.default_rng(row.seed % (1 << 63)).standard_normal((len(sims), len(names)))
                r = np.array([mean.get(n, 0.0) for n in names]) + z @ kernels.cholesky(sigma).T
                out = pd.DataFrame({k: getattr(row, k) for k in keys}, index=range(r.size)) if keys else pd.DataFrame(index=range(r.size))
                yield out.assign(sim=np.repeat(sims, len(names)), asset=names * len(sims), r=r.ravel())

    types = dict(cov.dtypes)
    return dealt.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", sim long, asset string, r double")


def drawn_portfolio(panel: DataFrame, weights: DataFrame, draws: int = 10_000, s: Settings = DEFAULT) -> DataFrame:
    """(panel, sim, x): one bar's portfolio returns, by draws of all assets under the GARCH-DCC covariance, or the sample's where that is incoherent."""
    cov = garch_dcc_covariance(panel, weights, s)
    means = last_bars(returns(panel), YEAR).where("lr is not null").groupBy("panel", "asset").agg(F.avg("lr").alias("mu"))
    return drawn_returns(cov, means, draws, s).join(weights, ["panel", "asset"]).groupBy("panel", "sim").agg(F.sum(F.col("w") * F.col("r")).alias("x"))


def parametric(panel: DataFrame, weights: DataFrame, alpha: float = 0.99, window: int = YEAR) -> DataFrame:
    """(panel, sigma, var): a normal quantile without the mean."""
    v = portfolio_variance(sample_covariance(panel, window), weights)
    return v.select("panel", F.sqrt("variance").alias("sigma"), (F.lit(-kernels.normal_quantile(1 - alpha)) * F.sqrt("variance")).alias("var"))


def risk_contributions(cov: DataFrame, weights: DataFrame, budget: float = DEFAULT.risk_budget) -> DataFrame:
    """(panel, asset, w, contribution, share, status): each asset's part of the portfolio's deviation, against a budget."""
    w = weights.withColumn("w", F.col("w") / F.sum("w").over(whole()))
    marginal = both_ways(cov).join(w.select("panel", F.col("asset").alias("other"), F.col("w").alias("wo")), ["panel", "other"]).groupBy("panel", "asset").agg(F.sum(F.col("cov") * F.col("wo")).alias("m")).join(w, ["panel", "asset"])
    part = marginal.withColumn("p", F.col("w") * F.col("m"))
    sigma = F.sqrt(F.sum("p").over(whole()))
    out = part.select("panel", "asset", "w", (F.col("p") / sigma).alias("contribution"), (F.col("p") / F.sum("p").over(whole())).alias("share"))
    return out.withColumn("status", F.when(F.col("share") > 1.25 * budget, "breach").when(F.col("share") < 0.15 * budget, "low").otherwise("ok"))


def calmar(pr: DataFrame) -> DataFrame:
    """(panel, calmar): yearly mean return over the worst fall of compounded returns; null without a fall."""
    level = F.exp(F.sum("pr").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    path = pr.withColumn("level", level)
    fall = path.withColumn("fall", F.col("level") / F.max("level").over(series().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return fall.groupBy("panel").agg(F.when(F.min("fall") < 0, F.avg("pr") * YEAR / F.abs(F.min("fall"))).alias("calmar"))


def rolling_var(pr: DataFrame, alpha: float = 0.99, window: int = YEAR, least: int = 60) -> DataFrame:
    """pr with var (from the window before the bar) and breach, once `least` returns are known."""
    w = series().rowsBetween(-window, -1)
    z = -kernels.normal_quantile(1 - alpha)
    out = pr.withColumn("n", F.count("pr").over(w)).withColumn("var", z * F.stddev_samp("pr").over(w) - F.avg("pr").over(w)).where(F.col("n") >= least).drop("n")
    return out.withColumn("breach", (F.col("pr") < -F.col("var")).cast("int"))


def kupiec(breaches: DataFrame, p: float = 0.01) -> DataFrame:
    """(panel, n, x, lr): likelihood ratio of the share of breaches against p; 0 if none or all are."""
    c = breaches.groupBy("panel").agg(F.count("*").alias("n"), F.sum("breach").alias("x"))
    q = F.col("x") / F.col("n")
    fit = (F.col("n") - F.col("x")) * F.log(1 - q) + F.col("x") * F.log(q)
    null = (F.col("n") - F.col("x")) * F.log(F.lit(1 - p)) + F.col("x") * F.log(F.lit(p))
    return c.withColumn("lr", F.when((F.col("x") == 0) | (F.col("x") == F.col("n")), 0.0).otherwise(-2 * (null - fit)))


def christoffersen(breaches: DataFrame) -> DataFrame:
    """(panel, n00, n01, n10, n11, lr): independence of successive breaches; 0 for under 10 bars or an empty cell."""
    steps = breaches.withColumn("next", F.lead("breach").over(series())).where("next is not null")
    n = {f"{i}{j}": F.sum(((F.col("breach") == i) & (F.col("next") == j)).cast("int")).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)}
    c = steps.groupBy("panel").agg(*n.values(), F.count("*").alias("steps"))
    a, b, d, e = (F.col(x) for x in ("n00", "n01", "n10", "n11"))
    p01, p11, p = b / (a + b), e / (d + e), (b + e) / (a + b + d + e)
    fit = a * F.log(1 - p01) + b * F.log(p01) + d * F.log(1 - p11) + e * F.log(p11)
    null = (a + d) * F.log(1 - p) + (b + e) * F.log(p)
    empty = (F.least(a, b, d, e) == 0) | (F.col("steps") < 9)
    return c.withColumn("lr", F.when(empty, 0.0).otherwise(-2 * (null - fit))).drop("steps")


def with_p_value(tests: DataFrame, lr: str = "lr") -> DataFrame:
    """tests with p_value of a statistic that is chi-squared with one degree of freedom."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(kernels.chi2_1_tail)

    return tests.withColumn("p_value", tail(F.col(lr).cast("double")))


def vol_errors(forecasts: DataFrame) -> DataFrame:
    """(panel, rmse, mae) of columns forecast and realized."""
    e = F.col("forecast") - F.col("realized")
    return forecasts.groupBy("panel").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def basel(breaches: DataFrame, window: int = YEAR) -> DataFrame:
    """(panel, n, breaches, zone) of the last `window` bars: green up to 4, yellow up to 9, else red; green below 10 bars."""
    c = last_bars(breaches, window).groupBy("panel").agg(F.count("*").alias("n"), F.sum("breach").alias("breaches"))
    return c.withColumn("zone", F.when((F.col("n") < 10) | (F.col("breaches") <= 4), "GREEN").when(F.col("breaches") <= 9, "YELLOW").otherwise("RED"))


def breach_runs(breaches: DataFrame) -> DataFrame:
    """(panel, n, rate, longest): share of breaches and their longest run."""
    island = F.col("bar_idx") - F.row_number().over(Window.partitionBy("panel", "breach").orderBy("bar_idx"))
    runs = breaches.withColumn("island", island).groupBy("panel", "breach", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("panel").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("breach")) / F.sum("n")).alias("rate"), F.coalesce(F.max(F.when(F.col("breach") == 1, F.col("n"))), F.lit(0)).alias("longest"))


def var_block(breaches: DataFrame, history: int = YEAR) -> DataFrame:
    """(panel, bar_idx, var, percentile, breach, breaches_30, trend, clustered) of the last bar.

    percentile: the rank of the value among the last `history` ones, of 8 at
    least; trend: the sign of the mean of the last 14 changes.
    """
    recent = last_bars(breaches, history)
    now = recent.withColumn("last", F.last("var").over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("change", F.col("var") - F.lag("var").over(series())).withColumn("age", F.max("bar_idx").over(whole()) - F.col("bar_idx"))
    below, upto = F.sum((F.col("var") < F.col("last")).cast("int")), F.sum((F.col("var") <= F.col("last")).cast("int"))
    rank = 50.0 * (below + upto + (upto > below).cast("int")) / F.count("*")
    slope = F.avg(F.when(F.col("age") < 14, F.col("change")))
    return now.groupBy("panel").agg(
        F.max("bar_idx").alias("bar_idx"), F.first("last").alias("var"), F.when(F.count("*") >= 8, rank).alias("percentile"), F.max(F.when(F.col("age") == 0, F.col("breach"))).alias("breach"),
        F.sum(F.when(F.col("age") < 30, F.col("breach")).otherwise(0)).alias("breaches_30"), F.when(slope > 1e-5, "increasing").when(slope < -1e-5, "decreasing").otherwise("flat").alias("trend"),
        (F.sum(F.when(F.col("age") < 10, F.col("breach")).otherwise(0)) >= 3).alias("clustered"),
    )


def risk_vs_target(pr: DataFrame, forecast: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, forecast_vol, realized_vol, deviation_bps, deviation_pct, hint): forecast (panel, sigma) against the target."""
    t = s.portfolio.target_vol
    tail = last_bars(pr, 60).groupBy("panel").agg(F.when(F.count("*") >= 10, F.stddev_samp("pr") * F.sqrt(F.lit(float(YEAR)))).alias("r"))
    out = forecast.select("panel", (F.col("sigma") * F.sqrt(F.lit(float(YEAR)))).alias("f")).join(tail, "panel")
    hint = F.when(F.col("f") > t * 1.1, "above target").when(F.col("f") < t * 0.85, "below target").otherwise("near target")
    return out.select("panel", F.round("f", 6).alias("forecast_vol"), F.round(F.coalesce("r", "f"), 6).alias("realized_vol"), F.round((F.col("f") - t) * 10000, 2).alias("deviation_bps"), F.round((F.col("f") - t) / t * 100, 2).alias("deviation_pct"), hint.alias("hint"))


def allocation_delta(before: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """(panel, side, rank, asset, delta): the largest increases and decreases of weights."""
    d = after.select("panel", "asset", F.col("w").alias("wa")).join(before.select("panel", "asset", F.col("w").alias("wb")), ["panel", "asset"], "left").select("panel", "asset", (F.col("wa") - F.coalesce("wb", F.lit(0.0))).alias("delta")).where(F.abs("delta") > 1e-8)
    side = d.withColumn("side", F.when(F.col("delta") > 0, "increase").otherwise("decrease"))
    return side.withColumn("rank", F.row_number().over(Window.partitionBy("panel", "side").orderBy(F.abs("delta").desc(), "asset"))).where(F.col("rank") <= top).select("panel", "side", "rank", "asset", "delta")


def dcc(residuals: DataFrame, a: float = 0.04, b: float = 0.94) -> DataFrame:
    """(panel, a, b, rho): dynamic conditional correlation of residuals (panel, bar_idx, asset, e).

    The recursion is linear, so that its last state is a weighted sum of the
    residuals' products: one pass over pairs, without a loop over bars. The last
    residual isn't used.
    """
    r = residuals.withColumnRenamed("e", "lr").withColumn("bar_date", F.lit(None).cast("date"))
    both = pairs(r, False).withColumn("t", F.max("bar_idx").over(Window.partitionBy("panel")) - F.col("bar_idx"))
    mean_corr = both.groupBy(*PAIR).agg(F.corr("ra", "rb").alias("q0"), F.count("*").alias("n"), F.sum(F.when(F.col("t") >= 1, a * F.pow(F.lit(b), F.col("t") - 1) * F.col("ra") * F.col("rb")).otherwise(0.0)).alias("moved"))
    decay = F.pow(F.lit(b), F.col("n") - 1)
    q = mean_corr.select(*PAIR, ((decay + (1 - a - b) * (1 - decay) / (1 - b)) * F.col("q0") + F.col("moved")).alias("q"))
    own = q.where("a = b").select("panel", F.col("a").alias("x"), F.col("q").alias("qx"))
    out = q.join(own.select("panel", F.col("x").alias("a"), F.col("qx").alias("qa")), ["panel", "a"]).join(own.select("panel", F.col("x").alias("b"), F.col("qx").alias("qb")), ["panel", "b"])
    return out.select("panel", "a", "b", (F.col("q") / F.sqrt(F.col("qa") * F.col("qb"))).alias("rho"))


def covariance_from(rho: DataFrame, vols: DataFrame) -> DataFrame:
    """(panel, a, b, cov) of correlations and volatilities (panel, asset, vol)."""
    va, vb = vols.select("panel", F.col("asset").alias("a"), F.col("vol").alias("va")), vols.select("panel", F.col("asset").alias("b"), F.col("vol").alias("vb"))
    return rho.join(va, ["panel", "a"]).join(vb, ["panel", "b"]).select("panel", "a", "b", (F.col("rho") * F.col("va") * F.col("vb")).alias("cov"))


def standardized(panel: DataFrame, window: int = DEFAULT.garch_window) -> DataFrame:
    """(panel, bar_idx, asset, e): returns of the last bars over their own deviation."""
    r = last_bars(returns(panel), window).where("lr is not null")
    w = Window.partitionBy("panel", "asset")
    return r.select("panel", "bar_idx", "asset", ((F.col("lr") - F.avg("lr").over(w)) / F.stddev_samp("lr").over(w)).alias("e"))


def garch(panel: DataFrame, window: int = DEFAULT.garch_window, most: float = 0.28) -> DataFrame:
    """(panel, asset, forecast, bar_idx, vol, e): GARCH(1,1) by asset; a group is one asset's last `window` bars."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        forecast, path, e = kernels.garch_fit(rows["lr"].to_numpy())
        return pd.DataFrame({"panel": rows["panel"], "asset": rows["asset"], "forecast": min(forecast, most), "bar_idx": rows["bar_idx"], "vol": path, "e": e})

    r = last_bars(returns(panel), window).where("lr is not null").select("panel", "asset", "bar_idx", "lr")
    return r.groupBy("panel", "asset").applyInPandas(fit, "panel string, asset string, forecast double, bar_idx int, vol double, e double")


def garch_dcc_covariance(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, a, b, cov, source): GARCH volatilities and DCC correlations, or the sample covariance where theirs is incoherent.

    Incoherent: a portfolio deviation above 0.035 and above 2.2 times the sample's.
    """
    fitted = garch(panel, s.garch_window)
    vols = fitted.groupBy("panel", "asset").agg(F.first("forecast").alias("vol"))
    cap = vols.groupBy("panel").agg(F.least(F.lit(0.28), F.greatest(8 * F.percentile("vol", F.lit(0.5)), F.lit(0.05))).alias("cap"))
    vols = vols.join(cap, "panel").select("panel", "asset", F.least("vol", "cap").alias("vol"))
    model = covariance_from(dcc(fitted.select("panel", "bar_idx", "asset", "e")), vols)
    sample = sample_covariance(panel).drop("n")
    sizes = portfolio_variance(model, weights).select("panel", F.sqrt("variance").alias("m")).join(portfolio_variance(sample, weights).select("panel", F.sqrt("variance").alias("p")), "panel")
    pick = sizes.select("panel", F.when(F.col("m") > F.greatest(F.lit(0.035), 2.2 * F.col("p")), "sample").otherwise("garch_dcc").alias("source"))
    both = model.withColumn("source", F.lit("garch_dcc")).unionByName(sample.withColumn("source", F.lit("sample")))
    return both.join(pick, ["panel", "source"]).select("panel", "a", "b", "cov", "source")


def matrices(pair_rows: DataFrame, value: str) -> DataFrame:
    """(panel, assets, cells): one row a panel, its matrix as entries; a group is one panel's pairs."""
    return pair_rows.groupBy("panel").agg(F.collect_list(F.struct("a", "b", F.col(value).alias("v"))).alias("cells"))


def _matrix(cells) -> tuple[list[str], np.ndarray]:
    names = sorted({c["a"] for c in cells} | {c["b"] for c in cells})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for c in cells:
        m[at[c["a"]], at[c["b"]]] = m[at[c["b"]], at[c["a"]]] = c["v"]
    return names, m


def contagion_index(rho: DataFrame) -> DataFrame:
    """(panel, contagion): the share of the largest eigenvalue of each panel's correlation matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"panel": b["panel"], "contagion": [kernels.absorption(_matrix(c)[1]) for c in b["cells"]]})

    return matrices(rho, "rho").mapInPandas(run, "panel string, contagion double")


def frobenius_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(panel, change): how far two covariances are apart, as the root of the summed squares."""
    d = before.withColumnRenamed("cov", "c0").join(after.withColumnRenamed("cov", "c1"), PAIR)
    e = F.pow(F.col("c1") - F.col("c0"), 2) * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return d.groupBy("panel").agg(F.sqrt(F.sum(e)).alias("change"))


def correlations(panel: DataFrame, window: int = YEAR) -> DataFrame:
    """(panel, a, b, rho) of the last bars."""
    return pairs(last_bars(returns(panel), window).where("lr is not null"), False).groupBy(*PAIR).agg(F.corr("ra", "rb").alias("rho"))


def portfolio_of(panel: DataFrame) -> DataFrame:
    """Equal-weight portfolio returns from the panel, for the queries."""
    return portfolio_returns(panel, equal_weights(panel))
