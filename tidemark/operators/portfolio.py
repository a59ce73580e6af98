"""Weights, constraints and costs, bar by bar, and the book that folds them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import kernels
from ..plans.scratch import stored
from ..sources.panels import by_asset, trailing
from . import alpha, decide
from .features import PAIR, YEAR, equal_weights, pairs, return_lines, returns

BAR = ["panel", "bar_idx"]


def bar() -> Window:
    return Window.partitionBy(*BAR)


def volatilities(panel: DataFrame, window: int = YEAR) -> DataFrame:
    """(panel, bar_idx, asset, sd) over trailing returns."""
    r = returns(panel).where("lr is not null")
    return r.select(*BAR, "asset", F.stddev_samp("lr").over(trailing(window)).alias("sd"))


def inverse_vol(vols: DataFrame) -> DataFrame:
    """vols with w, one over the deviation; unknown or zero ones count as the bar's median."""
    known = F.when(F.col("sd") > 0, F.col("sd"))
    mid = F.percentile(known, F.lit(0.5)).over(bar())
    return vols.withColumn("__i", 1 / F.coalesce(known, mid)).withColumn("w", F.col("__i") / F.sum("__i").over(bar())).drop("__i")


def signal_inverse_vol(rows: DataFrame, signal: str = "signal") -> DataFrame:
    """rows (sd, signal) with w: positive signals over deviations, or one over deviations if no signal is positive."""
    sd = F.sqrt(F.greatest(F.pow("sd", 2), F.lit(1e-12)))
    pos = F.greatest(F.col(signal), F.lit(0.0))
    raw = F.when(F.sum(pos).over(bar()) < 1e-12, 1 / sd).otherwise(pos / sd)
    return rows.withColumn("__r", raw).withColumn("w", F.coalesce(F.col("__r") / F.sum("__r").over(bar()), F.lit(0.0))).drop("__r")


def from_signals(rows: DataFrame, s: Settings = DEFAULT, signal: str = "signal") -> DataFrame:
    """rows with w in proportion to signals (positive ones only if long-only); equal if there are none."""
    x = F.greatest(F.coalesce(signal, F.lit(0.0)), F.lit(0.0)) if s.portfolio.long_only else F.coalesce(signal, F.lit(0.0))
    gross = F.sum(F.abs(x)).over(bar())
    return rows.withColumn("w", F.when(gross < 1e-12, 1.0 / F.count("*").over(bar())).otherwise(x / gross))


def top_momentum(panel: DataFrame, window: int = 60, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, asset, w): equal weights on the half of the assets that rose most."""
    r = returns(panel).where("lr is not null").withColumn("m", F.sum("lr").over(trailing(window)))
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(bar()) / 2))
    ranked = r.withColumn("k", k).withColumn("rank", F.row_number().over(bar().orderBy(F.desc("m"), "asset")))
    return ranked.select(*BAR, "asset", F.when(F.col("rank") <= F.col("k"), 1.0 / F.col("k")).otherwise(0.0).alias("w"))


def vol_scale(forecast: Column, s: Settings = DEFAULT) -> Column:
    """What weights are multiplied by to meet the target volatility; never above the leverage allowed."""
    return F.when(forecast > 1e-12, F.least(s.portfolio.target_vol / forecast, F.lit(s.portfolio.max_leverage))).otherwise(1.0)


def turnover_cost(before: DataFrame, after: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, turnover, cost) between two weight tables."""
    d = after.select("panel", "asset", F.col("w").alias("wa")).join(before.select("panel", "asset", F.col("w").alias("wb")), ["panel", "asset"], "full")
    turn = F.sum(F.abs(F.coalesce("wa", F.lit(0.0)) - F.coalesce("wb", F.lit(0.0))))
    return d.groupBy("panel").agg(turn.alias("turnover"), (turn * s.portfolio.cost_bps / 1e4).alias("cost"))


def constrained(w: np.ndarray, prior: np.ndarray, s: Settings) -> np.ndarray:
    """Caps on one weight, on gross weight and on turnover, then the cash floor."""
    p = s.portfolio
    w = np.clip(w, 0.0 if p.long_only else -p.max_weight, p.max_weight)
    if (gross := np.abs(w).sum()) > p.max_leverage:
        w = w * (p.max_leverage / gross)
    if (turn := np.abs(w - prior).sum()) > p.turnover_cap:
        w = prior + (w - prior) * (p.turnover_cap / turn)
    if p.min_cash > 0 and (g := w.sum() if p.long_only else np.abs(w).sum()) > 1 - p.min_cash:
        w = w * ((1 - p.min_cash) / g)
    return w


def rolling_covariances(panel: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, a, b, cov) over trailing returns, a <= b."""
    r = returns(panel).where("lr is not null")
    w = Window.partitionBy(*PAIR).orderBy("bar_idx").rowsBetween(-(s.corr.cov_window - 1), 0)
    return pairs(r, False).select(*BAR, "a", "b", F.covar_samp("ra", "rb").over(w).alias("cov"), F.avg("ra").over(w).alias("mean_a"))


MODES = ("baseline", "vol_target_only", "momentum_naive", "placebo_random", "signals_only", "corr_signal_only", "full")


class Made(NamedTuple):
    """What every book of a panel reads; stored once, whatever the number of books."""

    sleeves: DataFrame | None
    vols: DataFrame
    forecast: DataFrame
    lines: DataFrame
    calmest: DataFrame | None


def forecast_vol(panel: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, vol): yearly volatility of the equal-weight portfolio over trailing returns."""
    cov = rolling_covariances(panel, s)
    n = panel.select("panel", "asset").distinct().groupBy("panel").agg(F.count("*").alias("n"))
    term = F.col("cov") * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return cov.join(n, "panel").groupBy(*BAR).agg((F.sqrt(F.sum(term) / F.pow(F.first("n"), 2)) * F.sqrt(F.lit(float(YEAR)))).alias("vol"))


def made(panel: DataFrame, bars: DataFrame, modes: tuple = MODES, s: Settings = DEFAULT) -> Made:
    """The parts that books of these modes share."""
    sleeves = stored(alpha.sleeves(panel, s), "sleeves") if {"signals_only", "full"} & {*modes} else None
    calmest = stored(least_variance(panel, bars, s), "least-variance") if "full" in modes else None
    return Made(sleeves, stored(volatilities(panel), "volatilities"), stored(forecast_vol(panel, s), "forecast"), stored(return_lines(panel), "return-lines"), calmest)


def raw_targets(panel: DataFrame, bars: DataFrame, mode: str, s: Settings = DEFAULT, by_regime: bool = True, by_anomaly: bool = True, use_decision: bool = True, sleeves: DataFrame | None = None, vols: DataFrame | None = None) -> DataFrame:
    """(panel, bar_idx, asset, w, w_hot, regime): what a mode wants to hold, before constraints.

    w_hot: the same if the VaR of the weights held is beyond its limit; it may differ from w for `full`
    only, which alone reads decisions. bars: one row a bar with regime, anomalies, corr_z, bucket.
    sleeves, vols: alpha.sleeves and volatilities of the panel, if they are made already.
    """
    plain = lambda rows: rows.select(*BAR, "asset", "w", F.col("w").alias("w_hot"), F.lit("CALM").alias("regime"))
    if mode == "baseline":
        return plain(panel.join(bars.select(*BAR), BAR).join(equal_weights(panel), ["panel", "asset"]))
    if mode == "vol_target_only":
        return plain(inverse_vol(volatilities(panel) if vols is None else vols))
    if mode == "momentum_naive":
        return plain(top_momentum(panel, s=s))
    if mode == "placebo_random":
        noise = F.sqrt(-2 * F.log((F.abs(F.xxhash64(F.lit(s.seed), "bar_idx", "asset")) % 999_983 + 1) / 999_984.0)) * F.cos(F.lit(2 * np.pi) * (F.abs(F.xxhash64("asset", "bar_idx", F.lit(s.seed))) % 999_983) / 999_983.0)
        return plain(from_signals(panel.select(*BAR, "asset", noise.alias("signal")), s))
    signals = alpha.correlation_only(panel, bars, s) if mode == "corr_signal_only" else alpha.combined(alpha.sleeves(panel, s) if sleeves is None else sleeves, bars, s)
    deciding = mode == "full" and use_decision
    rows = signals.drop("bar_date", "bucket").join(decide.either(bars, s) if deciding else decide.neutral(bars), BAR).join(volatilities(panel) if vols is None else vols, [*BAR, "asset"])
    gated = F.col("signal") * alpha.gate(F.col("regime"), F.col("anomalies"), by_regime, by_anomaly)
    if not deciding:
        out = signal_inverse_vol(rows.withColumn("signal", decide.applied(gated)))
        return plain(out) if mode != "full" else out.select(*BAR, "asset", "w", F.col("w").alias("w_hot"), "regime")
    both = rows.withColumn("__cool", decide.applied(gated, "cool.")).withColumn("__hot", decide.applied(gated, "hot."))
    cool = signal_inverse_vol(both, "__cool").withColumnRenamed("w", "__w")
    return signal_inverse_vol(cool, "__hot").select(*BAR, "asset", F.col("__w").alias("w"), F.col("w").alias("w_hot"), "regime")


class VarOfWeights:
    """The VaR of any weights over a ring of the last complete bars' returns."""

    def __init__(self, assets: int, s: Settings, least: int = 30, ridge: float = 1e-10) -> None:
        self.ring, self.tenth = np.zeros((s.corr.cov_window, assets)), np.zeros(s.corr.cov_window, bool)
        self.n, self.least, self.ridge, self.alpha, self.limit = 0, least, ridge, s.backtest.var_alpha, s.backtest.disagreement
        self.z = -kernels.normal_quantile(1 - self.alpha)
        self.draws, self.random = s.backtest.var_draws, np.random.default_rng(s.seed)

    def add(self, returns: np.ndarray, tenth: bool) -> None:
        at = self.n % len(self.ring)
        self.ring[at], self.tenth[at] = returns, tenth
        self.n += 1

    def of(self, w: np.ndarray) -> tuple[float | None, float | None, bool]:
        """(VaR of normal returns, historical VaR, whether they are far apart) of weights brought to a sum of 1.

        Normal returns are drawn for all assets if the settings ask for draws. Moments are those of the ring; means and history are of bars that have
        returns over 10 bars too. With fewer than `least` such bars there is no history, and the mean counts as 0.
        """
        k = min(self.n, len(self.ring))
        if k < 2:
            return None, None, False
        total = w.sum()
        w = w / total if total > 1e-12 else np.full(len(w), 1 / len(w))
        x = self.ring[:k] @ w
        own = x[self.tenth[:k]]
        if len(own) < self.least:
            return self.z * float(np.sqrt(x.var(ddof=1))), None, False
        normal = self._drawn(w, k) if self.draws else self.z * float(np.sqrt(x.var(ddof=1) + self.ridge * (w @ w))) - float(own.mean())
        past = -float(np.quantile(own, 1 - self.alpha))
        return normal, past, abs(past - normal) / max(normal, 1e-8) > self.limit


    def _drawn(self, w: np.ndarray, k: int) -> float:
        factor = kernels.cholesky(np.atleast_2d(np.cov(self.ring[:k].T)), self.ridge)
        mean = self.ring[:k][self.tenth[:k]].mean(0)
        own = w @ (mean[:, None] + factor @ self.random.standard_normal((len(w), self.draws)))
        self.random.standard_normal((len(w), self.draws))  # those of 10 bars, which no decision reads
        return -float(np.quantile(own, 1 - self.alpha))


_BOOK = "strategy string, panel string, bar_idx int, equity double, gross_equity double, turnover double, pnl double, w_sum double, var_99 double, hs_var_99 double, disagreement boolean, rebalanced boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_BOOK_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in _BOOK.split(", "))])


def book(lines: DataFrame, targets: DataFrame, forecast: DataFrame, s: Settings = DEFAULT, use_target: bool = True, calmest: DataFrame | None = None) -> DataFrame:
    """(strategy, panel, bar_idx, equity, gross_equity, turnover, pnl, w_sum, var_99, hs_var_99, disagreement, rebalanced): the fold over bars.

    lines: return_lines of the panel; targets: (strategy, panel, bar_idx, asset, w, w_hot, regime); forecast:
    (panel, bar_idx, vol), the equal-weight portfolio's yearly volatility; calmest: what STRESSED bars hold
    instead of their targets (least_variance). var_99 and hs_var_99 are those of the weights held before the bar, over
    the returns up to it; if var_99 is beyond its limit, the bar's target is w_hot. Each bar's weights earn the return to the next bar.

    VaR and turnover caps make a bar depend on the one before, so a strategy of a
    panel is one run of rows in bar order; a task reads them one by one and
    keeps only weights, sums and the ring of returns. Strategies, panels, folds and ablations run side by side.
    """
    strategies = targets.select("strategy", "panel").distinct()
    rows = targets.join(forecast, BAR)
    if calmest is not None:
        rows = rows.join(calmest.withColumnRenamed("w", "__calm"), [*BAR, "asset"], "left")
        calm = F.when(F.col("regime") == "STRESSED", F.coalesce("__calm", F.lit(0.0)))
        rows = rows.withColumn("w", F.coalesce(calm, "w")).withColumn("w_hot", F.coalesce(calm, "w_hot"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    held = rows.groupBy("strategy", *BAR).agg(F.map_from_entries(F.collect_list(F.struct("asset", F.struct(zero("w").alias("w"), zero("w_hot").alias("h"))))).alias("t"), F.first("vol").alias("vol"))
    # bars before the first target and between targets fill the ring
    ordered = strategies.join(lines, "panel").join(held, ["strategy", *BAR], "left")
    at = F.transform("names", lambda a: F.element_at("t", a))
    weights = lambda c: F.when(F.col("t").isNotNull(), F.transform(at, lambda x: zero(x[c])))
    flat = ordered.select("strategy", *BAR, "lr", "next", "whole", "whole_10", weights("w").alias("w"), weights("h").alias("w_hot"), "vol")
    sorted_ = flat.repartition("strategy", "panel").sortWithinPartitions("strategy", *BAR)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        names = [x.split()[0] for x in _BOOK.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                if (row["strategy"], row["panel"]) != key:
                    key, n = (row["strategy"], row["panel"]), len(row["lr"])
                    prior, net, gross, i = np.full(n, 1 / n), s.backtest.cash, s.backtest.cash, 0
                    var = VarOfWeights(n, s)
                if row["whole"]:
                    var.add(np.array(row["lr"]), row["whole_10"])
                x = np.array(row["next"])
                if row["w"] is None or np.isnan(x).all():
                    continue
                x = np.nan_to_num(x)
                normal, past, apart = var.of(prior)
                rebalance = i % s.backtest.rebalance_every == 0
                i += 1
                w, turn = prior, 0.0
                if rebalance:
                    w = np.array(row["w_hot"] if normal is not None and normal > s.risk_limit_var99 else row["w"])
                    if use_target and row["vol"] > 1e-12:
                        w = w * min(s.portfolio.target_vol / row["vol"], s.portfolio.max_leverage)
                    w = constrained(w, prior, s)
                    turn = float(np.abs(w - prior).sum())
                pnl = float(w @ x)
                net = net * (1 - turn * s.portfolio.cost_bps / 1e4) * np.exp(pnl)
                gross = gross * np.exp(pnl)
                out.append((*key, row["bar_idx"], net, gross, turn, pnl, float(w.sum()), normal, past, apart, rebalance))
                prior = w
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_BOOK_ARROW)
                out = []

    return sorted_.mapInArrow(fold, _BOOK)


def holdings(weights: DataFrame, panel: DataFrame, equity: float) -> DataFrame:
    """(panel, bar_idx, asset, shares) bought with weights at a bar's closes."""
    return weights.join(panel, [*BAR, "asset"]).select(*BAR, "asset", (F.lit(equity) * F.col("w") / F.col("close")).alias("shares"))


def period_pnl(held: DataFrame, panel: DataFrame) -> DataFrame:
    """(panel, bar_idx, pnl): shares times the change of closes to the next bar."""
    step = panel.withColumn("move", F.lead("close").over(by_asset()) - F.col("close"))
    return held.join(step, [*BAR, "asset"]).groupBy(*BAR).agg(F.sum(F.col("shares") * F.col("move")).alias("pnl"))


def min_variance_weights(cov: DataFrame, cap: float = DEFAULT.portfolio.max_weight, keys: tuple = ("panel",)) -> DataFrame:
    """(keys, asset, w) of least variance; a group is one covariance."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        assets = sorted(set(rows["a"]) | set(rows["b"]))
        sigma = np.zeros((len(assets), len(assets)))
        for a, b, c in zip(rows["a"], rows["b"], rows["cov"]):
            sigma[assets.index(a), assets.index(b)] = sigma[assets.index(b), assets.index(a)] = c
        return pd.DataFrame({**dict(zip(keys, key)), "asset": assets, "w": kernels.min_variance(sigma, cap)})

    types = dict(cov.dtypes)
    return cov.select(*keys, "a", "b", "cov").groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {types[k]}" for k in keys) + ", asset string, w double")


def least_variance(panel: DataFrame, bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, asset, w) of least variance at each STRESSED bar, under its trailing covariance."""
    cov = rolling_covariances(panel, s).join(bars.where("regime = 'STRESSED'").select(*BAR), BAR, "left_semi")
    return min_variance_weights(cov.where("cov is not null"), s.portfolio.max_weight, tuple(BAR))


def class_share(weights: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(panel, share): the weight in assets of one class."""
    hit = weights.join(classes.where(F.col("asset_class") == name).select("asset"), "asset", "left_semi")
    return weights.groupBy("panel").agg(F.sum("w").alias("total")).join(hit.groupBy("panel").agg(F.sum("w").alias("share")), "panel", "left").select("panel", F.coalesce("share", F.lit(0.0)).alias("share"))

