"""Backtests, their measures, and studies of what signals say about the bars after them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..plans.scratch import stored
from . import alpha, decide, portfolio
from .features import YEAR, equal_weights, neutral, portfolio_returns, return_lines, series, whole
from .portfolio import BAR
from .risk import portfolio_variance, rolling_var

STRATEGY = ["strategy", "panel"]


def in_order() -> Window:
    return Window.partitionBy(*STRATEGY).orderBy("bar_idx")


def backtest(panel: DataFrame, bars: DataFrame, modes: tuple = portfolio.MODES, s: Settings = DEFAULT, name: str = "", made: portfolio.Made | None = None, **ablation) -> DataFrame:
    """The book of each mode over bars (regime, anomalies, corr_z, bucket), from the warm-up to the last bar but one.

    made: portfolio.made, if several backtests share it.
    """
    use_target = ablation.pop("use_target", True)
    if not ablation.pop("use_correlation", True):
        bars = neutral(bars)
    if not ablation.pop("use_turnover_cap", True):
        s = replace(s, portfolio=replace(s.portfolio, turnover_cap=float("inf")))
    if not ablation.pop("use_costs", True):
        s = replace(s, portfolio=replace(s.portfolio, cost_bps=0.0))
    made = made or portfolio.made(panel, bars, modes, s)
    targets = None
    for mode in modes:
        one = portfolio.raw_targets(panel, bars, mode, s, sleeves=made.sleeves, vols=made.vols, **ablation).join(bars.select(*BAR), BAR).withColumn("strategy", F.lit(name or mode))
        targets = one if targets is None else targets.unionByName(one)
    return portfolio.book(made.lines, targets, made.forecast, s, use_target, made.calmest)


def backtest_log(book: DataFrame, bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """book with each bar's regime, correlation and anomalies, and the decision that its own VaR leads to."""
    own = bars.drop("var_99").join(book, BAR)
    deciding = decide.decided(own.where("strategy = 'full'"), s)
    return deciding.unionByName(decide.neutral(own.where("strategy != 'full'")).select(*deciding.columns))


def breach_stats(book: DataFrame) -> DataFrame:
    """(strategy, panel, var_breach_rate, breach_cluster_max): bars that lose more than the VaR of the weights before them."""
    hits = book.where("var_99 is not null").select(*STRATEGY, "bar_idx", (F.col("pnl") < -F.col("var_99")).cast("int").alias("breach"))
    numbered = hits.withColumn("nth", F.row_number().over(in_order()))
    island = F.col("nth") - F.row_number().over(Window.partitionBy(*STRATEGY, "breach").orderBy("bar_idx"))
    runs = numbered.withColumn("island", island).groupBy(*STRATEGY, "breach", "island").agg(F.count("*").alias("n"))
    rate = F.sum(F.col("n") * F.col("breach")) / F.sum("n")
    return runs.groupBy(*STRATEGY).agg(rate.alias("var_breach_rate"), F.coalesce(F.max(F.when(F.col("breach") == 1, F.col("n"))), F.lit(0)).alias("breach_cluster_max"))


ABLATIONS = {
    "all": {}, "no_regime_gate": {"by_regime": False}, "no_anomaly_gate": {"by_anomaly": False}, "no_gates": {"by_regime": False, "by_anomaly": False},
    "no_decision": {"use_decision": False}, "no_vol_target": {"use_target": False}, "no_decision_no_gates": {"by_regime": False, "by_anomaly": False, "use_decision": False},
    "no_correlation_signal": {"use_correlation": False}, "no_turnover_cap": {"use_turnover_cap": False}, "no_costs": {"use_costs": False},
    "signals_alone": {"by_regime": False, "by_anomaly": False, "use_decision": False, "use_target": False},
}


def ablations(panel: DataFrame, bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The measures of `full` under each set of switched-off parts."""
    out, made = None, portfolio.made(panel, bars, ("full",), s)
    for name, parts in ABLATIONS.items():
        one = backtest(panel, bars, ("full",), s, name, made, **parts)
        out = one if out is None else out.unionByName(one)
    return summary(stored(out, "books"), s)


def cost_sweep(panel: DataFrame, bars: DataFrame, costs: tuple = (5.0, 10.0, 20.0), s: Settings = DEFAULT) -> DataFrame:
    out, made = None, portfolio.made(panel, bars, ("full",), s)
    for bps in costs:
        one = backtest(panel, bars, ("full",), replace(s, portfolio=replace(s.portfolio, cost_bps=bps)), f"cost_{bps:g}", made)
        out = one if out is None else out.unionByName(one)
    return summary(stored(out, "books"), s)


def _measures(book: DataFrame, equity: str, s: Settings) -> DataFrame:
    e = book.withColumn("e", F.col(equity)).withColumn("r", F.col("e") / F.lag("e").over(in_order()) - 1).withColumn("fall", F.col("e") / F.max("e").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rf = s.daily_rf
    n, sd = F.count("r"), F.stddev_samp("r")
    down = F.when(F.col("r") < rf, F.col("r") - rf)
    g = e.groupBy(*STRATEGY).agg(
        F.max_by("e", "bar_idx").alias("last"), F.min_by("e", "bar_idx").alias("first"), n.alias("n"), (sd * F.sqrt(F.lit(float(YEAR)))).alias("ann_vol"), F.min("fall").alias("max_dd"),
        F.when((n >= 5) & (sd > 1e-12), F.sqrt(F.lit(float(YEAR))) * (F.avg("r") - rf) / sd).otherwise(0.0).alias("sharpe"),
        F.when((F.count(down) >= 2) & (F.stddev_samp(down) > 1e-12), F.sqrt(F.lit(float(YEAR))) * (F.avg("r") - rf) / F.stddev_samp(down)).otherwise(0.0).alias("sortino"), F.avg("turnover").alias("mean_turnover"),
    )
    cagr = F.pow(F.col("last") / F.col("first"), 1 / F.greatest(F.col("n") / YEAR, F.lit(1e-6))) - 1
    out = g.withColumn("cagr", cagr).withColumn("calmar", F.when(F.col("max_dd") < -1e-8, F.col("cagr") / F.abs("max_dd")).otherwise(0.0))
    return out.select(*STRATEGY, "n", "cagr", "ann_vol", "sharpe", "sortino", "max_dd", "calmar", "mean_turnover")


def summary(book: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(strategy, panel, n, cagr, ann_vol, sharpe, sortino, max_dd, calmar, mean_turnover), growth, Sharpe and fall before costs, and VaR breaches."""
    net, gross = _measures(book, "equity", s), _measures(book, "gross_equity", s)
    return net.join(gross.select(*STRATEGY, *[F.col(c).alias(f"{c}_gross") for c in ("cagr", "sharpe", "max_dd")]), STRATEGY).join(breach_stats(book), STRATEGY, "left")


def ladder(book: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The measures as a report shows them: four to six digits."""
    r = lambda c, n: F.round(c, n).alias(c)
    return summary(book, s).select("strategy", r("sharpe", 4), r("sharpe_gross", 4), r("max_dd", 6), r("max_dd_gross", 6), r("var_breach_rate", 6), "breach_cluster_max", r("mean_turnover", 6), r("cagr", 6), r("cagr_gross", 6))


def forward(log: DataFrame, horizon: int) -> DataFrame:
    """log (panel, bar_idx, pnl) with fwd_dd, fwd_vol, fwd_breach over the next bars, where all of them exist."""
    w = series().rowsBetween(1, horizon)
    kept = log.withColumn("__next", F.collect_list("pnl").over(w)).withColumn("fwd_vol", F.stddev_pop("pnl").over(w) * F.sqrt(F.lit(float(YEAR)))).where(F.size("__next") == horizon)

    def step(acc: Column, r: Column) -> Column:
        e = acc.e * F.exp(r)
        peak = F.greatest(acc.peak, e)
        return F.struct(e.alias("e"), peak.alias("peak"), F.least(acc.dd, e / peak - 1).alias("dd"))

    fall = F.aggregate("__next", F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd")), step, lambda a: a.dd)
    return kept.withColumn("fwd_dd", fall).withColumn("fwd_breach", F.exists("__next", lambda r: r < -0.02).cast("int")).drop("__next")


def lead_lag(log: DataFrame, horizon: int = 5, z: float = 1.5) -> DataFrame:
    """(panel, condition, n, avg_fwd_dd, avg_fwd_vol, breach_rate): bars of high correlation stress against the others."""
    label = F.when(F.col("corr_z") > z, "high").when(F.abs("corr_z") <= z, "base")
    return forward(log, horizon).withColumn("condition", label).where("condition is not null").groupBy("panel", "condition").agg(F.count("*").alias("n"), F.avg("fwd_dd").alias("avg_fwd_dd"), F.avg("fwd_vol").alias("avg_fwd_vol"), F.avg("fwd_breach").alias("breach_rate"))


def forward_measures(panel: DataFrame, horizons: tuple = (5, 10, 20), block: int = 512) -> DataFrame:
    """(panel, bar_idx, fwd_vol_h, fwd_dd_h, fwd_corr_h for each h): what the next h bars bring, where the panel has that many.

    Of these bars those count at which all assets have a return, max(3, h // 2) of them at least: the deviation of all returns
    by year, the deepest fall of the equal-weight portfolio from its peak among them, and the mean correlation of all pairs,
    which is read off the squared sums of standardised returns. A task gets the lines of `block` bars and of those after them.
    """
    far = max(horizons)
    lines = return_lines(panel).select("panel", "bar_idx", "lr", "whole", (F.row_number().over(series()) - 1).alias("t"), F.count("*").over(whole()).alias("n"))
    spread = lines.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("t") - far, F.lit(0)) / block), F.floor(F.col("t") / block))))
    names = [f"{m}_{h}" for h in horizons for m in ("fwd_vol", "fwd_dd", "fwd_corr")]

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x, known, t, n = np.array(rows["lr"].tolist()), rows["whole"].to_numpy(), rows["t"].to_numpy(), int(rows["n"].iloc[0])
        out = []
        for i in np.flatnonzero(t // block == key[1]):
            own = [key[0], int(rows["bar_idx"].iloc[i])]
            for h in horizons:
                r = x[i + 1 : i + 1 + h][known[i + 1 : i + 1 + h]] if t[i] + 1 + h <= n else x[:0]
                if len(r) < max(3, h // 2):
                    own += [None] * 3
                    continue
                e = np.exp(r.mean(1).cumsum())
                sd, k = r.std(0, ddof=1), r.shape[1]
                z = ((r - r.mean(0)) / np.maximum(sd, 1e-6)).sum(1)
                own += [float(r.std(ddof=1) * np.sqrt(YEAR)), float((e / np.maximum.accumulate(e) - 1).min()), float((z @ z / (len(r) - 1) - k) / (k * (k - 1))) if k > 1 else None]
            out.append(own)
        return pd.DataFrame(out, columns=["panel", "bar_idx", *names])

    return spread.groupBy("panel", "block").applyInPandas(measure, "panel string, bar_idx int, " + ", ".join(f"{n} double" for n in names))


def hero_validation(panel: DataFrame, path: DataFrame, horizons: tuple = (5, 10, 20)) -> DataFrame:
    """path with its full-sample quarter and, for each horizon, forward volatility, fall and average correlation."""
    pct = F.cume_dist().over(Window.partitionBy("panel").orderBy("corr_z"))
    out = path.select(*BAR, "corr_z").withColumn("pct", pct)
    out = out.withColumn("quarter", F.when(F.col("pct") <= 0.25, "low").when(F.col("pct") <= 0.5, "medium_low").when(F.col("pct") <= 0.75, "medium_high").otherwise("extreme_high"))
    return out.join(forward_measures(panel, horizons), BAR, "left")


def quarter_means(table: DataFrame) -> DataFrame:
    return table.groupBy("panel", "quarter").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in table.columns if c.startswith("fwd_")])


def breakdown(log: DataFrame, key: str = "priority") -> DataFrame:
    """(panel, key, bars, pct) of all bars, nulls included."""
    n = log.groupBy("panel", key).agg(F.count("*").alias("bars"))
    return n.withColumn("pct", F.round(100 * F.col("bars") / F.sum("bars").over(whole()), 4))


def by_regime(log: DataFrame, s: Settings = DEFAULT, few: int = 30) -> DataFrame:
    """(panel, regime, n, cagr, ann_vol, sharpe, max_dd, small): a regime's bars put behind one another."""
    kept = log.where("pnl is not null").select(F.col("regime").alias("strategy"), "panel", "bar_idx", F.exp(F.sum("pnl").over(Window.partitionBy("panel", "regime").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0))).alias("equity"), F.lit(0.0).alias("turnover"))
    n = log.where("pnl is not null").groupBy("panel", "regime").agg(F.count("*").alias("bars"))
    m = _measures(kept, "equity", s).withColumnRenamed("strategy", "regime")
    shown = lambda c: F.when(F.col("bars") >= 5, F.col(c)).alias(c)
    return n.join(m, ["panel", "regime"]).select("panel", "regime", "bars", *[shown(c) for c in ("cagr", "ann_vol", "sharpe", "max_dd")], (F.col("bars") < few).alias("small"))


def failure_windows(log: DataFrame, window: int = 5, worst: int = 5) -> DataFrame:
    """(panel, rank, begin_idx, end_idx, total, tags): the stretches of bars with the lowest summed returns.

    log: panel, bar_idx, pnl, regime, priority, var_99. Stretches may overlap;
    ties go to the earlier one, a regime's mode to the first by name.
    """
    w = series().rowsBetween(0, window - 1)
    rows = log.select(
        "panel", "bar_idx", F.count("*").over(w).alias("n"), F.sum("pnl").over(w).alias("total"), F.max("bar_idx").over(w).alias("end_idx"), F.collect_list("regime").over(w).alias("regimes"), F.collect_list("priority").over(w).alias("priorities"),
        F.sum(((F.col("var_99") > 0) & (F.col("pnl") < -F.col("var_99"))).cast("int")).over(w).alias("breaches"), F.lag("regime").over(series()).alias("before"),
    ).where(F.col("n") == window)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("panel").orderBy("total", "bar_idx"))).where(F.col("rank") <= worst)
    names = ("CALM", "STRESSED", "TRANSITION")
    of = lambda name: lambda x: x == name
    counts = [F.size(F.filter("regimes", of(n))) for n in names]
    mode = F.when(counts[0] >= F.greatest(counts[1], counts[2]), names[0]).when(counts[1] >= counts[2], names[1]).otherwise(names[2])
    severe = F.col("total") < -0.03 * F.sqrt(F.lit(float(window)))
    stressy = F.exists("priorities", lambda p: p.startswith("stress") | (p == "corr_crisis"))
    tags = F.array_compact(F.array(
        F.when((mode == "STRESSED") & (F.col("total") > 0.002 * window), "false_stress_candidate"), F.when(severe & (F.col("before") == "CALM") & ~stressy, "late_derisk_candidate"), F.when(severe, "severe_drawdown_window"),
        F.when(F.col("breaches") >= 3, "var_breach_cluster"), F.when(F.array_contains("priorities", "anomaly_suppress") & (F.col("total") < -0.02), "anomaly_suppress_stress_persisted"),
    ))
    return ranked.select("panel", "rank", F.col("bar_idx").alias("begin_idx"), "end_idx", "total", tags.alias("tags"))


def failure_summary(log: DataFrame, book: DataFrame, s: Settings = DEFAULT, window: int = 5, worst: int = 5) -> DataFrame:
    """(strategy, panel, windows, metrics, bars): the worst stretches of a log, the measures of a book beside them, and the log's bars.

    log: as failure_windows reads it; book: (strategy, panel, bar_idx, equity), without turnover. Fewer than three bars of a book have no metrics.
    """
    found = failure_windows(log, window, worst)
    gathered = found.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct(*[c for c in found.columns if c != "panel"]))).alias("windows"))
    measures = _measures(book.withColumn("turnover", F.lit(0.0)), "equity", s)
    metrics = measures.select(*STRATEGY, F.when(F.col("n") >= 2, F.struct(*[c for c in measures.columns if c not in (*STRATEGY, "n")])).alias("metrics"))
    return metrics.join(log.groupBy("panel").agg(F.count("*").alias("bars")), "panel").join(gathered, "panel", "left").select(*STRATEGY, "windows", "metrics", "bars")


def anomaly_predictive(log: DataFrame, many: int = 3, horizon: int = 5) -> DataFrame:
    """(panel, many, n, next_vol): deviation of the next bars' returns after many anomalies and after few."""
    w = series().rowsBetween(1, horizon)
    rows = log.withColumn("v", F.when(F.count("pnl").over(w) == horizon, F.stddev_samp("pnl").over(w))).where("v is not null")
    return rows.groupBy("panel", (F.col("anomalies") >= many).alias("many")).agg(F.count("*").alias("n"), F.avg("v").alias("next_vol"))


def transition_study(log: DataFrame, by: tuple[str, ...] = ("panel",)) -> DataFrame:
    """(panel, transitions, mean_abs_move): how far corr_z moves when the regime changes; none and null where it never does.

    Without `by` one row for the whole log, empty ones included.
    """
    changed = F.lag("regime").over(series()) != F.col("regime")
    rows = log.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("moved", F.abs(F.col("corr_z") - F.lag("corr_z").over(series())))
    return rows.groupBy(*by).agg(F.count_if("changed").alias("transitions"), F.avg(F.when(F.col("changed"), F.col("moved"))).alias("mean_abs_move"))


def stress_vs_reality(log: DataFrame, assumed: float = -0.15) -> DataFrame:
    """(panel, worst, assumed, covered): the worst fall of the log's returns against an assumed one."""
    e = log.withColumn("e", F.exp(F.sum("pnl").over(series().rowsBetween(Window.unboundedPreceding, 0))))
    fall = e.withColumn("fall", F.col("e") / F.max("e").over(series().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return fall.groupBy("panel").agg(F.min("fall").alias("worst")).select("panel", "worst", F.lit(assumed).alias("assumed"), (F.col("worst") >= assumed).alias("covered"))


def walk_forward_folds(path: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, fold, train_end, test_begin, test_end, z_high, z_low): thresholds fitted to all z up to the train end.

    A book's row of a bar earns the return to the next one, so the test window begins with the row of the last bar that is fitted to.
    """
    b = s.backtest
    size = path.groupBy("panel").agg(F.max("bar_idx").alias("n"))
    folds = size.select("panel", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - b.train_bars - b.test_bars - 1) / b.test_bars).cast("int"))).alias("fold")).where(F.col("n") > b.train_bars + b.test_bars)
    folds = folds.withColumn("train_end", F.col("fold") * b.test_bars + b.train_bars)
    joined = folds.join(path.select("panel", F.col("bar_idx").alias("i"), "corr_z"), "panel").where(F.col("i") <= F.col("train_end"))
    q = joined.groupBy("panel", "fold", "train_end").agg(F.percentile("corr_z", F.lit(0.9)).alias("z_high"), F.percentile("corr_z", F.lit(0.1)).alias("z_low"))
    return q.select("panel", "fold", "train_end", F.col("train_end").alias("test_begin"), (F.col("train_end") + b.test_bars - 1).alias("test_end"), "z_high", "z_low")


def walk_forward(panel: DataFrame, bars: DataFrame, s: Settings = DEFAULT, mode: str = "full") -> DataFrame:
    """(strategy, panel, ...) measures of each fold's test window under its own thresholds; folds run side by side.

    A fold is a strategy from the warm-up to the end of its test window, so that
    weights, turnover caps and costs carry over; only the measures are cut to the window.
    """
    folds = stored(walk_forward_folds(bars, s), "folds")
    runs = folds.select("panel", F.concat(F.col("fold").cast("string"), F.lit(":"), "panel").alias("__run"), "test_end", "z_high", "z_low")

    def each(df: DataFrame, *keep: str) -> DataFrame:
        """df up to the end of each fold, whose number leads the panel's name."""
        own = df.join(runs, "panel").where(F.col("bar_idx") <= F.col("test_end")).withColumn("panel", F.col("__run"))
        return own.select(*df.columns, *keep)

    made = portfolio.made(panel, bars, (mode,), s)
    if mode in ("signals_only", "corr_signal_only", "full"):
        own = each(bars, "z_high", "z_low")
        z = F.col("corr_z")
        own = own.withColumn("bucket", F.when(z > F.col("z_high"), "crisis_spike").when(z < F.col("z_low"), "diversification").otherwise("normal"))
        targets = portfolio.raw_targets(each(panel), own, mode, s, sleeves=None if made.sleeves is None else each(made.sleeves), vols=each(made.vols))
    else:
        targets = each(portfolio.raw_targets(panel, bars, mode, s, vols=made.vols).join(bars.select(*BAR), BAR))
    run = F.split("panel", ":", 2)
    targets = targets.withColumn("strategy", F.concat(F.lit("fold_"), run[0])).withColumn("panel", run[1])
    book = portfolio.book(made.lines, targets, made.forecast, s, calmest=made.calmest)
    windows = folds.select("panel", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("strategy"), "test_begin", "test_end")
    tested = book.join(windows, STRATEGY).where(F.col("bar_idx").between(F.col("test_begin"), F.col("test_end"))).select(*book.columns)
    return summary(stored(tested, "tested"), s)


def decision_log(panel: DataFrame, bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a bar: the decision, the anomalies and what the equal-weight portfolio earns to the next bar."""
    pnl = portfolio_returns(panel, equal_weights(panel)).select(*BAR, F.lead("pr").over(series()).alias("pnl"))
    return decide.decided(bars, s).join(pnl, BAR).where("pnl is not null")


def with_var(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """bars with var_99 of the equal-weight portfolio, normal, from the window before."""
    v = rolling_var(portfolio_returns(panel, equal_weights(panel))).select(*BAR, F.col("var").alias("var_99"))
    return bars.join(v, BAR)


def regression_r2(rows: DataFrame, y: str, xs: list[str], least: int = 20) -> DataFrame:
    """(panel, n, r2) of a linear fit with a constant, by panel; null below `least` complete rows or if y doesn't vary.

    The covariances of a panel are sums that Spark makes; only they, a row a panel, are solved.
    """
    known = rows.dropna(subset=[y, *xs])
    names = [*xs, y]
    cells = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    sums = known.groupBy("panel").agg(F.count("*").alias("n"), *cells)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(names)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                c = np.array([[row[f"c{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], float)
                fit = row["n"] >= least and c[-1, -1] > 0
                out.append(c[-1, :-1] @ np.linalg.pinv(c[:-1, :-1], hermitian=True) @ c[-1, :-1] / c[-1, -1] if fit else None)
            yield pd.DataFrame({"panel": batch["panel"], "n": batch["n"], "r2": pd.Series(out, dtype=float)})

    solved = sums.mapInPandas(solve, "panel string, n long, r2 double")
    return solved.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def portfolio_vol(cov: DataFrame, weights: DataFrame) -> DataFrame:
    return portfolio_variance(cov, weights).select("panel", F.sqrt("variance").alias("sigma"))
