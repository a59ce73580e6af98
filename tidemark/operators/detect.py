"""Anomaly layers over returns, their conjunction, and regime labels.

Each layer gives events (panel, bar_idx, layer, severity, asset, metric,
threshold), for every bar or for the last one; `asset` is the primary asset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import kernels
from ..sources.panels import by_asset, trailing
from .features import YEAR, drawdown, portfolio_drawdown, portfolio_returns, returns, series, whole

EVENT = ["panel", "bar_idx", "layer", "severity", "asset", "metric", "threshold"]


def graded(x: Column, watch: float, warning: float, critical: float, strict: bool) -> tuple[Column, Column]:
    """(severity, threshold) of a metric; null below `watch`."""
    over = (lambda t: x > t) if strict else (lambda t: x >= t)
    return (
        F.when(over(critical), "CRITICAL").when(over(warning), "WARNING").when(over(watch), "WATCH"),
        F.when(over(critical), critical).when(over(warning), warning).when(over(watch), watch),
    )


def _events(df: DataFrame, layer: str, severity: Column, metric: Column, threshold: Column, asset: Column) -> DataFrame:
    return df.select("panel", "bar_idx", F.lit(layer).alias("layer"), severity.alias("severity"), asset.alias("asset"), metric.alias("metric"), threshold.alias("threshold")).where("severity is not null")


def zscores(panel: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Returns with mu, sd and z over the trailing window, the bar included."""
    w = trailing(s.anomaly.z_window)
    r = returns(panel).where("bar_idx > 1").withColumn("mu", F.avg("lr").over(w)).withColumn("sd", F.stddev_samp("lr").over(w))
    return r.withColumn("z", F.when(F.col("sd") > 0, (F.col("lr") - F.col("mu")) / F.col("sd")))


def zscore_layer(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Assets and the portfolio beyond 2, 3 and 4 deviations; the portfolio's primary asset adds most to its move."""
    scored = zscores(panel, s)
    sev, th = graded(F.abs("z"), 2.0, 3.0, 4.0, True)
    assets = _events(scored, "ZSCORE", sev, F.abs("z"), th, F.col("asset"))
    top = scored.join(weights, ["panel", "asset"]).withColumn("move", F.abs(F.col("w") * (F.col("lr") - F.col("mu")))).groupBy("panel", "bar_idx").agg(F.min_by("asset", F.struct(-F.col("move"), F.col("asset"))).alias("asset"))
    w = series().rowsBetween(-(s.anomaly.z_window - 1), 0)
    pr = portfolio_returns(panel, weights).withColumn("sd", F.stddev_samp("pr").over(w)).withColumn("z", F.when(F.col("sd") > 0, (F.col("pr") - F.avg("pr").over(w)) / F.col("sd")))
    return assets.unionByName(_events(pr.join(top, ["panel", "bar_idx"]), "ZSCORE", sev, F.abs("z"), th, F.col("asset")))


def attribution(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT, top: int = 3) -> DataFrame:
    """(panel, bar_idx, attribution map<asset, share>) of the assets that move the portfolio most."""
    moves = zscores(panel, s).join(weights, ["panel", "asset"]).withColumn("move", F.abs(F.col("w") * (F.col("lr") - F.col("mu"))))
    ranked = moves.withColumn("k", F.row_number().over(Window.partitionBy("panel", "bar_idx").orderBy(F.desc("move"), "asset"))).where(F.col("k") <= top)
    share = ranked.withColumn("share", F.col("move") / F.sum("move").over(Window.partitionBy("panel", "bar_idx")))
    return share.groupBy("panel", "bar_idx").agg(F.map_from_entries(F.collect_list(F.struct("asset", "share"))).alias("attribution"))


def cusum(values: Column, mu: Column, k: Column, h: Column) -> Column:
    """struct(up, down, alarms) of a two-sided CUSUM over an array, reset at each alarm."""

    def step(acc: Column, r: Column) -> Column:
        up, down = F.greatest(F.lit(0.0), acc.up + r - mu - k), F.greatest(F.lit(0.0), acc.down - r + mu - k)
        alarm = (up > h) | (down > h)
        return F.struct(F.when(alarm, 0.0).otherwise(up).alias("up"), F.when(alarm, 0.0).otherwise(down).alias("down"), (acc.alarms + alarm.cast("int")).alias("alarms"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("alarms")), step)


def cusum_layer(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT, least: int = 30) -> DataFrame:
    """A warning at each bar whose last returns, of the portfolio, raise an alarm."""
    w = series().rowsBetween(-(s.anomaly.cusum_window - 1), 0)
    pr = portfolio_returns(panel, weights).select("panel", "bar_idx", F.collect_list("pr").over(w).alias("kept"), F.avg("pr").over(w).alias("mu"), F.stddev_samp("pr").over(w).alias("sd"))
    pr = pr.where((F.size("kept") >= least) & (F.col("sd") > 0)).withColumn("c", cusum(F.col("kept"), F.col("mu"), s.anomaly.cusum_k_sigma * F.col("sd"), s.anomaly.cusum_h_sigma * F.col("sd")))
    return _events(pr, "CUSUM", F.when(F.col("c.alarms") > 0, "WARNING"), F.greatest("c.up", "c.down"), s.anomaly.cusum_h_sigma * F.col("sd"), F.lit("PORTFOLIO"))


def variance_ratios(panel: DataFrame, ks: tuple = (2, 5, 10)) -> DataFrame:
    """(panel, bar_idx, asset, k, vr, se) over the history up to each bar, once k + 20 returns are known."""
    past = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    r = returns(panel).where("lr is not null")
    for k in ks:
        w = trailing(k)
        r = r.withColumn(f"s{k}", F.when(F.count("lr").over(w) == k, F.sum("lr").over(w)))
    r = r.withColumn("n", F.count("lr").over(past)).withColumn("v1", F.var_samp("lr").over(past))
    for k in ks:
        r = r.withColumn(f"v{k}", F.var_samp(f"s{k}").over(past))
    each = r.select("panel", "bar_idx", "asset", "n", "v1", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("vk")) for k in ks])).alias("e")).select("*", "e.*").drop("e")
    se = F.sqrt(2.0 * (2 * F.col("k") - 1) * (F.col("k") - 1) / (3.0 * F.col("k") * F.col("n")))
    return each.where((F.col("n") >= F.col("k") + 20) & (F.col("v1") > 0)).select("panel", "bar_idx", "asset", "k", (F.col("vk") / (F.col("k") * F.col("v1"))).alias("vr"), se.alias("se"))


def variance_ratio_layer(panel: DataFrame) -> DataFrame:
    """A warning for each asset at its first k whose ratio is over two errors from 1."""
    far = variance_ratios(panel).where(F.abs(F.col("vr") - 1) > 2 * F.col("se"))
    first = far.groupBy("panel", "bar_idx", "asset").agg(F.min_by(F.struct("vr", "se"), "k").alias("e"))
    return _events(first, "VR", F.lit("WARNING"), F.col("e.vr"), 1 + 2 * F.col("e.se"), F.col("asset"))


def drawdown_layer(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Assets below their high by 5, 10, 20 %; the portfolio by 10 and 20 %."""
    a = s.anomaly
    sev, th = graded(F.abs("drawdown"), a.drawdown_watch, a.drawdown_warning, a.drawdown_critical, False)
    assets = _events(drawdown(panel).where("drawdown is not null"), "DRAWDOWN", sev, F.abs("drawdown"), th, F.col("asset"))
    own = F.when(F.abs("drawdown") >= a.drawdown_critical, "CRITICAL").when(F.abs("drawdown") >= a.drawdown_warning, "WARNING")
    return assets.unionByName(_events(portfolio_drawdown(panel, weights), "DRAWDOWN", own, F.abs("drawdown"), F.lit(a.drawdown_critical), F.lit("PORTFOLIO")))


def mahalanobis_layer(panel: DataFrame, s: Settings = DEFAULT, window: int = YEAR, least: int = 30, bars: int | None = None) -> DataFrame:
    """A critical event where the last bar's returns are far from their window's.

    `bars`: of how many last bars (all by default). A task gets one panel's
    returns of a block of 64 bars with the window before it.
    """
    r = returns(panel).where("bar_idx > 1")
    if bars is not None:
        r = r.withColumn("__last", F.max("bar_idx").over(whole())).where(F.col("bar_idx") > F.col("__last") - bars - window).withColumn("judge", F.col("bar_idx") > F.col("__last") - bars).drop("__last")
    else:
        r = r.withColumn("judge", F.lit(True))
    # each row goes to the blocks that judge it or look back on it
    block = F.floor(F.col("bar_idx") / 64)
    spread = r.select("panel", "bar_idx", "asset", "lr", "judge", F.explode(F.sequence(block, block + -(-window // 64))).alias("block"))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="bar_idx", columns="asset", values="lr").sort_index()
        asked = set(rows.loc[rows["judge"] & (rows["bar_idx"] // 64 == key[1]), "bar_idx"])
        out, th = [], kernels.chi2_quantile(s.anomaly.mahalanobis_quantile, x.shape[1])
        for i, bar in enumerate(x.index):
            if bar not in asked:
                continue
            part = x.iloc[max(0, i - window + 1) : i + 1]
            known = part.dropna()
            if len(known) < least or part.iloc[-1].isna().any():
                continue
            d = kernels.mahalanobis(known.to_numpy())
            if d > th:
                out.append((key[0], int(bar), "MAHAL", "CRITICAL", x.columns[0], d, th))
        return pd.DataFrame(out, columns=EVENT)

    return spread.groupBy("panel", "block").applyInPandas(judge, "panel string, bar_idx int, layer string, severity string, asset string, metric double, threshold double")


def conjunction(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Events with layers, the number of layers that fired for the same asset; those of one layer stay only if critical."""
    w = Window.partitionBy("panel", "bar_idx", "asset")
    return events.withColumn("layers", F.size(F.collect_set("layer").over(w))).where((F.col("layers") >= s.anomaly.min_layers) | (F.col("severity") == "CRITICAL"))


def action(layer: Column) -> Column:
    return F.when(layer.isin("CUSUM", "MAHAL", "DRAWDOWN"), "REDUCE_POSITION").otherwise("MONITOR")


_ORDER = {"ZSCORE": 1, "CUSUM": 2, "MAHAL": 3, "VR": 4, "DRAWDOWN": 5}
LAYERS = tuple(_ORDER)


def layer_events(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT, layers: tuple = LAYERS) -> DataFrame:
    """The events of the named layers, one under another."""
    made = {
        "ZSCORE": lambda: zscore_layer(panel, weights, s), "CUSUM": lambda: cusum_layer(panel, weights, s), "MAHAL": lambda: mahalanobis_layer(panel, s),
        "VR": lambda: variance_ratio_layer(panel), "DRAWDOWN": lambda: drawdown_layer(panel, weights, s),
    }
    events = None
    for name in layers:
        events = made[name]() if events is None else events.unionByName(made[name]())
    return events


def anomalies(panel: DataFrame, weights: DataFrame, s: Settings = DEFAULT, layers: tuple = LAYERS) -> DataFrame:
    """The kept events of each bar: the last 20 in the order of layers and assets, with an action."""
    events = layer_events(panel, weights, s, layers)
    order = F.create_map(*[x for k, v in _ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("layer")]
    kept = conjunction(events, s).withColumn("k", F.row_number().over(Window.partitionBy("panel", "bar_idx").orderBy(order.desc(), F.desc("asset"), F.desc("metric"))))
    return kept.where(F.col("k") <= s.anomaly.most_events).drop("k").withColumn("action", action(F.col("layer")))


def anomaly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("panel", "bar_idx").agg(F.count("*").alias("anomalies"))


# ---- regimes ----


def regime_label(tail: Column, corr: Column, vol: Column, fall: Column, count: Column, s: Settings = DEFAULT) -> Column:
    """STRESSED, TRANSITION or CALM; the first rule that holds."""
    g = s.regime
    stressed = (tail > g.stressed_tail) | (corr > g.stressed_corr)
    moving = (tail > g.transition_tail) | (corr > g.transition_corr) | (vol > g.transition_vol) | (fall < g.transition_drawdown) | (count >= g.transition_anomalies)
    return F.when(stressed, "STRESSED").when(moving, "TRANSITION").otherwise("CALM")


def bar_features(panel: DataFrame, weights: DataFrame, events: DataFrame, path: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a bar of a corr_z path: ann_vol, drawdown, anomalies, label and what they come from."""
    r = returns(panel).where("lr is not null")
    vol = r.withColumn("sd", F.stddev_samp("lr").over(trailing(s.corr.cov_window))).groupBy("panel", "bar_idx").agg(((F.sqrt(F.percentile(F.pow("sd", 2), F.lit(0.5))) + 1e-8) * F.sqrt(F.lit(float(YEAR)))).alias("ann_vol"))
    falls = portfolio_drawdown(panel, weights).select("panel", "bar_idx", "drawdown")
    bars = path.join(vol, ["panel", "bar_idx"]).join(falls, ["panel", "bar_idx"]).join(anomaly_counts(events), ["panel", "bar_idx"], "left").fillna(0, ["anomalies"])
    return bars.withColumn("regime", regime_label(F.lit(1.0), F.col("avg_corr"), F.col("ann_vol"), F.col("drawdown"), F.col("anomalies"), s))


def normalized(label: Column) -> Column:
    up = F.upper(F.coalesce(label, F.lit("")))
    return F.when(up.contains("STRESS"), "STRESSED").when(up.contains("TRANS"), "TRANSITION").otherwise("CALM")


def transition_events(bars: DataFrame) -> DataFrame:
    """bars with previous_regime and event: init, no_change, enter_ or exit_ of stress or transition."""
    before = F.lag("regime").over(series())
    p, c = normalized(F.col("previous_regime")), normalized(F.col("regime"))
    event = (
        F.when(F.col("previous_regime").isNull(), "init").when(p == c, "no_change").when(c == "STRESSED", "enter_stress").when(p == "STRESSED", "exit_stress")
        .when(c == "TRANSITION", "enter_transition").otherwise("exit_transition")
    )
    return bars.withColumn("previous_regime", before).withColumn("event", event)


def durations(bars: DataFrame) -> DataFrame:
    """bars with island, the number of the run of equal regimes, and duration, the bars since it began."""
    change = F.coalesce((F.col("regime") != F.lag("regime").over(series())).cast("int"), F.lit(0))
    marked = bars.withColumn("__change", change).withColumn("island", F.sum("__change").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("__change")
    return marked.withColumn("duration", F.row_number().over(Window.partitionBy("panel", "island").orderBy("bar_idx")))


def timeline(bars: DataFrame, most: int = 30) -> DataFrame:
    """(panel, island, regime, begin, end, bars, mean_corr_z) of the last runs of equal regimes."""
    runs = durations(bars).groupBy("panel", "island", "regime").agg(F.min("bar_date").alias("begin"), F.max("bar_date").alias("end"), F.count("*").alias("bars"), F.round(F.avg("corr_z"), 4).alias("mean_corr_z"))
    return runs.withColumn("k", F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("island")))).where(F.col("k") <= most).drop("k")


def transition_stats(bars: DataFrame, last: int = 20, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, transitions, window_bars, avg_confidence, hint) over trailing bars."""
    w = series().rowsBetween(-(last - 1), 0)
    moved = transition_events(bars).withColumn("moved", (~F.col("event").isin("no_change", "init")).cast("int"))
    n = F.sum("moved").over(w)
    return moved.select("panel", "bar_idx", n.alias("transitions"), F.count("*").over(w).alias("window_bars"), F.lit(s.regime.confidence).alias("avg_confidence"), F.when(n >= 4, "elevated_churn").otherwise("stable").alias("hint"))


def transition_matrix(bars: DataFrame) -> DataFrame:
    """(panel, before, after, n, share): how often a regime follows another."""
    steps = bars.select("panel", F.col("regime").alias("before"), F.lead("regime").over(series()).alias("after")).where("after is not null")
    n = steps.groupBy("panel", "before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("panel", "before")))


STATES = ("CALM", "TRANSITION", "STRESSED")


def posteriors(bars: DataFrame, s: Settings = DEFAULT, restarts: int = 10, block: int = 64) -> DataFrame:
    """(panel, bar_idx, probabilities map<state, share>, matrix array<array<double>>) of bars with enough history.

    Each bar's last features up to it (yearly volatility, average correlation, tail, fall) are clustered anew into three
    states, named in the order of volatility. Probabilities go by the inverse distance of the bar to the centres, the matrix holds
    the shares of states that follow each state. A task gets `block` bars of a panel and those that they look back on.
    """
    g = s.regime
    nth = F.row_number().over(series()) - 1
    rows = bars.select("panel", "bar_idx", nth.alias("t"), "ann_vol", "avg_corr", (F.col("tail") if "tail" in bars.columns else F.lit(1.0)).alias("tail"), F.abs(F.least("drawdown", F.lit(0.0))).alias("fall"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("t") / block), F.floor((F.col("t") + g.most_history - 1) / block))))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x, out = rows[["ann_vol", "avg_corr", "tail", "fall"]].to_numpy(), []
        for i, t in enumerate(rows["t"]):
            own = x[max(0, i - g.most_history + 1) : i + 1]
            if t // block == key[1] and t + 1 >= g.least_history:
                post, matrix, _ = kernels.states(own, len(STATES), restarts, s.seed)
                out.append((key[0], int(rows["bar_idx"].iloc[i]), dict(zip(STATES, post.tolist())), matrix.tolist()))
        return pd.DataFrame(out, columns=["panel", "bar_idx", "probabilities", "matrix"])

    return spread.groupBy("panel", "block").applyInPandas(judge, "panel string, bar_idx int, probabilities map<string, double>, matrix array<array<double>>")


def classified(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """bars with regime, probabilities, confidence, duration, last_transition, matrix and persistence.

    The rules' label is certain and has the settings' confidence. If the settings say `clustered`, the likeliest state takes its
    place, with its probability, at bars with enough history. The duration counts the bars of the rules' label in any case, as
    the state is read off after it.
    """
    out = durations(bars)
    out = out.withColumn("last_transition", F.first("bar_date").over(Window.partitionBy("panel", "island").orderBy("bar_idx")))
    plain = F.create_map(F.col("regime"), F.lit(1.0))
    if not s.regime.clustered:
        out = out.withColumns({"probabilities": plain, "confidence": F.lit(s.regime.confidence), "matrix": F.lit(None).cast("array<array<double>>")})
    else:
        found = out.join(posteriors(bars, s).withColumnRenamed("probabilities", "__p"), ["panel", "bar_idx"], "left")
        best = F.array_max(F.transform(F.array(*[F.lit(x) for x in STATES]), lambda x: F.struct(F.element_at("__p", x).alias("p"), (-F.array_position(F.array(*[F.lit(y) for y in STATES]), x)).alias("k"), x.alias("x"))))
        found = found.withColumn("__b", F.when(F.col("__p").isNotNull(), best))
        out = found.withColumns({"regime": F.coalesce("__b.x", "regime"), "probabilities": F.coalesce("__p", plain), "confidence": F.coalesce("__b.p", F.lit(s.regime.confidence))}).drop("__p", "__b")
    return out.withColumn("persistence", F.concat(F.lit("In "), "regime", F.lit(" for "), F.col("duration").cast("string"), F.lit(" bar(s).")))


def serialized(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(panel, bar_idx, regime json) of classified bars: label, probabilities, confidence, duration, last transition, matrix, persistence and features."""
    features = F.struct((F.col("tail") if "tail" in bars.columns else F.lit(1.0)).alias("tail_multiplier"), F.col("avg_corr").alias("avg_pairwise_corr"), "ann_vol", F.col("drawdown").alias("portfolio_drawdown"), F.col("anomalies").alias("anomaly_count"))
    whole_ = F.struct(F.col("regime").alias("label"), F.col("probabilities").alias("prob_vector"), "confidence", F.col("duration").alias("duration_bars"), F.col("last_transition").cast("string").alias("last_transition"), F.col("matrix").alias("transition_matrix"), F.col("persistence").alias("persistence_note"), features.alias("features"))
    return classified(bars, s).select("panel", "bar_idx", F.to_json(whole_, {"ignoreNullFields": "false"}).alias("regime"))


def clustered_regimes(bars: DataFrame, clusters: int = 3, seed: int = 42) -> DataFrame:
    """(panel, bar_idx, state, confidence): K-means over standardised features, states in order of volatility.

    confidence is the inverse-distance weight of the nearest centre.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=["ann_vol", "avg_corr", "fall"], outputCol="raw").transform(bars.withColumn("fall", F.abs(F.least("drawdown", F.lit(0.0)))))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    model = KMeans(k=clusters, seed=seed, initSteps=5, maxIter=50).fit(scaled)
    centers = np.array(model.clusterCenters())
    rank = {int(c): i for i, c in enumerate(np.argsort(centers[:, 0]))}
    names = ["CALM", "TRANSITION", "STRESSED"] if len(centers) == 3 else [f"STATE_{i}" for i in range(len(centers))]
    x = vector_to_array("features")
    near = [1 / (F.sqrt(sum((x[j] - float(v)) ** 2 for j, v in enumerate(c))) + 1e-9) for c in centers]
    state = F.create_map(*[v for c, i in rank.items() for v in (F.lit(c), F.lit(names[i]))])[F.col("prediction")]
    return model.transform(scaled).select("panel", "bar_idx", state.alias("state"), (F.greatest(*near) / sum(near[1:], near[0])).alias("confidence"))
