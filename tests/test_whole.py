"""Results that need the whole job: all layers, books, folds, bars and lines, against brute force."""

from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import kernels
from tidemark.config import DEFAULT
from tidemark.operators import features, portfolio, research
from tidemark.plans.scratch import stored


def long_panel(spark, closes):
    days = pd.bdate_range("2020-01-01", periods=len(closes))
    rows = [("p", d.date(), i + 1, f"A{j}", float(x)) for i, (d, row) in enumerate(zip(days, closes)) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "panel string, bar_date date, bar_idx int, asset string, close double")


def shaken():
    """Closes of three assets: quiet, then one bar against the usual co-movement, then a fall."""
    rng = np.random.default_rng(5)
    steps = rng.normal(0, 0.01, (220, 1)) + rng.normal(0, 0.002, (220, 3))
    steps[120] = (0.012, -0.012, 0.012)
    steps[170:] -= 0.006
    return 100 * np.exp(steps.cumsum(0))


def brute_counts(closes):
    """Kept events by bar, and the layers that fired, read off the rules one bar at a time."""
    out, fired, k = {}, set(), closes.shape[1]
    for t in range(len(closes)):
        sub = closes[: t + 1]
        lr = np.diff(np.log(sub), axis=0)
        if len(lr) < 2:
            continue
        ev, pr, last = [], lr.mean(1), lr[-60:]
        grade = lambda z: "CRITICAL" if z > 4 else "WARNING" if z > 3 else "WATCH"
        for j in range(k):
            z = abs((lr[-1, j] - last[:, j].mean()) / last[:, j].std(ddof=1))
            if z > 2:
                ev.append(("ZSCORE", grade(z), j))
        z = abs((pr[-1] - pr[-60:].mean()) / pr[-60:].std(ddof=1))
        if z > 2:
            ev.append(("ZSCORE", grade(z), int(np.argmax(abs(lr[-1] - last.mean(0))))))
        x = pr[-120:]
        if len(x) >= 30:
            up = down = alarms = 0.0
            for r in x - x.mean():
                up, down = max(0.0, up + r - 0.5 * x.std(ddof=1)), max(0.0, down - r - 0.5 * x.std(ddof=1))
                if up > 4 * x.std(ddof=1) or down > 4 * x.std(ddof=1):
                    up, down, alarms = 0.0, 0.0, alarms + 1
            if alarms:
                ev.append(("CUSUM", "WARNING", "PORTFOLIO"))
        x = lr[-252:]
        if len(x) >= 30:
            d = x[-1] - x.mean(0)
            if d @ np.linalg.pinv(np.cov(x, rowvar=False)) @ d > kernels.chi2_quantile(0.999, k):
                ev.append(("MAHAL", "CRITICAL", 0))
        for j in range(k):
            r = lr[:, j]
            for n in (2, 5, 10):
                if len(r) >= n + 20:
                    vr = np.convolve(r, np.ones(n), "valid").var(ddof=1) / (n * r.var(ddof=1))
                    if abs(vr - 1) > 2 * np.sqrt(2 * (2 * n - 1) * (n - 1) / (3 * n * len(r))):
                        ev.append(("VR", "WARNING", j))
                        break
        falls = [*((j, 1 - sub[-1, j] / sub[:, j].max()) for j in range(k)), ("PORTFOLIO", 1 - (sub / sub[0]).mean(1)[-1] / (sub / sub[0]).mean(1).max())]
        for j, f in falls:
            if f >= (0.1 if j == "PORTFOLIO" else 0.05):
                ev.append(("DRAWDOWN", "CRITICAL" if f >= 0.2 else "WARNING" if f >= 0.1 else "WATCH", j))
        kept = [e for e in ev if e[1] == "CRITICAL" or len({x[0] for x in ev if x[2] == e[2]}) >= 2]
        fired |= {e[0] for e in kept}
        if kept:
            out[t + 1] = min(len(kept), 20)
    return out, fired


def test_all_five_layers_count(spark):
    closes = shaken()
    want, fired = brute_counts(closes)
    assert fired == {"ZSCORE", "CUSUM", "MAHAL", "VR", "DRAWDOWN"}
    panel = long_panel(spark, closes)
    got = {r.bar_idx: r.n for r in registry._events(panel).groupBy("bar_idx").count().withColumnRenamed("count", "n").collect()}
    assert got == want


def test_every_query_counts_all_layers(spark, monkeypatch):
    panel = long_panel(spark, shaken())
    monkeypatch.setattr(registry, "P", lambda *_: panel)
    found = {r.layer for r in registry.queries()["conjunction"](spark, "").select("layer").distinct().collect()}
    assert found == {"ZSCORE", "CUSUM", "MAHAL", "VR", "DRAWDOWN"}
    assert not [n for n in registry.queries() if n.endswith("_five")]


def moving_together(bars=170, assets=4):
    rng = np.random.default_rng(9)
    beta = np.array([0.6, 0.9, 1.2, 1.5])[:assets]
    steps = rng.normal(0, 0.01, (bars, 1)) * beta + rng.normal(0, 0.004, (bars, assets))
    return 100 * np.exp(steps.cumsum(0))


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "panel string, bar_idx int, regime string, anomalies long, corr_z double, bucket string, var_99 double")


def least_variance(sigma, cap):
    """Every choice of which weights are nought, at the cap or free, and the best that is allowed."""
    n, best = len(sigma), None
    for kind in product((0, cap, None), repeat=n):
        free = [i for i in range(n) if kind[i] is None]
        w = np.array([0.0 if x is None else x for x in kind])
        if free:
            k = len(free)
            a = np.block([[2 * sigma[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            w[free] = np.linalg.solve(a, np.r_[-2 * sigma[free] @ w, 1 - w.sum()])[:k]
        if abs(w.sum() - 1) < 1e-9 and w.min() > -1e-12 and w.max() < cap + 1e-12 and (best is None or w @ sigma @ w < best @ sigma @ best):
            best = w
    return best


def test_stressed_bars_hold_the_least_variance(spark):
    closes = moving_together()
    panel = long_panel(spark, closes)
    bars = bars_of(spark, [("p", t, "STRESSED", 0, 0.0, "normal", 0.02) for t in range(131, 170)])
    got = {r.bar_idx: r for r in research.backtest(panel, bars, ("full",)).collect()}
    lr, prior, net = np.diff(np.log(closes), axis=0), np.full(4, 0.25), DEFAULT.backtest.cash
    for t in range(131, 170):
        sigma = np.cov(lr[: t - 1], rowvar=False)
        w = least_variance(sigma, DEFAULT.portfolio.max_weight)
        vol = np.sqrt(np.full(4, 0.25) @ sigma @ np.full(4, 0.25) * 252)
        w = portfolio.constrained(w * min(DEFAULT.portfolio.target_vol / vol, 1.0), prior, DEFAULT)
        turn = abs(w - prior).sum()
        net *= (1 - turn * DEFAULT.portfolio.cost_bps / 1e4) * np.exp(w @ lr[t - 1])
        assert (got[t].turnover, got[t].equity) == pytest.approx((turn, net), rel=1e-5, abs=1e-7), t
        prior = w
    assert len(got) == 39


def test_decisions_read_the_var_of_the_weights_held(spark):
    closes = moving_together(190)
    closes[60, 2] = np.nan
    panel = long_panel(spark, closes).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    bars = bars_of(spark, [("p", t, "CALM", 0, -2.0 if t % 7 == 0 else 0.0, "normal", 9.0) for t in range(131, 190) if t % 11])
    s = replace(DEFAULT, risk_limit_var99=0.0268)
    book = research.backtest(panel, bars, ("momentum_naive", "vol_target_only", "full"), s)
    log = {(r.strategy, r.bar_idx): r for r in research.backtest_log(book, bars, s).collect()}
    lr = np.diff(np.log(closes), axis=0)
    whole = ~np.isnan(lr).any(1)
    tenth = np.array([i >= 9 and whole[i - 9 : i + 1].all() for i in range(len(lr))])
    prior = np.full(4, 0.25)
    for t in (b for b in range(131, 190) if b % 11):
        have = np.flatnonzero(whole[: t - 1])[-252:]
        x, own = lr[have] @ (prior / prior.sum()), lr[[i for i in have if tenth[i]]] @ (prior / prior.sum())
        normal = -kernels.normal_quantile(0.01) * np.sqrt(x.var(ddof=1) + 1e-10 * ((prior / prior.sum()) ** 2).sum()) - own.mean()
        past = -np.quantile(own, 0.01)
        r = log["momentum_naive", t]
        assert (r.var_99, r.hs_var_99) == pytest.approx((normal, past), rel=1e-9) and r.disagreement == (abs(past - normal) / normal > 0.35), t
        top = np.argsort(-np.nansum(lr[max(0, t - 61) : t - 1], axis=0), kind="stable")[:2]
        w = np.zeros(4)
        w[top] = 0.5
        sigma = np.array([[np.cov(*lr[: t - 1][~np.isnan(lr[: t - 1, [a, b]]).any(1)][:, [a, b]].T)[0, 1] for b in range(4)] for a in range(4)])
        prior = portfolio.constrained(w * min(0.1 / np.sqrt(sigma.mean() * 252), 1.0), prior, s)
    full = [r for (name, _), r in log.items() if name == "full"]
    hot = {r.var_99 > s.risk_limit_var99 for r in full}
    assert hot == {True, False} and {log["vol_target_only", 131].priority} == {"signals_only_neutral"}
    for r in full:
        want = "var_breach_risk" if r.var_99 > s.risk_limit_var99 else "diversification_regime" if r.corr_z < -1 else "normal"
        assert r.priority == want, r.bar_idx


@pytest.mark.parametrize("mode", ["full", "vol_target_only"])
def test_walk_forward_folds_run_from_the_warm_up(spark, mode):
    rng = np.random.default_rng(11)
    panel = stored(long_panel(spark, moving_together(291, 3)), "panel")
    regimes = ("CALM", "TRANSITION", "STRESSED")
    z = rng.normal(0, 1.2, 160)
    bars = bars_of(spark, [("p", 131 + i, regimes[rng.integers(3)], int(rng.integers(5)), float(z[i]), "normal", 0.02) for i in range(160)])
    s = replace(DEFAULT, backtest=replace(DEFAULT.backtest, train_bars=180, test_bars=50))
    got = {r.strategy: r.asDict() for r in research.walk_forward(panel, bars, s, mode).collect()}
    assert set(got) == {"fold_0", "fold_1"}
    for k in (0, 1):
        end = 180 + 50 * k
        past = z[: end - 130]
        own = replace(s, corr=replace(s.corr, z_high=float(np.quantile(past, 0.9)), z_low=float(np.quantile(past, 0.1))))
        # the fold's history alone, under settings that hold its thresholds
        cut = bars.where(f"bar_idx < {end + 50}").withColumn("bucket", features.bucket(F.col("corr_z"), own))
        book = research.backtest(panel.where(f"bar_idx <= {end + 50}"), cut, (mode,), own, f"fold_{k}").where(f"bar_idx >= {end}")
        want = research.summary(book, own).first().asDict()
        assert want["n"] == 49
        have = got[f"fold_{k}"]
        assert {c: have[c] for c in want if c not in research.STRATEGY} == pytest.approx({c: want[c] for c in want if c not in research.STRATEGY}, rel=1e-9, abs=1e-12)


def test_mahalanobis_judges_every_bar(spark, monkeypatch):
    rng = np.random.default_rng(13)
    steps = rng.normal(0, 0.01, (600, 3))
    steps[[79, 300, 560]] *= 8
    panel = long_panel(spark, 100 * np.exp(steps.cumsum(0)))
    monkeypatch.setattr(registry, "P", lambda *_: panel)
    lr, want = steps[1:], {}
    for t in range(30, 600):
        x = lr[max(0, t - 252) : t]
        d = x[-1] - x.mean(0)
        m = d @ np.linalg.pinv(np.cov(x, rowvar=False)) @ d
        if m > kernels.chi2_quantile(0.999, 3):
            want[t + 1] = m
    got = {r.bar_idx: r.metric for r in registry.queries()["mahalanobis_layer"](spark, "").collect()}
    assert min(want) < 100 and got == pytest.approx(want, rel=1e-5)


def test_pairs_are_counted(spark, monkeypatch):
    closes = moving_together(200, 3)
    panel = long_panel(spark, closes).withColumn("close", F.when((F.col("asset") != "A2") | (F.col("bar_idx") > 40), F.col("close")))
    monkeypatch.setattr(registry, "P", lambda *_: panel)
    got = {r.bar_idx: r.n_pairs for r in registry.queries()["avg_pairwise_corr"](spark, "").collect()}
    # A2 has its first return at bar 42 and the 130th at bar 171
    assert got == {t: 1 if t < 171 else 3 for t in range(131, 201)}
