"""Kernels and operators that need an algorithm of their own, against brute force."""

import json
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_whole import long_panel, moving_together
from tidemark.config import DEFAULT
from tidemark.functions import kernels
from tidemark.operators import decide, detect, features, research, risk, stress
from tidemark.sources import panels, reports


def least_by_faces(sigma, w, target, bound):
    """The best x over every choice of components at a bound."""
    p, n, best = np.linalg.inv(sigma), len(w), None
    for kind in product((-1, 0, 1), repeat=n):
        at, x = np.array(kind), bound * np.array(kind, float)
        free = np.flatnonzero(at == 0)
        if len(free):
            a = np.zeros((len(free) + 1, len(free) + 1))
            a[:-1, :-1], a[:-1, -1], a[-1, :-1] = p[np.ix_(free, free)], w[free], w[free]
            x[free] = np.linalg.lstsq(a, np.r_[-p[free] @ x, target - w @ x], rcond=None)[0][:-1]
        if abs(w @ x - target) < 1e-9 and np.abs(x).max() <= bound + 1e-9 and (best is None or x @ p @ x < best @ p @ best):
            best = x
    return best


@pytest.mark.parametrize("seed", range(12))
def test_least_shock_is_the_best_within_bounds(seed):
    rng = np.random.default_rng(seed)
    n = 5
    root = rng.normal(0, 0.01, (n, n))
    sigma = root @ root.T * rng.choice([1.0, 30.0]) + 1e-8 * np.eye(n)
    w = rng.dirichlet(np.ones(n)) * rng.choice([1, -1], n, p=[0.8, 0.2])
    if seed % 4 == 3:
        w[0] = 0.0
    reach = 0.99 * np.abs(w).sum()
    for target in (-0.1, -0.6 * reach, -0.97 * reach, 0.5 * reach, -reach):
        x = kernels.least_shock(sigma, w, target, 0.99)
        want = least_by_faces(sigma, w, target, 0.99)
        assert w @ x == pytest.approx(target, abs=1e-9) and np.abs(x).max() <= 0.99 + 1e-12
        assert x @ np.linalg.solve(sigma, x) == pytest.approx(want @ np.linalg.solve(sigma, want), rel=1e-6), target
    assert kernels.least_shock(sigma, w, -reach * 1.01, 0.99) is None


def test_reverse_stress_by_panel(spark):
    rng = np.random.default_rng(2)
    names, cov, weights, sigmas = ["a", "b", "c"], [], [], {}
    for k, panel in enumerate(("calm", "bound", "beyond")):
        root = rng.normal(0, 0.02, (3, 3)) * np.array([[1], [4], [1]])
        sigmas[panel] = root @ root.T
        cov += [(panel, names[i], names[j], float(sigmas[panel][i, j])) for i in range(3) for j in range(i, 3)]
        weights += [(panel, a, 1.0 / 3) for a in names]
    cov, weights = spark.createDataFrame(cov, "panel string, a string, b string, cov double"), spark.createDataFrame(weights, "panel string, asset string, w double")
    for panel, target in (("calm", -0.05), ("bound", -0.9), ("beyond", -0.995)):
        rows = {r.asset: r for r in stress.reverse_stress(weights, cov, target).where(F.col("panel") == panel).collect()}
        assert len(rows) == 3
        if panel == "beyond":
            assert all(r.shock is None and r.binding for r in rows.values())
            continue
        sigma = sigmas[panel] + 1e-8 * np.eye(3)
        want = least_by_faces(sigma, np.full(3, 1 / 3), target, 0.99)
        assert [rows[a].shock for a in names] == pytest.approx(want, abs=1e-6)
        assert rows["a"].distance_sq == pytest.approx(want @ np.linalg.solve(sigma, want), rel=1e-6)
        assert [rows[a].binding for a in names] == [bool(x) for x in np.abs(want) > 0.99 - 1e-9]
        assert any(r.binding for r in rows.values()) == (panel == "bound")


@pytest.mark.parametrize("semi", [False, True])
def test_cholesky_of_stacks_and_of_what_has_none(semi):
    rng = np.random.default_rng(1)
    root = rng.normal(size=(3, 4, 2 if semi else 6))
    sigma = root @ np.swapaxes(root, 1, 2)
    if semi:
        sigma[1] -= 1e-3 * np.eye(4)  # not even semidefinite
    factor = kernels.cholesky(sigma)
    assert np.triu(factor, 1).max() == 0
    values, vectors = np.linalg.eigh(sigma)
    nearest = (vectors * np.maximum(values, 0)[:, None, :]) @ np.swapaxes(vectors, 1, 2)
    assert factor @ np.swapaxes(factor, 1, 2) == pytest.approx(nearest, abs=1e-6)


def test_strided_correlation_is_that_of_all_pairs(spark):
    closes = moving_together(420, 4)
    closes[200, 1] = np.nan
    panel = long_panel(spark, closes).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = pd.Series({pd.Timestamp(r.bar_date): r.avg_corr for r in features.strided_correlation(panel, 60, 70, 96).collect()}).sort_index()
    lr = np.diff(np.log(closes), axis=0)
    keep = ~np.isnan(lr).any(1)
    lr, days = lr[keep], pd.bdate_range("2020-01-01", periods=420)[1:][keep]
    want, n, stride = pd.Series(np.nan, days), len(lr), -(-(len(lr) - 60) // 70)
    mean = lambda x: np.corrcoef(x, rowvar=False)[np.triu_indices(4, 1)].mean()
    for t in range(60, n, stride):
        want.iloc[t] = mean(lr[t - 60 : t])
    want.iloc[-1] = mean(lr[-60:])
    assert stride > 1 and got.to_numpy() == pytest.approx(want.interpolate(method="time").bfill().ffill().to_numpy(), abs=1e-10)
    assert list(got.index) == list(days)
    assert features.strided_correlation(panel.where("bar_idx <= 40"), 60).count() == 0


def test_strided_correlation_of_many_assets_makes_no_pairs(spark):
    rng = np.random.default_rng(4)
    closes = 100 * np.exp((rng.normal(0, 0.01, (90, 1)) + rng.normal(0, 0.01, (90, 1500))).cumsum(0))
    panel = long_panel(spark, closes)
    got = {r.bar_idx: r.avg_corr for r in features.strided_correlation(panel, 60).collect()}
    lr = np.diff(np.log(closes), axis=0)
    c = np.corrcoef(lr[-60:], rowvar=False)
    assert len(got) == 89 and got[90] == pytest.approx((c.sum() - 1500) / (1500 * 1499))


def garch_process(rng, n, omega, alpha, beta):
    h, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(np.sqrt(h) * rng.standard_normal())
        h = omega + alpha * out[-1] ** 2 + beta * h
    return np.array(out)


@pytest.mark.parametrize("seed", range(3))
def test_garch_finds_the_parameters_of_a_process(seed):
    r = garch_process(np.random.default_rng(seed), 6000, 2e-6, 0.08, 0.9)
    mu, omega, alpha, beta = kernels.garch_likeliest(r)
    assert abs(mu) < 6e-4 and abs(alpha - 0.08) < 0.03 and abs(beta - 0.9) < 0.04 and 5e-7 < omega < 6e-6
    best = kernels.garch_path(r, mu, omega, alpha, beta)[0]
    assert best >= kernels.garch_path(r, 0.0, 2e-6, 0.08, 0.9)[0]
    v = r.var()
    grid = max(kernels.garch_path(r, r.mean(), v * (1 - a - b), a, b)[0] for a in np.linspace(0.01, 0.3, 12) for b in np.linspace(0.3, 0.98, 18) if a + b < 0.999)
    assert best >= grid


def test_garch_of_few_or_still_returns():
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.02, 50)
    vol, path, e = kernels.garch_fit(r)
    want = pd.Series(r).rolling(16, min_periods=3).std().bfill()
    assert vol == pytest.approx(r.std(ddof=1)) and path == pytest.approx(want.to_numpy()) and e == pytest.approx(r / path)
    assert kernels.garch_fit(np.zeros(200))[0] == 1e-6 and kernels.garch_fit(np.array([0.1]))[0] == 0.01
    assert len(kernels.garch_fit(np.empty(0))[1]) == 0
    quiet = garch_process(rng, 400, 2e-6, 0.1, 0.85)
    assert kernels.garch_fit(quiet)[0] > 0 and len(kernels.garch_fit(quiet)[1]) == 400


def test_draws_have_the_covariance_they_are_given(spark):
    sigma = np.array([[4.0, 1.2, -0.5], [1.2, 1.0, 0.3], [-0.5, 0.3, 2.0]]) * 1e-4
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]]) * 1e-4
    names = "abc"
    cov = spark.createDataFrame([(p, names[i], names[j], float(m[i, j])) for p, m in (("good", sigma), ("bad", bad)) for i in range(3) for j in range(i, 3)], "panel string, a string, b string, cov double")
    means = spark.createDataFrame([(p, a, 0.001 * k) for p in ("good", "bad") for k, a in enumerate(names)], "panel string, asset string, mu double")
    draws = risk.drawn_returns(cov, means, 20_000)
    rows = draws.toPandas()
    assert rows.groupby(["panel", "sim"]).size().eq(3).all() and rows.groupby("panel")["sim"].nunique().eq(20_000).all()
    values, vectors = np.linalg.eigh(bad)
    for panel, want in (("good", sigma), ("bad", (vectors * np.maximum(values, 0)) @ vectors.T)):
        wide = rows[rows["panel"] == panel].pivot(index="sim", columns="asset", values="r")
        assert np.cov(wide.T) == pytest.approx(want, abs=0.03 * want.max()) and wide.mean().to_numpy() == pytest.approx([0, 0.001, 0.002], abs=4e-4)
    again = risk.drawn_returns(cov, means, 20_000).toPandas()
    key = ["panel", "sim", "asset"]
    assert rows.sort_values(key)["r"].tolist() == again.sort_values(key)["r"].tolist()


def test_adjusted_tails(spark):
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(0, 0.4, 500)) * 0.01 - 0.01
    df = spark.createDataFrame([("p", float(v)) for v in x] + [("few", 0.1)], "panel string, x double")
    got = {(r.panel, r.alpha): r for r in risk.adjusted(df, ["panel"], "x", (0.95, 0.99)).collect()}
    m = x - x.mean()
    g1, g2 = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2 - 3
    for a in (0.95, 0.99):
        z, q = kernels.normal_quantile(a), np.quantile(x, 1 - a)
        k = abs((z + (z * z - 1) * g1 / 6 + (z**3 - 3 * z) * g2 / 24 - (2 * z**3 - 5 * z) * g1**2 / 36) / z)
        r = got["p", a]
        assert (r["var"], r.cvar, r.multiplier, r.cf_cvar) == pytest.approx((-q, -x[x <= q].mean(), k, -x[x <= q].mean() * k))
    assert (got["few", 0.99].cf_cvar, got["few", 0.99].multiplier) == (0.0, 1.0)


def regime_bars(spark, n=150):
    rng = np.random.default_rng(12)
    state = np.repeat([0, 1, 2, 0, 2], n // 5)
    rows = [("p", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), i + 1, ("CALM", "TRANSITION", "STRESSED")[k], float(0.1 + 0.1 * k + rng.normal(0, 0.004)), float(0.2 + 0.2 * k + rng.normal(0, 0.01)), float(-0.05 * k + rng.normal(0, 0.002)), 0) for i, k in enumerate(state)]
    return state, spark.createDataFrame(rows, "panel string, bar_date date, bar_idx int, regime string, ann_vol double, avg_corr double, drawdown double, anomalies int")


def test_posteriors_follow_the_states(spark):
    state, bars = regime_bars(spark)
    s = replace(DEFAULT, regime=replace(DEFAULT.regime, clustered=True, most_history=90))
    got = {r.bar_idx: r for r in detect.classified(bars, s).collect()}
    x = np.array([(r.ann_vol, r.avg_corr, 1.0, abs(min(r.drawdown, 0.0))) for r in bars.orderBy("bar_idx").collect()])
    for t in range(1, 151):
        r = got[t]
        if t < 60:
            assert r.matrix is None and r.probabilities == {r.regime: 1.0} and r.confidence == 0.72
            continue
        assert sum(r.probabilities.values()) == pytest.approx(1) and r.confidence == max(r.probabilities.values()) and r.probabilities[r.regime] == r.confidence
        own, label = x[max(0, t - 90) : t], state[max(0, t - 90) : t]
        if len(set(label)) == 3:  # else three clusters split what is one state
            assert r.regime == detect.STATES[state[t - 1]]
            z = (own - own.mean(0)) / (own.std(0) + 1e-9)
            near = np.array([1 / (np.linalg.norm(z[-1] - z[label == k].mean(0)) + 1e-6) for k in range(3)])
            assert [r.probabilities[n] for n in detect.STATES] == pytest.approx(near / near.sum())
            moves = np.array([[((label[:-1] == a) & (label[1:] == b)).sum() for b in range(3)] for a in range(3)])
            assert np.array(r.matrix) == pytest.approx(moves / np.maximum(moves.sum(1, keepdims=True), 1))
            assert all(round(sum(row), 9) in (0, 1) for row in r.matrix)


def test_rules_are_certain_and_serialized(spark):
    _, bars = regime_bars(spark)
    last = json.loads(detect.serialized(bars).orderBy(F.desc("bar_idx")).first().regime)
    assert list(last) == ["label", "prob_vector", "confidence", "duration_bars", "last_transition", "transition_matrix", "persistence_note", "features"]
    assert last["prob_vector"] == {"STRESSED": 1.0} and last["duration_bars"] == 30 and last["last_transition"] == "2020-04-30" and last["transition_matrix"] is None
    assert last["persistence_note"] == "In STRESSED for 30 bar(s)." and last["features"]["anomaly_count"] == 0


def test_regressions_by_panel(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for p, n in (("a", 200), ("b", 300), ("few", 10), ("still", 50)):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 100, 3]
        y = x @ [1.0, -0.3, 2.0] * (p == "a") + rng.normal(size=n) if p != "still" else np.ones(n)
        rows += [(p, *map(float, r), float(v)) for r, v in zip(x, y)] + [(p, None, 1.0, 1.0, 5.0)]
        if p in "ab":
            a = np.c_[np.ones(n), x]
            want[p] = (n, 1 - ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    got = {r.panel: (r.n, r.r2) for r in research.regression_r2(spark.createDataFrame(rows, "panel string, x1 double, x2 double, x3 double, y double"), "y", ["x1", "x2", "x3"]).collect()}
    assert got["few"] == (10, None) and got["still"] == (50, None)
    for p in "ab":
        assert got[p] == pytest.approx(want[p], rel=1e-9)


def test_alignment_staleness_and_gaps(spark):
    days = pd.date_range("2020-01-01", periods=14)
    known = {"a": range(14), "b": [0, 1, 2, 7, 8, 9, 10, 11, 12, 13], "c": [1, *range(3, 9)], "none": []}
    rows = [("p", d.date(), i + 1, a, 1.0 + i if i in own else None) for a, own in known.items() for i, d in enumerate(days)]
    rows += [("q", d.date(), i + 1, a, 1.0) for a in "ab" for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "panel string, bar_date date, bar_idx int, asset string, close double")
    got = panels.aligned(df)
    # b is filled on bars 4 to 7, c on bars 1, 3 and 10 to 12; then c has no price
    assert sorted({r.bar_idx for r in got.collect()}) == list(range(1, 13)) and got.count() == 36
    assert {r.asset: r.stale for r in got.collect()} == {"a": False, "b": False, "c": False}
    assert {r.close for r in got.where("asset = 'b' and bar_idx between 4 and 7").collect()} == {3.0, 8.0}
    assert {(r.panel, r.asset): (r.gap_days, r.stale) for r in panels.staleness(df).collect()}["p", "c"] == (5, True)
    assert sorted((r.asset, r.begin.day, r.end.day, r.bars, r.days) for r in panels.gaps(df).collect()) == [("b", 4, 7, 4, 5), ("c", 10, 14, 5, 5), ("none", 1, 14, 14, 13)]


BARS = "panel string, bar_date date, bar_idx int, regime string, corr_z double, anomalies int, var_99 double, drawdown double, vol_ann double, avg_corr double, bucket string"


def decision_bars(spark):
    day = pd.Timestamp("2020-01-01").date()
    rows = [("p", day, 1, "STRESSED", 2.0, 5, 0.1, -0.1, 0.2, 0.8, "crisis_spike"), ("p", day, 2, "CALM", 1.4, 3, 0.0, 0.0, 0.1, 0.3, "normal"), ("p", day, 3, "CALM", 0.0, 0, 0.06, 0.0, float("nan"), 1.2, "normal")]
    return spark.createDataFrame(rows, BARS)


def test_traces_and_counterfactuals(spark):
    bars = decision_bars(spark)
    got = {r.bar_idx: r.trace for r in decide.trace(bars).collect()}
    assert [got[i].rule for i in (1, 2, 3)] == ["R1_STRESS_HIGH_CORR", "R3_ANOMALY_SUPPRESS", "R6_VAR_LIMIT_BREACH"] and {got[i].signal for i in got} == {"REDUCE_RISK"}
    assert sorted(k for k, v in got[1].flags.items() if v) == ["R1_STRESS_HIGH_CORR", "R2_CORR_CRISIS_Z", "R3_ANOMALY_SUPPRESS", "R4_STRESSED_REGIME", "R6_VAR_LIMIT_BREACH"]
    assert [got[i].correlation for i in (1, 2, 3)] == ["clustering", "within_crisis_band", "typical"]
    assert {m.name: m.value for m in got[3].measures}["diversification"] == 0.0 and got[1].hedge and got[1].multiplier == 0.5
    cases = {"quiet": {"anomalies": F.lit(0)}, "up": {"corr_z": F.col("corr_z") + 0.25}, "same": {"corr_z": F.col("corr_z")}}
    changed = {(r.bar_idx, r.case): {k: (v.before, v.after) for k, v in r.changes.items()} for r in decide.counterfactuals(bars, cases).collect()}
    assert changed == {
        (2, "quiet"): {"priority": ("anomaly_suppress", "normal"), "exposure": ("0.65", "1.0"), "suppress": ("true", "false")},
        (2, "up"): {"priority": ("anomaly_suppress", "corr_crisis"), "exposure": ("0.65", "0.55"), "suppress": ("true", "false"), "hedge": ("false", "true")},
    }


def test_snapshots_are_finite_and_read_back(spark, tmp_path):
    bars = decision_bars(spark)
    tail = spark.createDataFrame([("p", float("inf"), 0.5)], "panel string, hs_var_99 double, mc_var_99 double")
    weights = spark.createDataFrame([("p", "a", 0.5), ("p", "b", float("nan"))], "panel string, asset string, w double")
    runs = detect.timeline(bars)
    shot = stress.snapshot(bars, tail, weights, runs, decide.analogs(bars, ["corr_z"]))
    folder = str(tmp_path / "out")
    reports.write_json(shot, folder, "snapshot")
    text = spark.read.text(reports.manifest(spark, folder).first().path).first()[0]
    one = json.loads(text)["snapshot"]
    assert tuple(one) == stress.SECTIONS and len(one) == 11
    assert one["market_state"]["vol_ann"] is None and one["risk"]["tail"] == {"hs_var_99": None, "mc_var_99": 0.5} and [w["w"] for w in one["portfolio"]] == [0.5, None] and one["analogs"] is None
    assert reports.read_json(spark, folder, "snapshot", shot.schema).collect() == shot.collect()


def test_the_latest_table_holds(spark, tmp_path):
    folder = str(tmp_path / "out")
    for k in (1, 2):
        for fold in ("fold_0", "fold_1"):
            reports.write_json(spark.createDataFrame([(k, fold)] * k, "k long, fold string"), folder, "walk_forward", fold)
    assert {(r.name, r.part): r.rows for r in reports.manifest(spark, folder).collect()} == {("walk_forward", "fold_0"): 2, ("walk_forward", "fold_1"): 2}
    assert [tuple(r) for r in reports.read_json(spark, folder, "walk_forward", "k long, fold string", "fold_1").collect()] == [(2, "fold_1")] * 2
    with pytest.raises(FileNotFoundError):
        reports.read_json(spark, folder, "nothing", "k long")


def test_what_the_next_bars_bring(spark):
    closes = moving_together(60, 3)
    closes[20:23, 1] = np.nan
    panel = long_panel(spark, closes).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = {r.bar_idx: r for r in research.forward_measures(panel, (5, 10), 16).collect()}
    lr = np.vstack([np.full(3, np.nan), np.diff(np.log(closes), axis=0)])
    seen = set()
    for t in range(60):
        for h in (5, 10):
            r = lr[t + 1 : t + 1 + h] if t + 1 + h <= 60 else lr[:0]
            r = r[~np.isnan(r).any(1)]
            have = tuple(got[t + 1][f"fwd_{m}_{h}"] for m in ("vol", "dd", "corr"))
            if len(r) < max(3, h // 2):
                assert have == (None, None, None), (t, h)
                continue
            seen.add((h, len(r) == h))
            e = np.exp(r.mean(1).cumsum())
            want = (r.std(ddof=1) * np.sqrt(252), (e / np.maximum.accumulate(e) - 1).min(), np.corrcoef(r, rowvar=False)[np.triu_indices(3, 1)].mean())
            assert have == pytest.approx(want), (t, h)
    assert seen == {(5, True), (5, False), (10, True), (10, False)}


def test_transitions_of_a_calm_log(spark):
    """A log whose regime never changes has no transitions, as in its SQL; an empty one as well."""
    rows = [("calm", i, 0.1 * i, "CALM") for i in range(5)] + [("moving", i, 0.5 * i, "CALM" if i % 2 else "TRANSITION") for i in range(4)]
    log = spark.createDataFrame(rows, "panel string, bar_idx int, corr_z double, regime string")
    got = {r.panel: (r.transitions, r.mean_abs_move) for r in research.transition_study(log).collect()}
    assert got == {"calm": (0, None), "moving": (3, 0.5)}
    assert [tuple(r) for r in research.transition_study(log.limit(0), ()).collect()] == [(0, None)]
