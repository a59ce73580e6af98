"""Settings of the risk engine. Defaults are fixed values that results depend on."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Anomaly:
    z_window: int = 60
    cusum_window: int = 120
    cusum_k_sigma: float = 0.5
    cusum_h_sigma: float = 4.0
    mahalanobis_quantile: float = 0.999
    drawdown_watch: float = 0.05
    drawdown_warning: float = 0.10
    drawdown_critical: float = 0.20
    min_layers: int = 2
    most_events: int = 20


@dataclass(frozen=True)
class Regime:
    stressed_tail: float = 1.35
    stressed_corr: float = 0.55
    transition_tail: float = 1.15
    transition_corr: float = 0.40
    transition_vol: float = 0.25
    transition_drawdown: float = -0.08
    transition_anomalies: int = 4
    confidence: float = 0.72
    #: Whether states of clustered bars take the place of the rules' label, from how many bars on, and over how many.
    clustered: bool = False
    least_history: int = 60
    most_history: int = 200


@dataclass(frozen=True)
class CorrSignal:
    window: int = 120
    cov_window: int = 252
    z_high: float = 1.5
    z_low: float = -1.0
    eps: float = 1e-6


@dataclass(frozen=True)
class Decisions:
    stress_z: float = 1.0
    suppress_count: int = 3
    scale_stress: float = 0.55
    scale_transition: float = 0.82
    confidence_divisor: float = 14.0
    transition_penalty: float = 0.08


@dataclass(frozen=True)
class Portfolio:
    target_vol: float = 0.10
    max_leverage: float = 1.0
    max_weight: float = 0.35
    min_cash: float = 0.0
    turnover_cap: float = 0.5
    cost_bps: float = 10.0
    long_only: bool = True


@dataclass(frozen=True)
class Alpha:
    mom_windows: tuple = (20, 60, 120)
    ewma_lambda: float = 0.94
    vol_floor_quantile: float = 0.1
    mr_window: int = 5
    mr_slow: int = 63
    carry_level: float = 0.65
    carry_change: float = 0.35
    carry_bars: int = 21
    carry_scale: float = 3.0
    w_momentum: float = 0.28
    w_reversion: float = 0.18
    w_cross: float = 0.22
    w_carry: float = 0.12
    w_corr: float = 0.20


@dataclass(frozen=True)
class Backtest:
    warmup: int = 130
    cash: float = 1_000_000.0
    train_bars: int = 504
    test_bars: int = 63
    rebalance_every: int = 1
    var_alpha: float = 0.99
    disagreement: float = 0.35
    #: Normal draws of the assets' returns a bar for a book's VaR; with none it is what draws tend to.
    var_draws: int = 0


@dataclass(frozen=True)
class Settings:
    risk_free: float = 0.035
    beta_window: int = 252
    garch_window: int = 504
    var_alphas: tuple = (0.95, 0.99)
    risk_limit_var99: float = 0.05
    risk_budget: float = 0.05
    drift_threshold: float = 0.05
    tail_hedge: float = 1.5
    corr_alert: float = 0.7
    drawdown_stop: float = 0.15
    seed: int = 42
    anomaly: Anomaly = field(default_factory=Anomaly)
    regime: Regime = field(default_factory=Regime)
    corr: CorrSignal = field(default_factory=CorrSignal)
    decision: Decisions = field(default_factory=Decisions)
    portfolio: Portfolio = field(default_factory=Portfolio)
    alpha: Alpha = field(default_factory=Alpha)
    backtest: Backtest = field(default_factory=Backtest)

    @property
    def daily_rf(self) -> float:
        return (1 + self.risk_free) ** (1 / 252) - 1


DEFAULT = Settings()


def load(path: str | None = None, environ: dict | None = None) -> Settings:
    """Defaults, then a JSON file's values, then variables like TIDEMARK__portfolio__max_weight."""
    given: dict = json.loads(Path(path).read_text()) if path else {}
    for name, value in (os.environ if environ is None else environ).items():
        parts = name.split("__")
        if parts[0] == "TIDEMARK" and len(parts) > 1:
            at = given
            for part in parts[1:-1]:
                at = at.setdefault(part, {})
            at[parts[-1]] = json.loads(value)

    def merged(own, values):
        known = {f.name for f in fields(own)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(own, **{k: merged(getattr(own, k), v) if is_dataclass(getattr(own, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    return merged(DEFAULT, given)
