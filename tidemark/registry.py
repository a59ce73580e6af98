"""Queries over the driver's tables, each with the SQL that checks it.

A query is a function of (spark, sf_dir). Its SQL is a body over the common
table expressions in CTES; only those that a body names, directly or through
others, are written before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import kernels
from .operators import alpha, decide, detect, features, portfolio, research, risk, stress
from .plans.scratch import small, steady, stored
from .sources import panels
from .streaming import jobs

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _mahalanobis(n: int) -> dict[str, str]:
    """Table expressions of the distance of n assets' returns from their window's mean: covariances, then Cholesky column by column."""
    every = range(1, n + 1)
    out = {
        "mhw": f"SELECT bar_idx, {', '.join(f'max(lr) FILTER (g = {i}) AS r{i}' for i in every)} FROM (SELECT bar_idx, lr, dense_rank() OVER (ORDER BY asset) AS g FROM r) WHERE lr IS NOT NULL GROUP BY bar_idx HAVING count(*) = {n}",
        "mhc": f"SELECT bar_idx, {', '.join(f'r{i} - avg(r{i}) OVER w AS d{i}' for i in every)}, {', '.join(f'covar_samp(r{i}, r{j}) OVER w AS c{i}{j}' for i in every for j in range(1, i + 1))}, count(*) OVER w AS n FROM mhw WINDOW w AS (ORDER BY bar_idx ROWS 251 PRECEDING) QUALIFY n >= 30",
    }
    for j in every:
        less = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))  # noqa: E731, B023
        diagonal = f"sqrt(greatest(c{j}{j}{less(j)}, 1e-300)) AS l{j}{j}"
        below = "".join(f", (c{i}{j}{less(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, n + 1))
        y = f", (d{j}{''.join(f' - l{j}{k} * y{k}' for k in range(1, j))}) / l{j}{j} AS y{j}"
        out[f"mh{j}"] = f"SELECT *, {diagonal}{below}{y} FROM {'mhc' if j == 1 else f'mh{j - 1}'}"
    far = " + ".join(f"y{j} * y{j}" for j in every)
    limit = kernels.chi2_quantile(DEFAULT.anomaly.mahalanobis_quantile, n)
    out["mhev"] = f"SELECT bar_idx, 'MAHAL' AS layer, 'CRITICAL' AS severity, (SELECT min(asset) FROM p) AS asset, {far} AS metric, {limit!r}::DOUBLE AS threshold FROM mh{n} WHERE {far} > {limit!r}"
    return out


CTES = {
    "t": "SELECT CAST(l_shipdate AS DATE) AS bar_date, l_returnflag || l_linestatus AS asset, sum(l_extendedprice) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
    "axis": "SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS bar_idx FROM (SELECT DISTINCT bar_date FROM t)",
    "grid": "SELECT x.bar_date, x.bar_idx, n.asset, t.revenue, t.quantity FROM axis x CROSS JOIN (SELECT DISTINCT asset FROM t) n LEFT JOIN t ON t.bar_date = x.bar_date AND t.asset = n.asset",
    "rawp": "SELECT bar_date, bar_idx, asset, revenue / quantity AS close FROM grid",
    "f1": "SELECT bar_date, bar_idx, asset, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS close FROM rawp",
    "fp": "SELECT bar_date, bar_idx, asset, coalesce(close, first_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS close FROM f1",
    "p": "SELECT bar_date, bar_idx - 59 AS bar_idx, asset, close FROM (SELECT bar_date, bar_idx, asset, sum(revenue) OVER w / sum(quantity) OVER w AS close FROM grid WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 59 PRECEDING)) WHERE bar_idx >= 60",
    "r": "SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY bar_idx)) AS lr FROM p",
    "r10": "SELECT bar_date, bar_idx, asset, lr, CASE WHEN count(lr) OVER w = 10 THEN sum(lr) OVER w END AS lr10 FROM r WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 9 PRECEDING)",
    "m": "SELECT max(bar_idx) AS m FROM p",
    "rec": "SELECT r.* FROM r, m WHERE bar_idx > m - 252 AND lr IS NOT NULL",
    "pairs": "SELECT a.bar_date, a.bar_idx, a.asset AS a, b.asset AS b, a.lr AS ra, b.lr AS rb FROM r a JOIN r b ON a.bar_idx = b.bar_idx WHERE a.lr IS NOT NULL AND b.lr IS NOT NULL",
    "cov": "SELECT a.asset AS a, b.asset AS b, covar_samp(a.lr, b.lr) AS cov, corr(a.lr, b.lr) AS rho, count(*) AS n FROM rec a JOIN rec b ON a.bar_idx = b.bar_idx GROUP BY 1, 2",
    "k": "SELECT count(DISTINCT asset) AS k FROM p",
    "pr": "SELECT bar_date, bar_idx, sum(lr / k) AS pr FROM r, k WHERE bar_idx > 1 GROUP BY 1, 2",
    "dd": "SELECT *, close / max(close) OVER (PARTITION BY asset ORDER BY bar_idx) - 1 AS drawdown FROM p",
    "pv": "SELECT bar_date, bar_idx, sum(c / k) AS value FROM (SELECT bar_date, bar_idx, close / first_value(close) OVER (PARTITION BY asset ORDER BY bar_idx) AS c FROM p), k GROUP BY 1, 2",
    "pd": "SELECT *, value / max(value) OVER (ORDER BY bar_idx) - 1 AS drawdown FROM pv",
    "rho": "SELECT bar_date, bar_idx, a, b, corr(ra, rb) OVER w AS rho, count(*) OVER w AS n FROM pairs WHERE a < b WINDOW w AS (PARTITION BY a, b ORDER BY bar_idx ROWS 251 PRECEDING)",
    "ac": "SELECT bar_date, bar_idx, avg(rho) AS avg_corr FROM rho WHERE n >= 130 GROUP BY 1, 2",
    "zs": "SELECT *, avg(avg_corr) OVER w AS corr_mean, CASE WHEN count(*) OVER w < 10 THEN coalesce(stddev_samp(avg_corr) OVER w, 1) ELSE stddev_samp(avg_corr) OVER w + 1e-6 END AS corr_std FROM ac WINDOW w AS (ORDER BY bar_idx ROWS 119 PRECEDING)",
    "z": "SELECT *, CASE WHEN z > 1.5 THEN 'crisis_spike' WHEN z < -1.0 THEN 'diversification' ELSE 'normal' END AS bucket, z AS corr_z FROM (SELECT *, CASE WHEN corr_std > 0 THEN (avg_corr - corr_mean) / corr_std ELSE 0 END AS z FROM zs)",
    "zl": "SELECT *, CASE WHEN sd > 0 THEN (lr - mu) / sd END AS z FROM (SELECT *, avg(lr) OVER w AS mu, stddev_samp(lr) OVER w AS sd FROM r WHERE bar_idx > 1 WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 59 PRECEDING))",
    "pz": "SELECT bar_idx, CASE WHEN sd > 0 THEN (pr - mu) / sd END AS z FROM (SELECT *, avg(pr) OVER w AS mu, stddev_samp(pr) OVER w AS sd FROM pr WINDOW w AS (ORDER BY bar_idx ROWS 59 PRECEDING))",
    "zev": "SELECT bar_idx, 'ZSCORE' AS layer, CASE WHEN abs(z) > 4 THEN 'CRITICAL' WHEN abs(z) > 3 THEN 'WARNING' ELSE 'WATCH' END AS severity, asset, abs(z) AS metric, CASE WHEN abs(z) > 4 THEN 4.0 WHEN abs(z) > 3 THEN 3.0 ELSE 2.0 END AS threshold FROM (SELECT bar_idx, asset, z FROM zl UNION ALL SELECT bar_idx, asset, z FROM pz JOIN (SELECT bar_idx, arg_min(asset, (-abs(lr - mu), asset)) AS asset FROM zl GROUP BY 1) USING (bar_idx)) WHERE abs(z) > 2",
    "vs": "SELECT bar_idx, asset, lr, count(lr) OVER e AS n, var_samp(lr) OVER e AS v1, CASE WHEN count(lr) OVER w2 = 2 THEN sum(lr) OVER w2 END AS s2, CASE WHEN count(lr) OVER w5 = 5 THEN sum(lr) OVER w5 END AS s5, CASE WHEN count(lr) OVER w10 = 10 THEN sum(lr) OVER w10 END AS s10 FROM r WHERE lr IS NOT NULL WINDOW e AS (PARTITION BY asset ORDER BY bar_idx), w2 AS (PARTITION BY asset ORDER BY bar_idx ROWS 1 PRECEDING), w5 AS (PARTITION BY asset ORDER BY bar_idx ROWS 4 PRECEDING), w10 AS (PARTITION BY asset ORDER BY bar_idx ROWS 9 PRECEDING)",
    "vk": "SELECT bar_idx, asset, n, v1, unnest([2, 5, 10]) AS k, unnest([v2, v5, v10]) AS v FROM (SELECT *, var_samp(s2) OVER e AS v2, var_samp(s5) OVER e AS v5, var_samp(s10) OVER e AS v10 FROM vs WINDOW e AS (PARTITION BY asset ORDER BY bar_idx))",
    "vr": "SELECT bar_idx, asset, k, v / (k * v1) AS vr, sqrt(2.0 * (2 * k - 1) * (k - 1) / (3.0 * k * n)) AS se FROM vk WHERE n >= k + 20 AND v1 > 0",
    "vev": "SELECT bar_idx, 'VR' AS layer, 'WARNING' AS severity, asset, arg_min(vr, k) AS metric, 1 + 2 * arg_min(se, k) AS threshold FROM vr WHERE abs(vr - 1) > 2 * se GROUP BY bar_idx, asset",
    "dev": "SELECT bar_idx, 'DRAWDOWN' AS layer, CASE WHEN -drawdown >= 0.2 THEN 'CRITICAL' WHEN -drawdown >= 0.1 THEN 'WARNING' ELSE 'WATCH' END AS severity, asset, -drawdown AS metric, CASE WHEN -drawdown >= 0.2 THEN 0.2 WHEN -drawdown >= 0.1 THEN 0.1 ELSE 0.05 END AS threshold FROM dd WHERE -drawdown >= 0.05 UNION ALL SELECT bar_idx, 'DRAWDOWN', CASE WHEN -drawdown >= 0.2 THEN 'CRITICAL' ELSE 'WARNING' END, 'PORTFOLIO', -drawdown, 0.2 FROM pd WHERE -drawdown >= 0.1",
    "cul": "SELECT bar_idx, list(pr) OVER w AS x, avg(pr) OVER w AS mu, stddev_samp(pr) OVER w AS sd, count(*) OVER w AS n FROM pr WINDOW w AS (ORDER BY bar_idx ROWS 119 PRECEDING)",
    "cuf": """SELECT bar_idx, sd, list_reduce(list_transform(x, lambda r: {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'n': 0, 'e': r - mu}), lambda a, e:
      CASE WHEN greatest(a.up + e.e - 0.5 * sd, a.down - e.e - 0.5 * sd) > 4 * sd THEN {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'n': a.n + 1, 'e': 0.0::DOUBLE}
      ELSE {'up': greatest(0.0, a.up + e.e - 0.5 * sd)::DOUBLE, 'down': greatest(0.0, a.down - e.e - 0.5 * sd)::DOUBLE, 'n': a.n, 'e': 0.0::DOUBLE} END, {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'n': 0, 'e': 0.0::DOUBLE}) AS c FROM cul WHERE n >= 30 AND sd > 0""",
    "cuev": "SELECT bar_idx, 'CUSUM' AS layer, 'WARNING' AS severity, 'PORTFOLIO' AS asset, greatest(c.up, c.down) AS metric, 4 * sd AS threshold FROM cuf WHERE c.n > 0",
    **_mahalanobis(6),
    "ev": "SELECT * FROM zev UNION ALL SELECT * FROM cuev UNION ALL SELECT * FROM mhev UNION ALL SELECT * FROM vev UNION ALL SELECT * FROM dev",
    "evn": "SELECT bar_idx, asset, count(DISTINCT layer) AS layers FROM ev GROUP BY 1, 2",
    "kept": "SELECT ev.*, layers FROM ev JOIN evn USING (bar_idx, asset) WHERE layers >= 2 OR severity = 'CRITICAL'",
    "an": "SELECT bar_idx, least(count(*), 20) AS anomalies FROM kept GROUP BY 1",
    "sd": "SELECT bar_idx, asset, stddev_samp(lr) OVER (PARTITION BY asset ORDER BY bar_idx ROWS 251 PRECEDING) AS sd FROM r WHERE lr IS NOT NULL",
    "mv": "SELECT bar_idx, (sqrt(quantile_cont(sd * sd, 0.5)) + 1e-8) * sqrt(252) AS ann_vol FROM sd GROUP BY 1",
    "b0": "SELECT z.bar_date, z.bar_idx, z.avg_corr, z.corr_z, z.bucket, mv.ann_vol, pd.drawdown, coalesce(an.anomalies, 0) AS anomalies FROM z JOIN mv USING (bar_idx) JOIN pd USING (bar_idx) LEFT JOIN an USING (bar_idx)",
    "b": "SELECT *, CASE WHEN avg_corr > 0.55 THEN 'STRESSED' WHEN avg_corr > 0.4 OR ann_vol > 0.25 OR drawdown < -0.08 OR anomalies >= 4 THEN 'TRANSITION' ELSE 'CALM' END AS regime FROM b0",
    "rv": "SELECT * FROM (SELECT bar_date, bar_idx, pr, {z99} * stddev_samp(pr) OVER w - avg(pr) OVER w AS var, count(pr) OVER w AS n FROM pr WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) WHERE n >= 60",
    "br": "SELECT *, (pr < -var)::INT AS breach FROM rv",
    "bv": "SELECT b.*, rv.var AS var_99 FROM b JOIN rv USING (bar_idx)",
    "dc": """SELECT *, CASE priority WHEN 'stress_corr_override' THEN 0.5 WHEN 'corr_crisis' THEN 0.55 WHEN 'anomaly_suppress' THEN 0.65 WHEN 'stressed_regime' THEN 0.55 WHEN 'transition' THEN 0.82 WHEN 'var_breach_risk' THEN 0.7 ELSE 1.0 END AS exposure,
      priority IN ('stress_corr_override', 'corr_crisis') OR (priority = 'stressed_regime' AND corr_z > 1.5) AS hedge FROM (SELECT *, CASE WHEN regime = 'STRESSED' AND corr_z > 1 THEN 'stress_corr_override' WHEN corr_z > 1.5 THEN 'corr_crisis' WHEN anomalies >= 3 THEN 'anomaly_suppress' WHEN regime = 'STRESSED' THEN 'stressed_regime'
      WHEN regime = 'TRANSITION' THEN 'transition' WHEN var_99 > 0.05 THEN 'var_breach_risk' WHEN corr_z < -1 THEN 'diversification_regime' ELSE 'normal' END AS priority FROM bv)""",
    "lg": "SELECT dc.*, x.pnl FROM dc JOIN (SELECT bar_idx, lead(pr) OVER (ORDER BY bar_idx) AS pnl FROM pr) x USING (bar_idx) WHERE x.pnl IS NOT NULL",
}


def sql(body: str) -> str:
    """The body behind the table expressions that it needs, each of which reads earlier ones only."""
    names = list(CTES)
    need: set[str] = set()

    def visit(text: str, before: int) -> None:
        for i, name in enumerate(names[:before]):
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b(?!\s*\()", text):
                need.add(name)
                visit(CTES[name], i)

    visit(body, len(names))
    made = ",\n".join(f"{n} AS ({CTES[n]})" for n in names if n in need)
    if body.startswith("WITH "):
        body = body.removeprefix("WITH ")
        return f"WITH {made},\n{body}".replace("{z99}", repr(-kernels.normal_quantile(0.01)))
    text = f"WITH {made}\n{body}" if made else body
    return text.replace("{z99}", repr(-kernels.normal_quantile(0.01)))


def query(body: str | None = None) -> Callable:
    """Register a function as a query of its name, with the body of its SQL."""

    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = (f, body)
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, drop: tuple = ("panel",)) -> DataFrame:
    """df with doubles rounded, a negative nought made positive, dates as text, and the panel's name dropped."""
    shown = {"double": lambda c: F.round(c, digits) + 0.0, "date": lambda c: F.col(c).cast("string")}
    return df.select(*[shown[t](c).alias(c) if t in shown else F.col(c) for c, t in df.dtypes if c not in drop])


def _steadily(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        steady(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _steadily(f) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, (_, body) in _QUERIES.items() if body}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corr_z over a weekly panel, with windows that fit its few bars."""
    s = replace(DEFAULT, corr=replace(DEFAULT.corr, window=26, cov_window=52))
    return rounded(features.corr_z_path(panels.weekly(spark, sf_dir), s, 26), drop=())


P = panels.smooth


def _w(panel: DataFrame) -> DataFrame:
    return features.equal_weights(panel)


def portfolio_next(panel: DataFrame) -> DataFrame:
    """(panel, bar_idx, corr_z, ann_vol, y): y is the equal-weight portfolio's return to the next bar."""
    none = detect.layer_events(panel, _w(panel), DEFAULT, ("DRAWDOWN",)).limit(0)
    bars = detect.bar_features(panel, _w(panel), none, features.corr_z_path(panel))
    y = features.portfolio_returns(panel, _w(panel)).withColumn("y", F.lead("pr").over(features.series())).select("panel", "bar_idx", "y")
    return bars.join(y, ["panel", "bar_idx"]).where("y is not null").select("panel", "bar_idx", "corr_z", "ann_vol", "y")


def _events(panel: DataFrame) -> DataFrame:
    return detect.anomalies(panel, _w(panel))


def _bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel and its bars with regimes and var_99; both stored, as many steps read them."""
    panel = stored(P(spark, sf_dir), "panel")
    bars = detect.bar_features(panel, _w(panel), _events(panel), features.corr_z_path(panel))
    return panel, stored(research.with_var(panel, bars), "bars")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bars = _bars(spark, sf_dir)
    return decide.decided(bars)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.decision_log(*_bars(spark, sf_dir))


# ---- panels and their quality ----


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(close, 6) AS close FROM p")
def panel_build(spark, d):
    return rounded(P(spark, d))


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(close, 6) AS close FROM fp")
def panel_fill3(spark, d):
    return rounded(panels.filled(panels.raw(spark, d)))


_STALE = "SELECT asset, max(bar_date) FILTER (close IS NOT NULL) AS last_date, max(bar_date) - max(bar_date) FILTER (close IS NOT NULL) AS gap_days FROM fp GROUP BY 1"


@query(f"SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(close, 9) AS close, gap_days > 2 AS stale FROM (SELECT *, count(*) FILTER (close IS NULL) OVER (PARTITION BY bar_idx) AS missing FROM fp) JOIN ({_STALE}) USING (asset) WHERE missing = 0")
def aligned_panel(spark, d):
    return rounded(panels.aligned(panels.raw(spark, d)), 9)


@query(f"SELECT asset, last_date::VARCHAR AS last_date, gap_days::INT AS gap_days, gap_days > 2 AS stale FROM ({_STALE})")
def asset_staleness(spark, d):
    return rounded(panels.staleness(panels.filled(panels.raw(spark, d))))


@query("""SELECT asset, min(bar_date)::VARCHAR AS "begin", max(bar_date)::VARCHAR AS "end", count(*) AS bars, (b - a)::INT AS days FROM (SELECT asset, bar_date, close, coalesce(last_value(CASE WHEN close IS NOT NULL THEN bar_date END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), min(bar_date) OVER (PARTITION BY asset)) AS a,
  coalesce(first_value(CASE WHEN close IS NOT NULL THEN bar_date END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(bar_date) OVER (PARTITION BY asset)) AS b FROM rawp) WHERE close IS NULL AND b - a > 2 GROUP BY asset, a, b""")
def price_gaps(spark, d):
    return rounded(panels.gaps(panels.raw(spark, d)))


@query("""SELECT asset, (min(bar_date) FILTER (close IS NOT NULL))::VARCHAR AS first_valid, (max(bar_date) FILTER (close IS NOT NULL))::VARCHAR AS last_valid, round(avg((close IS NULL)::INT), 6) AS missing_frac,
  coalesce(max(run), 0) AS longest_stale, coalesce(any_value(jumps), 0) AS jumps FROM rawp
  LEFT JOIN (SELECT asset, max(n) AS run FROM (SELECT asset, g, count(*) AS n FROM (SELECT asset, bar_idx - row_number() OVER (PARTITION BY asset ORDER BY bar_idx) AS g FROM rawp WHERE close IS NULL) GROUP BY 1, 2) GROUP BY 1) USING (asset)
  LEFT JOIN (SELECT asset, sum((abs((x - mu) / s) > 5)::INT)::BIGINT AS jumps FROM (SELECT *, avg(x) OVER (PARTITION BY asset) AS mu, stddev_samp(x) OVER (PARTITION BY asset) AS s FROM (SELECT asset, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY bar_idx)) AS x FROM rawp WHERE close IS NOT NULL) WHERE x IS NOT NULL) GROUP BY 1) USING (asset)
  GROUP BY asset""")
def panel_quality_columns(spark, d):
    from .operators import quality

    return rounded(quality.columns(panels.raw(spark, d)))


@query("""SELECT count(*) AS bars, count(*) FILTER (missing = 0) AS overlap, round(1 - count(*) FILTER (missing = 0) / count(*), 6) AS dropped_frac, any_value(k) AS assets, count(*) FILTER (missing = 0) >= 150 AND any_value(k) >= 3 AS ok
  FROM (SELECT bar_idx, sum((close IS NULL)::INT) AS missing, count(*) AS k FROM rawp GROUP BY 1)""")
def panel_quality_summary(spark, d):
    from .operators import quality

    return rounded(quality.summary(panels.raw(spark, d)))


@query("SELECT asset, max(n) AS longest_stale FROM (SELECT asset, g, count(*) AS n FROM (SELECT asset, bar_idx - row_number() OVER (PARTITION BY asset ORDER BY bar_idx) AS g FROM rawp WHERE close IS NULL) GROUP BY 1, 2) GROUP BY 1")
def longest_stale_run(spark, d):
    from .operators import quality

    return rounded(quality.stale_runs(panels.raw(spark, d)))


# ---- returns and features ----


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(lr, 8) AS lr FROM r WHERE lr IS NOT NULL")
def log_returns(spark, d):
    return rounded(features.returns(P(spark, d)).select("bar_date", "bar_idx", "asset", "lr").where("lr is not null"), 8)


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(lr10, 8) AS lr10 FROM r10 WHERE lr10 IS NOT NULL")
def returns_10d(spark, d):
    return rounded(features.returns_10d(P(spark, d)).drop("lr").where("lr10 is not null"), 8)


@query("SELECT asset, count(*) AS bars FROM (SELECT *, sum((lr IS NULL OR lr10 IS NULL)::INT) OVER (PARTITION BY bar_idx) AS missing FROM r10) WHERE missing = 0 GROUP BY 1")
def return_coverage_align(spark, d):
    return features.coverage_aligned(P(spark, d)).groupBy("asset").agg(F.count("*").alias("bars"))


@query("SELECT a, b, round(cov * 1e6, 6) AS cov_e6, n FROM cov WHERE a <= b")
def sample_cov(spark, d):
    return rounded(features.sample_covariance(P(spark, d)).select("a", "b", (F.col("cov") * 1e6).alias("cov_e6"), "n"))


@query("""SELECT a, b, round((sum(w * ra * rb) / sum(w) - sum(w * ra) * sum(w * rb) / (sum(w) * sum(w))) * 1e6, 5) AS cov_e6 FROM (
  SELECT a.asset AS a, b.asset AS b, a.lr AS ra, b.lr AS rb, CASE WHEN m = a.bar_idx THEN 1.0 ELSE (1 - 0.94) * pow(0.94, m - a.bar_idx - 1) END AS w FROM rec a JOIN rec b ON a.bar_idx = b.bar_idx AND a.asset <= b.asset, m) GROUP BY 1, 2""")
def ewma_cov(spark, d):
    return rounded(features.ewma_covariance(P(spark, d)).select("a", "b", (F.col("cov") * 1e6).alias("cov_e6")), 5)


@query("SELECT x.asset, CASE WHEN x.asset = 'AF' THEN 1.0 ELSE round(regr_slope(x.lr, y.lr), 6) END AS beta FROM rec x LEFT JOIN (SELECT bar_idx, lr FROM rec WHERE asset = 'AF') y USING (bar_idx) GROUP BY 1")
def beta_vs_benchmark(spark, d):
    return rounded(features.beta(P(spark, d), "AF"))


@query(f"SELECT asset, round(sqrt(252) * (avg(lr) - {DEFAULT.daily_rf!r}) / stddev_samp(lr), 5) AS sharpe FROM rec GROUP BY 1")
def sharpe_252(spark, d):
    return rounded(features.sharpe(P(spark, d)), 5)


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, asset, round(drawdown, 6) AS drawdown FROM dd")
def drawdown_asset(spark, d):
    return rounded(features.drawdown(P(spark, d)).drop("close"))


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(value, 6) AS value, round(drawdown, 6) AS drawdown FROM pd")
def drawdown_portfolio(spark, d):
    panel = P(spark, d)
    return rounded(features.portfolio_drawdown(panel, _w(panel)))


@query(f"SELECT round(sqrt(252) * (avg(pr) - {DEFAULT.daily_rf!r}) / stddev_samp(pr), 5) AS sharpe FROM pr")
def portfolio_sharpe(spark, d):
    panel = P(spark, d)
    return rounded(features.portfolio_sharpe(panel, _w(panel)), 5)


@query("SELECT bar_idx, asset, round(CASE WHEN count(lr) OVER w >= 5 THEN stddev_samp(lr) OVER w * sqrt(252) ELSE 0.2 END, 6) AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 20 PRECEDING)")
def rolling_ann_vol(spark, d):
    return rounded(features.rolling_vol(P(spark, d)).select("bar_idx", "asset", "vol"))


@query("SELECT asset, round(corr(lr, b), 6) AS autocorr FROM (SELECT asset, lr, lag(lr) OVER (PARTITION BY asset ORDER BY bar_idx) AS b FROM r, m WHERE lr IS NOT NULL AND bar_idx > m - 60) GROUP BY 1")
def autocorr_1(spark, d):
    return rounded(features.autocorrelation(P(spark, d)))


@query("SELECT p_name AS asset, p_brand AS asset_class, p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING max(p_partkey) % 5 = 0)")
def universe_filter(spark, d):
    return panels.universe(spark, d)


@query("""SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(avg(rho), 6) AS avg_corr, count(*) AS n_pairs FROM rho WHERE n >= 130 GROUP BY 1, 2""")
def avg_pairwise_corr(spark, d):
    return rounded(features.average_correlation(P(spark, d)))


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(avg_corr, 6) AS avg_corr, round(corr_mean, 6) AS corr_mean, round(corr_std, 6) AS corr_std, round(corr_z, 4) + 0.0 AS corr_z, bucket FROM z")
def corr_z_path(spark, d):
    return rounded(features.corr_z_path(P(spark, d)).withColumn("corr_z", F.round("corr_z", 4)))


def _strided(most: int) -> str:
    """SQL of the strided correlation, pair by pair."""
    return f"""WITH pn AS (SELECT max(bar_idx) - 1 AS n FROM r), sp AS (SELECT bar_date, bar_idx, bar_idx - 2 AS t, corr(ra, rb) OVER w AS before, corr(ra, rb) OVER v AS upto FROM pairs WHERE a < b
  WINDOW w AS (PARTITION BY a, b ORDER BY bar_idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY a, b ORDER BY bar_idx ROWS 251 PRECEDING)),
sm AS (SELECT bar_date, bar_idx, CASE WHEN any_value(t) = any_value(n) - 1 THEN avg(upto) WHEN any_value(t) >= 252 AND (any_value(t) - 252) % greatest(1, ceil((any_value(n) - 252) / {most}))::BIGINT = 0 THEN avg(before) END AS x FROM sp, pn GROUP BY 1, 2),
si AS (SELECT bar_date, bar_idx, x, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN bar_date END IGNORE NULLS) OVER b AS d0, first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN bar_date END IGNORE NULLS) OVER f AS d1 FROM sm
  WINDOW b AS (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), f AS (ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
st AS (SELECT bar_date, bar_idx, coalesce(x, v0 + (v1 - v0) * (bar_date - d0) / nullif(d1 - d0, 0), v1, v0) AS avg_corr FROM si)"""


@query(_strided(400) + " SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(avg_corr, 6) AS avg_corr FROM st")
def strided_corr(spark, d):
    return rounded(features.strided_correlation(P(spark, d), most=400))


@query(_strided(2500) + """, sz AS (SELECT *, avg(avg_corr) OVER w AS mu, CASE WHEN count(*) OVER w < 10 THEN coalesce(stddev_samp(avg_corr) OVER w, 1) ELSE stddev_samp(avg_corr) OVER w + 1e-6 END AS sd FROM st WINDOW w AS (ORDER BY bar_idx ROWS 119 PRECEDING)),
sy AS (SELECT *, CASE WHEN sd > 1e-12 THEN (avg_corr - mu) / sd ELSE 0 END AS corr_z FROM sz)
SELECT sy.bar_date::VARCHAR AS bar_date, bar_idx, round(drawdown * 100, 5) + 0.0 AS drawdown_pct, round(corr_z, 3) + 0.0 AS corr_z, CASE WHEN corr_z > 1.5 THEN 'STRESSED' WHEN corr_z < -1 THEN 'CALM' ELSE 'NORMAL' END AS label FROM sy JOIN pd USING (bar_idx)""")
def full_span_overlay(spark, d):
    return rounded(features.overlay(P(spark, d)).withColumn("corr_z", F.round("corr_z", 3)), 5)


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(avg_corr, 6) AS avg_corr, round(avg_corr, 6) AS corr_mean, 1.0::DOUBLE AS corr_std, 0.0::DOUBLE AS corr_z, 'normal' AS bucket FROM z")
def neutral_signal(spark, d):
    return rounded(features.neutral(features.corr_z_path(P(spark, d))))


@query("""SELECT count(*) AS n, round(regr_r2(y, x1), 6) AS r2_one,
  round((pow(covar_pop(y, x1), 2) * var_pop(x2) + pow(covar_pop(y, x2), 2) * var_pop(x1) - 2 * covar_pop(y, x1) * covar_pop(y, x2) * covar_pop(x1, x2)) / ((var_pop(x1) * var_pop(x2) - pow(covar_pop(x1, x2), 2)) * var_pop(y)), 6) AS r2_two
  FROM (SELECT corr_z AS x1, ann_vol AS x2, lead(pr) OVER (ORDER BY bar_idx) AS y FROM z JOIN mv USING (bar_idx) JOIN pr USING (bar_idx)) WHERE y IS NOT NULL""")
def return_regression(spark, d):
    """How much of the next bar's return corr_z explains, alone and with volatility."""
    panel = P(spark, d)
    r = portfolio_next(panel)
    one, two = research.regression_r2(r, "y", ["corr_z"]), research.regression_r2(r, "y", ["corr_z", "ann_vol"])
    return rounded(one.withColumnRenamed("r2", "r2_one").join(two.select("panel", F.col("r2").alias("r2_two")), "panel"))


# ---- risk ----


@query("""SELECT horizon, alpha, round(-q, 6) AS var, round(greatest(-t, -q), 6) AS cvar FROM (
  SELECT horizon, alpha, any_value(q) AS q, avg(x) FILTER (x <= q) AS t FROM (
  SELECT horizon, x, alpha, quantile_cont(x, 0.05) OVER (PARTITION BY horizon, alpha) AS q05, quantile_cont(x, 0.01) OVER (PARTITION BY horizon, alpha) AS q01, CASE WHEN alpha = 0.95 THEN q05 ELSE q01 END AS q FROM (
  SELECT unnest([1, 10]) AS horizon, unnest([x1, x10]) AS x FROM (SELECT bar_idx, sum(lr / k) AS x1, sum(lr10 / k) AS x10, count(lr10) AS n, any_value(k) AS k FROM r10, k GROUP BY 1) WHERE n = k), (VALUES (0.95), (0.99)) v(alpha)) GROUP BY 1, 2)""")
def hs_var_cvar_grid(spark, d):
    panel = P(spark, d)
    return rounded(risk.historical(risk.portfolio_horizons(panel, _w(panel)), ["panel", "horizon"], "x", DEFAULT.var_alphas))


_Z = {a: kernels.normal_quantile(1 - a) for a in DEFAULT.var_alphas}


@query(f"""SELECT alpha, horizon, round(mu, 8) AS mu, round(sigma, 8) AS sigma, round(-(mu + z * sigma), 6) AS var, round(d * sigma - mu, 6) AS cvar FROM (
  SELECT alpha, horizon, mu, z, d, sqrt(v * horizon) AS sigma FROM (SELECT sum(cov / (k * k)) AS v FROM cov, k),
  (SELECT unnest([1, 10]) AS horizon, unnest([avg(x1), avg(x10)]) AS mu FROM (SELECT bar_idx, sum(lr / k) AS x1, sum(s / k) AS x10 FROM (SELECT bar_idx, asset, lr, CASE WHEN count(lr) OVER w = 10 THEN sum(lr) OVER w END AS s FROM (SELECT r.bar_idx, asset, CASE WHEN r.bar_idx > m - 261 THEN lr END AS lr FROM r, m WHERE r.bar_idx > m - 262) WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 9 PRECEDING)), k WHERE s IS NOT NULL GROUP BY 1)),
  (VALUES (0.95, {_Z[0.95]!r}, {kernels.NORMAL.pdf(_Z[0.95]) / 0.05!r}), (0.99, {_Z[0.99]!r}, {kernels.NORMAL.pdf(_Z[0.99]) / 0.01!r})) c(alpha, z, d))""")
def mc_var_analytic(spark, d):
    panel = P(spark, d)
    out = risk.monte_carlo_analytic(panel, _w(panel))
    return rounded(out.select("alpha", "horizon", F.round("mu", 8).alias("mu"), F.round("sigma", 8).alias("sigma"), F.round("var", 6).alias("var"), F.round("cvar", 6).alias("cvar")), 8)


@query(f"SELECT round(sqrt(v), 8) AS sigma, round({-_Z[0.99]!r} * sqrt(v), 8) AS var FROM (SELECT sum(cov / (k * k)) AS v FROM cov, k)")
def parametric_var(spark, d):
    panel = P(spark, d)
    return rounded(risk.parametric(panel, _w(panel)), 8)


@query(f"""SELECT round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(zc, 5) AS z_cf, round(abs(zc / ({-_Z[0.99]!r})), 5) AS multiplier FROM (SELECT skew, kurt, z + (z * z - 1) * skew / 6 + (z * z * z - 3 * z) * kurt / 24 - (2 * z * z * z - 5 * z) * skew * skew / 36 AS zc FROM (
  SELECT {-_Z[0.99]!r}::DOUBLE AS z, avg(pow(pr - mu, 3)) / pow(avg(pow(pr - mu, 2)), 1.5) AS skew, avg(pow(pr - mu, 4)) / pow(avg(pow(pr - mu, 2)), 2) - 3 AS kurt FROM (SELECT pr, avg(pr) OVER () AS mu FROM pr)))""")
def cornish_fisher_multiplier(spark, d):
    return rounded(risk.tail_shape(risk.portfolio_of(P(spark, d))), 5)


#: The multiplier of cornish_fisher_multiplier, not rounded.
_TAIL = f"""SELECT abs((z + (z * z - 1) * skew / 6 + (z * z * z - 3 * z) * kurt / 24 - (2 * z * z * z - 5 * z) * skew * skew / 36) / z) AS tail FROM (
  SELECT {-_Z[0.99]!r}::DOUBLE AS z, avg(pow(pr - mu, 3)) / pow(avg(pow(pr - mu, 2)), 1.5) AS skew, avg(pow(pr - mu, 4)) / pow(avg(pow(pr - mu, 2)), 2) - 3 AS kurt FROM (SELECT pr, avg(pr) OVER () AS mu FROM pr))"""


def _with_tail(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """bars with tail, the panel's measured multiplier."""
    return bars.join(small(stored(risk.tail_shape(risk.portfolio_of(panel)).select("panel", F.col("multiplier").alias("tail")), "tails")), "panel")


_RC = "SELECT a AS asset, 1.0 / any_value(k) AS w, sum(cov / k) / any_value(k) AS p FROM cov, k GROUP BY 1"


@query(f"SELECT asset, round(w, 6) AS w, round(p / sqrt(sum(p) OVER ()), 8) AS contribution, round(p / sum(p) OVER (), 6) AS share, CASE WHEN p / sum(p) OVER () > 0.0625 THEN 'breach' WHEN p / sum(p) OVER () < 0.0075 THEN 'low' ELSE 'ok' END AS status FROM ({_RC})")
def risk_contributions(spark, d):
    panel = P(spark, d)
    out = risk.risk_contributions(features.sample_covariance(panel), _w(panel))
    return rounded(out.select("asset", F.round("w", 6).alias("w"), F.round("contribution", 8).alias("contribution"), F.round("share", 6).alias("share"), "status"), 8)


@query("SELECT round(CASE WHEN min(f) < 0 THEN avg(pr) * 252 / abs(min(f)) END, 5) AS calmar FROM (SELECT pr, l / max(l) OVER (ORDER BY bar_idx) - 1 AS f FROM (SELECT bar_idx, pr, exp(sum(pr) OVER (ORDER BY bar_idx)) AS l FROM pr))")
def calmar(spark, d):
    return rounded(risk.calmar(risk.portfolio_of(P(spark, d))), 5)


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(pr, 8) AS pr, round(var, 8) AS var, breach FROM br")
def rolling_var(spark, d):
    return rounded(risk.rolling_var(risk.portfolio_of(P(spark, d))), 8)


@query("SELECT n, x, round(CASE WHEN x = 0 OR x = n THEN 0 ELSE -2 * ((n - x) * ln(0.99) + x * ln(0.01) - (n - x) * ln(1 - x / n) - x * ln(x / n)) END, 5) AS lr FROM (SELECT count(*) AS n, sum(breach)::BIGINT AS x FROM br)")
def kupiec_lr(spark, d):
    return rounded(risk.kupiec(risk.rolling_var(risk.portfolio_of(P(spark, d)))), 5)


@query("""SELECT n00, n01, n10, n11, round(CASE WHEN least(n00, n01, n10, n11) = 0 OR s < 9 THEN 0 ELSE -2 * ((n00 + n10) * ln(1 - p) + (n01 + n11) * ln(p) - n00 * ln(1 - p0) - n01 * ln(p0) - n10 * ln(1 - p1) - n11 * ln(p1)) END, 5) AS lr FROM (
  SELECT *, n01 / (n00 + n01) AS p0, n11 / (n10 + n11) AS p1, (n01 + n11) / s AS p FROM (SELECT count(*) FILTER (breach = 0 AND x = 0) AS n00, count(*) FILTER (breach = 0 AND x = 1) AS n01, count(*) FILTER (breach = 1 AND x = 0) AS n10, count(*) FILTER (breach = 1 AND x = 1) AS n11, count(*) AS s
  FROM (SELECT breach, lead(breach) OVER (ORDER BY bar_idx) AS x FROM br) WHERE x IS NOT NULL))""")
def christoffersen_lr(spark, d):
    return rounded(risk.christoffersen(risk.rolling_var(risk.portfolio_of(P(spark, d)))), 5)


@query("SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM (SELECT CASE WHEN count(lr) OVER w >= 5 THEN stddev_samp(lr) OVER w * sqrt(252) ELSE 0.2 END - CASE WHEN count(lr) OVER v >= 5 THEN stddev_samp(lr) OVER v * sqrt(252) ELSE 0.2 END AS e FROM r WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 20 PRECEDING), v AS (PARTITION BY asset ORDER BY bar_idx ROWS 62 PRECEDING))")
def vol_rmse_mae(spark, d):
    panel = P(spark, d)
    fast, slow = (features.rolling_vol(panel, n).select("panel", "bar_idx", "asset", F.col("vol").alias(c)) for n, c in ((21, "forecast"), (63, "realized")))
    return rounded(risk.vol_errors(fast.join(slow, ["panel", "bar_idx", "asset"])))


@query("SELECT count(*) AS n, sum(breach)::BIGINT AS breaches, CASE WHEN count(*) < 10 OR sum(breach) <= 4 THEN 'GREEN' WHEN sum(breach) <= 9 THEN 'YELLOW' ELSE 'RED' END AS zone FROM br, m WHERE bar_idx > m - 252")
def basel_zone(spark, d):
    return rounded(risk.basel(risk.rolling_var(risk.portfolio_of(P(spark, d)))))


@query("SELECT sum(n)::BIGINT AS n, round(sum(n * breach) / sum(n), 6) AS rate, coalesce(max(n) FILTER (breach = 1), 0) AS longest FROM (SELECT breach, g, count(*) AS n FROM (SELECT breach, bar_idx - row_number() OVER (PARTITION BY breach ORDER BY bar_idx) AS g FROM br) GROUP BY 1, 2)")
def var_breach_runs(spark, d):
    return rounded(risk.breach_runs(risk.rolling_var(risk.portfolio_of(P(spark, d)))))


@query("""SELECT max(bar_idx) AS bar_idx, round(any_value(l), 6) AS var, round(CASE WHEN count(*) >= 8 THEN 50.0 * (sum((var < l)::INT) + sum((var <= l)::INT) + (sum((var <= l)::INT) > sum((var < l)::INT))::INT) / count(*) END, 6) AS percentile, max(breach) FILTER (age = 0) AS breach,
  coalesce(sum(breach) FILTER (age < 30), 0)::BIGINT AS breaches_30, CASE WHEN avg(c) FILTER (age < 14) > 1e-5 THEN 'increasing' WHEN avg(c) FILTER (age < 14) < -1e-5 THEN 'decreasing' ELSE 'flat' END AS trend, coalesce(sum(breach) FILTER (age < 10), 0) >= 3 AS clustered
  FROM (SELECT bar_idx, var, breach, m - bar_idx AS age, var - lag(var) OVER (ORDER BY bar_idx) AS c, last_value(var) OVER (ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM br, m WHERE bar_idx > m - 252)""")
def var_percentile_rank(spark, d):
    return rounded(risk.var_block(risk.rolling_var(risk.portfolio_of(P(spark, d)))))


@query("""SELECT round(f, 6) AS forecast_vol, round(coalesce(rl, f), 6) AS realized_vol, round((f - 0.1) * 10000, 2) AS deviation_bps, round((f - 0.1) / 0.1 * 100, 2) AS deviation_pct, CASE WHEN f > 0.1 * 1.1 THEN 'above target' WHEN f < 0.1 * 0.85 THEN 'below target' ELSE 'near target' END AS hint
  FROM (SELECT sqrt(sum(cov / (k * k))) * sqrt(252) AS f FROM cov, k), (SELECT stddev_samp(pr) * sqrt(252) AS rl FROM pr, m WHERE bar_idx > m - 60)""")
def risk_vs_target(spark, d):
    panel = P(spark, d)
    return rounded(risk.risk_vs_target(risk.portfolio_of(panel), risk.parametric(panel, _w(panel))))


_IV = "SELECT bar_idx, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY bar_idx) AS w FROM sd"


@query(f"""SELECT side, rank, asset, round(delta, 8) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(delta) DESC, asset) AS rank FROM (
  SELECT asset, y.w - x.w AS delta, CASE WHEN y.w > x.w THEN 'increase' ELSE 'decrease' END AS side FROM (SELECT asset, w FROM ({_IV}), m WHERE bar_idx = m - 20) x JOIN (SELECT asset, w FROM ({_IV}), m WHERE bar_idx = m) y USING (asset)) WHERE abs(delta) > 1e-8) WHERE rank <= 5""")
def allocation_delta_topk(spark, d):
    w = portfolio.inverse_vol(portfolio.volatilities(P(spark, d))).withColumn("age", F.max("bar_idx").over(features.whole()) - F.col("bar_idx"))
    at = lambda k: w.where(F.col("age") == k).select("panel", "asset", "w")
    return rounded(risk.allocation_delta(at(20), at(0)), 8)


_HX = """SELECT horizon, alpha, var, greatest(t, var) AS cvar, skew, kurt FROM (SELECT horizon, alpha, -any_value(q) AS var, -avg(x) FILTER (x <= q) AS t, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS skew, avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3 AS kurt FROM (
  SELECT horizon, alpha, x, avg(x) OVER h AS mu, CASE WHEN alpha = 0.95 THEN quantile_cont(x, 0.05) OVER h ELSE quantile_cont(x, 0.01) OVER h END AS q FROM (
  SELECT unnest([1, 10]) AS horizon, unnest([x1, x10]) AS x FROM (SELECT bar_idx, sum(lr / k) AS x1, sum(lr10 / k) AS x10, count(lr10) AS n, any_value(k) AS k FROM r10, k GROUP BY 1) WHERE n = k), (VALUES (0.95::DOUBLE), (0.99::DOUBLE)) v(alpha) WINDOW h AS (PARTITION BY horizon, alpha)) GROUP BY 1, 2)"""
_CF = f"""SELECT *, abs((z + (z * z - 1) * skew / 6 + (z * z * z - 3 * z) * kurt / 24 - (2 * z * z * z - 5 * z) * skew * skew / 36) / z) AS multiplier FROM (SELECT *, CASE WHEN alpha = 0.95 THEN {-_Z[0.95]!r}::DOUBLE ELSE {-_Z[0.99]!r}::DOUBLE END AS z FROM ({_HX}))"""


@query(f"SELECT horizon, alpha, round(var, 6) AS var, round(cvar, 6) AS cvar, round(cvar * multiplier, 6) AS cf_cvar, round(multiplier, 5) AS multiplier FROM ({_CF})")
def cf_cvar_grid(spark, d):
    panel = P(spark, d)
    out = risk.adjusted(risk.portfolio_horizons(panel, _w(panel)), ["panel", "horizon"], "x", DEFAULT.var_alphas)
    return rounded(out.withColumn("multiplier", F.round("multiplier", 5)))


@query(f"""SELECT round(h.var, 6) AS hs_var_99, round(h.cvar, 6) AS hs_cvar_99, round(h.cvar * multiplier, 6) AS cf_cvar_99, round(multiplier, 6) AS tail_multiplier, round(mv.var, 6) AS mc_var_99, round(mv.cvar, 6) AS mc_cvar_99, b.trend, b.breaches_30, b.breach AS breach_today, b.clustered
  FROM ({_CF}) h, ({_QUERIES["mc_var_analytic"][1]}) mv, ({_QUERIES["var_percentile_rank"][1]}) b WHERE h.horizon = 1 AND h.alpha = 0.99 AND mv.horizon = 1 AND mv.alpha = 0.99""")
def tail_block(spark, d):
    panel = P(spark, d)
    return rounded(risk.tail_block(panel, _w(panel)))


@query("""WITH e AS (SELECT r.bar_idx, asset, (lr - avg(lr) OVER (PARTITION BY asset)) / stddev_samp(lr) OVER (PARTITION BY asset) AS e FROM r, m WHERE lr IS NOT NULL AND bar_idx > m - 504),
  q AS (SELECT a, b, pow(0.94, n - 1) * q0 + (1 - 0.98) * (1 - pow(0.94, n - 1)) / (1 - 0.94) * q0 + v AS q FROM (SELECT x.asset AS a, y.asset AS b, corr(x.e, y.e) AS q0, count(*) AS n, sum(CASE WHEN m > x.bar_idx THEN 0.04 * pow(0.94, m - x.bar_idx - 1) * x.e * y.e ELSE 0 END) AS v FROM e x JOIN e y ON x.bar_idx = y.bar_idx, m GROUP BY 1, 2))
  SELECT q.a, q.b, round(q.q / sqrt(u.q * w.q), 6) AS rho FROM q JOIN q u ON u.a = q.a AND u.b = q.a JOIN q w ON w.a = q.b AND w.b = q.b WHERE q.a <= q.b""")
def dcc_closed_form(spark, d):
    return rounded(risk.dcc(risk.standardized(P(spark, d))))


@query()
def mc_var_sampled(spark, d):
    panel = P(spark, d)
    draws = risk.monte_carlo_sampled(panel, _w(panel))
    return rounded(risk.historical(draws, ["panel", "horizon"], "x", DEFAULT.var_alphas))


@query()
def mc_assets_drawn(spark, d):
    """VaR and adjusted tail means of draws of all assets under the coherent covariance."""
    panel = P(spark, d)
    return rounded(risk.adjusted(risk.drawn_portfolio(panel, _w(panel)), ["panel"], "x", DEFAULT.var_alphas))


@query()
def garch_forecast(spark, d):
    return rounded(risk.garch(P(spark, d)).groupBy("panel", "asset").agg(F.first("forecast").alias("forecast"), F.count("*").alias("bars")))


@query()
def garch_dcc_cov(spark, d):
    panel = P(spark, d)
    return rounded(risk.garch_dcc_covariance(panel, _w(panel)), 10)


@query()
def contagion_index(spark, d):
    return rounded(risk.contagion_index(risk.correlations(P(spark, d))))


@query()
def kupiec_p_value(spark, d):
    return rounded(risk.with_p_value(risk.kupiec(risk.rolling_var(risk.portfolio_of(P(spark, d))))))


# ---- anomalies and regimes ----


@query("SELECT bar_idx, layer, severity, asset, round(metric, 5) AS metric, threshold::DOUBLE AS threshold FROM zev")
def zscore_layer(spark, d):
    panel = P(spark, d)
    return rounded(detect.zscore_layer(panel, _w(panel)), 5)


@query("SELECT bar_idx, layer, severity, asset, round(metric, 5) AS metric, round(threshold, 5) AS threshold FROM vev")
def vr_layer(spark, d):
    return rounded(detect.variance_ratio_layer(P(spark, d)), 5)


@query("SELECT bar_idx, layer, severity, asset, round(metric, 6) AS metric, threshold::DOUBLE AS threshold FROM dev")
def drawdown_layer(spark, d):
    panel = P(spark, d)
    return rounded(detect.drawdown_layer(panel, _w(panel)))


@query("SELECT bar_idx, layer, severity, asset, round(metric, 5) AS metric, round(threshold, 5) AS threshold, layers FROM kept")
def conjunction(spark, d):
    panel = P(spark, d)
    return rounded(detect.conjunction(detect.layer_events(panel, _w(panel))), 5)


@query("SELECT bar_idx, layer, severity, asset, round(metric, 6) AS metric, round(threshold, 6) AS threshold FROM cuev")
def cusum_layer(spark, d):
    panel = P(spark, d)
    return rounded(detect.cusum_layer(panel, _w(panel)))


@query("SELECT bar_idx, layer, severity, asset, round(metric, 4) AS metric, round(threshold, 4) AS threshold FROM mhev")
def mahalanobis_layer(spark, d):
    return rounded(detect.mahalanobis_layer(P(spark, d)), 4)


@query("SELECT bar_date::VARCHAR AS bar_date, bar_idx, round(avg_corr, 6) AS avg_corr, round(corr_z, 4) + 0.0 AS corr_z, bucket, round(ann_vol, 6) AS ann_vol, round(drawdown, 6) AS drawdown, anomalies, regime FROM b")
def regime_label(spark, d):
    panel = P(spark, d)
    bars = detect.bar_features(panel, _w(panel), _events(panel), features.corr_z_path(panel))
    return rounded(bars.select("bar_date", "bar_idx", "avg_corr", (F.round("corr_z", 4) + 0.0).alias("corr_z"), "bucket", "ann_vol", "drawdown", "anomalies", "regime"))


_RUN = "SELECT *, sum(c) OVER (ORDER BY bar_idx)::BIGINT AS island FROM (SELECT *, coalesce((regime <> lag(regime) OVER (ORDER BY bar_idx))::INT, 0) AS c FROM b)"


@query(f"SELECT bar_idx, regime, island, row_number() OVER (PARTITION BY island ORDER BY bar_idx) AS duration FROM ({_RUN}) WHERE bar_idx IN (SELECT bar_idx FROM rv)")
def regime_duration(spark, d):
    _, bars = _bars(spark, d)
    return detect.durations(bars).select("bar_idx", "regime", "island", "duration")


@query(f"SELECT regime, min(bar_date)::VARCHAR AS \"begin\", max(bar_date)::VARCHAR AS \"end\", count(*) AS bars, round(avg(corr_z), 4) + 0.0 AS mean_corr_z, island FROM ({_RUN}) GROUP BY regime, island QUALIFY row_number() OVER (ORDER BY island DESC) <= 30")
def regime_timeline(spark, d):
    _, bars = _bars(spark, d)
    return rounded(detect.timeline(bars))


_TE = """SELECT bar_idx, regime, p AS previous_regime, CASE WHEN p IS NULL THEN 'init' WHEN p = regime THEN 'no_change' WHEN regime = 'STRESSED' THEN 'enter_stress' WHEN p = 'STRESSED' THEN 'exit_stress' WHEN regime = 'TRANSITION' THEN 'enter_transition' ELSE 'exit_transition' END AS event
  FROM (SELECT bar_idx, regime, lag(regime) OVER (ORDER BY bar_idx) AS p FROM b)"""


@query(_TE)
def transition_events(spark, d):
    _, bars = _bars(spark, d)
    return detect.transition_events(bars).select("bar_idx", "regime", "previous_regime", "event")


@query(f"SELECT bar_idx, sum((event NOT IN ('no_change', 'init'))::INT) OVER w::BIGINT AS transitions, count(*) OVER w AS window_bars, 0.72 AS avg_confidence, CASE WHEN sum((event NOT IN ('no_change', 'init'))::INT) OVER w >= 4 THEN 'elevated_churn' ELSE 'stable' END AS hint FROM ({_TE}) WINDOW w AS (ORDER BY bar_idx ROWS 19 PRECEDING)")
def transition_stats(spark, d):
    _, bars = _bars(spark, d)
    return rounded(detect.transition_stats(bars))


@query("SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM (SELECT before, after, count(*) AS n FROM (SELECT regime AS before, lead(regime) OVER (ORDER BY bar_idx) AS after FROM b) WHERE after IS NOT NULL GROUP BY 1, 2)")
def transition_matrix(spark, d):
    _, bars = _bars(spark, d)
    return rounded(detect.transition_matrix(bars))


@query(f"""SELECT bar_idx, regime, 1.0::DOUBLE AS probability, 0.72::DOUBLE AS confidence, duration, min(bar_date) OVER (PARTITION BY island)::VARCHAR AS last_transition, 'In ' || regime || ' for ' || duration || ' bar(s).' AS persistence
  FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY bar_idx) AS duration FROM ({_RUN}))""")
def regime_classify(spark, d):
    panel = stored(P(spark, d), "panel")
    bars = detect.bar_features(panel, _w(panel), _events(panel), features.corr_z_path(panel))
    out = detect.classified(bars)
    return rounded(out.select("bar_idx", "regime", F.element_at("probabilities", F.col("regime")).alias("probability"), "confidence", "duration", "last_transition", "persistence"))


@query()
def regime_posteriors(spark, d):
    """Every bar's state, its probabilities and the matrix of state changes behind it."""
    _, bars = _bars(spark, d)
    out = detect.classified(bars, replace(DEFAULT, regime=replace(DEFAULT.regime, clustered=True)))
    shares = [F.round(F.element_at("probabilities", x), 6).alias(x.lower()) for x in detect.STATES]
    return rounded(out.select("bar_idx", "regime", "confidence", *shares, F.transform("matrix", lambda r: F.transform(r, lambda v: F.round(v, 6))).alias("matrix"), "persistence"))


@query()
def regime_json(spark, d):
    _, bars = _bars(spark, d)
    return detect.serialized(bars).drop("panel")


@query()
def hmm_lite(spark, d):
    _, bars = _bars(spark, d)
    return rounded(detect.clustered_regimes(bars))


# ---- alpha ----


def _ewm_sql(n: int) -> str:
    """The bias-corrected weighted deviation of list l of up to n returns."""
    w = "CASE WHEN i = 1 THEN pow(0.94, len(l) - 1) ELSE 0.06 * pow(0.94, len(l) - i) END"
    s = f"list_sum(list_transform(l, lambda x, i: {w}))"
    q = f"list_sum(list_transform(l, lambda x, i: pow({w}, 2)))"
    m1 = f"list_sum(list_transform(l, lambda x, i: x * {w}))"
    m2 = f"list_sum(list_transform(l, lambda x, i: x * x * {w}))"
    return f"(SELECT bar_idx, asset, s, n, CASE WHEN n >= 2 THEN sqrt(greatest((m2 / s0 - pow(m1 / s0, 2)) * s0 * s0 / (s0 * s0 - q), 0)) END AS v FROM (SELECT bar_idx, asset, list_sum(l) AS s, len(l) AS n, {s} AS s0, {q} AS q, {m1} AS m1, {m2} AS m2 FROM (SELECT bar_idx, asset, list(lr) OVER (PARTITION BY asset ORDER BY bar_idx ROWS {n - 1} PRECEDING) AS l FROM r WHERE lr IS NOT NULL)))"


_MOM = f"""SELECT bar_idx, asset, (h20 + h60 + h120) / 3 AS momentum FROM (SELECT bar_idx, asset,
  CASE WHEN n20 < 3 THEN 0 ELSE greatest(least(s20 / (greatest(coalesce(v20, f), f) * sqrt(20)), 3), -3) END AS h20, CASE WHEN n60 < 3 THEN 0 ELSE greatest(least(s60 / (greatest(coalesce(v60, f), f) * sqrt(60)), 3), -3) END AS h60, CASE WHEN n120 < 3 THEN 0 ELSE greatest(least(s120 / (greatest(coalesce(v120, f), f) * sqrt(120)), 3), -3) END AS h120
  FROM (SELECT a.bar_idx, a.asset, a.s AS s20, a.n AS n20, a.v AS v20, b.s AS s60, b.n AS n60, b.v AS v60, c.s AS s120, c.n AS n120, c.v AS v120, greatest(coalesce(list_aggregate(list_filter([a.v, b.v, c.v], lambda x: x > 0), 'quantile_cont', 0.1), 1e-8), 1e-8) AS f
  FROM {_ewm_sql(20)} a JOIN {_ewm_sql(60)} b USING (bar_idx, asset) JOIN {_ewm_sql(120)} c USING (bar_idx, asset)))"""
_REV = f"SELECT bar_idx, asset, CASE WHEN k < 63 THEN 0 ELSE greatest(least(-((s - mu * 5) / greatest(v, 1e-8) / sqrt(5)), 3), -3) END AS reversion FROM {_ewm_sql(5)} JOIN (SELECT bar_idx, asset, avg(lr) OVER w AS mu, count(lr) OVER w AS k FROM r WHERE lr IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY bar_idx ROWS 62 PRECEDING)) USING (bar_idx, asset)"
_CAR = "SELECT bar_idx, asset, tanh(3 * (0.65 * l + 0.35 * coalesce(l - lag(l, 21) OVER (PARTITION BY asset ORDER BY bar_idx), 0))) * 0.45 AS carry FROM (SELECT p.bar_idx, p.asset, ln(x.close / y.close) AS l FROM p JOIN p x ON x.bar_idx = p.bar_idx AND x.asset = 'AF' JOIN p y ON y.bar_idx = p.bar_idx AND y.asset = 'RF')"
_XS = f"SELECT bar_idx, asset, momentum, rank() OVER (PARTITION BY bar_idx ORDER BY momentum) + (count(*) OVER (PARTITION BY bar_idx, momentum) - 1) / 2 AS rank_mean, count(*) OVER (PARTITION BY bar_idx) AS n FROM ({_MOM})"


@query(f"SELECT bar_idx, asset, round(momentum, 5) AS momentum FROM ({_MOM})")
def momentum(spark, d):
    return rounded(alpha.momentum(P(spark, d)).drop("bar_date"), 5)


@query(f"SELECT bar_idx, asset, round(reversion, 5) + 0.0 AS reversion FROM ({_REV})")
def mean_reversion(spark, d):
    return rounded(alpha.mean_reversion(P(spark, d)).drop("bar_date"), 5)


@query(f"SELECT bar_idx, asset, round(carry, 6) AS carry FROM ({_CAR})")
def carry(spark, d):
    return rounded(alpha.carry(P(spark, d), "AF", "RF").drop("bar_date"))


@query(f"SELECT bar_idx, asset, rank_mean::DOUBLE AS rank_mean, round(greatest(least((rank_mean - 0.5) / n, 0.999), 0.001), 6) AS u FROM ({_XS})")
def xsec_rank(spark, d):
    return rounded(alpha.cross_section(alpha.momentum(P(spark, d))).select("bar_idx", "asset", "rank_mean", "u"))


@query()
def combine(spark, d):
    panel = P(spark, d)
    return rounded(alpha.combined(alpha.sleeves(panel, DEFAULT, "AF", "RF"), features.corr_z_path(panel)).drop("bar_date"), 5)


@query("SELECT bar_idx, CASE regime WHEN 'STRESSED' THEN 0.35 WHEN 'TRANSITION' THEN 0.7 ELSE 1.0 END * CASE WHEN anomalies >= 3 THEN 0.5 ELSE 1.0 END AS gate, CASE bucket WHEN 'crisis_spike' THEN -0.2 WHEN 'diversification' THEN 0.2 ELSE 0.0 END::DOUBLE AS tilt FROM bv")
def gate(spark, d):
    _, bars = _bars(spark, d)
    return rounded(bars.select("bar_idx", alpha.gate(F.col("regime"), F.col("anomalies")).alias("gate"), alpha.tilt(F.col("bucket")).alias("tilt")))


# ---- decisions ----


@query("SELECT bar_idx, regime, anomalies, round(var_99, 6) AS var_99, priority, exposure::DOUBLE AS exposure, hedge FROM dc")
def decision_ladder(spark, d):
    return rounded(_decided(spark, d).select("bar_idx", "regime", "anomalies", "var_99", "priority", "exposure", "hedge"))


@query("""SELECT bar_idx, concat_ws(',', CASE WHEN regime = 'STRESSED' AND corr_z > 1 AND priority <> 'stress_corr_override' THEN 'fact_stress_high_corr' END, CASE WHEN corr_z > 1.5 AND priority <> 'corr_crisis' THEN 'fact_high_corr_z' END, CASE WHEN anomalies >= 3 AND priority <> 'anomaly_suppress' THEN 'fact_anomaly' END,
  CASE WHEN regime = 'STRESSED' AND priority <> 'stressed_regime' THEN 'fact_stressed_regime' END, CASE WHEN regime = 'TRANSITION' AND priority <> 'transition' THEN 'fact_transition' END, CASE WHEN var_99 > 0.05 AND priority <> 'var_breach_risk' THEN 'fact_var_hot' END, CASE WHEN corr_z < -1 AND priority <> 'diversification_regime' THEN 'fact_diversification_corr' END) AS secondary FROM dc""")
def decision_facts(spark, d):
    return _decided(spark, d).select("bar_idx", F.array_join("secondary", ",").alias("secondary"))


_MASS = """CASE WHEN corr_z > 1.5 THEN 0.22 WHEN corr_z > 1.5 * 0.65 THEN 0.10 ELSE 0 END + CASE WHEN anomalies >= 3 THEN 0.28 WHEN anomalies >= 2 THEN 0.12 ELSE 0 END + CASE WHEN var_99 > 0.05 THEN 0.18 WHEN var_99 > 0.72 * 0.05 THEN 0.09 ELSE 0 END + CASE WHEN drawdown <= -0.05 THEN 0.14 WHEN drawdown <= -0.03 THEN 0.07 ELSE 0 END
  + CASE regime WHEN 'STRESSED' THEN 0.16 WHEN 'TRANSITION' THEN 0.11 ELSE 0 END + CASE WHEN regime = 'STRESSED' AND corr_z > 1 THEN 0.24 ELSE 0 END + CASE WHEN corr_z < -1 THEN 0.08 ELSE 0 END + CASE WHEN ann_vol > 0.1 * 1.2 THEN 0.06 ELSE 0 END + CASE WHEN avg_corr > 0.7 THEN 0.12 WHEN avg_corr > 0.45 THEN 0.06 ELSE 0 END"""


@query(f"SELECT bar_idx, round(m, 4)::DOUBLE AS mass, round(greatest(least(0.22 + 0.38 * 0.72 + 0.28 * (1 - greatest(least(anomalies / 14.0, 1), 0)) + 0.22 * greatest(least(m::DOUBLE / 0.85, 1), 0) - CASE WHEN priority = 'transition' THEN 0.08 ELSE 0 END, 0.92), 0.18), 4)::DOUBLE AS confidence FROM (SELECT *, {_MASS} AS m FROM dc)")
def confidence(spark, d):
    _, bars = _bars(spark, d)
    out = decide.traced(bars.withColumn("vol_ann", F.col("ann_vol")))
    mass = F.aggregate("drivers", F.lit(0.0), lambda acc, x: acc + x.delta)
    return rounded(out.select("bar_idx", F.round(mass, 4).alias("mass"), "confidence"))


@query()
def driver_masses(spark, d):
    _, bars = _bars(spark, d)
    return decide.traced(bars.withColumn("vol_ann", F.col("ann_vol"))).select("bar_idx", F.array_join("lines", " | ").alias("lines"), "conclusion")


@query(f"""SELECT bar_idx, round(CASE WHEN hedge THEN least(0.35, greatest(0, beta * 0.4)) ELSE 0 END + overlay * 0.5, 6)::DOUBLE AS notional,
  coalesce(nullif(concat_ws(',', CASE WHEN hedge THEN 'corr_or_stress_hedge' END, CASE WHEN overlay > 0 THEN 'tail_overlay' END), ''), 'none') AS notes
  FROM dc, (SELECT CASE WHEN tail <= 1.35 THEN 0 ELSE least(0.25, (tail - 1.35) * 0.2) END AS overlay FROM ({_TAIL})),
  (SELECT avg(beta) AS beta FROM (SELECT x.asset, CASE WHEN x.asset = 'AF' THEN 1.0 ELSE regr_slope(x.lr, y.lr) END AS beta FROM rec x LEFT JOIN (SELECT bar_idx, lr FROM rec WHERE asset = 'AF') y USING (bar_idx) GROUP BY 1))""")
def hedge_bundle(spark, d):
    panel, bars = _bars(spark, d)
    b = decide.portfolio_beta(features.beta(panel, "AF"), _w(panel))
    return rounded(decide.hedges(_with_tail(panel, decide.decided(bars)).join(b, "panel")).select("bar_idx", "notional", "notes"))


@query(f"SELECT type, priority, asset, round(value, 6) AS value FROM (SELECT CASE WHEN s > 0.0625 THEN 'REDUCE_RISK' ELSE 'INCREASE' END AS type, CASE WHEN s > 0.0625 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, asset, s AS value FROM (SELECT asset, p / sum(p) OVER () AS s FROM ({_RC})) WHERE s > 0.0625 OR s < 0.0075 UNION ALL SELECT 'REBALANCE', 'MEDIUM', NULL, v FROM (SELECT max(abs(1 / k - w)) AS v FROM ({_IV}), m, k WHERE bar_idx = m) WHERE v > 0.05 UNION ALL SELECT 'REDUCE_RISK', 'HIGH', NULL, var_99 FROM bv, m WHERE bar_idx = m AND var_99 > 0.05 UNION ALL SELECT 'CORRELATION_ALERT', 'CRITICAL', NULL, avg_corr FROM bv, m WHERE bar_idx = m AND avg_corr > 0.7 UNION ALL SELECT 'DRAWDOWN_STOP', 'CRITICAL', NULL, drawdown FROM bv, m WHERE bar_idx = m AND drawdown < -0.15 UNION ALL SELECT 'HEDGE', 'HIGH', NULL, tail FROM ({_TAIL}) WHERE tail > 1.5)")
def rebalance_signals(spark, d):
    panel, bars = _bars(spark, d)
    last = lambda df: features.last_bars(df, 1)
    targets = last(portfolio.inverse_vol(portfolio.volatilities(panel))).select("panel", "asset", "w")
    state = _with_tail(panel, last(bars))
    return rounded(decide.rebalance_signals(state, risk.risk_contributions(features.sample_covariance(panel), _w(panel)), _w(panel), targets))


@query("SELECT bar_idx, CASE WHEN exposure < 0.75 OR priority IN ('stress_corr_override', 'corr_crisis', 'anomaly_suppress') THEN 'cut back' WHEN regime = 'TRANSITION' THEN 'hold less' WHEN bucket = 'diversification' THEN 'room to add' ELSE 'as planned' END || ': ' || priority || ' at ' || printf('%.2f', exposure) AS headline FROM dc")
def narrative_headline(spark, d):
    _, bars = _bars(spark, d)
    return decide.narrated(decide.decided(bars).withColumn("vol_ann", F.col("ann_vol"))).select("bar_idx", "headline")


@query("""SELECT bar_idx, round(corr_z - lag(corr_z) OVER w, 6) + 0.0 AS corr_z_1, round(corr_z - lag(corr_z, 5) OVER w, 6) + 0.0 AS corr_z_5, round(corr_z - lag(corr_z, 20) OVER w, 6) + 0.0 AS corr_z_20, round(var_99 - lag(var_99) OVER w, 8) + 0.0 AS var_99_1, round(var_99 - lag(var_99, 5) OVER w, 8) + 0.0 AS var_99_5,
  coalesce(lag(regime) OVER w <> regime, false) AS regime_changed, round(exposure - lag(exposure) OVER w, 4)::DOUBLE + 0.0 AS exposure_1 FROM dc WINDOW w AS (ORDER BY bar_idx)""")
def recent_changes(spark, d):
    return rounded(decide.recent_changes(_decided(spark, d)).drop("notes"), 8)


@query("""SELECT rank, bar_idx, round(d, 5) AS distance FROM (SELECT row_number() OVER (ORDER BY d, bar_idx) AS rank, bar_idx, d FROM (SELECT h.bar_idx, sqrt(pow((h.corr_z - c.corr_z) / s1, 2) + pow((h.ann_vol - c.ann_vol) / s2, 2) + pow((h.drawdown - c.drawdown) / s3, 2) + pow((h.var_99 - c.var_99) / s4, 2)) AS d
  FROM bv h, (SELECT * FROM bv, m WHERE bar_idx = m) c, (SELECT stddev_samp(corr_z) + 1e-9 AS s1, stddev_samp(ann_vol) + 1e-9 AS s2, stddev_samp(drawdown) + 1e-9 AS s3, stddev_samp(var_99) + 1e-9 AS s4 FROM bv, m WHERE bar_idx < m) WHERE h.bar_idx < c.bar_idx)) WHERE rank <= 5""")
def analog_knn(spark, d):
    _, bars = _bars(spark, d)
    return rounded(decide.analogs(bars, ["corr_z", "ann_vol", "drawdown", "var_99"]), 5)


# ---- portfolios and backtests ----


@query(f"SELECT bar_idx, asset, round(w, 6) AS w FROM ({_IV}) WHERE w IS NOT NULL")
def inverse_vol_weights(spark, d):
    return rounded(portfolio.inverse_vol(portfolio.volatilities(P(spark, d))).where("sd is not null").select("bar_idx", "asset", "w"))


@query("SELECT bar_idx, asset, CASE WHEN row_number() OVER (PARTITION BY bar_idx ORDER BY s DESC, asset) <= 3 THEN round(1 / 3, 6) ELSE 0 END::DOUBLE AS w FROM (SELECT bar_idx, asset, sum(lr) OVER (PARTITION BY asset ORDER BY bar_idx ROWS 59 PRECEDING) AS s FROM r WHERE lr IS NOT NULL)")
def momentum_naive_topk(spark, d):
    return rounded(portfolio.top_momentum(P(spark, d)).select("bar_idx", "asset", "w"))


@query("SELECT asset, round(1 / k, 6) AS w FROM (SELECT DISTINCT asset FROM p), k")
def equal_weight(spark, d):
    return rounded(_w(P(spark, d)))


@query(f"SELECT round(sum(abs(y.w - x.w)), 8) AS turnover, round(sum(abs(y.w - x.w)) * 10 / 10000, 8) AS cost FROM (SELECT asset, w FROM ({_IV}), m WHERE bar_idx = m - 20) x JOIN (SELECT asset, w FROM ({_IV}), m WHERE bar_idx = m) y USING (asset)")
def turnover_cost(spark, d):
    w = portfolio.inverse_vol(portfolio.volatilities(P(spark, d))).withColumn("age", F.max("bar_idx").over(features.whole()) - F.col("bar_idx"))
    at = lambda k: w.where(F.col("age") == k).select("panel", "asset", "w")
    return rounded(portfolio.turnover_cost(at(20), at(0)), 8)


_FV = "SELECT bar_idx, sqrt(sum(c / (k * k))) * sqrt(252) AS vol FROM (SELECT bar_idx, a, b, covar_samp(ra, rb) OVER (PARTITION BY a, b ORDER BY bar_idx ROWS 251 PRECEDING) AS c FROM pairs), k GROUP BY 1"


@query(f"SELECT bar_idx, round(vol, 6) AS vol, round(least(0.1 / vol, 1.0), 6) AS scale FROM ({_FV}) WHERE bar_idx >= 131")
def vol_target(spark, d):
    v = portfolio.forecast_vol(P(spark, d)).where("bar_idx >= 131")
    return rounded(v.select("bar_idx", "vol", portfolio.vol_scale(F.col("vol")).alias("scale")))


@query()
def backtest_ladder(spark, d):
    panel, bars = _bars(spark, d)
    return rounded(research.ladder(research.backtest(panel, bars)), drop=())


#: What the equal-weight book reads at each bar: VaR of its weights over 252 returns, and what the bar earns under the volatility target.
_BV = f"""SELECT bar_idx, v, h, abs(h - v) / greatest(v, 1e-8) > 0.35 AS disagreement, (scale * pnl < -v)::INT AS breach FROM (
  SELECT bar_idx, {{z99}} * sqrt(var_samp(pr) OVER w + 1e-10 / k) - avg(CASE WHEN bar_idx > 10 THEN pr END) OVER w AS v, -quantile_cont(CASE WHEN bar_idx > 10 THEN pr END, 0.01) OVER w AS h, lead(pr) OVER (ORDER BY bar_idx) AS pnl
  FROM pr, k WINDOW w AS (ORDER BY bar_idx ROWS 251 PRECEDING)) JOIN (SELECT bar_idx, least(0.1 / vol, 1.0) AS scale FROM ({_FV})) USING (bar_idx) JOIN b USING (bar_idx) WHERE pnl IS NOT NULL"""


def _book(spark, d, *modes):
    panel, bars = _bars(spark, d)
    return bars, stored(research.backtest(panel, bars, modes), "book")


@query(f"SELECT bar_idx, round(v, 7) AS var_99, round(h, 7) AS hs_var_99, disagreement FROM ({_BV})")
def bar_var(spark, d):
    """The VaR that each bar's decision reads, of the weights held before it."""
    return rounded(_book(spark, d, "baseline")[1].select("bar_idx", "var_99", "hs_var_99", "disagreement"), 7)


@query(f"""SELECT round(avg(breach), 6) AS var_breach_rate, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT breach, row_number() OVER (ORDER BY bar_idx) - row_number() OVER (PARTITION BY breach ORDER BY bar_idx) AS g FROM ({_BV})) WHERE breach = 1 GROUP BY g)) AS breach_cluster_max FROM ({_BV})""")
def book_breaches(spark, d):
    return rounded(research.breach_stats(_book(spark, d, "baseline")[1]).drop("strategy"))


@query()
def backtest_log(spark, d):
    """Every strategy's bars with the VaR of its own weights and, for the full system, what was decided under it."""
    bars, book = _book(spark, d, *portfolio.MODES)
    return rounded(research.backtest_log(book, bars), drop=())


@query()
def backtest_ablations(spark, d):
    panel, bars = _bars(spark, d)
    return rounded(research.ablations(panel, bars))


@query()
def backtest_cost_sweep(spark, d):
    panel, bars = _bars(spark, d)
    return rounded(research.cost_sweep(panel, bars))


@query()
def failure_report(spark, d):
    """The full system's worst stretches under the decisions it took, with its measures."""
    bars, book = _book(spark, d, "full")
    log = research.backtest_log(book, bars)
    return research.failure_summary(log, book).select("strategy", "windows", "metrics", "bars")


@query()
def walk_forward(spark, d):
    panel, bars = _bars(spark, d)
    return rounded(research.walk_forward(panel, bars))


@query()
def min_variance_weights(spark, d):
    return rounded(portfolio.min_variance_weights(features.sample_covariance(P(spark, d))))


# ---- research ----

_NEXT = "SELECT bar_idx, corr_z, pnl, [{}] AS nx, stddev_pop(pnl) OVER w * sqrt(252) AS v, count(pnl) OVER w AS n FROM lg WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)".format(", ".join(f"lead(pnl, {i}) OVER (ORDER BY bar_idx)" for i in range(1, 6)))
_CUM = ", ".join(f"exp(list_sum(nx[1:{i}])) AS e{i}" for i in range(1, 6))
_DD = ", ".join(f"e{i} / greatest(1, {', '.join(f'e{j}' for j in range(1, i + 1))}) - 1" for i in range(1, 6))


@query(f"SELECT condition, count(*) AS n, round(avg(f), 6) AS avg_fwd_dd, round(avg(v), 6) AS avg_fwd_vol, round(avg(br), 6) AS breach_rate FROM (SELECT CASE WHEN corr_z > 1.5 THEN 'high' WHEN abs(corr_z) <= 1.5 THEN 'base' END AS condition, v, least(0, {_DD}) AS f, (list_min(nx) < -0.02)::INT AS br FROM (SELECT *, {_CUM} FROM ({_NEXT}) WHERE n = 5)) WHERE condition IS NOT NULL GROUP BY 1")
def leadlag(spark, d):
    return rounded(research.lead_lag(_log(spark, d)))


def _ahead(h: int) -> str:
    """SQL of what the next h bars bring: volatility, fall and mean correlation."""
    w = f"WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    fold = """list_reduce(list_transform(xs, lambda r: {'e': r, 'peak': 0.0::DOUBLE, 'dd': 0.0::DOUBLE}), lambda a, x: {'e': a.e + x.e, 'peak': greatest(a.peak, a.e + x.e), 'dd': least(a.dd, exp(a.e + x.e - greatest(a.peak, a.e + x.e)) - 1)}, {'e': 0.0::DOUBLE, 'peak': -1e9::DOUBLE, 'dd': 0.0::DOUBLE})"""
    return f"""hv{h} AS (SELECT bar_idx, sqrt((q - s * s / m) / (m - 1)) * sqrt(252) AS fwd_vol_{h}, {fold}.dd AS fwd_dd_{h} FROM (
    SELECT bar_idx, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(m) OVER w AS m, list(p) OVER w AS xs, count(*) OVER w AS n FROM (SELECT bar_idx, sum(lr) AS s, sum(lr * lr) AS q, count(lr) AS m, avg(lr) AS p FROM r GROUP BY 1) {w}) WHERE n = {h}),
  hc{h} AS (SELECT bar_idx, avg(c) AS fwd_corr_{h} FROM (SELECT bar_idx, corr(ra, rb) OVER v AS c, count(*) OVER v AS n FROM pairs WHERE a < b WINDOW v AS (PARTITION BY a, b ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) WHERE n = {h} GROUP BY 1)"""


_FWD = [f"fwd_{m}_{h}" for h in (5, 10, 20) for m in ("vol", "dd", "corr")]
_HERO = f"""WITH {", ".join(_ahead(h) for h in (5, 10, 20))},
hero AS (SELECT bar_idx, corr_z, CASE WHEN c <= 0.25 THEN 'low' WHEN c <= 0.5 THEN 'medium_low' WHEN c <= 0.75 THEN 'medium_high' ELSE 'extreme_high' END AS quarter, {", ".join(_FWD)}
  FROM (SELECT bar_idx, corr_z, cume_dist() OVER (ORDER BY corr_z) AS c FROM z) {" ".join(f"LEFT JOIN hv{h} USING (bar_idx) LEFT JOIN hc{h} USING (bar_idx)" for h in (5, 10, 20))})"""


@query(f"{_HERO} SELECT bar_idx, round(corr_z, 4) + 0.0 AS corr_z, quarter, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _FWD)} FROM hero")
def hero_validation(spark, d):
    panel = P(spark, d)
    out = research.hero_validation(panel, features.corr_z_path(panel)).drop("pct")
    return rounded(out.withColumn("corr_z", F.round("corr_z", 4)))


@query(f"{_HERO} SELECT quarter, count(*) AS n, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in _FWD)} FROM hero GROUP BY quarter")
def hero_buckets(spark, d):
    panel = P(spark, d)
    return rounded(research.quarter_means(research.hero_validation(panel, features.corr_z_path(panel))))


@query("SELECT priority, count(*) AS bars, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM lg GROUP BY 1")
def decision_breakdown(spark, d):
    return rounded(research.breakdown(_log(spark, d)))


@query(f"""SELECT regime, bars, CASE WHEN bars >= 5 THEN round(pow(el / ef, 252 / n) - 1, 5) END AS cagr, CASE WHEN bars >= 5 THEN round(s * sqrt(252), 5) END AS ann_vol, CASE WHEN bars >= 5 THEN round(CASE WHEN n >= 5 AND s > 1e-12 THEN sqrt(252) * (mu - {DEFAULT.daily_rf!r}) / s ELSE 0 END, 4) END AS sharpe, CASE WHEN bars >= 5 THEN round(f, 5) END AS max_dd, bars < 30 AS small FROM (
  SELECT regime, count(*) AS bars, count(x) AS n, arg_max(e, bar_idx) AS el, arg_min(e, bar_idx) AS ef, avg(x) AS mu, stddev_samp(x) AS s, min(fall) AS f FROM (SELECT *, e / lag(e) OVER w - 1 AS x, e / max(e) OVER w - 1 AS fall FROM (SELECT regime, bar_idx, exp(sum(pnl) OVER (PARTITION BY regime ORDER BY bar_idx)) AS e FROM lg) WINDOW w AS (PARTITION BY regime ORDER BY bar_idx)) GROUP BY 1)""")
def by_regime_perf(spark, d):
    out = research.by_regime(_log(spark, d))
    return rounded(out.withColumn("sharpe", F.round("sharpe", 4)), 5)


@query("""SELECT rank, bar_idx AS begin_idx, e AS end_idx, round(total, 6) AS total, concat_ws(',', CASE WHEN mode = 'STRESSED' AND total > 0.01 THEN 'false_stress_candidate' END,
  CASE WHEN severe AND before = 'CALM' AND NOT stressy THEN 'late_derisk_candidate' END, CASE WHEN severe THEN 'severe_drawdown_window' END, CASE WHEN breaches >= 3 THEN 'var_breach_cluster' END,
  CASE WHEN list_contains(ps, 'anomaly_suppress') AND total < -0.02 THEN 'anomaly_suppress_stress_persisted' END) AS tags
  FROM (SELECT *, row_number() OVER (ORDER BY total, bar_idx) AS rank, total < -0.03 * sqrt(5) AS severe, len(list_filter(ps, lambda p: p LIKE 'stress%' OR p = 'corr_crisis')) > 0 AS stressy,
    CASE WHEN c >= greatest(s, t) THEN 'CALM' WHEN s >= t THEN 'STRESSED' ELSE 'TRANSITION' END AS mode
  FROM (SELECT bar_idx, sum(pnl) OVER w AS total, count(*) OVER w AS n, max(bar_idx) OVER w AS e, list(priority) OVER w AS ps, sum((var_99 > 0 AND pnl < -var_99)::INT) OVER w AS breaches, lag(regime) OVER (ORDER BY bar_idx) AS before,
    sum((regime = 'CALM')::INT) OVER w AS c, sum((regime = 'STRESSED')::INT) OVER w AS s, sum((regime = 'TRANSITION')::INT) OVER w AS t FROM lg WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5) WHERE rank <= 5""")
def failure_windows(spark, d):
    return rounded(research.failure_windows(_log(spark, d)).withColumn("tags", F.concat_ws(",", "tags")))


@query("SELECT many, count(*) AS n, round(avg(v), 8) AS next_vol FROM (SELECT anomalies >= 3 AS many, stddev_samp(pnl) OVER w AS v, count(pnl) OVER w AS k FROM lg WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE k = 5 GROUP BY 1")
def anomaly_predictive(spark, d):
    return rounded(research.anomaly_predictive(_log(spark, d)), 8)


@query("SELECT count(*) AS transitions, round(avg(mv), 5) AS mean_abs_move FROM (SELECT abs(corr_z - lag(corr_z) OVER (ORDER BY bar_idx)) AS mv, lag(regime) OVER (ORDER BY bar_idx) AS q, regime FROM lg) WHERE q <> regime")
def transition_study(spark, d):
    return rounded(research.transition_study(_log(spark, d), ()), 5)


@query("SELECT round(min(f), 6) AS worst, -0.15::DOUBLE AS assumed, min(f) >= -0.15 AS covered FROM (SELECT e / max(e) OVER (ORDER BY bar_idx) - 1 AS f FROM (SELECT bar_idx, exp(sum(pnl) OVER (ORDER BY bar_idx)) AS e FROM lg))")
def stress_vs_reality(spark, d):
    return rounded(research.stress_vs_reality(_log(spark, d)))


@query("""SELECT fold, 504 + 63 * fold AS train_end, 504 + 63 * fold AS test_begin, 504 + 63 * fold + 62 AS test_end, round(quantile_cont(corr_z, 0.9), 4) AS z_high, round(quantile_cont(corr_z, 0.1), 4) AS z_low FROM z, (SELECT unnest(range(0, ((m - 504 - 63 - 1) // 63 + 1)::BIGINT))::INT AS fold FROM m) WHERE bar_idx <= 504 + 63 * fold GROUP BY fold""")
def wf_thresholds(spark, d):
    return rounded(research.walk_forward_folds(features.corr_z_path(P(spark, d))), 4)


# ---- stress ----


@query(f"SELECT scenario, round(direct, 6) AS direct, round(direct * 0.02 * c, 9) AS correlation_effect, round(0.25 * direct, 6) AS vol_effect FROM (SELECT s.scenario, sum(coalesce(CASE WHEN n.asset = s.asset THEN shock END, 0) / k) AS direct FROM (VALUES {', '.join(f'({x!r}, {a!r}, {v!r}::DOUBLE)' for x, a, v in (('fall', 'AF', -0.2), ('fall', 'NF', -0.1), ('split', 'RF', 0.1), ('split', 'NO', -0.3)))}) s(scenario, asset, shock), (SELECT DISTINCT asset FROM p) n, k GROUP BY 1), (SELECT sum(cov) / (any_value(k) * (any_value(k) - 1) + 1e-9) AS c FROM cov, k WHERE a <> b)")
def scenario_pnl(spark, d):
    panel = P(spark, d)
    shocks = spark.createDataFrame([("fall", "AF", -0.2), ("fall", "NF", -0.1), ("split", "RF", 0.1), ("split", "NO", -0.3)], "scenario string, asset string, shock double")
    out = stress.scenario_pnl(_w(panel), shocks, features.sample_covariance(panel), 1.25)
    return rounded(out.select("scenario", F.round("direct", 6).alias("direct"), F.round("correlation_effect", 9).alias("correlation_effect"), F.round("vol_effect", 6).alias("vol_effect")), 9)


@query("SELECT asset, round(x * -0.1 / sum(x / k) OVER (), 6) AS shock, round(0.01 / sum(x / k) OVER (), 4) AS distance_sq FROM (SELECT a AS asset, sum((cov + CASE WHEN a = b THEN 1e-8 ELSE 0 END) / k) AS x, any_value(k) AS k FROM cov, k GROUP BY 1)")
def reverse_stress(spark, d):
    panel = P(spark, d)
    out = stress.reverse_stress(_w(panel), features.sample_covariance(panel), -0.1)
    return rounded(out.select("asset", "shock", F.round("distance_sq", 4).alias("distance_sq")))


@query()
def reverse_stress_bounded(spark, d):
    """Returns that lose 98.5 %: some assets end at their bounds."""
    panel = P(spark, d)
    return rounded(stress.reverse_stress(_w(panel), features.sample_covariance(panel), -0.985), 5)


@query("SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE 0.6 * rho + 0.4 * 0.85 END, 6) AS rho FROM cov WHERE a <= b")
def crisis_corr_blend(spark, d):
    return rounded(stress.crisis_blend(risk.correlations(P(spark, d)), 0.4))


@query("SELECT bar_idx, field, round(base, 4) + 0.0 AS base, round(shocked, 4) + 0.0 AS shocked FROM (SELECT bar_idx, 'corr_z' AS field, corr_z AS base, corr_z + 0.25 AS shocked FROM bv UNION ALL SELECT bar_idx, 'vol_ann', ann_vol, ann_vol * 1.5 FROM bv)")
def shock_state(spark, d):
    _, bars = _bars(spark, d)
    base = bars.withColumns({"vol_ann": F.col("ann_vol"), "tail": F.lit(1.0)})
    return rounded(stress.difference(base, stress.shocked(base, 1.5, 0.25), ["bar_idx"], ["vol_ann", "corr_z", "tail", "drawdown"]), 4)


@query("SELECT label, min(bar_idx) AS \"begin\", max(bar_idx) AS \"end\", count(*) AS bars FROM (SELECT bucket AS label, bar_idx, bar_idx - row_number() OVER (PARTITION BY bucket ORDER BY bar_idx) AS g FROM z) GROUP BY label, g")
def overlay_islands(spark, d):
    return rounded(stress.islands(features.corr_z_path(P(spark, d)), "bucket"))


@query("SELECT asset, round(x.w, 6) AS now, round(y.w, 6) AS target, round(x.w - y.w, 6) + 0.0 AS drift FROM (SELECT asset, 1 / k AS w FROM (SELECT DISTINCT asset FROM p), k) x JOIN (SELECT asset, w FROM (SELECT bar_idx, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY bar_idx) AS w FROM sd), m WHERE bar_idx = m) y USING (asset)")
def weights_drift(spark, d):
    panel = P(spark, d)
    target = features.last_bars(portfolio.inverse_vol(portfolio.volatilities(panel)), 1).select("panel", "asset", "w")
    return rounded(stress.weights_drift(_w(panel), target))


@query("SELECT bar_idx, asset, round((close / lag(close) OVER (PARTITION BY asset ORDER BY bar_idx) - 1) * 100, 6) AS pct FROM p")
def daily_pct(spark, d):
    return rounded(stress.daily_pct(P(spark, d)))


_ASSETS = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("SELECT a, " + ", ".join(f"round(max(rho) FILTER (b = '{x}'), 6) AS \"{x}\"" for x in _ASSETS) + " FROM cov GROUP BY a")
def correlation_heatmap(spark, d):
    return rounded(stress.correlation_matrix(risk.correlations(P(spark, d)), list(_ASSETS)))


@query("""SELECT bar_idx, layer, severity, asset, round(metric, 5) AS metric, rank FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, metric DESC, asset, layer) AS rank
  FROM kept WHERE bar_idx = (SELECT max(bar_idx) FROM kept)) WHERE rank <= 12""")
def anomaly_feed(spark, d):
    return rounded(stress.feed(_events(P(spark, d))).select("bar_idx", "layer", "severity", "asset", "metric", "rank"), 5)


@query("""SELECT bin, count(*) AS n, round(min(pr), 8) AS low FROM (SELECT pr, least(floor((pr - lo) / ((hi - lo) / 55)), 54)::INT AS bin FROM pr, (SELECT min(pr) AS lo, max(pr) AS hi FROM pr)) GROUP BY bin""")
def return_histogram(spark, d):
    return rounded(stress.histogram(risk.portfolio_of(P(spark, d)), "pr"), 8)


@query("SELECT bar_idx, round(corr_z, 4) + 0.0 AS corr_z, bucket FROM z ORDER BY bar_idx DESC LIMIT 250")
def overlay_tail(spark, d):
    return rounded(stress.tail_rows(features.corr_z_path(P(spark, d)), 250).select("bar_idx", "corr_z", "bucket"), 4)


@query("SELECT bar_idx, round(corr_z, 4) + 0.0 AS corr_z, bucket FROM (SELECT *, row_number() OVER (ORDER BY bar_idx) - 1 AS k, count(*) OVER () AS n FROM z) WHERE k % greatest(1, n // 500) = 0")
def overlay_thinned(spark, d):
    return rounded(stress.downsampled(features.corr_z_path(P(spark, d)), 500).select("bar_idx", "corr_z", "bucket"), 4)


@query(f"SELECT horizon, alpha, round(h.var * 100, 4) AS hs, round(m.var * 100, 4) AS mc FROM ({_QUERIES['hs_var_cvar_grid'][1]}) h JOIN ({_QUERIES['mc_var_analytic'][1]}) m USING (horizon, alpha)")
def var_grid(spark, d):
    panel = P(spark, d)
    made = risk.historical(risk.portfolio_horizons(panel, _w(panel)), ["panel", "horizon"], "x", DEFAULT.var_alphas).select("panel", "horizon", "alpha", "var", F.lit("hs").alias("method"))
    made = made.unionByName(risk.monte_carlo_analytic(panel, _w(panel)).select("panel", "horizon", "alpha", "var", F.lit("mc").alias("method")))
    return rounded(stress.var_grid(made.withColumn("var", F.round("var", 6))), 4)


@query(f"SELECT asset, shock FROM (SELECT asset, shock, row_number() OVER (ORDER BY abs(shock) DESC, asset) AS k FROM ({_QUERIES['reverse_stress'][1]})) WHERE k <= 3")
def reverse_stress_top(spark, d):
    panel = P(spark, d)
    return rounded(stress.largest(stress.reverse_stress(_w(panel), features.sample_covariance(panel), -0.1), "shock", 3).select("asset", "shock"))


@query("SELECT bar_idx, CASE WHEN move > 0.05 THEN 'up' WHEN move < -0.05 THEN 'down' ELSE 'flat' END AS arrow FROM (SELECT bar_idx, corr_z - lag(corr_z) OVER (ORDER BY bar_idx) AS move FROM z)")
def corr_z_arrow(spark, d):
    path = features.corr_z_path(P(spark, d))
    return path.select("bar_idx", stress.arrow(F.col("corr_z") - F.lag("corr_z").over(features.series())).alias("arrow"))


def _rule(z: str, anomalies: str) -> str:
    """SQL of the priority under other inputs."""
    return f"""CASE WHEN regime = 'STRESSED' AND {z} > 1 THEN 'stress_corr_override' WHEN {z} > 1.5 THEN 'corr_crisis' WHEN {anomalies} >= 3 THEN 'anomaly_suppress' WHEN regime = 'STRESSED' THEN 'stressed_regime' WHEN regime = 'TRANSITION' THEN 'transition'
      WHEN var_99 > 0.05 THEN 'var_breach_risk' WHEN {z} < -1 THEN 'diversification_regime' ELSE 'normal' END"""


@query("""SELECT bar_idx, CASE priority WHEN 'stress_corr_override' THEN 'R1_STRESS_HIGH_CORR' WHEN 'corr_crisis' THEN 'R2_CORR_CRISIS_Z' WHEN 'anomaly_suppress' THEN 'R3_ANOMALY_SUPPRESS' WHEN 'stressed_regime' THEN 'R4_STRESSED_REGIME' WHEN 'transition' THEN 'R5_TRANSITION_REGIME'
    WHEN 'var_breach_risk' THEN 'R6_VAR_LIMIT_BREACH' WHEN 'diversification_regime' THEN 'R7_DIVERSIFICATION_REGIME' ELSE 'R8_DEFAULT_NORMAL' END AS rule,
  CASE priority WHEN 'transition' THEN 'TRANSITION_DEFENSIVE' WHEN 'diversification_regime' THEN 'ALLOW_EXPAND_RISK' WHEN 'normal' THEN 'MAINTAIN' ELSE 'REDUCE_RISK' END AS signal,
  concat_ws(',', CASE WHEN regime = 'STRESSED' AND corr_z > 1 THEN 'R1_STRESS_HIGH_CORR' END, CASE WHEN corr_z > 1.5 THEN 'R2_CORR_CRISIS_Z' END, CASE WHEN anomalies >= 3 THEN 'R3_ANOMALY_SUPPRESS' END, CASE WHEN regime = 'STRESSED' THEN 'R4_STRESSED_REGIME' END,
    CASE WHEN regime = 'TRANSITION' THEN 'R5_TRANSITION_REGIME' END, CASE WHEN var_99 > 0.05 THEN 'R6_VAR_LIMIT_BREACH' END, CASE WHEN corr_z < -1 THEN 'R7_DIVERSIFICATION_REGIME' END) AS flags,
  CASE WHEN corr_z > 1.5 THEN 'clustering' WHEN corr_z > 1.5 * 0.7 THEN 'within_crisis_band' ELSE 'typical' END AS correlation, round(greatest(0, least(1, 1 - avg_corr)), 6) AS diversification, exposure::DOUBLE AS multiplier FROM dc""")
def decision_trace(spark, d):
    _, bars = _bars(spark, d)
    out = decide.trace(bars.withColumn("vol_ann", F.col("ann_vol")))
    true = F.array_join(F.map_keys(F.map_filter("trace.flags", lambda _, v: v)), ",")
    spread = F.element_at(F.filter("trace.measures", lambda m: m["name"] == "diversification"), 1)["value"]
    return rounded(out.select("bar_idx", "trace.rule", "trace.signal", true.alias("flags"), "trace.correlation", spread.alias("diversification"), "trace.multiplier"))


@query(f"""WITH cf AS (SELECT bar_idx, 'no_anomalies' AS "case", corr_z, priority AS was, {_rule("corr_z", "0")} AS now FROM dc UNION ALL SELECT bar_idx, 'corr_z_up' AS "case", corr_z + 0.25, priority, {_rule("(corr_z + 0.25)", "anomalies")} FROM dc)
SELECT bar_idx, "case", was AS priority_before, now AS priority_after FROM cf WHERE was <> now""")
def decision_counterfactuals(spark, d):
    """What would have been decided without anomalies, and under a higher correlation stress."""
    _, bars = _bars(spark, d)
    out = decide.counterfactuals(bars, {"no_anomalies": {"anomalies": F.lit(0).cast(dict(bars.dtypes)["anomalies"])}, "corr_z_up": {"corr_z": F.col("corr_z") + 0.25}})
    changed = F.element_at("changes", "priority")
    return out.where(changed.isNotNull()).select("bar_idx", "case", changed["before"].alias("priority_before"), changed["after"].alias("priority_after"))


@query()
def snapshot(spark, d):
    """The last bar's snapshot, as JSON."""
    panel, bars = _bars(spark, d)
    own = bars.withColumn("vol_ann", F.col("ann_vol"))
    near = decide.analogs(bars, ["corr_z", "ann_vol", "drawdown"])
    out = stress.snapshot(own, risk.tail_block(panel, _w(panel)), _w(panel), detect.timeline(bars), near)
    return out.select("panel", F.to_json("snapshot", {"ignoreNullFields": "false"}).alias("snapshot"))


# ---- streams ----


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_daily_events(spark, d):
    return jobs.daily_events(spark, d)


@query("""SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS "begin", strftime(b + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * unnest(range(4)) AS b FROM events) WHERE b + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY b, event_type""")
def stream_sliding(spark, d):
    return jobs.sliding_events(spark, d)


@query("""SELECT user_id, strftime(lo, '%Y-%m-%d %H:%M:%S') AS "begin", strftime(hi + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", n FROM (SELECT user_id, g, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT, 0) AS fresh FROM events)) GROUP BY 1, 2)
  WHERE hi + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    return jobs.event_sessions(spark, d)


_RULE = "CASE WHEN avg_corr > 0.55 THEN 'STRESSED' WHEN avg_corr > 0.4 OR ann_vol > 0.25 OR drawdown < -0.08 THEN 'TRANSITION' ELSE 'CALM' END"


@query(f"""WITH rr AS (SELECT bar_idx, {_RULE} AS regime FROM z JOIN mv USING (bar_idx) JOIN pd USING (bar_idx)),
re AS (SELECT bar_idx, regime, lag(regime) OVER (ORDER BY bar_idx) AS q, row_number() OVER (ORDER BY bar_idx) - row_number() OVER (PARTITION BY regime ORDER BY bar_idx) AS g FROM rr),
rd AS (SELECT bar_idx, regime, CASE WHEN q IS NULL THEN 'init' WHEN q = regime THEN 'no_change' ELSE 'changed' END AS event, row_number() OVER (PARTITION BY regime, g ORDER BY bar_idx) AS duration FROM re),
b30 AS (SELECT bar_idx, breach, sum(breach) OVER (ORDER BY bar_idx ROWS 29 PRECEDING)::BIGINT AS breaches_30, var FROM br)
SELECT pd.bar_date::VARCHAR AS bar_date, bar_idx, round(value, 6) AS value, round(pd.drawdown, 6) + 0.0 AS drawdown, round(ann_vol, 6) AS ann_vol, round(avg_corr, 6) AS avg_corr, round(corr_z, 4) + 0.0 AS corr_z, bucket, round(var, 6) AS var_99, breach, breaches_30,
  regime, event, duration, least(row_number() OVER (ORDER BY bar_idx), 2000)::INT AS history, 0::BIGINT AS late
FROM pd LEFT JOIN mv USING (bar_idx) LEFT JOIN z USING (bar_idx) LEFT JOIN b30 USING (bar_idx) LEFT JOIN rd USING (bar_idx)""")
def live_cycle(spark, d):
    """A panel replayed in micro-batches through capped state equals the batch, bar by bar."""
    out = jobs.replayed_cycle(spark, P(spark, d)).rows
    return rounded(out.withColumn("corr_z", F.round("corr_z", 4)))


@query()
def stream_cusum(spark, d):
    return jobs.cusum_alarms(spark, d)
