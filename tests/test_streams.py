"""Streams: ticks against the batch, restarts, late rows, and state that outlives a micro-batch."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_whole import long_panel, moving_together
from tidemark.operators import features, risk
from tidemark.plans.scratch import new_folder
from tidemark.streaming import jobs


def ticks(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows.collect())


@pytest.fixture(scope="module")
def panel(spark):
    one, two = long_panel(spark, moving_together(330, 3)), long_panel(spark, moving_together(170, 4)[::-1]).withColumn("panel", F.lit("q"))
    return one.unionByName(two).cache()


def test_cycle_goes_on_from_its_checkpoint(spark, panel):
    whole = jobs.replayed_cycle(spark, panel, 5)
    assert whole.batches >= 5
    source, store = new_folder(spark, "bars"), new_folder(spark, "cycle")
    rows = panel.select(*jobs.PANEL.names)
    jobs.sliced(rows.where("bar_idx <= 160"), source, "bar_idx", 2)
    first = jobs.risk_cycle(jobs.files_of(spark, source, jobs.PANEL), path=store)
    assert first.rows.count() == 320
    jobs.sliced(rows.where("bar_idx > 160"), source, "bar_idx", 3, first=2)
    again = jobs.risk_cycle(jobs.files_of(spark, source, jobs.PANEL), path=store).rows
    names = [n for n in jobs.TICK.names if n != "bar_date"]
    assert again.count() == 500 and repr(ticks(again, *names)) == repr(ticks(whole.rows, *names))
    # a run with nothing new adds nothing
    assert jobs.risk_cycle(jobs.files_of(spark, source, jobs.PANEL), path=store).rows.count() == 500


def test_ticks_equal_the_batch_operators(spark, panel):
    got = {(r.panel, r.bar_idx): r for r in jobs.replayed_cycle(spark, panel, 4).rows.collect()}
    for r in features.corr_z_path(panel).collect():
        t = got[r.panel, r.bar_idx]
        assert (t.avg_corr, t.corr_z, t.bucket) == (pytest.approx(r.avg_corr), pytest.approx(r.corr_z, abs=1e-6), r.bucket)
    w = features.equal_weights(panel)
    for r in risk.rolling_var(features.portfolio_returns(panel, w)).collect():
        t = got[r.panel, r.bar_idx]
        assert (t.var_99, t.breach) == (pytest.approx(r["var"]), r.breach)


def test_state_is_capped_and_late_bars_are_counted(spark, panel):
    source, store = new_folder(spark, "bars"), new_folder(spark, "cycle")
    rows = panel.where("panel = 'p'").select(*jobs.PANEL.names)
    jobs.sliced(rows.where("bar_idx <= 200"), source, "bar_idx", 2)
    jobs.sliced(rows.where("bar_idx between 150 and 154"), source, "bar_idx", 1, first=2)
    jobs.sliced(rows.where("bar_idx > 200"), source, "bar_idx", 1, first=3)
    out = jobs.risk_cycle(jobs.files_of(spark, source, jobs.PANEL), path=store, most=50).rows
    assert out.count() == 330 and out.agg(F.max("history")).first()[0] == 50
    assert {r.late for r in out.where("bar_idx > 200").collect()} == {5} and {r.late for r in out.where("bar_idx <= 200").collect()} == {0}


def event_stream(spark, slices):
    path = new_folder(spark, "events")
    for i, rows in enumerate(slices):
        jobs.sliced(spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(hours=h), u, "x" if u else "y", v) for k, (h, u, v) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double"), path, "ts", 1, first=i)
    return jobs.files_of(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_late_rows_are_dropped_and_counted(spark):
    stream = event_stream(spark, [[(1, 1, 1.0), (30, 1, 2.0)], [(60, 1, 3.0)], [(2, 1, 9.0), (3, 1, 9.0), (2, 0, 9.0), (61, 1, 4.0)], [(130, 1, 5.0)]])
    run = jobs.run_once(jobs.windowed(stream), "append", "late")
    got = {r.w.start.day: (r.n, r.total) for r in run.rows.collect()}
    assert got == {1: (1, 1.0), 2: (1, 2.0), 3: (2, 7.0)} and run.dropped == 2  # one a key


def test_sessions_and_sliding_windows_across_batches(spark):
    slices = [[(0, 1, 1.0), (1, 2, 1.0)], [(4, 1, 1.0), (8, 1, 1.0)], [(20, 1, 1.0), (21, 2, 1.0)], [(100, 3, 1.0)]]
    got = sorted((r.user_id, r.begin.hour, r.n) for r in jobs.run_once(jobs.sessions(event_stream(spark, slices), "6 hours"), "append", "sessions").rows.collect())
    assert got == [(1, 0, 3), (1, 20, 1), (2, 1, 1), (2, 21, 1)]
    sums = jobs.run_once(jobs.windowed(event_stream(spark, slices), "12 hours", "6 hours"), "append", "sliding").rows
    assert {(r.w.start.day, r.w.start.hour): r.n for r in sums.collect()} == {(31, 18): 3, (1, 0): 4, (1, 6): 1, (1, 12): 2, (1, 18): 2}


@pytest.mark.parametrize("parts", [1, 7])
def test_cusum_state_does_not_depend_on_batches(spark, tmp_path, parts):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(2, 1, 100)])
    spark.createDataFrame([(i, datetime(2024, 1, 1), 1, "ab"[i % 2], float(v)) for i, v in enumerate(x)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: (r.n, r.alarms, r.up, r.down) for r in jobs.cusum_alarms(spark, str(tmp_path), parts=parts).collect()}
    for k, own in (("a", x[0::2]), ("b", x[1::2])):
        up = down = alarms = 0.0
        for n in range(31, len(own) + 1):
            z = (own[n - 1] - own[:n].mean()) / own[:n].std(ddof=1)
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            if up > 4 or down > 4:
                up, down, alarms = 0.0, 0.0, alarms + 1
        assert got[k] == (len(own), alarms, pytest.approx(up, abs=1e-4), pytest.approx(down, abs=1e-4))
