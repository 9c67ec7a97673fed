"""Runs, concurrent positions and sliding drawdowns against plain loops."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import metrics, trades
from tidewater.plans import sliding
from tidewater.plans.runs import runs

START = dt.datetime(2024, 1, 1)


def test_sliding_falls_are_window_falls():
    r = np.random.default_rng(1)
    for size, n in ((1, 1), (5, 7), (40, 1), (40, 7), (41, 13), (200, 30)):
        ret = r.normal(0, 0.05, size)
        ret[r.random(size) < 0.02] = -1.0
        got = sliding.sliding_falls(ret, n)
        for i in range(size):
            if i < n - 1:
                assert np.isnan(got[i])
                continue
            cum, peak, low = 1.0, 0.0, 0.0
            for x in ret[i - n + 1:i + 1]:
                cum *= max(1 + x, 0)
                peak = max(peak, cum)
                low = min(low, cum / peak - 1 if peak else 0.0)
            assert abs(got[i] - low) < 1e-12


def test_rolling_and_period_drawdowns(spark, small_chunks):
    r = random.Random(2)
    rows = [(s, START + dt.timedelta(hours=7 * i), None if r.random() < 0.05 else r.uniform(-0.1, 0.1)) for s in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, ret double")
    got = {(x.series_id, x.window_bars): x.max_drawdown for x in metrics.rolling_drawdowns(df, (3, 10, 100)).collect()}

    def fall(path):
        cum, peak, low = 1.0, 0.0, 0.0
        for x in path:
            cum *= 1 + x
            peak = max(peak, cum)
            low = min(low, cum / peak - 1)
        return low

    for s in ("a", None):
        ret = [x[2] for x in rows if x[0] == s and x[2] is not None]
        for n in (3, 10):
            assert abs(got[s, n] - np.mean([fall(ret[i - n + 1:i + 1]) for i in range(n - 1, len(ret))])) < 1e-12
        assert got[s, 100] is None
    months = {(x.series_id, x.period.month): x.max_drawdown for x in metrics.per_period(df, ("month",)).collect()}
    for (s, m), low in months.items():
        assert abs(low - fall([x[2] for x in rows if x[0] == s and x[1].month == m and x[2] is not None])) < 1e-12


def test_runs_across_slices(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice("xxyz")) for k in ("a", "b", None) for i in range(300)] + [("one", 5, "x")] + [("same", i, "x") for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v string").repartition(4)
    want = set()
    for k in ("a", "b", None, "one", "same"):
        mine = sorted((i, v) for kk, i, v in rows if kk == k)
        start = 0
        for j in range(1, len(mine) + 1):
            if j == len(mine) or mine[j][1] != mine[start][1]:
                want.add((k, mine[start][1], mine[start][0], mine[j - 1][0], j - start))
                start = j
    for width in (1, 4, 1000):
        out = runs(df, "k", ["i"], F.floor(F.col("i") / width), F.struct("v", "i"), lambda a, b: a["v"] != b["v"])
        assert {(x.k, x.first.v, x.first.i, x.last.i, x.n) for x in out.collect()} == want


def test_at_most_n_positions(spark, small_chunks):
    r = random.Random(4)
    rows = [(k, i, START + dt.timedelta(minutes=r.randrange(3000)), r.choice([0, 5, 60, 600, 2500])) for k in ("a", "b", None) for i in range(150)]
    rows = [(k, i, a, a + dt.timedelta(minutes=m)) for k, i, a, m in rows] + [("a", 900, None, START), ("a", 901, START, None)]
    df = spark.createDataFrame(rows, "symbol string, trade_id long, entry_time timestamp, exit_time timestamp")
    for most in (1, 3):
        want = set()
        for k in ("a", "b", None):
            held = []
            for a, z, i in sorted((a, z, i) for kk, i, a, z in rows if kk == k and a and z):
                held = [x for x in held if x > a]
                if len(held) < most:
                    held.append(z)
                    want.add((k, i))
        assert {(x.symbol, x.trade_id) for x in trades.at_most(df, most).collect()} == want
