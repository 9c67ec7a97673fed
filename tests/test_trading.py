"""Order-dependent rules against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import sweep, trades
from tidewater.operators import risk


def random_trades(n=400, seed=1):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60 * 24, n), unit="h")
    hold = pd.to_timedelta(rng.integers(0, 72, n), unit="h")
    return pd.DataFrame({"trade_id": np.arange(n), "symbol": rng.choice(["A", "A", "A", "B"], n), "entry_time": start, "exit_time": start + hold})


def test_non_overlapping(spark, small_chunks):
    pdf = random_trades()
    got = {r["trade_id"] for r in trades.non_overlapping(spark.createDataFrame(pdf)).collect()}
    want = set()
    for _, g in pdf.sort_values(["entry_time", "exit_time", "trade_id"]).groupby("symbol"):
        busy = None
        for r in g.itertuples():
            if busy is None or r.entry_time >= busy:
                want.add(r.trade_id)
                busy = r.exit_time
    assert got == want


def test_replay(spark):
    rng = np.random.default_rng(3)
    pdf = random_trades(120, 5).rename(columns={"entry_time": "entry_ts", "exit_time": "exit_ts"})
    pdf["run_id"] = rng.choice(["r1", "r2"], len(pdf))
    pdf["side"] = rng.choice(["long", "short"], len(pdf))
    pdf["entry_price"], pdf["exit_price"] = 100.0, rng.normal(100, 5, len(pdf))
    got = trades.replay(spark.createDataFrame(pdf), capital=1000.0, max_positions=2, one_per_symbol=False).toPandas()
    for run, g in pdf.sort_values(["entry_ts", "exit_ts", "trade_id"]).groupby("run_id"):
        cash, book, want = 1000.0, [], []
        for r in g.itertuples():
            for b in [b for b in book if b[0] <= r.entry_ts]:
                book.remove(b)
                cash += b[1]
            if len(book) == 2:
                continue
            value = cash * 0.1
            qty = value / r.entry_price
            cash -= value * 1.0015
            back = qty * r.exit_price
            gain = (back - value) * (1 if r.side == "long" else -1)
            book.append((r.exit_ts, value + gain - back * 0.0015))
            want.append((r.trade_id, gain - back * 0.0015 - value * 0.0015))
        mine = got[got.run_id == run].sort_values(["entry_ts", "exit_ts", "trade_id"])
        assert list(mine.trade_id) == [w[0] for w in want]
        np.testing.assert_allclose(mine.pnl, [w[1] for w in want], rtol=1e-9)
    curve = trades.replay_equity(spark.createDataFrame(got), 1000.0)
    last = curve.groupBy("run_id").agg(F.max_by("equity", "exit_ts").alias("e")).toPandas().set_index("run_id")["e"]
    for run, g in got.groupby("run_id"):
        assert last[run] == pytest.approx(1000.0 + g.pnl.sum(), rel=1e-9)


def test_exits_stop_before_target(spark):
    t0 = dt.datetime(2024, 1, 1)
    bars = [("A", t0 + dt.timedelta(hours=i), c, c, c) for i, c in enumerate([100.0, 101.0, 97.0, 110.0])]
    bars = spark.createDataFrame(bars, "symbol string, ts timestamp, high double, low double, close double")
    e = spark.createDataFrame([("A", t0, "long", 100.0, 98.0, 105.0), ("A", t0, "short", 100.0, 120.0, 97.5)], "symbol string, entry_ts timestamp, side string, entry_price double, stop double, target double")
    got = {r["side"]: r for r in trades.exits(e, bars, 86400, ["symbol", "entry_ts", "side"], at_level=True).collect()}
    assert got["long"]["reason"] == "stop" and got["long"]["exit_price"] == 98.0
    assert got["short"]["reason"] == "target" and got["short"]["exit_price"] == 97.5


def candidates(n=150, seed=9):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "pop": rng.choice(["p", "q"], n), "x": rng.integers(0, 25, n).astype(float), "y": rng.integers(0, 25, n).astype(float)})


def dominates(a, b):
    return a.x <= b.x and a.y <= b.y and (a.x < b.x or a.y < b.y)


def test_pareto_and_ranks(spark, small_chunks):
    pdf = candidates()
    df = spark.createDataFrame(pdf)
    rows = list(pdf.itertuples())
    strict = {b.id for b in rows if not any(a.x > b.x and a.y > b.y for a in rows)}
    weak = {b.id for b in rows if not any(a.x >= b.x and a.y >= b.y and (a.x > b.x or a.y > b.y) for a in rows)}
    assert {r["id"] for r in sweep.pareto_front(df, "id", "x", "y").collect()} == strict
    assert {r["id"] for r in sweep.pareto_front(df, "id", "x", "y", strict=False).collect()} == weak
    got = {r["id"]: r["rank"] for r in sweep.front_ranks(df, "pop", "x", "y").collect()}
    for _, g in pdf.groupby("pop"):
        left, rank = list(g.itertuples()), 0
        while left:
            front = [b for b in left if not any(dominates(a, b) for a in left)]
            for b in front:
                assert got[b.id] == rank
            left = [b for b in left if b not in front]
            rank += 1


def test_diversity(spark, small_chunks):
    pdf = candidates(40)
    got = {r["pop"]: r["diversity"] for r in risk.diversity(spark.createDataFrame(pdf), "pop", "id", ["x", "y"]).collect()}
    for p, g in pdf.groupby("pop"):
        v = g[["x", "y"]].to_numpy()
        d = [np.abs(v[i] - v[j]).mean() for i in range(len(v)) for j in range(i + 1, len(v))]
        assert got[p] == pytest.approx(np.mean(d))
