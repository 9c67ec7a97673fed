"""First-touch searches over block trees against plain loops, with chunks of a few rows so that searches cross many."""

import datetime as dt
import random

import numpy as np
import pytest

from tidewater.operators import trades
from tidewater.plans import firsttouch as ft

START = dt.datetime(2024, 1, 1)


def make(seed=1, n=80, symbols=("A", "B", None)):
    r = random.Random(seed)
    bars, entries = [], []
    for s in symbols:
        p, minute = 100.0, 0
        for _ in range(n):
            minute += r.choice([5, 5, 5, 60, 600])
            p = round(p * (1 + r.uniform(-0.02, 0.02)), 1)
            close = None if r.random() < 0.03 else p
            ts = START + dt.timedelta(minutes=minute)
            bars.append((s, ts, p + r.choice([0.0, 1.0]), p - r.choice([0.0, 1.0]), close, r.uniform(0.5, 2.0)))
            for _ in range(r.choice([0, 1, 1, 2])):
                side, k = r.choice([("long", 1), ("short", -1)])
                stop = None if r.random() < 0.05 else round(p * (1 - k * r.choice([0.01, 0.05, 0.2])), 1)
                entries.append((len(entries), s, ts + dt.timedelta(minutes=r.choice([0, 0, 2])), side, p, stop, round(p * (1 + k * r.choice([0.02, 0.1, 0.3])), 1)))
    entries += [(len(entries), "none", START, "long", 1.0, 0.5, 2.0), (len(entries) + 1, "A", None, "long", 1.0, 0.5, 2.0), (len(entries) + 2, "A", START + dt.timedelta(days=4000), "long", 1.0, 0.5, 2.0)]
    return bars, entries


def frames(spark, seed=1):
    bars, entries = make(seed)
    return bars, entries, (spark.createDataFrame(entries, "id long, symbol string, entry_ts timestamp, side string, entry_price double, stop double, target double").repartition(3),
                           spark.createDataFrame(bars, "symbol string, ts timestamp, high double, low double, close double, atr double").repartition(3))


def loop(bars, entries, seconds, rule):
    """{id: (exit ts, close, reason)}; ``rule(entry)`` gives a function of bar that returns a reason or None."""
    out = {}
    for e in entries:
        id_, symbol, entry = e[:3]
        if symbol is None or entry is None:
            continue
        judge, last = rule(e), None
        for b in sorted((b for b in bars if b[0] == symbol and entry < b[1] <= entry + dt.timedelta(seconds=seconds)), key=lambda b: b[1]):
            last, why = b, judge(b)
            if why:
                out[id_] = (b[1], b[4], why)
                break
        else:
            if last:
                out[id_] = (last[1], last[4], "horizon")
    return out


def fixed(e, intrabar=False):
    k, stop, target = (1 if e[3] == "long" else -1), e[5], e[6]

    def judge(b):
        high, low = (b[2], b[3]) if intrabar else (b[4], b[4])
        if high is None:
            return None
        worst, best = (low, high) if k > 0 else (high, low)
        return "stop" if stop is not None and k * worst <= k * stop else "target" if k * best >= k * target else None

    return judge


def trailing(e, gap):
    k, level = (1 if e[3] == "long" else -1), None if e[5] is None else e[5] * (1 if e[3] == "long" else -1)

    def judge(b):
        nonlocal level
        if b[4] is None:
            return None
        hit = level is not None and k * b[4] <= level
        up = k * b[4] - gap(b)
        level = up if level is None else max(level, up)
        return "stop" if hit else None

    return judge


def break_even(e):
    k, stop, target, price = (1 if e[3] == "long" else -1), e[5], e[6], e[4]
    level = stop

    def judge(b):
        nonlocal level
        if b[4] is None:
            return None
        if level is not None and k * b[4] <= k * level:
            return "stop"
        if k * b[4] >= k * target:
            return "target"
        if stop is not None and abs(b[4] - target) < 0.5 * abs(price - stop):
            level = k * max(k * price, k * stop)
        return None

    return judge


def answers(df):
    return {r.id: (r.exit_ts, r.exit_price, r.reason) for r in df.collect()}


@pytest.mark.parametrize("seconds, intrabar", [(3_600, False), (400_000, True), (40_000_000, False)])
def test_fixed_levels(spark, small_chunks, seconds, intrabar):
    bars, entries, (e, b) = frames(spark)
    assert answers(trades.exits(e, b, seconds, ["id"], intrabar=intrabar)) == loop(bars, entries, seconds, lambda x: fixed(x, intrabar))


@pytest.mark.parametrize("how", ["distance", "atr"])
def test_trailing_levels(spark, small_chunks, how):
    bars, entries, (e, b) = frames(spark, 2)
    kind, gap = ({"distance": 0.05}, lambda x: x[4] * 0.05) if how == "distance" else ({"atr_multiple": 2.0}, lambda x: 2.0 * x[5])
    assert answers(trades.trailing_exits(e, b, 3_000_000, ["id"], **kind)) == loop(bars, entries, 3_000_000, lambda x: trailing(x, gap))


def test_break_even(spark, small_chunks):
    bars, entries, (e, b) = frames(spark, 3)
    e = e.where("stop IS NOT NULL")
    assert answers(trades.break_even_exits(e, b, 900_000, ["id"])) == loop(bars, [x for x in entries if x[5] is not None], 900_000, break_even)


def test_one_chunk_and_no_rows(spark):
    bars, entries, (e, b) = frames(spark, 4)
    assert answers(trades.exits(e, b, 400_000, ["id"])) == loop(bars, entries, 400_000, fixed)
    assert trades.exits(e.limit(0), b, 60, ["id"]).count() == 0
    assert trades.exits(e, b.limit(0), 60, ["id"]).count() == 0


def test_rows_follow_the_entries_not_the_horizon(spark, small_chunks):
    _, _, (e, b) = frames(spark)
    met = ft.first_met(trades._asked(e, 40_000_000, ["id"], trades.F.lit(-1.0), trades.F.lit(-1e9)), trades._steps(b, trades.F.col("close"), -trades.F.col("close")), "symbol", 10 ** 12)
    assert met.count() == e.where("symbol IN ('A', 'B') AND entry_ts IS NOT NULL").count()
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in met._jdf.queryExecution().toString()


def test_tree_search_is_a_scan():
    r = np.random.default_rng(6)
    for n in (1, 2, 7, 64, 100):
        a, b, top = r.integers(0, 40, n).astype(float), r.integers(0, 40, n).astype(float), r.integers(-5, 12, n).astype(float)
        rows = ft.Level(np.arange(n), a, b, top, top - 1, np.zeros(n, bool), np.zeros(n, bool))
        m = 200
        start, trail = r.integers(0, n + 1, m), r.integers(0, 3, m).astype(np.int32)
        asked = ft.Searches(r.integers(0, 2 * n, m), r.integers(-3, 4, m).astype(float), r.integers(-3, 4, m).astype(float), trail)
        fa, fb = asked.fa.copy(), asked.fb.copy()
        got = ft.search(ft.build(rows), start, asked)
        for i in range(m):
            want = -1
            for j in range(start[i], n):
                if a[j] <= fa[i] or b[j] <= fb[i] or j > asked.until[i]:
                    want = j
                    break
                fa[i] = max(fa[i], top[j]) if trail[i] == 1 else fa[i]
                fb[i] = max(fb[i], top[j] - 1) if trail[i] == 2 else fb[i]
            assert got[i] == want and asked.fa[i] == fa[i] and asked.fb[i] == fb[i]
