"""Keyed streams in event-time order: shuffled arrival within the delay changes nothing, later rows are counted apart."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from tidewater.session import settle, shared_folder
from tidewater.streaming import stateful, streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, close double"


def stream(spark, files):
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)


def test_order_of_arrival_and_late_rows(spark):
    r = random.Random(5)
    rows = [(s, START + dt.timedelta(minutes=i), float(r.randrange(100)) if r.random() > 0.1 else None) for s in ("a", "b") for i in range(60)]
    came = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.random() * 10))
    again = [("a", START + dt.timedelta(minutes=3), 1.0), ("a", START + dt.timedelta(minutes=70), 2.0)]
    files = [came[:30], came[30:80], came[80:], again]
    seen = {}

    def step(state, x):
        n = state[0] + len(x)
        return (n,), [(float(n), float(v)) for (v,) in x]

    got = streams.run_once(stateful.in_event_order(stream(spark, files), "symbol", ["close"], 600, step, (0,), "n double, close double", "n long"), "order").collect()
    for x in sorted(got, key=lambda x: x.ts):
        if not x.late:
            seen.setdefault(x.symbol, []).append((x.ts, x.n))
    assert [(x.symbol, x.ts) for x in got if x.late] == [("a", START + dt.timedelta(minutes=3))]
    assert seen["a"] == [(START + dt.timedelta(minutes=i), i + 1) for i in range(60)]
    assert seen["b"] == [(START + dt.timedelta(minutes=i), i + 1) for i in range(50)]


def test_warm_start_goes_on_from_history(spark):
    bars = [("a", START + dt.timedelta(hours=i), float(i * i % 17)) for i in range(40)] + [("new", START + dt.timedelta(hours=30), 5.0)]
    history = spark.createDataFrame([b for b in bars if b[1] < START + dt.timedelta(hours=25)], SCHEMA).repartition(4)
    live = [b for b in bars if b[1] >= START + dt.timedelta(hours=25)]
    first = settle(stateful.last_bars_state(history, 7), "state")
    late = ("a", START + dt.timedelta(hours=20), 99.0)
    out = streams.run_once(stateful.last_bars(stream(spark, [live[:4] + [late], live[4:]]), 7, initial=first), "warm").collect()
    got = {(x.symbol, x.ts): (x.held, x.mean_close) for x in out if not x.late}
    for s in ("a", "new"):
        mine = [b for b in bars if b[0] == s]
        for i, b in enumerate(mine):
            if b in live:
                w = [x[2] for x in mine[max(0, i - 6):i + 1]]
                assert got[s, b[1]] == (len(w), sum(w) / len(w))
    assert [x.ts for x in out if x.late] == [late[1]]


def test_running_metrics_fold_rows_of_one_time(spark):
    rows = [("a", START + dt.timedelta(days=d), p) for d, p in ((0, 10.0), (0, -4.0), (1, -20.0), (2, 5.0), (2, 5.0))]
    out = streams.run_once(stateful.running_metrics(stream(spark, [rows[:2], rows[2:]]).withColumnRenamed("close", "pnl"), capital=100.0), "metrics").orderBy("ts").collect()
    assert [(x.trades, x.pnl) for x in out] == [(2, 6.0), (3, -14.0), (5, -4.0)]
    assert abs(out[-1].max_drawdown - (86 / 106 - 1)) < 1e-12 and out[0].max_drawdown == 0
