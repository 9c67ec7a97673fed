"""Queries: streams replayed from landed files; results equal the batch answer on closed windows."""

import uuid

from pyspark.sql import functions as F

from tidewater.catalog.features import uni
from tidewater.catalog.indicators import DI, MACD, MACD_REC, WILDER
from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, ema_step, lag, recurrence, roll, rows
from tidewater.functions.scalars import uniform
from tidewater.operators import risk
from tidewater.session import settle, shared_folder
from tidewater.streaming import stateful, streams

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"


FILES, DELAY = 4, 6 * 3600


def landed(t, df, name="landed", parts=3, by="ts"):
    """Write ``df`` in time spans of equal length, FILES files each, and open them as a stream that takes one span at a time."""
    path = f"{shared_folder(t.spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.unix_micros(F.min(by)), F.unix_micros(F.max(by))).first()
    span = F.least(F.floor((F.unix_micros(by) - lo) * parts / max(hi - lo, 1)), F.lit(parts - 1))
    for i in range(parts):
        df.where(span == i).repartition(FILES).write.mode("append").parquet(path)
    return streams.read_stream(t.spark, path, df.schema, files_per_batch=FILES)


def arriving(t, df, name="arriving", parts=5):
    """``df`` as a stream whose rows arrive up to DELAY seconds after their time, in any order."""
    late = uniform(F.unix_micros("ts"), "symbol", F.lit(21)) * DELAY * 1e6
    return landed(t, df.withColumn("arrived", F.timestamp_micros((F.unix_micros("ts") + late).cast("long"))), name, parts, "arrived")


def passed(sql):
    """Rows of ``sql`` that every watermark of its symbol has passed."""
    return f"SELECT * FROM ({sql}) q WHERE ts <= (SELECT max(ts) FROM bars b WHERE b.symbol = q.symbol) - INTERVAL {DELAY} SECOND"


def tick_stream(t):
    return landed(t, t.ticks)


def bar_stream(t):
    return landed(t, t.bars_kept.select("symbol", "ts", "open", "high", "low", "close", "volume"))


def late_bars(t):
    return arriving(t, t.bars_kept.select("symbol", "ts", "open", "high", "low", "close", "volume"))


@query("st01_landed_ticks", "trade_id:i symbol ts:t price:d amount:d", "SELECT * FROM ticks")
def _(t):
    return streams.run_once(tick_stream(t), "ticks")


ROUTED = "CASE event_id % 5 WHEN 0 THEN 'trade' WHEN 1 THEN 'kline' WHEN 2 THEN 'bookTicker' WHEN 3 THEN 'depth' ELSE 'unknown' END"


def messages(t):
    i = F.col("event_id") % 5
    kind = F.when(i == 0, "btcusdt@trade").when(i == 1, "btcusdt@kline_1h").when(i == 2, "btcusdt@bookTicker").when(i == 3, "btcusdt@depth20").otherwise("other")
    return t.events.select("event_id", "ts", F.to_json(F.struct(kind.alias("stream"), "value")).alias("body"))


@query("st02_routing", "event_id:i msg_type", f"SELECT event_id, {ROUTED} AS msg_type FROM events")
def _(t):
    return streams.run_once(streams.route(landed(t, messages(t))).select("event_id", "msg_type"), "routed")


@query("st03_fan_out", "consumer rows:i", f"SELECT 'trades' AS consumer, count(*) AS rows FROM events WHERE {ROUTED} = 'trade' UNION ALL SELECT 'books', count(*) FROM events WHERE {ROUTED} IN ('depth', 'bookTicker')")
def _(t):
    s = streams.route(landed(t, messages(t)))
    a, b = streams.AppendTable(t.spark, s.schema), streams.AppendTable(t.spark, s.schema)
    streams.run_batches(s, "fan", streams.fan_out(
        lambda df, n: a(df.where("msg_type = 'trade'"), n), lambda df, n: b(df.where("msg_type IN ('depth', 'bookTicker')"), n)))
    count = lambda x, n: x.table().agg(F.count(F.lit(1)).alias("rows")).withColumn("consumer", F.lit(n))
    return count(a, "trades").unionByName(count(b, "books"))


@query("st04_dedupe", "trade_id:i symbol price:d", "SELECT trade_id, symbol, price FROM ticks")
def _(t):
    twice = t.ticks.unionByName(t.ticks.where("trade_id % 3 = 0"))
    return streams.run_once(streams.dedupe(landed(t, twice), ["trade_id"]), "deduped")


@query("st05_tumbling_bars", "symbol ts:t open:d high:d low:d close:d volume:d", f"SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
def _(t):
    return streams.run_once(streams.tumbling_bars(tick_stream(t)), "bars")


@query("st06_sliding_state", "symbol ts:t last:d high:d low:d volume:d trades:i change:d",
       f"""SELECT symbol, w + INTERVAL 24 HOUR AS ts, arg_max(price, ts) AS last, max(price) AS high, min(price) AS low, sum(amount) AS volume, count(*) AS trades, arg_max(price, ts) / arg_min(price, ts) - 1 AS change
       FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM ticks) WHERE w + INTERVAL 24 HOUR <= {CLOSED} GROUP BY symbol, w""")
def _(t):
    return streams.run_once(streams.sliding_state(tick_stream(t)), "state")


@query("st07_sessions", "symbol start_ts:t trades:i volume:d",
       f"""SELECT symbol, min(ts) AS start_ts, count(*) AS trades, sum(amount) AS volume FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER ({P}) AS s
       FROM (SELECT *, ts - {lag('ts')} AS gap FROM ticks)) GROUP BY symbol, s HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def _(t):
    return streams.run_once(streams.sessions(tick_stream(t)), "sessions").withColumnRenamed("start", "start_ts")


LAST50 = f"SELECT symbol, ts, count(*) OVER {rows(50)} AS held, avg(close) OVER {rows(50)} AS mean_close FROM bars"


@query("st08_last_bars", "symbol ts:t held:i mean_close:d late", f"SELECT *, false AS late FROM ({passed(LAST50)})")
def _(t):
    return streams.run_once(stateful.last_bars(late_bars(t), delay_seconds=DELAY), "history")


A10, A20 = 2 / 11, 2 / 21
EMAS = f"""{recurrence(f"SELECT *, {roll('avg', 'close', 10)} AS m10, {roll('avg', 'close', 20)} AS m20 FROM bars",
    {'f': ('n.m10', ema_step('n.close', 'f', A10)), 's': ('0', f"CASE WHEN n.pos = 19 THEN n.m20 ELSE {ema_step('n.close', 's', A20)} END")}, start=9)}"""
CROSS = f"SELECT symbol, ts, pos, f, s, lag(f) OVER ({P}) AS pf, lag(s) OVER ({P}) AS ps FROM rec"


@query("st09_incremental_indicators", "symbol ts:t fast_ema:d slow_ema:d",
       f"WITH RECURSIVE {EMAS} {passed('SELECT b.symbol, b.ts, rec.f AS fast_ema, CASE WHEN rec.pos >= 19 THEN rec.s END AS slow_ema FROM bars b LEFT JOIN rec ON rec.symbol = b.symbol AND rec.ts = b.ts')}")
def _(t):
    return streams.run_once(stateful.incremental_indicators(late_bars(t), delay_seconds=DELAY), "indicators")


RSI_SQL = """SELECT b.symbol, b.ts, CASE WHEN b.rn <= 14 THEN 50.0 WHEN rec.al = 0 THEN 100.0 ELSE 100 - 100 / (1 + rec.ag / nullif(rec.al, 0)) END AS rsi
       FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) b LEFT JOIN rec ON b.symbol = rec.symbol AND b.ts = rec.ts"""


@query("st09_incremental_rsi", "symbol ts:t rsi:d", f"{WILDER} {passed(RSI_SQL)}")
def _(t):
    return streams.run_once(stateful.incremental_indicators(late_bars(t), delay_seconds=DELAY), "indicators")


@query("st09_incremental_macd", "symbol ts:t macd:d macd_signal:d macd_histogram:d", f"WITH RECURSIVE {MACD_REC} {passed(MACD)}")
def _(t):
    return streams.run_once(stateful.incremental_trend(late_bars(t), delay_seconds=DELAY), "trend")


@query("st09_incremental_adx", "symbol ts:t plus_di:d minus_di:d adx:d",
       passed(f"SELECT symbol, ts, p AS plus_di, m AS minus_di, {roll('avg', 'dx', 14)} AS adx FROM (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM ({DI}))"))
def _(t):
    return streams.run_once(stateful.incremental_trend(late_bars(t), delay_seconds=DELAY), "trend")


SIG = f"""WITH RECURSIVE {EMAS}, c AS ({CROSS}) SELECT c.symbol, c.ts, b.close, CASE WHEN pos > 19 AND volume >= 10 AND pf <= ps AND f > s THEN 'buy' WHEN pos > 19 AND volume >= 10 AND pf >= ps AND f < s THEN 'sell' END AS signal
    FROM c JOIN bars b ON b.symbol = c.symbol AND b.ts = c.ts"""


@query("st10_stream_signals", "symbol ts:t signal", passed(f"SELECT symbol, ts, signal FROM ({SIG}) WHERE signal IS NOT NULL"))
def _(t):
    s = stateful.stream_signals(stateful.incremental_indicators(late_bars(t), delay_seconds=DELAY))
    return streams.run_once(s.where("signal IS NOT NULL"), "signals")


FALL = 0.002


POSITIONS = f"""WITH RECURSIVE k AS (SELECT symbol, ts, close, signal, row_number() OVER ({P}) AS rn FROM ({SIG})),
       w(symbol, rn, ts, kind, price, cash, qty, entry, pnl, equity, peak, under, alert) AS (SELECT symbol, 0::BIGINT, NULL::TIMESTAMP, NULL::VARCHAR, 0.0::DOUBLE, 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, 10000.0::DOUBLE, 10000.0::DOUBLE, false, false FROM (SELECT DISTINCT symbol FROM k) UNION ALL
       SELECT symbol, rn, ts, kind, close, cash, qty, entry, pnl, cash + qty * close, greatest(peak, cash + qty * close), cash + qty * close < greatest(peak, cash + qty * close) * (1 - {FALL}::DOUBLE), cash + qty * close < greatest(peak, cash + qty * close) * (1 - {FALL}::DOUBLE) AND NOT under FROM
       (SELECT k.symbol, k.rn, k.ts, k.close, w.peak, w.under, CASE WHEN signal = 'buy' AND qty = 0 THEN 'open' WHEN signal = 'sell' AND qty > 0 THEN 'close' END AS kind,
       CASE WHEN signal = 'buy' AND qty = 0 THEN cash - cash * 0.1::DOUBLE / close * close WHEN signal = 'sell' AND qty > 0 THEN cash + qty * close ELSE cash END AS cash,
       CASE WHEN signal = 'buy' AND qty = 0 THEN cash * 0.1::DOUBLE / close WHEN signal = 'sell' AND qty > 0 THEN 0 ELSE qty END AS qty, CASE WHEN signal = 'buy' AND qty = 0 THEN close ELSE entry END AS entry,
       CASE WHEN signal = 'sell' AND qty > 0 THEN qty * (close - entry) END AS pnl FROM w JOIN k ON k.symbol = w.symbol AND k.rn = w.rn + 1))
       SELECT symbol, ts, kind AS event, price, pnl, equity FROM w WHERE kind IS NOT NULL UNION ALL SELECT symbol, ts, 'alert', price, NULL, equity FROM w WHERE alert"""


@query("st11_positions", "symbol ts:t event price:d pnl:d equity:d", POSITIONS)
def _(t):
    """Positions from crosses, and an alert each time equity falls below the allowed drawdown."""
    s = stateful.stream_signals(stateful.incremental_indicators(bar_stream(t)))
    signals = streams.run_once(s.select("symbol", "ts", "close", "signal"), "signals")
    return streams.run_once(stateful.positions(landed(t, signals), max_drawdown=FALL), "positions")


@query("st12_running_metrics", "symbol ts:t trades:i win_rate:d pnl:d4 max_drawdown:d",
       """WITH d AS (SELECT symbol, exit_time AS ts, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS w, sum(pnl) AS p FROM closed_trades GROUP BY 1, 2),
       c AS (SELECT symbol, ts, sum(n) OVER o AS trades, sum(w) OVER o / sum(n) OVER o AS win_rate, sum(p) OVER o AS pnl FROM d WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
       e AS (SELECT *, greatest(1e8::DOUBLE, max(1e8::DOUBLE + pnl) OVER (PARTITION BY symbol ORDER BY ts)) AS peak FROM c)
       SELECT symbol, ts, trades, win_rate, pnl, least(0, min((1e8::DOUBLE + pnl) / peak - 1) OVER (PARTITION BY symbol ORDER BY ts)) AS max_drawdown FROM e""")
def _(t):
    trades = settle(t.closed_trades.select("symbol", "pnl", F.col("exit_time").alias("ts")), "closed")  # landing reads it once per span
    return streams.run_once(stateful.running_metrics(landed(t, trades), capital=1e8), "metrics")


@query("st13_latency_monitor", "symbol late:i mean_latency:d3",
       f"""SELECT symbol, count(*) AS late, avg(lag) AS mean_latency FROM (SELECT symbol, floor({uni('epoch_us(ts)', 'symbol', 21)} * {DELAY} * 1e6::DOUBLE) / 1e6::DOUBLE AS lag FROM ticks) WHERE lag > 10800 GROUP BY symbol""")
def _(t):
    """Messages that arrived more than three hours after their time."""
    late = streams.run_once(streams.late_arrivals(arriving(t, t.ticks), 3 * 3600, "arrived"), "late")
    return late.groupBy("symbol").agg(F.count(F.lit(1)).alias("late"), F.avg("latency_seconds").alias("mean_latency"))


@query("st14_late_data_policy", "symbol ts:t trades:i",
       f"SELECT symbol, ts, trades FROM bars WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
def _(t):
    """A second copy of the first days arrives after the watermark has passed and is dropped."""
    return streams.run_once(streams.tumbling_bars(resent(t)), "bars")


def resent(t):
    """Ticks in order, then the first five days again."""
    again = t.ticks.where(F.dayofmonth("ts") <= 5)
    first = t.ticks.withColumn("arrived", F.col("ts"))
    return landed(t, first.unionByName(again.withColumn("arrived", F.col("ts") + F.expr("interval 60 days"))), "resent", 8, "arrived")


@query("st14_late_counts", "symbol in_time:i late:i",
       """SELECT symbol, count(*) FILTER (WHERE ts <= m - INTERVAL 1 HOUR) AS in_time, count(*) FILTER (WHERE dayofmonth(ts) <= 5) AS late FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM ticks) GROUP BY symbol""")
def _(t):
    """Late rows go to a sink of their own and are counted there."""
    rows = stateful.in_event_order(resent(t), "symbol", ["price"], 3600, lambda state, x: (state, [(float(v[0]),) for v in x]), (0,), "price double", "none long")
    kept, late = streams.AppendTable(t.spark, rows.schema), streams.AppendTable(t.spark, rows.schema)
    streams.run_batches(rows, "late", streams.fan_out(lambda df, n: kept(df.where("NOT late"), n), lambda df, n: late(df.where("late"), n)))
    count = lambda x, name: x.table().groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    return count(kept, "in_time").join(count(late, "late"), "symbol", "left")


CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("st15_warm_start", "symbol ts:t held:i mean_close:d late", f"SELECT *, false AS late FROM ({passed(LAST50)}) WHERE ts >= {CUT}")
def _(t):
    """History (several files, any order) becomes the state the live bars start from."""
    bars = t.bars_kept.select("symbol", "ts", "close")
    path = f"{shared_folder(t.spark)}/tidewater/history-{uuid.uuid4().hex}"
    bars.where(f"ts < {CUT}").repartition(5).write.parquet(path)
    start = settle(stateful.last_bars_state(t.spark.read.schema(bars.schema).parquet(path)), "warm")
    return streams.run_once(stateful.last_bars(arriving(t, bars.where(f"ts >= {CUT}")), delay_seconds=DELAY, initial=start), "warm")


@query("st16_stream_static_join", "trade_id:i symbol over_limit", "SELECT trade_id, t.symbol, amount > l AS over_limit FROM ticks t LEFT JOIN (SELECT symbol, avg(amount) AS l FROM ticks GROUP BY symbol) d ON d.symbol = t.symbol")
def _(t):
    limits = settle(t.ticks.groupBy("symbol").agg(F.avg("amount").alias("limit")), "limits")
    s = streams.with_limits(tick_stream(t), limits).withColumn("over_limit", F.col("amount") > F.col("limit"))
    return streams.run_once(s, "checked")


@query("st17_stream_stream_join", "trade_id:i book_id:i symbol", "SELECT t.trade_id, b.trade_id AS book_id, t.symbol FROM ticks t JOIN ticks b ON b.symbol = t.symbol AND t.ts BETWEEN b.ts AND b.ts + INTERVAL 600 SECOND")
def _(t):
    books = t.ticks.select(F.col("trade_id").alias("book_id"), "symbol", "ts")
    near = streams.nearest_books(tick_stream(t).select("trade_id", "symbol", "ts"), landed(t, books, "books"), 600)
    return streams.run_once(near.select("trade_id", "book_id", "symbol"), "near")


@query("st18_metric_history", "symbol ts:t close:d", "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 100")
def _(t):
    s = bar_stream(t).select("symbol", "ts", "close")
    history = streams.LatestTable(t.spark, ["symbol"], "ts", s.schema, keep=100)
    streams.run_batches(s, "history", history)
    return history.table()


@query("st18_stream_alerts", "symbol ts:t metric value:d", "SELECT symbol, ts, 'range' AS metric, high - low AS value FROM bars WHERE high - low > 40 UNION ALL SELECT symbol, ts, 'volume', volume FROM bars WHERE volume > 30")
def _(t):
    s = bar_stream(t).select("symbol", "ts", (F.col("high") - F.col("low")).alias("range"), "volume")
    keyed = s.withColumn("id", F.struct("symbol", "ts"))
    a = risk.alerts(keyed, "id", {"range": 40.0, "volume": 30.0}).select("id.symbol", "id.ts", "metric", "value")
    return streams.run_once(a, "alerts")


@query("st20_chunked_backtest", "symbol ts:t event price:d pnl:d equity:d", POSITIONS)
def _(t):
    """Ten days at a time, stopped and taken up again after each chunk; the same events as in one run."""
    bars = t.bars_kept.select("symbol", "ts", "close", "volume")
    path = f"{shared_folder(t.spark)}/tidewater/backtest-{uuid.uuid4().hex}"
    last = bars.agg(F.max(F.floor(F.unix_seconds("ts") / 864_000))).first()[0]
    first = bars.agg(F.min(F.floor(F.unix_seconds("ts") / 864_000))).first()[0]
    for chunk in range(first, last + 1):
        bars.where(F.floor(F.unix_seconds("ts") / 864_000) == chunk).write.mode("append").parquet(f"{path}/chunks")
        out = stateful.chunked_backtest(t.spark, f"{path}/chunks", bars.schema, path, FALL)
    return out


@query("st21_latest_value", "symbol ts:t close:d", "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY symbol")
def _(t):
    s = bar_stream(t).select("symbol", "ts", "close")
    latest = streams.LatestTable(t.spark, ["symbol"], "ts", s.schema)
    streams.run_batches(s, "latest", latest)
    return latest.table()
