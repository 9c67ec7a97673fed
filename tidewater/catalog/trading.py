"""Queries: signals, exits, positions, replay."""

from pyspark.sql import functions as F

from tidewater.catalog.indicators import A12, A26, BB, DM, GL, LR, MACD_REC, RSI, RSI14, TR
from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, ema_step, lag, recurrence, roll, rows
from tidewater.operators import indicators as ind
from tidewater.operators import metrics, risk, signals, trades
from tidewater.operators.features import bars_timeline
from tidewater.session import settle
from tidewater.sources.views import TRADE_ORDER_SQL

CROSS = f"SELECT *, {lag('f')} AS pf, {lag('s')} AS ps FROM (SELECT *, {roll('avg', 'close', 10)} AS f, {roll('avg', 'close', 20)} AS s FROM bars)"


@query("t01_ma_cross_signal", "symbol ts:t fast_ma:d slow_ma:d signal",
       f"SELECT symbol, ts, f AS fast_ma, s AS slow_ma, CASE WHEN volume >= 10 AND pf <= ps AND f > s THEN 'buy' WHEN volume >= 10 AND pf >= ps AND f < s THEN 'sell' END AS signal FROM ({CROSS})")
def _(t):
    return signals.MaCross().run(t.bars_kept)


MR = f"""SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'tr', 14)} AS atr,
    {RSI('ag', 'al')} AS rsi FROM (SELECT g.*, {roll('avg', 'g', 14, P.replace('symbol', 'g.symbol').replace(' ts', ' g.ts'))} AS ag, {roll('avg', 'l', 14, P.replace('symbol', 'g.symbol').replace(' ts', ' g.ts'))} AS al, tr
    FROM ({GL}) g JOIN ({TR}) x ON x.symbol = g.symbol AND x.ts = g.ts)"""


def side_sql(k):
    return f"SELECT *, {k} AS th, CASE WHEN close > m + {k} * sd AND rsi > 60 THEN -1 WHEN close < m - {k} * sd AND rsi < 40 THEN 1 ELSE 0 END AS size FROM ({MR})"


@query("t02_mean_reversion_signal", "symbol ts:t action size:d confidence:d stop_loss:d take_profit:d",
       f"""SELECT symbol, ts, CASE size WHEN -1 THEN 'SELL' WHEN 1 THEN 'BUY' ELSE 'HOLD' END AS action, size, CASE WHEN size <> 0 THEN least(abs((close - m) / m) / 1.5, 1.0) ELSE 0 END AS confidence,
       CASE WHEN size <> 0 THEN close * (1 - size * 0.02::DOUBLE) END AS stop_loss, CASE WHEN size <> 0 THEN m END AS take_profit FROM ({side_sql('1.5::DOUBLE')})""")
def _(t):
    return signals.MeanReversion(k=1.5, overbought=60.0, oversold=40.0).run(t.bars_kept)


@query("t03_mean_reversion_atr", "symbol ts:t size:d stop_loss:d take_profit:d position_size:d",
       f"""SELECT symbol, ts, size, close - size * atr * 2 AS stop_loss, m AS take_profit, coalesce(200.0::DOUBLE / nullif(abs(close - (close - size * atr * 2)), 0), 0) AS position_size FROM ({side_sql('1.5::DOUBLE')}) WHERE size <> 0""")
def _(t):
    s = signals.MeanReversion(k=1.5, overbought=60.0, oversold=40.0, atr_stop=2.0).run(t.bars_kept).where("size <> 0")
    return s.withColumn("position_size", signals.stop_risk_size(10_000.0, F.col("close"), F.col("stop_loss")))


@query("t04_trend_following", "symbol ts:t direction:i stop_loss:d",
       f"""WITH RECURSIVE {recurrence('SELECT * FROM bars', {'f': ('n.close', ema_step('n.close', 'f', A12)), 's': ('n.close', ema_step('n.close', 's', A26))})},
       d AS (SELECT symbol, ts, atr, {roll('avg', 'dx', 14)} AS adx FROM (SELECT symbol, ts, atr, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM (SELECT symbol, ts, {roll('avg', 'tr', 14)} AS atr,
       100 * ({roll('sum', 'pdm', 14)}) / nullif({roll('sum', 'tr', 14)}, 0) AS p, 100 * ({roll('sum', 'ndm', 14)}) / nullif({roll('sum', 'tr', 14)}, 0) AS m FROM ({DM})))),
       x AS (SELECT r.*, {lag('f')} AS pf, {lag('s')} AS ps FROM rec r), y AS (SELECT x.symbol, x.ts, b.close, atr, CASE WHEN adx > 20 AND pf <= ps AND f > s THEN 1 WHEN adx > 20 AND pf >= ps AND f < s THEN -1 ELSE 0 END AS direction
       FROM x JOIN d ON d.symbol = x.symbol AND d.ts = x.ts JOIN bars b ON b.symbol = x.symbol AND b.ts = x.ts)
       SELECT symbol, ts, direction, CASE WHEN direction <> 0 THEN close - direction * atr * 2 END AS stop_loss FROM y""")
def _(t):
    return signals.TrendFollowing(adx_min=20.0).run(t.bars_kept)


@query("t05_dynamic_threshold", "symbol ts:t threshold:d action",
       f"SELECT symbol, ts, th AS threshold, CASE size WHEN -1 THEN 'SELL' WHEN 1 THEN 'BUY' ELSE 'HOLD' END AS action FROM ({side_sql('(1.5::DOUBLE * (1 + sd / nullif(m, 0)))')})")
def _(t):
    return signals.MeanReversion(k=1.5, overbought=60.0, oversold=40.0, dynamic=True).run(t.bars_kept)


@query("t06_rsi_macd_signal", "symbol ts:t signal:d",
       f"""WITH RECURSIVE {MACD_REC} SELECT r.symbol, r.ts, sign((CASE WHEN x.rsi < 30 THEN 1 WHEN x.rsi > 70 THEN -1 ELSE 0 END) + sign(r.f - r.s - r.sig)) AS signal
       FROM rec r JOIN (SELECT symbol, ts, {RSI('ag', 'al')} AS rsi FROM ({RSI14})) x ON x.symbol = r.symbol AND x.ts = r.ts""")
def _(t):
    return signals.RsiMacd().run(t.bars_kept)


@query("t07_threshold_orders", "symbol ts:t side signal:d", "SELECT symbol, ts, CASE WHEN pred > 0 THEN 'long' ELSE 'short' END AS side, pred * 5 AS signal FROM scored WHERE abs(pred * 5) >= 0.5")
def _(t):
    return signals.threshold_orders(t.scored.withColumn("signal", F.col("pred") * 5))


@query("t08_position_sizes", "trade_id:i l_partkey:i fixed:d8 by_stop:d by_confidence:d by_volatility:d8",
       """SELECT trade_id, l_partkey, 10000 * 0.02::DOUBLE / entry_price AS fixed, coalesce(200.0::DOUBLE / nullif(abs(entry_price - entry_price * 0.98::DOUBLE), 0), 0) AS by_stop, 10000 * 0.02::DOUBLE * abs(ret) AS by_confidence,
       least(2000.0::DOUBLE / nullif(entry_price * abs(ret), 0), 10.0) AS by_volatility FROM closed_trades""")
def _(t):
    e, r = F.col("entry_price"), F.abs("ret")
    return t.closed_trades.withColumns({
        "fixed": signals.fixed_fraction_size(10_000.0, e), "by_stop": signals.stop_risk_size(10_000.0, e, e * 0.98),
        "by_confidence": signals.confidence_size(10_000.0, r), "by_volatility": signals.volatility_size(10_000.0, e, r)})


@query("t09_strategy_returns", "symbol ts:t strategy_ret:d", "SELECT symbol, ts, sign(pred) * actual AS strategy_ret FROM scored")
def _(t):
    return t.scored.withColumn("strategy_ret", signals.strategy_return(F.col("pred"), F.col("actual")))


@query("t10_trade_costs", "trade_id:i l_partkey:i commission:d8 slippage:d8 net_pnl:d8",
       "SELECT trade_id, l_partkey, abs(entry_price * quantity) * 0.001::DOUBLE AS commission, abs(entry_price * quantity) * 0.0005::DOUBLE AS slippage, pnl - abs(entry_price * quantity) * 0.0015::DOUBLE AS net_pnl FROM closed_trades")
def _(t):
    return metrics.trade_costs(t.closed_trades)


# -- exits: every bar opens a position, long when it closed up --------------------------------
def entries(t, stop=0.05, target=0.08):
    sign = F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0)
    return t.bars_kept.select(
        "symbol", F.col("ts").alias("entry_ts"), F.when(sign > 0, "long").otherwise("short").alias("side"), F.col("close").alias("entry_price"),
        (F.col("close") * (1 - sign * stop)).alias("stop"), (F.col("close") * (1 + sign * target)).alias("target"))


ENTRIES = """SELECT symbol, ts AS entry_ts, CASE WHEN close >= open THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, close AS entry_price FROM bars"""
PATH = f"""SELECT e.*, b.ts, b.high, b.low, b.close, entry_price * (1 - sg * 0.05::DOUBLE) AS stop, entry_price * (1 + sg * 0.08::DOUBLE) AS target
    FROM ({ENTRIES}) e JOIN bars b ON b.symbol = e.symbol AND b.ts > e.entry_ts AND b.ts <= e.entry_ts + INTERVAL 24 HOUR"""


def touch(stopped, reached, px="close", path=PATH):
    return f"""SELECT symbol, entry_ts, coalesce(min(ts) FILTER (WHERE why IS NOT NULL), max(ts)) AS exit_ts, coalesce(arg_min(px, ts) FILTER (WHERE why IS NOT NULL), arg_max(px, ts)) AS exit_price,
    coalesce(arg_min(why, ts) FILTER (WHERE why IS NOT NULL), 'horizon') AS reason FROM (SELECT *, {px} AS px FROM (SELECT *, CASE WHEN {stopped} THEN 'stop' WHEN {reached} THEN 'target' END AS why FROM ({path}))) GROUP BY symbol, entry_ts"""


STOPPED, REACHED = "sg * close <= sg * stop", "sg * close >= sg * target"
ID, DAY = ["symbol", "entry_ts"], 86400
EXIT_SPEC = "symbol entry_ts:t exit_ts:t exit_price:d reason"


@query("t11_first_touch_exit", EXIT_SPEC, touch(STOPPED, REACHED))
def _(t):
    return trades.exits(entries(t), t.bars_kept, DAY, ID)


@query("t11_first_touch_at_level", EXIT_SPEC, touch(STOPPED, REACHED, "CASE why WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE close END"))
def _(t):
    return trades.exits(entries(t), t.bars_kept, DAY, ID, at_level=True)


@query("t12_intrabar_exit", EXIT_SPEC, touch("CASE WHEN sg > 0 THEN low <= stop ELSE high >= stop END", "CASE WHEN sg > 0 THEN high >= target ELSE low <= target END"))
def _(t):
    return trades.exits(entries(t), t.bars_kept, DAY, ID, intrabar=True)


BEFORE = "OVER (PARTITION BY symbol, entry_ts ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("t13_trailing_stop", EXIT_SPEC, touch("sg * close <= lvl", "false", path=f"SELECT *, greatest(max(sg * close * (1 - sg * 0.05::DOUBLE)) {BEFORE}, sg * stop) AS lvl FROM ({PATH})"))
def _(t):
    return trades.trailing_exits(entries(t), t.bars_kept, DAY, ID, distance=0.05)


ATRB = f"(SELECT *, {roll('avg', 'tr', 14)} AS atr FROM ({TR}))"


@query("t14_atr_trailing_stop", EXIT_SPEC, touch("sg * close <= lvl", "false", path=f"SELECT *, greatest(max(sg * close - 1.5::DOUBLE * atr) {BEFORE}, sg * stop) AS lvl FROM ({PATH.replace('JOIN bars b', f'JOIN {ATRB} b').replace('b.close,', 'b.close, b.atr,')})"))
def _(t):
    with_atr = settle(ind.add_indicators(t.bars_kept, ["atr"]), "atr")
    return trades.trailing_exits(entries(t), with_atr, DAY, ID, atr_multiple=1.5)


@query("t14_break_even", EXIT_SPEC, touch("sg * close <= sg * lvl", REACHED, path=f"""SELECT *, CASE WHEN coalesce(max(CASE WHEN abs(close - target) < 0.5 * abs(entry_price - stop) THEN 1 ELSE 0 END) {BEFORE}, 0) = 1
       THEN sg * greatest(sg * entry_price, sg * stop) ELSE stop END AS lvl FROM ({PATH})"""))
def _(t):
    return trades.break_even_exits(entries(t), t.bars_kept, DAY, ID)


NONOVER = """numbered AS (SELECT trade_id, l_partkey, symbol, epoch_us(entry_time) AS a, epoch_us(exit_time) AS z, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id, l_partkey) AS rn FROM closed_trades),
    walk(symbol, rn, busy, kept, trade_id, l_partkey) AS (SELECT symbol, rn, z, true, trade_id, l_partkey FROM numbered WHERE rn = 1 UNION ALL
    SELECT n.symbol, n.rn, CASE WHEN n.a >= w.busy THEN n.z ELSE w.busy END, n.a >= w.busy, n.trade_id, n.l_partkey FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"""


@query("t15_non_overlapping", "symbol trade_id:i l_partkey:i", f"WITH RECURSIVE {NONOVER} SELECT symbol, trade_id, l_partkey FROM walk WHERE kept")
def _(t):
    slim = settle(t.closed_trades.select("symbol", "entry_time", "exit_time", "trade_id", "l_partkey"), "trades")
    return trades.non_overlapping(slim, order=["entry_time", "exit_time", "trade_id", "l_partkey"])


@query("t15_max_concurrent", "symbol trade_id:i l_partkey:i", f"""WITH RECURSIVE n AS (SELECT trade_id, l_partkey, symbol, epoch_us(entry_time) AS a, epoch_us(exit_time) AS z, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id, l_partkey) AS rn FROM closed_trades),
       w(symbol, rn, busy, kept, trade_id, l_partkey) AS (SELECT symbol, 0::BIGINT, [-1::BIGINT, -1, -1], false, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT symbol FROM n) UNION ALL
       SELECT n.symbol, n.rn, CASE WHEN w.busy[1] <= n.a THEN list_sort(list_append(w.busy[2:], n.z)) ELSE w.busy END, w.busy[1] <= n.a, n.trade_id, n.l_partkey FROM w JOIN n ON n.symbol = w.symbol AND n.rn = w.rn + 1)
       SELECT symbol, trade_id, l_partkey FROM w WHERE kept""")
def _(t):
    """At most three open trades per symbol."""
    slim = settle(t.closed_trades.select("symbol", "entry_time", "exit_time", "trade_id", "l_partkey"), "trades")
    return trades.at_most(slim, 3, order=["entry_time", "exit_time", "trade_id", "l_partkey"])


def candidates(t):
    e = entries(t)
    out = trades.exits(e, t.bars_kept, DAY, [*ID, "side", "entry_price"])
    return out.withColumn("trade_id", F.xxhash64("symbol", "entry_ts"))


def single_run(fee):
    """One open position per symbol, 10 % of cash per trade, costs on both legs."""
    gain = "w.cash * 0.1::DOUBLE / n.entry_price * (n.exit_price - n.entry_price) * n.sg"
    cost = f"(w.cash * 0.1::DOUBLE + w.cash * 0.1::DOUBLE / n.entry_price * n.exit_price) * {fee!r}::DOUBLE"
    return f"""c AS (SELECT x.*, e.sg, e.entry_price, row_number() OVER (PARTITION BY x.symbol ORDER BY x.entry_ts) AS rn FROM ({touch(STOPPED, REACHED)}) x JOIN ({ENTRIES}) e ON e.symbol = x.symbol AND e.entry_ts = x.entry_ts),
    w(symbol, rn, busy, cash, pnl, entry_ts, exit_ts) AS (SELECT symbol, 0::BIGINT, TIMESTAMP '1970-01-01', 10000.0::DOUBLE, NULL::DOUBLE, NULL::TIMESTAMP, NULL::TIMESTAMP FROM (SELECT DISTINCT symbol FROM c) UNION ALL
    SELECT n.symbol, n.rn, CASE WHEN n.entry_ts >= w.busy THEN n.exit_ts ELSE w.busy END, CASE WHEN n.entry_ts >= w.busy THEN w.cash + {gain} - {cost} ELSE w.cash END,
    CASE WHEN n.entry_ts >= w.busy THEN {gain} - {cost} END, n.entry_ts, n.exit_ts FROM w JOIN c n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"""


@query("t16_portfolio_replay", "run_id trades:i win_rate:d pnl:d4 return_pct:d profit_factor:d",
       f"""WITH RECURSIVE {single_run(0.0015)} SELECT symbol AS run_id, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate, sum(pnl) AS pnl, sum(pnl) / 100 AS return_pct,
       sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))) AS profit_factor FROM w WHERE pnl IS NOT NULL GROUP BY symbol""")
def _(t):
    """One run per symbol: candidate trades from first-touch exits, one position at a time, compounding cash."""
    c = candidates(t).withColumn("run_id", F.col("symbol"))
    return trades.replay_summary(trades.replay_single(c), 10_000.0)


@query("t17_multi_symbol_replay", "run_id exit_ts:t equity:d4")
def _(t):
    """All symbols share the cash of one run; two runs differ in the side they trade."""
    c = candidates(t).withColumn("run_id", F.col("side"))
    return trades.replay_equity(settle(trades.replay(c, max_positions=3), "accepted"), 10_000.0)


@query("t18_single_position", "run_id entry_ts:t exit_ts:t pnl:d", f"WITH RECURSIVE {single_run(0.0)} SELECT symbol AS run_id, entry_ts, exit_ts, pnl FROM w WHERE pnl IS NOT NULL")
def _(t):
    """One position at a time per symbol."""
    c = candidates(t).withColumn("run_id", F.col("symbol"))
    return trades.replay_single(c, commission=0.0, slippage=0.0)


@query("t19_position_pnl", "trade_id:i l_partkey:i pnl_now:d pct:d hours:d",
       """SELECT trade_id, l_partkey, CASE WHEN side = 'short' THEN entry_price - entry_price * (1 + ret) ELSE entry_price * (1 + ret) - entry_price END * quantity * 2 AS pnl_now, ret * 100 AS pct,
       (epoch(exit_time) - epoch(entry_time)) / 3600 AS hours FROM closed_trades""")
def _(t):
    e = F.col("entry_price")
    return t.closed_trades.withColumns({
        "pnl_now": trades.position_pnl(F.col("side"), e, e * (1 + F.col("ret")), F.col("quantity"), 2.0), "pct": F.col("ret") * 100,
        "hours": (F.unix_seconds("exit_time") - F.unix_seconds("entry_time")) / 3600})


POS = "SELECT trade_id, symbol, side, price AS entry_price, amount AS quantity FROM ticks"


def positions(t):
    side = F.when(F.col("side") == "buy", "long").otherwise("short")
    return t.ticks.select("trade_id", "symbol", side.alias("side"), F.col("price").alias("entry_price"), F.col("amount").alias("quantity"))


@query("t20_mark_to_market", "trade_id:i symbol last_price:d value:d unrealized_pnl:d",
       f"""SELECT trade_id, p.symbol, last_price, quantity * last_price AS value, CASE WHEN side = 'sell' THEN entry_price - last_price ELSE last_price - entry_price END * quantity AS unrealized_pnl
       FROM ({POS}) p JOIN (SELECT symbol, arg_max(close, ts) AS last_price FROM bars GROUP BY symbol) l ON l.symbol = p.symbol""")
def _(t):
    return trades.mark_to_market(positions(t), t.bars_kept)


@query("t21_exposure", "symbol exposure:d4 leverage:d", f"SELECT symbol, sum(abs(quantity * entry_price)) AS exposure, sum(abs(quantity * entry_price)) / 1000000.0::DOUBLE AS leverage FROM ({POS}) GROUP BY ROLLUP (symbol)")
def _(t):
    return trades.exposures(positions(t), 1e6)


@query("t22_order_limits", "trade_id:i symbol accepted reason",
       f"""WITH s AS (SELECT symbol, sum(quantity * entry_price) AS e FROM ({POS}) GROUP BY symbol), x AS (SELECT t.trade_id, t.symbol, (SELECT sum(e) FROM s) + price * amount AS ne, e FROM ticks t LEFT JOIN s ON s.symbol = t.symbol)
       SELECT trade_id, symbol, reason = 'OK' AS accepted, reason FROM (SELECT *, CASE WHEN ne > (SELECT sum(e) FROM s) + 1000 THEN 'total exposure' WHEN ne / 1e6::DOUBLE > 100 THEN 'leverage' WHEN e > 900000 THEN 'symbol exposure' ELSE 'OK' END AS reason FROM x)""")
def _(t):
    pos = positions(t)
    total = pos.agg(F.sum(F.col("quantity") * F.col("entry_price")).alias("v")).first()["v"]
    orders = t.ticks.select("trade_id", "symbol", F.col("price").alias("entry_price"), F.col("amount").alias("quantity"))
    return trades.check_orders(orders, pos, {"max_exposure": total + 1000, "max_leverage": 100.0, "max_symbol_exposure": 900_000.0}, 1e6)


@query("t23_daily_budget", "day:t pnl:d4 week_pnl:d4 day_breached week_breached",
       """WITH d AS (SELECT date_trunc('day', exit_time) AS day, sum(pnl) AS pnl FROM closed_trades GROUP BY 1) SELECT day::TIMESTAMP AS day, pnl, sum(pnl) OVER (PARTITION BY date_trunc('week', day)) AS week_pnl, pnl < -5000 AS day_breached,
       sum(pnl) OVER (PARTITION BY date_trunc('week', day)) < -20000 AS week_breached FROM d""")
def _(t):
    return trades.daily_budget(t.closed_trades, 5000.0, 20000.0)


@query("t24_limit_fill", "symbol ts:t buy_fill:d sell_fill:d", "SELECT symbol, ts, least(open + 1, high) AS buy_fill, greatest(open - 1, low) AS sell_fill FROM bars")
def _(t):
    o, h, l = F.col("open"), F.col("high"), F.col("low")
    return t.bars.withColumns({"buy_fill": signals.limit_fill(F.lit("buy"), o + 1, h, l), "sell_fill": signals.limit_fill(F.lit("sell"), o - 1, h, l)})


@query("t25_entry_spacing", "symbol trade_id:i l_partkey:i spaced capped_exit:t",
       """SELECT symbol, trade_id, l_partkey, coalesce(epoch(entry_time) - epoch(lag(entry_time) OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id, l_partkey)) >= 300, true) AS spaced,
       least(exit_time, entry_time + INTERVAL 24 HOUR) AS capped_exit FROM closed_trades""")
def _(t):
    from tidewater.plans.timeline import lay_out, time_slice

    tl = lay_out(t.trades_with(), "symbol", ["entry_time", "exit_time", "trade_id", "l_partkey"], time_slice("entry_time", 86400), back=1)
    return trades.spaced_entries(tl, 300).rows().withColumn("capped_exit", F.least(F.col("exit_time"), F.col("entry_time") + F.expr("interval 24 hours")))


@query("t26_order_validation", "problem rows:i",
       """SELECT problem, count(*) AS rows FROM (SELECT CASE WHEN trade_id % 7 = 0 THEN 'bad side' WHEN trade_id % 11 = 0 THEN 'bad type' WHEN amount - 1 <= 0 THEN 'bad quantity' WHEN trade_id % 3 = 0 AND trade_id % 5 = 0 THEN 'limit price missing' END AS problem FROM ticks) GROUP BY 1""")
def _(t):
    i = F.col("trade_id")
    o = t.ticks.select(
        F.when(i % 7 == 0, "hold").otherwise(F.col("side")).alias("side"), F.when(i % 11 == 0, "iceberg").when(i % 3 == 0, "limit").otherwise("market").alias("order_type"),
        (F.col("amount") - 1).alias("quantity"), F.when(i % 5 != 0, F.col("price")).alias("price"))
    return o.groupBy(signals.order_problem().alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


@query("t27_adjusted_signal", "symbol ts:t adjusted:d", "SELECT symbol, ts, least(greatest(pred * 8, -1), 1) AS adjusted FROM scored")
def _(t):
    return t.scored.withColumn("adjusted", signals.adjusted(F.col("pred") * 10, 0.8))


@query("t28_ensemble", "symbol ts:t pred:d", "SELECT symbol, ts, (0.5::DOUBLE * pred + 0.3::DOUBLE * actual + 0.2::DOUBLE * (pred + actual)) / 1.0::DOUBLE AS pred FROM scored")
def _(t):
    long = t.scored.select("symbol", "ts", F.inline(F.array(
        F.struct(F.lit("momentum").alias("model"), F.col("pred").alias("pred")), F.struct(F.lit("target").alias("model"), F.col("actual").alias("pred")),
        F.struct(F.lit("sum").alias("model"), (F.col("pred") + F.col("actual")).alias("pred")))))
    weights = t.spark.createDataFrame([("momentum", 0.5), ("target", 0.3), ("sum", 0.2)], "model string, weight double")
    return signals.ensemble(long, weights, ["symbol", "ts"])


def level(g, share):
    return f"SELECT symbol, entry_ts, sg * (exit_price - entry_price) * {share}::DOUBLE AS pnl, CASE WHEN reason = 'target' THEN 1 ELSE 0 END AS hit FROM (SELECT e.sg, e.entry_price, x.* FROM ({touch(STOPPED, REACHED, path=PATH.replace('0.08', str(g)))}) x JOIN ({ENTRIES}) e ON e.symbol = x.symbol AND e.entry_ts = x.entry_ts)"


@query("t29_partial_targets", "symbol entry_ts:t pnl:d levels_hit:i",
       f"SELECT symbol, entry_ts, sum(pnl) AS pnl, sum(hit) AS levels_hit FROM ({level(0.02, 0.3)} UNION ALL {level(0.03, 0.3)} UNION ALL {level(0.04, 0.4)}) GROUP BY 1, 2")
def _(t):
    # Profit levels and shares of the partial take-profit rule.
    return trades.partial_targets(entries(t), t.bars_kept, DAY, ID, [(0.02, 0.3), (0.03, 0.3), (0.04, 0.4)])


@query("t30_market_update", "symbol ts:t regime signal:d risk_score:d confidence:d",
       f"""SELECT v.symbol, v.ts, CASE WHEN vol > 0.1::DOUBLE THEN 'volatile' WHEN abs(slope / ma) > 0.002::DOUBLE THEN 'trending' ELSE 'ranging' END AS regime, least(greatest(pred * 0.8::DOUBLE, -1), 1) AS signal,
       least(1.0, greatest(0.0, vol * 0.3::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE)) AS risk_score, 0.8::DOUBLE AS confidence FROM (SELECT symbol, ts, {roll('stddev_samp', 'lr', 20)} AS vol, {roll('avg', 'close', 20)} AS ma,
       CASE WHEN pos >= 19 THEN regr_slope(close, pos) OVER {rows(20)} END AS slope FROM (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM ({LR}))) v JOIN scored s ON s.symbol = v.symbol AND s.ts = v.ts""")
def _(t):
    from tidewater.operators.regime import rolling_regime

    r = rolling_regime(t.bars_kept, 20, 0.1, 0.002)
    x = r.join(t.scored_kept, ["symbol", "ts"])
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("volatility") * 0.3 + 0.5 * 0.3))
    return x.withColumns({"signal": signals.adjusted(F.col("pred")), "risk_score": score, "confidence": F.lit(0.8)})
