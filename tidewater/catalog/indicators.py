"""Queries: technical indicators."""

from pyspark.sql import functions as F

from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, ema_step, lag, recurrence, roll, rows
from tidewater.operators import indicators as ind
from tidewater.plans.attach import attach, quantiles
from tidewater.operators.features import bars_timeline, simple_returns

A12, A26, A9, A20, A14 = 2 / 13, 2 / 27, 2 / 10, 2 / 21, 1 / 14
TP = "(high + low + close) / 3"
DELTA = f"SELECT *, close - {lag('close')} AS d FROM bars"
GL = f"""SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END AS g,
    CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END AS l FROM ({DELTA})"""
TR = f"""SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
    {lag('high')} AS ph, {lag('low')} AS pl FROM bars"""
DM = f"""SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0::DOUBLE END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0::DOUBLE END AS ndm FROM ({TR})"""
RSI = lambda g, l: (
    f"CASE WHEN {l} = 0 AND {g} > 0 THEN 100.0 ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END"
)


@query("w01_sma", "symbol ts:t sma_5:d sma_20:d sma_50:d",
       f"SELECT symbol, ts, {roll('avg', 'close', 5)} AS sma_5, {roll('avg', 'close', 20)} AS sma_20, "
       f"{roll('avg', 'close', 50)} AS sma_50 FROM bars")
def _(t):
    tl = bars_timeline(t.bars_kept, back=50)
    for n in (5, 20, 50):
        tl = ind.sma(tl, n)
    return tl.rows()


@query("w02_ema", "symbol ts:t ema_12:d ema_26:d",
       f"""WITH RECURSIVE {recurrence('SELECT * FROM bars', {
           'ema_12': ('n.close', ema_step('n.close', 'ema_12', A12)),
           'ema_26': ('n.close', ema_step('n.close', 'ema_26', A26))})} SELECT * FROM rec""")
def _(t):
    tl = bars_timeline(t.bars_kept, back=ind.REACH["ema"](n=26))
    return tl.smooth(ema_12=("close", A12), ema_26=("close", A26)).rows()


KNOWN = f"SELECT *, k - lag(k) OVER ({P}) AS gap FROM (SELECT *, row_number() OVER ({P}) AS k FROM bars_with_gaps) WHERE close IS NOT NULL"


def gap_step(y: str, a: float) -> str:
    """The next value after ``gap`` rows: the old one has faded once per row, known or not."""
    return f"(pow({1 - a!r}::DOUBLE, n.gap) * r.{y} + {a!r}::DOUBLE * n.close) / (pow({1 - a!r}::DOUBLE, n.gap) + {a!r}::DOUBLE)"


@query("w02_ema_gaps", "symbol ts:t ema_12:d ema_26:d",
       f"""WITH RECURSIVE {recurrence(KNOWN, {'ema_12': ('n.close', gap_step('ema_12', A12)), 'ema_26': ('n.close', gap_step('ema_26', A26))})}
       SELECT b.symbol, b.ts, last_value(rec.ema_12 IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS ema_12,
       last_value(rec.ema_26 IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS ema_26
       FROM bars_with_gaps b LEFT JOIN rec ON b.symbol = rec.symbol AND b.ts = rec.ts""")
def _(t):
    tl = bars_timeline(t.bars_with_gaps, back=ind.REACH["ema"](n=26))
    return tl.smooth(ema_12=("close", A12), ema_26=("close", A26)).rows()


@query("w03_ema_seeded", "symbol ts:t ema:d",
       f"""WITH RECURSIVE {recurrence(f"SELECT *, {roll('avg', 'close', 20)} AS m FROM bars",
           {'ema': ('n.m', ema_step('n.close', 'ema', A20))}, start=19)}
       SELECT b.symbol, b.ts, rec.ema FROM bars b LEFT JOIN rec ON b.symbol = rec.symbol AND b.ts = rec.ts""")
def _(t):
    return ind.add_indicators(t.bars_kept, {"ema_seeded": {"n": 20, "out": "ema"}})


MACD_REC = recurrence("SELECT * FROM bars", {
    "f": ("n.close", ema_step("n.close", "f", A12)),
    "s": ("n.close", ema_step("n.close", "s", A26)),
    "sig": ("0", f"{A9!r}::DOUBLE * (({ema_step('n.close', 'f', A12)}) - ({ema_step('n.close', 's', A26)})) + {1 - A9!r}::DOUBLE * r.sig"),
})
MACD = f"SELECT symbol, ts, pos, f - s AS macd, sig AS macd_signal, f - s - sig AS macd_histogram FROM rec"


@query("w04_macd", "symbol ts:t macd:d macd_signal:d macd_histogram:d", f"WITH RECURSIVE {MACD_REC} {MACD}")
def _(t):
    return ind.add_indicators(t.bars_kept, ["macd"])


RSI14 = f"SELECT symbol, ts, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al, close FROM ({GL})"


@query("w05_rsi", "symbol ts:t rsi:d", f"SELECT symbol, ts, {RSI('ag', 'al')} AS rsi FROM ({RSI14})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["rsi"])


WILDER = f"""WITH RECURSIVE {recurrence(
    f"SELECT *, avg(g) OVER {rows(14)} AS g0, avg(l) OVER {rows(14)} AS l0 FROM ({GL})",
    {'ag': ('n.g0', ema_step('n.g', 'ag', A14)), 'al': ('n.l0', ema_step('n.l', 'al', A14))}, start=14)}"""


@query("w06_rsi_wilder", "symbol ts:t rsi_wilder:d",
       f"""{WILDER} SELECT b.symbol, b.ts, CASE WHEN b.rn <= 14 THEN 50.0 WHEN rec.al = 0 THEN 100.0
       ELSE 100 - 100 / (1 + rec.ag / nullif(rec.al, 0)) END AS rsi_wilder
       FROM (SELECT *, row_number() OVER ({P}) AS rn FROM bars) b
       LEFT JOIN rec ON b.symbol = rec.symbol AND b.ts = rec.ts""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["rsi_wilder"])


@query("w07_rsi_flags", "symbol ts:t overbought oversold",
       f"SELECT symbol, ts, rsi >= 70 AS overbought, rsi <= 30 AS oversold FROM (SELECT symbol, ts, {RSI('ag', 'al')} AS rsi FROM ({RSI14}))")
def _(t):
    return ind.add_indicators(t.bars_kept, ["rsi_flags"])


@query("w08_macd_cross", "symbol ts:t bullish_cross bearish_cross",
       f"""WITH RECURSIVE {MACD_REC}, m AS ({MACD}), l AS (SELECT *, {lag('macd')} AS pm, {lag('macd_signal')} AS ps FROM m)
       SELECT symbol, ts, coalesce(pm <= ps AND macd > macd_signal, false) AS bullish_cross,
       coalesce(pm >= ps AND macd < macd_signal, false) AS bearish_cross FROM l""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["macd_cross"])


BB = f"SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd FROM bars"


@query("w09_bollinger", "symbol ts:t bb_mid:d bb_upper:d bb_lower:d",
       f"SELECT symbol, ts, m AS bb_mid, m + 2 * sd AS bb_upper, m - 2 * sd AS bb_lower FROM ({BB})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["bollinger"])


@query("w10_bollinger_width", "symbol ts:t bb_width:d",
       f"SELECT symbol, ts, 4 * sd / nullif(m, 0) AS bb_width FROM ({BB})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["bollinger"])


@query("w11_atr", "symbol ts:t true_range:d atr:d",
       f"SELECT symbol, ts, tr AS true_range, {roll('avg', 'tr', 14)} AS atr FROM ({TR})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["atr"])


STO = f"""SELECT *, 100 * (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) AS k FROM bars"""


@query("w12_stochastic", "symbol ts:t stoch_k:d stoch_d:d",
       f"SELECT symbol, ts, k AS stoch_k, {roll('avg', 'k', 3)} AS stoch_d FROM ({STO})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["stochastic"])


@query("w13_roc", "symbol ts:t roc:d",
       f"SELECT symbol, ts, (close - {lag('close', 12)}) / nullif({lag('close', 12)}, 0) * 100 AS roc FROM bars")
def _(t):
    return ind.add_indicators(t.bars_kept, ["roc"])


@query("w14_money_flow", "symbol ts:t mfi:d",
       f"""SELECT symbol, ts, {RSI('p', 'q')} AS mfi FROM (SELECT symbol, ts, {roll('sum', 'up', 14)} AS p, {roll('sum', 'dn', 14)} AS q
       FROM (SELECT symbol, ts, CASE WHEN d > 0 THEN f ELSE 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN f ELSE 0.0::DOUBLE END AS dn
       FROM (SELECT symbol, ts, tp * volume AS f, tp - {lag('tp')} AS d FROM (SELECT *, {TP} AS tp FROM bars))))""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["mfi"])


@query("w15_obv", "symbol ts:t obv:d",
       f"""SELECT symbol, ts, sum(CASE WHEN d IS NULL THEN volume ELSE sign(d) * volume END) OVER ({P}) AS obv FROM ({DELTA})""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["obv"])


@query("w16_vwap_daily", "symbol ts:t vwap:d",
       f"""SELECT symbol, ts, sum({TP} * volume) OVER w / sum(volume) OVER w AS vwap FROM bars
       WINDOW w AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts)""")
def _(t):
    return ind.vwap_daily(t.bars_kept)


@query("w17_vwap", "symbol ts:t vwap_rolling:d vwap_cumulative:d",
       f"""SELECT symbol, ts, {roll('sum', 'pv', 14)} / {roll('sum', 'volume', 14).replace('CASE', '(CASE').replace(' END', ' END)')} AS vwap_rolling,
       sum(pv) OVER ({P}) / sum(volume) OVER ({P}) AS vwap_cumulative FROM (SELECT *, {TP} * volume AS pv FROM bars)""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["vwap_rolling", "vwap_cumulative"])


@query("w18_adl", "symbol ts:t adl:d",
       f"""SELECT symbol, ts, sum(((close - low) - (high - close)) / nullif(high - low, 0) * volume) OVER ({P}) AS adl FROM bars""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["adl"])


DI = f"""SELECT symbol, ts, 100 * ({roll('sum', 'pdm', 14)}) / nullif({roll('sum', 'tr', 14)}, 0) AS p,
    100 * ({roll('sum', 'ndm', 14)}) / nullif({roll('sum', 'tr', 14)}, 0) AS m FROM ({DM})"""


@query("w19_adx", "symbol ts:t plus_di:d minus_di:d adx:d",
       f"""SELECT symbol, ts, p AS plus_di, m AS minus_di, {roll('avg', 'dx', 14)} AS adx
       FROM (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM ({DI}))""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["adx"])


DIW = f"""SELECT symbol, ts, row_number() OVER ({P}) - 1 AS pos0,
    CASE WHEN avg(tr) OVER {rows(14)} = 0 THEN 0 ELSE 100 * avg(pdm) OVER {rows(14)} / nullif(avg(tr) OVER {rows(14)}, 0) END AS p,
    CASE WHEN avg(tr) OVER {rows(14)} = 0 THEN 0 ELSE 100 * avg(ndm) OVER {rows(14)} / nullif(avg(tr) OVER {rows(14)}, 0) END AS m FROM ({DM})"""
DXW = f"SELECT *, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / nullif(p + m, 0) END AS dx FROM ({DIW})"


@query("w20_adx_wilder", "symbol ts:t plus_di_w:d minus_di_w:d adx_w:d strong_trend bullish_trend",
       f"""WITH RECURSIVE {recurrence(DXW, {'a': ('n.dx', ema_step('n.dx', 'a', A14))}, start=14)}
       SELECT n.symbol, n.ts, CASE WHEN n.pos >= 14 THEN n.p END AS plus_di_w, CASE WHEN n.pos >= 14 THEN n.m END AS minus_di_w,
       rec.a AS adx_w, rec.a >= 25 AS strong_trend, CASE WHEN n.pos >= 14 THEN n.p > n.m END AS bullish_trend
       FROM numbered n LEFT JOIN rec ON n.symbol = rec.symbol AND n.ts = rec.ts""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["adx_wilder"])


@query("w21_custom_momentum", "symbol ts:t custom_momentum:d",
       f"SELECT symbol, ts, (close - {lag('close', 10)}) * (volume - {lag('volume', 10)}) AS custom_momentum FROM bars")
def _(t):
    return ind.add_indicators(t.bars_kept, ["custom_momentum"])


LR = f"SELECT *, ln(close) - ln({lag('close')}) AS lr FROM bars"


@query("w22_volatility", "symbol ts:t volatility:d",
       f"SELECT symbol, ts, {roll('stddev_samp', 'lr', 20)} * sqrt(252) AS volatility FROM ({LR})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["volatility"])


@query("w23_volatility_ratio", "symbol ts:t volatility_ratio:d",
       f"SELECT symbol, ts, ({roll('stddev_samp', 'lr', 20)}) * ({roll('avg', 'volume', 20)}) AS volatility_ratio FROM ({LR})")
def _(t):
    return ind.add_indicators(t.bars_kept, ["volatility_ratio"])


@query("w24_price_sigma", "symbol ts:t price_sigma:d",
       f"SELECT symbol, ts, {roll('stddev_samp', 'close', 20)} AS price_sigma FROM bars")
def _(t):
    return ind.add_indicators(t.bars_kept, ["price_sigma"])


@query("w25_ma_deviation", "symbol ts:t ma_deviation:d",
       f"""SELECT symbol, ts, (close - f) / nullif(f, 0) AS ma_deviation FROM (SELECT *, coalesce(m, first_value(m IGNORE NULLS)
       OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM ({BB}))""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["ma_deviation"])


@query("w26_trend", "symbol ts:t trend_sign:d rolling_slope:d",
       f"""SELECT symbol, ts, sign(close - m) AS trend_sign, CASE WHEN pos >= 19 THEN regr_slope(close, pos) OVER {rows(20)} END AS rolling_slope
       FROM (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM ({BB}))""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["trend_sign"])


@query("w27_relative_volume", "symbol ts:t volume_sma:d volume_ema:d relative_volume:d",
       f"""WITH RECURSIVE {recurrence('SELECT * FROM bars', {'e': ('n.volume', ema_step('n.volume', 'e', A20))})}
       SELECT n.symbol, n.ts, {roll('avg', 'volume', 20, P.replace('symbol', 'n.symbol').replace(' ts', ' n.ts'))} AS volume_sma, rec.e AS volume_ema,
       volume / nullif({roll('avg', 'volume', 20, P.replace('symbol', 'n.symbol').replace(' ts', ' n.ts'))}, 0) AS relative_volume
       FROM numbered n JOIN rec ON n.symbol = rec.symbol AND n.ts = rec.ts""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["volume_averages"])


@query("w28_indicator_set", "symbol ts:t sma_10:d rsi:d atr:d roc:d obv:d",
       f"""SELECT symbol, ts, {roll('avg', 'close', 10)} AS sma_10, {RSI('ag', 'al')} AS rsi, {roll('avg', 'tr', 14)} AS atr,
       (close - p12) / nullif(p12, 0) * 100 AS roc, obv FROM (SELECT *, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al,
       {lag('close', 12)} AS p12, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
       sum(CASE WHEN d IS NULL THEN volume ELSE sign(d) * volume END) OVER ({P}) AS obv FROM ({GL}))""")
def _(t):
    return ind.add_indicators(t.bars_kept, {"sma": {"n": 10}, "rsi": {}, "atr": {}, "roc": {}, "obv": {}})


@query("w29_indicator_families", "symbol ts:t rsi:d macd:d bb_mid:d atr:d adx:d mfi:d",
       f"""WITH RECURSIVE {MACD_REC}, x AS (SELECT symbol, ts, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al,
       {roll('avg', 'close', 20)} AS bb_mid FROM ({GL})), a AS (SELECT symbol, ts, {roll('avg', 'tr', 14)} AS atr FROM ({TR}))
       SELECT x.symbol, x.ts, {RSI('ag', 'al')} AS rsi, rec.f - rec.s AS macd, bb_mid, atr, adx, mfi FROM x
       JOIN rec ON rec.symbol = x.symbol AND rec.ts = x.ts JOIN a ON a.symbol = x.symbol AND a.ts = x.ts
       JOIN (SELECT symbol, ts, {roll('avg', 'dx', 14)} AS adx FROM (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM ({DI}))) ax
         ON ax.symbol = x.symbol AND ax.ts = x.ts
       JOIN (SELECT symbol, ts, {RSI('p', 'q')} AS mfi FROM (SELECT symbol, ts, {roll('sum', 'up', 14)} AS p, {roll('sum', 'dn', 14)} AS q
       FROM (SELECT symbol, ts, CASE WHEN d > 0 THEN f ELSE 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN f ELSE 0.0::DOUBLE END AS dn
       FROM (SELECT symbol, ts, tp * volume AS f, tp - {lag('tp')} AS d FROM (SELECT *, {TP} AS tp FROM bars))))) mf
         ON mf.symbol = x.symbol AND mf.ts = x.ts""")
def _(t):
    return ind.add_families(t.bars_kept, ["momentum", "trend", "volatility", "volume"])


@query("w30_wilder_variants", "symbol ts:t atr_wilder:d rsi_wilder:d",
       f"""WITH RECURSIVE {recurrence(
           f'''SELECT x.*, y.g, y.l, avg(y.g) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS g0,
           avg(y.l) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l0,
           avg(tr) OVER (PARTITION BY x.symbol ORDER BY x.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS t0
           FROM ({TR}) x JOIN ({GL}) y ON x.symbol = y.symbol AND x.ts = y.ts''',
           {'a': ('n.t0', ema_step('n.tr', 'a', A14)),
            'ag': ('0', f"CASE WHEN n.pos = 14 THEN n.g0 ELSE {ema_step('n.g', 'ag', A14)} END"),
            'al': ('0', f"CASE WHEN n.pos = 14 THEN n.l0 ELSE {ema_step('n.l', 'al', A14)} END")}, start=13)}
       SELECT n.symbol, n.ts, rec.a AS atr_wilder, CASE WHEN n.pos < 14 THEN 50.0 WHEN rec.al = 0 THEN 100.0
       ELSE 100 - 100 / (1 + rec.ag / nullif(rec.al, 0)) END AS rsi_wilder
       FROM numbered n LEFT JOIN rec ON n.symbol = rec.symbol AND n.ts = rec.ts""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["atr_wilder", "rsi_wilder"])


@query("w31_volatility_thresholds", "symbol ts:t volatility:d p25:d p75:d band",
       f"""WITH v AS (SELECT symbol, ts, {roll('stddev_samp', 'lr', 20)} * sqrt(252) AS volatility FROM ({LR})),
       q AS (SELECT symbol, quantile_cont(volatility, 0.25) AS p25, quantile_cont(volatility, 0.75) AS p75 FROM v GROUP BY symbol)
       SELECT v.symbol, ts, volatility, p25, p75, CASE WHEN volatility > p75 THEN 'high' WHEN volatility < p25 THEN 'low'
       WHEN volatility IS NOT NULL THEN 'middle' END AS band FROM v JOIN q ON v.symbol = q.symbol""")
def _(t):
    from tidewater.session import settle

    v = settle(ind.add_indicators(t.bars_kept, ["volatility"]), "volatility")
    out = attach(v, quantiles(v, "symbol", "volatility", {"p25": 0.25, "p75": 0.75}), "symbol")
    band = F.when(F.col("volatility") > F.col("p75"), "high").when(F.col("volatility") < F.col("p25"), "low")
    return out.withColumn("band", band.when(F.col("volatility").isNotNull(), "middle"))


@query("w31_top_movers", "symbol change:d rank:i", "SELECT symbol, change, rank() OVER (ORDER BY change DESC) AS rank FROM (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) - 1 AS change FROM bars GROUP BY symbol)")
def _(t):
    from tidewater.operators import metrics

    return metrics.top_movers(t.bars_kept)


@query("w32_funding_trend", "symbol ts:t funding_ma:d11 funding_trend:d funding_signal:d",
       f"""SELECT symbol, ts, ma AS funding_ma, sign(funding_rate - ma) AS funding_trend, -sign(funding_rate - ma) AS funding_signal
       FROM (SELECT *, {roll('avg', 'funding_rate', 8)} AS ma FROM funding)""")
def _(t):
    return ind.funding_trend(t.funding)


@query("w32_open_interest_change", "symbol ts:t oi_change:d",
       f"SELECT symbol, ts, volume - {lag('volume', 24)} AS oi_change FROM bars")
def _(t):
    return ind.change_over(t.bars_kept, "volume", 24, "oi_change")


@query("w33_volume_trend", "symbol ts:t volume_trend:d relative_volume:d",
       f"""SELECT symbol, ts, sign(({roll('avg', 'volume', 5)}) - ({roll('avg', 'volume', 20)})) AS volume_trend,
       volume / nullif({roll('avg', 'volume', 20)}, 0) AS relative_volume FROM bars""")
def _(t):
    return ind.add_indicators(t.bars_kept, ["volume_averages"])
