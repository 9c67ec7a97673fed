"""Queries: performance, risk, profiles, model evaluation."""

from pyspark.sql import functions as F

from tidewater.catalog.indicators import BB, LR
from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, lag, roll
from tidewater.functions.scalars import ratio
from tidewater.operators import indicators as ind
from tidewater.operators import metrics as m
from tidewater.operators import risk
from tidewater.plans.attach import attach, quantiles
from tidewater.session import settle
from tidewater.sources.views import TRADE_ORDER_SQL

R = "(SELECT * FROM returns WHERE ret IS NOT NULL)"
S = "PARTITION BY series_id ORDER BY ts"
TO = f"PARTITION BY symbol ORDER BY {TRADE_ORDER_SQL}"
DAILY = 0.02 / 252
CUM = f"SELECT series_id, ts, ret, exp(sum(ln(1 + ret)) OVER ({S})) AS cum FROM {R}"
DD = f"SELECT *, (cum - peak) / peak AS dd FROM (SELECT *, max(cum) OVER ({S}) AS peak FROM ({CUM}))"
DDS = f"""SELECT series_id, min(dd) AS max_drawdown, avg(dd) AS avg_drawdown, sqrt(avg(dd * dd)) AS ulcer_index, sqrt(sum(dd * dd)) AS rss FROM ({DD}) GROUP BY series_id"""


def rets(t):
    return t.returns_kept.where("ret IS NOT NULL")


def dds(t):
    return settle(m.drawdowns(t.returns_kept), "drawdowns")


@query("a01_total_return", "series_id total:d annual:d2 calendar_annual:d2",
       f"""SELECT series_id, total, pow(1 + total, 252.0::DOUBLE / n) - 1 AS annual, CASE WHEN days > 0 THEN pow(1 + total, 365.25::DOUBLE / days) - 1 ELSE 0 END AS calendar_annual
       FROM (SELECT series_id, exp(sum(ln(1 + 0.01::DOUBLE * ret))) - 1 AS total, count(*) AS n, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS days FROM {R} GROUP BY series_id)""")
def _(t):
    damped = rets(t).withColumn("ret", F.col("ret") * 0.01)
    g = damped.groupBy("series_id").agg(m.total_return().alias("total"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return g.withColumns({"annual": m.annualised(F.col("total"), F.col("n")), "calendar_annual": m.calendar_annualised(F.col("total"), F.col("a"), F.col("z"))})


LOSS = "(SELECT series_id, ts, CASE WHEN extract('hour' FROM ts) = 5 AND extract('day' FROM ts) = 9 THEN -1.0 WHEN extract('hour' FROM ts) = 4 AND series_id > 'e' THEN -1.5 ELSE 0.01::DOUBLE * ret END AS ret FROM returns WHERE ret IS NOT NULL)"


def losses(t):
    """Returns with a total loss in some series and returns below -1 in others."""
    hour, day = F.hour("ts"), F.dayofmonth("ts")
    bad = F.when((hour == 5) & (day == 9), -1.0).when((hour == 4) & (F.col("series_id") > "e"), -1.5).otherwise(F.col("ret") * 0.01)
    return rets(t).withColumn("ret", bad)


@query("a01_total_loss", "series_id total:d", f"SELECT series_id, product(1 + ret) - 1 AS total FROM {LOSS} GROUP BY series_id")
def _(t):
    return losses(t).groupBy("series_id").agg(m.total_return().alias("total"))


@query("a05_total_loss", "series_id max_drawdown:d rows:i",
       f"""WITH c AS (SELECT *, product(1 + ret) OVER ({S}) AS cum FROM {LOSS}), d AS (SELECT *, (cum - max(cum) OVER ({S})) / nullif(max(cum) OVER ({S}), 0) AS dd FROM c)
       SELECT series_id, min(dd) AS max_drawdown, count(dd) AS rows FROM d GROUP BY series_id""")
def _(t):
    return m.drawdowns(losses(t)).groupBy("series_id").agg(F.min("dd").alias("max_drawdown"), F.count("dd").alias("rows"))


@query("a02_volatility", "series_id sample:d population:d", f"SELECT series_id, stddev_samp(ret) * sqrt(252) AS sample, stddev_pop(ret) * sqrt(252) AS population FROM {R} GROUP BY series_id")
def _(t):
    return rets(t).groupBy("series_id").agg((F.stddev("ret") * m.ROOT).alias("sample"), (F.stddev_pop("ret") * m.ROOT).alias("population"))


@query("a03_sharpe", "series_id plain:d risk_free_population:d guarded:d",
       f"""SELECT series_id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS plain, (avg(ret) - {DAILY!r}) / nullif(stddev_pop(ret), 0) * sqrt(252) AS risk_free_population,
       CASE WHEN count(*) < 30 THEN 0 ELSE (avg(ret) - {DAILY!r}) / nullif(stddev_pop(ret), 0) * sqrt(252) END AS guarded FROM {R} GROUP BY series_id""")
def _(t):
    r = F.col("ret")
    guarded = F.when(F.count(r) < 30, F.lit(0.0)).otherwise(m.sharpe(r, 0.02, sample=False))
    return rets(t).groupBy("series_id").agg(m.sharpe(r).alias("plain"), m.sharpe(r, 0.02, sample=False).alias("risk_free_population"), guarded.alias("guarded"))


X = f"(ret - {DAILY!r})"


@query("a04_sortino", "series_id rms_negative:d std_negative:d rms_all:d",
       f"""SELECT series_id, avg(ret) / sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) * sqrt(252) AS rms_negative,
       avg({X}) / (stddev_samp({X}) FILTER (WHERE {X} < 0)) * sqrt(252) AS std_negative, avg({X}) / sqrt(avg(pow(least({X}, 0), 2))) * sqrt(252) AS rms_all FROM {R} GROUP BY series_id""")
def _(t):
    r = F.col("ret")
    return rets(t).groupBy("series_id").agg(
        m.sortino(r).alias("rms_negative"), m.sortino(r, 0.02, "std_negative").alias("std_negative"), m.sortino(r, 0.02, "rms_all").alias("rms_all"))


@query("a05_drawdowns", "series_id max_drawdown:d avg_drawdown:d ulcer_index:d", DDS)
def _(t):
    return m.drawdown_stats(dds(t))


RUNS = f"SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER ({S}) AS run FROM ({DD})"


@query("a06_drawdown_duration", "series_id mean_duration:i",
       f"SELECT series_id, floor(avg(n)) AS mean_duration FROM (SELECT series_id, run, count(*) FILTER (WHERE dd < 0) AS n FROM ({RUNS}) GROUP BY 1, 2) WHERE n > 0 GROUP BY series_id")
def _(t):
    return m.drawdown_duration(dds(t))


@query("a07_drawdown_periods", "series_id start_date:t end_date:t duration_days:i max_drawdown:d",
       f"""WITH g AS (SELECT series_id, run, min(ts) FILTER (WHERE dd < 0) AS start_date, min(ts) FILTER (WHERE dd >= 0) AS peak_at, min(dd) AS max_drawdown FROM ({RUNS}) GROUP BY 1, 2)
       SELECT g.series_id, g.start_date, n.peak_at AS end_date, floor((epoch(n.peak_at) - epoch(g.start_date)) / 86400) AS duration_days, g.max_drawdown
       FROM g JOIN g n ON n.series_id = g.series_id AND n.run = g.run + 1 WHERE g.start_date IS NOT NULL""")
def _(t):
    return m.drawdown_periods(dds(t))


RATIOS = f"""SELECT b.*, d.max_drawdown, d.rss, pow(1 + total, 252.0::DOUBLE / n) - 1 AS annual, pow(2 + total, 252.0::DOUBLE / n) - 1 AS ref FROM (SELECT series_id, count(*) AS n, avg(ret) AS mean,
    exp(sum(ln(1 + ret))) - 1 AS total, avg({X}) / stddev_pop({X}) * sqrt(252) AS ex, (avg({X}) FILTER (WHERE {X} > 0)) / (stddev_pop({X}) FILTER (WHERE {X} < 0)) AS up
    FROM {R} GROUP BY series_id) b JOIN ({DDS}) d ON d.series_id = b.series_id"""


@query("a08_calmar_family", "series_id calmar_annual:d calmar_ref:d calmar_root:d calmar_mean:d calmar_total:d sterling:d recovery:d",
       f"""SELECT series_id, annual / abs(max_drawdown) AS calmar_annual, ref / abs(max_drawdown) AS calmar_ref, mean * sqrt(252) / abs(max_drawdown) AS calmar_root,
       mean * 252 / abs(max_drawdown) AS calmar_mean, total / abs(max_drawdown) AS calmar_total, annual / abs(max_drawdown) AS sterling, total / abs(max_drawdown) AS recovery FROM ({RATIOS})""")
def _(t):
    return m.return_ratios(t.returns_kept, dds(t))


@query("a09_omega", "series_id omega:d gain_loss:d", f"SELECT series_id, sum(greatest(ret, 0)) / abs(sum(least(ret, 0))) AS omega, sum({X}) FILTER (WHERE {X} > 0) / abs(sum({X}) FILTER (WHERE {X} < 0)) AS gain_loss FROM {R} GROUP BY series_id")
def _(t):
    return rets(t).groupBy("series_id").agg(m.omega(F.col("ret")).alias("omega"), m.omega(F.col("ret"), DAILY).alias("gain_loss"))


@query("a09_profit_factor", "symbol profit_factor:d", "SELECT symbol, sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))) AS profit_factor FROM closed_trades GROUP BY symbol")
def _(t):
    return t.closed_trades.groupBy("symbol").agg(m.omega(F.col("pnl")).alias("profit_factor"))


VAR = f"SELECT series_id, quantile_cont(ret, 0.05) AS var_95, quantile_cont(ret, 0.01) AS var_99 FROM {R} GROUP BY series_id"


@query("a10_historical_var", "series_id var_95:d cvar_95:d var_99:d cvar_99:d",
       f"""SELECT r.series_id, max(var_95) AS var_95, avg(ret) FILTER (WHERE ret <= var_95) AS cvar_95, max(var_99) AS var_99, avg(ret) FILTER (WHERE ret <= var_99) AS cvar_99
       FROM {R} r JOIN ({VAR}) v ON v.series_id = r.series_id GROUP BY r.series_id""")
def _(t):
    return m.value_at_risk(rets(t))


@query("a11_parametric_var", "series_id var:d es:d",
       f"SELECT series_id, avg(ret) - {m.NORMAL[0.95][0]!r} * stddev_samp(ret) AS var, avg(ret) - stddev_samp(ret) * {m.NORMAL[0.95][1]!r} / 0.05::DOUBLE AS es FROM {R} GROUP BY series_id")
def _(t):
    return m.parametric_var(rets(t))


@query("a12_shape", "series_id skew:d kurt:d", f"SELECT series_id, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM {R} GROUP BY series_id")
def _(t):
    return rets(t).groupBy("series_id").agg(m.skew_corrected("ret").alias("skew"), m.kurtosis_corrected("ret").alias("kurt"))


@query("a13_ratio_family", "series_id burke:d martin:d pain:d kappa:d modigliani:d upside_potential:d",
       f"SELECT series_id, annual / rss AS burke, annual / rss AS martin, ex AS pain, ex AS kappa, ex AS modigliani, up AS upside_potential FROM ({RATIOS})")
def _(t):
    return m.return_ratios(t.returns_kept, dds(t))


FEATS = ["open", "high", "low", "close", "volume"]


@query("a14_correlations", "symbol a b corr:d",
       " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM bars GROUP BY symbol" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]))
def _(t):
    return m.correlation_pairs(t.bars, ["symbol"], FEATS)


PROFILE = " UNION ALL ".join(
    f"""SELECT symbol, '{c}' AS feature, count(*) AS rows, count({c}) AS count, 1 - count({c}) / count(*) AS missing, count(DISTINCT {c}) AS distinct_values, min({c}) AS min, max({c}) AS max,
    avg({c}) AS mean, stddev_samp({c}) AS std, skewness({c}) AS skew, kurtosis({c}) AS kurtosis, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3
    FROM bars_with_gaps GROUP BY symbol""" for c in ("close", "volume"))


@query("a15_profile", "symbol feature rows:i count:i missing:d distinct_values:i min:d max:d mean:d std:d q1:d median:d q3:d", PROFILE)
def _(t):
    return m.profile(t.bars_with_gaps, "symbol", ["close", "volume"]).withColumn("distinct_values", F.col("distinct"))


@query("p27_feature_metadata", "symbol feature missing:d mean:d std:d min:d max:d median:d skew:d kurtosis:d", PROFILE)
def _(t):
    return m.profile(t.bars_with_gaps, "symbol", ["close", "volume"])


@query("a16_trade_stats", "symbol trades:i wins:i losses:i even:i win_rate:d avg_trade:d4 avg_win:d4 avg_loss:d4 avg_loss_incl_zero:d4 profit_factor:d",
       """SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, count(*) FILTER (WHERE pnl = 0) AS even,
       count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate, avg(pnl) AS avg_trade, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss,
       avg(pnl) FILTER (WHERE pnl <= 0) AS avg_loss_incl_zero, sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))) AS profit_factor FROM closed_trades GROUP BY symbol""")
def _(t):
    return m.trade_stats(t.closed_trades)


@query("a17_streaks", "symbol max_consecutive_wins:i max_consecutive_losses:i",
       f"""WITH f AS (SELECT symbol, pnl > 0 AS w, row_number() OVER ({TO}) - row_number() OVER (PARTITION BY symbol, pnl > 0 ORDER BY {TRADE_ORDER_SQL}) AS g FROM closed_trades),
       n AS (SELECT symbol, w, g, count(*) AS n FROM f GROUP BY 1, 2, 3) SELECT symbol, max(n) FILTER (WHERE w) AS max_consecutive_wins, max(n) FILTER (WHERE NOT w) AS max_consecutive_losses FROM n GROUP BY symbol""")
def _(t):
    return m.streaks(t.closed_trades)


@query("a18_back_to_back", "symbol max_chain:i",
       f"""WITH w AS (SELECT symbol, coalesce(epoch(entry_time) - epoch(lag(exit_time) OVER ({TO})) >= 3600, true) AS fresh, row_number() OVER ({TO}) AS rn FROM closed_trades),
       c AS (SELECT symbol, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS chain FROM w)
       SELECT symbol, max(n) AS max_chain FROM (SELECT symbol, chain, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY symbol""")
def _(t):
    return m.back_to_back(t.closed_trades)


@query("a19_day_state", "symbol ts:t last:d volume_24h:d change_24h:d high_24h:d low_24h:d",
       f"""SELECT symbol, ts, close AS last, sum(volume) OVER w AS volume_24h, (close - first_value(close) OVER w) / first_value(close) OVER w AS change_24h, max(high) OVER w AS high_24h, min(low) OVER w AS low_24h
       FROM bars WINDOW w AS ({P} RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    return m.day_state(t.bars_kept)


@query("a20_time_in_market", "symbol time_in_market:d avg_hours:d4",
       """SELECT symbol, sum(epoch(exit_time) - epoch(entry_time)) / (epoch(max(exit_time)) - epoch(min(entry_time))) AS time_in_market,
       avg((epoch(exit_time) - epoch(entry_time)) / 3600.0::DOUBLE) AS avg_hours FROM closed_trades GROUP BY symbol""")
def _(t):
    return m.trade_stats(t.closed_trades)


@query("a21_monthly_returns", "symbol months:i mean:d std:d best:d worst:d positive_months:d",
       """SELECT symbol, count(*) AS months, avg(m) AS mean, stddev_samp(m) AS std, max(m) AS best, min(m) AS worst, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS positive_months
       FROM (SELECT symbol, date_trunc('month', exit_time) AS mo, exp(sum(ln(1 + ret))) - 1 AS m FROM closed_trades GROUP BY 1, 2) GROUP BY symbol""")
def _(t):
    return m.monthly_stats(t.closed_trades, "symbol", "exit_time")


@query("a22_monthly_pnl", "symbol month:t pnl:d4 trades:i win_rate:d",
       """WITH a AS (SELECT symbol, date_trunc('month', exit_time) AS month, sum(pnl) AS pnl, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate
       FROM closed_trades GROUP BY 1, 2), g AS (SELECT symbol, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM a GROUP BY symbol)
       SELECT g.symbol, g.month, coalesce(pnl, 0) AS pnl, coalesce(trades, 0) AS trades, win_rate FROM g LEFT JOIN a ON a.symbol = g.symbol AND a.month = g.month""")
def _(t):
    slim = settle(t.closed_trades.select("symbol", "exit_time", "pnl"), "pnl")
    return m.monthly_pnl(slim)


@query("a23_cumulative_pnl", "symbol trade_id:i l_partkey:i exit_time:t cum_pnl:d5", f"SELECT symbol, trade_id, l_partkey, exit_time, sum(pnl) OVER ({TO} ROWS UNBOUNDED PRECEDING) AS cum_pnl FROM closed_trades")
def _(t):
    return m.cumulative_pnl(t.trades_with("pnl"))


@query("a24_symbol_performance", "symbol trades:i wins:i total_pnl:d5 avg_return:d", "SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, sum(pnl) AS total_pnl, avg(ret) AS avg_return FROM closed_trades GROUP BY symbol")
def _(t):
    return m.trade_stats(t.closed_trades)


BJ = "(SELECT r.series_id, r.ts, ret, bench FROM returns r JOIN benchmark_ret b ON b.ts = r.ts WHERE ret IS NOT NULL AND bench IS NOT NULL)"
BETA = "covar_samp(ret, bench) / var_samp(bench)"


@query("a25_benchmark", "series_id beta:d alpha:d tracking_error:d information_ratio:d correlation:d beta_mixed:d",
       f"""SELECT series_id, {BETA} AS beta, (avg(ret) - {DAILY!r} - {BETA} * (avg(bench) - {DAILY!r})) * 252 AS alpha, stddev_samp(ret - bench) * sqrt(252) AS tracking_error,
       avg(ret - bench) * 252 / (stddev_samp(ret - bench) * sqrt(252)) AS information_ratio, corr(ret, bench) AS correlation, covar_samp(ret, bench) / var_pop(bench) AS beta_mixed FROM {BJ} GROUP BY series_id""")
def _(t):
    return m.benchmark_stats(t.returns_kept, t.benchmark_ret)


@query("a26_t_statistic", "series_id t_stat:d", f"SELECT series_id, (avg(ret) - avg(bench)) / sqrt((var_samp(ret) + var_samp(bench)) / count(*)) AS t_stat FROM {BJ} GROUP BY series_id")
def _(t):
    return m.benchmark_stats(t.returns_kept, t.benchmark_ret)


@query("a27_treynor_jensen", "series_id treynor:d jensen:d",
       f"SELECT series_id, (avg(ret) - {DAILY!r}) / ({BETA}) * sqrt(252) AS treynor, avg(ret) - {DAILY!r} - {BETA} * (avg(bench) - {DAILY!r}) AS jensen FROM {BJ} GROUP BY series_id")
def _(t):
    return m.benchmark_stats(t.returns_kept, t.benchmark_ret)


@query("a28_risk_report", "series_id var_95:d cvar_95:d sortino_ratio:d calmar_ratio:d omega_ratio:d ulcer_index:d pain_index:d max_drawdown:d drawdown_duration:i sharpe_ratio:d volatility:d skewness:d kurtosis:d win_rate:d profit_factor:d",
       f"""SELECT b.*, v.var_95, c.cvar_95, d.max_drawdown, d.ulcer_index, d.avg_drawdown AS pain_index, mean * sqrt(252) / abs(d.max_drawdown) AS calmar_ratio, u.mean_duration AS drawdown_duration, t.win_rate, t.profit_factor FROM
       (SELECT series_id, avg(ret) AS mean, avg(ret) / sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) * sqrt(252) AS sortino_ratio, sum(greatest(ret, 0)) / abs(sum(least(ret, 0))) AS omega_ratio,
       avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio, stddev_samp(ret) * sqrt(252) AS volatility, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis FROM {R} GROUP BY series_id) b
       JOIN ({VAR}) v ON v.series_id = b.series_id JOIN (SELECT r.series_id, avg(ret) FILTER (WHERE ret <= var_95) AS cvar_95 FROM {R} r JOIN ({VAR}) v ON v.series_id = r.series_id GROUP BY 1) c ON c.series_id = b.series_id
       JOIN ({DDS}) d ON d.series_id = b.series_id JOIN (SELECT series_id, floor(avg(n)) AS mean_duration FROM (SELECT series_id, run, count(*) FILTER (WHERE dd < 0) AS n FROM ({RUNS}) GROUP BY 1, 2) WHERE n > 0 GROUP BY 1) u ON u.series_id = b.series_id
       JOIN (SELECT series_id, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate, sum(greatest(ret, 0)) / abs(sum(least(ret, 0))) AS profit_factor FROM {R} GROUP BY 1) t ON t.series_id = b.series_id""")
def _(t):
    trades = rets(t).select(F.col("series_id").alias("symbol"), F.col("ret").alias("pnl"))
    return m.risk_report(t.returns_kept, trades, dds(t))


@query("a28_equity_report", "series_id total_return:d sharpe_ratio:d sortino_ratio:d omega_ratio:d volatility:d max_drawdown:d recovery_factor:d",
       f"""WITH e AS (SELECT *, equity / lag(equity) OVER ({S}) - 1 AS r, equity / max(equity) OVER ({S}) - 1 AS dd FROM equity)
       SELECT series_id, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe_ratio, avg(r) / (stddev_samp(r) FILTER (WHERE r < 0)) * sqrt(252) AS sortino_ratio,
       sum(greatest(r, 0)) FILTER (WHERE r IS NOT NULL) / abs(sum(least(r, 0)) FILTER (WHERE r IS NOT NULL)) AS omega_ratio, stddev_samp(r) * sqrt(252) AS volatility, min(dd) AS max_drawdown, (arg_max(equity, ts) / arg_min(equity, ts) - 1) / abs(min(dd)) AS recovery_factor FROM e GROUP BY series_id""")
def _(t):
    return m.equity_report(t.equity_kept)


def rolled(n):
    w = f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT series_id, {n} AS window_bars, avg(sh) AS sharpe, avg(so) AS sortino, avg(wr) AS win_rate FROM (SELECT series_id, row_number() OVER ({S}) AS rn,
    avg({X}) OVER {w} / stddev_pop({X}) OVER {w} * sqrt(252) AS sh, avg({X}) OVER {w} / sqrt(avg(pow(least({X}, 0), 2)) OVER {w}) * sqrt(252) AS so, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER {w} AS wr FROM {R}) WHERE rn >= {n} GROUP BY series_id"""



@query("a29_rolling_robustness", "series_id window_bars:i sharpe:d sortino:d win_rate:d", " UNION ALL ".join(rolled(n) for n in (30, 60, 90, 180)))
def _(t):
    return m.rolling_robustness(t.returns_kept)


def fallen(n):
    return f"""SELECT series_id, {n} AS window_bars, avg(low) AS max_drawdown FROM (SELECT series_id, rn, min((cum - peak) / peak) AS low FROM (SELECT *, max(cum) OVER (PARTITION BY series_id, rn ORDER BY k) AS peak FROM
       (SELECT a.series_id, a.rn, b.rn AS k, exp(sum(ln(1 + b.ret)) OVER (PARTITION BY a.series_id, a.rn ORDER BY b.rn)) AS cum FROM (SELECT series_id, row_number() OVER ({S}) AS rn FROM {R}) a
       JOIN (SELECT series_id, ret, row_number() OVER ({S}) AS rn FROM {R}) b ON b.series_id = a.series_id AND b.rn BETWEEN a.rn - {n - 1} AND a.rn WHERE a.rn >= {n})) GROUP BY 1, 2) GROUP BY 1"""


@query("a29_rolling_drawdown", "series_id window_bars:i max_drawdown:d", " UNION ALL ".join(fallen(n) for n in (30, 60, 90, 180)))
def _(t):
    return m.rolling_drawdowns(t.returns_kept)


@query("a30_liquidity", "symbol avg_volume:d price_impact:d bid_ask_spread:d volume_ratio:d",
       f"""SELECT b.symbol, max(av) AS avg_volume, avg(abs(high - low) / nullif(volume, 0)) AS price_impact, avg(high - low) / arg_max(close, ts) AS bid_ask_spread, arg_max(volume, ts) / max(av) AS volume_ratio
       FROM bars b JOIN (SELECT symbol, avg(volume) AS av FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 20 GROUP BY symbol) v ON v.symbol = b.symbol GROUP BY b.symbol""")
def _(t):
    return m.liquidity(t.bars_kept)


@query("a31_book_metrics", "trade_id:i mid:d spread:d bid_depth:d imbalance:d",
       "SELECT trade_id, (bid_px[1] + ask_px[1]) / 2 AS mid, ask_px[1] - bid_px[1] AS spread, list_sum(qty) AS bid_depth, 0.0::DOUBLE AS imbalance FROM order_book")
def _(t):
    return m.book_metrics(t.order_book)


@query("a32_futures_metrics", "series_id funding_cost:d9 leveraged_sharpe:d leveraged_sortino:d leveraged_drawdown:d",
       f"""WITH j AS (SELECT r.series_id, r.ts, ret * 0.1::DOUBLE AS ret, funding_rate FROM {R} r ASOF LEFT JOIN funding f ON f.symbol = r.series_id AND r.ts >= f.ts), k AS (SELECT *, 3 * ret - {DAILY!r} AS x, exp(sum(ln(1 + 3 * ret)) OVER ({S})) AS cum FROM j),
       d AS (SELECT *, (cum - max(cum) OVER ({S})) / max(cum) OVER ({S}) AS dd FROM k)
       SELECT series_id, sum(funding_rate * ret) AS funding_cost, avg(x) / stddev_pop(x) * sqrt(252) AS leveraged_sharpe, avg(x) / (stddev_pop(x) FILTER (WHERE x < 0)) * sqrt(252) AS leveraged_sortino, abs(min(dd)) AS leveraged_drawdown FROM d GROUP BY series_id""")
def _(t):
    return risk.futures_metrics(rets(t).withColumn("ret", F.col("ret") * 0.1), t.funding, leverage=3.0)


@query("a33_volume_metrics", "symbol avg_relative_volume:d volume_trend:d vwap_efficiency:d",
       f"""WITH x AS (SELECT symbol, close / {lag('close')} - 1 AS r, volume / ({roll('avg', 'volume', 20)}) AS rv, sum((high + low + close) / 3 * volume) OVER ({P}) / sum(volume) OVER ({P}) AS vw FROM bars)
       SELECT x.symbol, avg(rv) AS avg_relative_volume, corr(r, rv) AS volume_trend, avg(abs(r)) FILTER (WHERE r * (vw - mv) > 0) AS vwap_efficiency FROM x JOIN (SELECT symbol, avg(vw) AS mv FROM x GROUP BY symbol) a ON a.symbol = x.symbol GROUP BY x.symbol""")
def _(t):
    return risk.volume_metrics(t.bars_kept)


@query("a34_risk_scores", "symbol weighted:d normalised:d",
       f"""SELECT symbol, least(1.0, lv * 10) * 0.4::DOUBLE + 0.5 * 0.3::DOUBLE + least(1.0, hl * 5) * 0.3::DOUBLE AS weighted, least(1.0, greatest(0.0, sv * 0.3::DOUBLE + vr * 0.4::DOUBLE + 0.5 * 0.3::DOUBLE)) AS normalised FROM
       (SELECT symbol, stddev_samp(lr) AS lv, avg(high - low) / avg(low) AS hl, stddev_samp(sr) AS sv, avg(abs(vc)) AS vr FROM (SELECT *, close / {lag('close')} - 1 AS sr, volume / {lag('volume')} - 1 AS vc FROM ({LR})) GROUP BY symbol)""")
def _(t):
    return risk.risk_scores(t.bars_kept)


@query("a35_position_limits", "symbol regime risk_factor:d liquidity_factor:d max_position:d max_leverage:d kelly:d",
       f"""WITH v AS (SELECT symbol, ts, close, volume, {roll('stddev_samp', 'lr', 20)} AS vol, {roll('avg', 'close', 20)} AS ma, lr FROM ({LR})), d AS (SELECT symbol, max(1 - close / peak) AS mdd FROM (SELECT symbol, close, max(close) OVER ({P}) AS peak FROM bars) GROUP BY symbol),
       q AS (SELECT symbol, quantile_cont(vol, 0.25) AS q1, quantile_cont(vol, 0.75) AS q3, avg(volume) AS av, stddev_samp(lr) AS sd, avg(CASE WHEN lr > 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE lr IS NOT NULL) AS p, avg(lr) FILTER (WHERE lr > 0) / abs(avg(lr) FILTER (WHERE lr < 0)) AS b FROM v GROUP BY symbol),
       l AS (SELECT symbol, arg_max(vol, ts) AS vol, arg_max(close > ma, ts) AS up FROM v GROUP BY symbol), r AS (SELECT q.*, mdd, CASE WHEN vol > q3 THEN 'high_risk_' WHEN vol < q1 THEN 'low_risk_' ELSE '' END || CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS regime
       FROM q JOIN l ON l.symbol = q.symbol JOIN d ON d.symbol = q.symbol), f AS (SELECT *, CASE regime WHEN 'high_risk_bearish' THEN 0.5 WHEN 'high_risk_bullish' THEN 0.7 WHEN 'bearish' THEN 0.6 WHEN 'bullish' THEN 0.9 WHEN 'low_risk_bullish' THEN 1.0 WHEN 'low_risk_bearish' THEN 0.8 ELSE 0.5 END::DOUBLE AS rf,
       CASE WHEN mdd > 0 THEN least(1.0, 0.2::DOUBLE / mdd) ELSE 1.0 END AS risk_factor, least(1.0, av / 20.0::DOUBLE) AS liquidity_factor FROM r)
       SELECT symbol, regime, risk_factor, liquidity_factor, least(least(1.0 / greatest(sd, 0.01::DOUBLE), 1.0) * rf * risk_factor * liquidity_factor, 1.0) AS max_position, least(3.0, 3.0 * risk_factor) AS max_leverage, p - (1 - p) / b AS kelly FROM f""")
def _(t):
    return risk.position_limits(t.bars_kept)


@query("a36_alerts", "symbol metric value:d threshold:d",
       """SELECT * FROM (SELECT symbol, 'avg_loss' AS metric, abs(avg(pnl) FILTER (WHERE pnl < 0)) AS value, 700.0::DOUBLE AS threshold FROM closed_trades GROUP BY symbol UNION ALL SELECT symbol, 'win_rate', count(*) FILTER (WHERE pnl > 0) / count(*), 0.45::DOUBLE FROM closed_trades GROUP BY symbol) WHERE abs(value) > threshold""")
def _(t):
    s = m.trade_stats(t.closed_trades).withColumn("avg_loss", F.abs("avg_loss"))
    return risk.alerts(s, "symbol", {"avg_loss": 700.0, "win_rate": 0.45})


@query("a37_fitness_score", "symbol score:d normalised:d",
       """SELECT symbol, (0.5::DOUBLE * win_rate + 0.5::DOUBLE * profit_factor) * (CASE WHEN worst < -0.045::DOUBLE THEN 0.5 ELSE 1 END) * (CASE WHEN n < 3000 THEN 0.5 ELSE 1 END) AS score,
       (0.3::DOUBLE * greatest(0, sh) / 3.0 + 0.4::DOUBLE * greatest(0, pct) / 100.0 + 0.3::DOUBLE * (1 - least(1.0, abs(worst) / 50.0))) * (CASE WHEN worst < -0.045::DOUBLE THEN 0.5 ELSE 1 END) AS normalised FROM
       (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate, sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))) AS profit_factor, min(ret) AS worst, avg(ret) / stddev_samp(ret) * sqrt(252) AS sh, sum(ret) * 100 AS pct FROM closed_trades GROUP BY symbol)""")
def _(t):
    x = t.closed_trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), m.omega(F.col("pnl")).alias("profit_factor"),
        F.min("ret").alias("max_drawdown"), m.sharpe(F.col("ret")).alias("sharpe_ratio"), (F.sum("ret") * 100).alias("total_profit_pct"))
    return risk.fitness(x, {"win_rate": 0.5, "profit_factor": 0.5}, min_drawdown=-0.045, min_trades=3000, penalty=0.5)


@query("a38_population_stats", "generation:i size:i best:d mean:d std:d gene_std:d oldest:i",
       """SELECT generation, count(*) AS size, max(score) AS best, avg(score) AS mean, stddev_pop(score) AS std, (stddev_pop(fast) + stddev_pop(slow)) / 2 AS gene_std, max(trial_id % 11) AS oldest FROM trials GROUP BY generation""")
def _(t):
    x = t.trials.withColumn("age", F.col("trial_id") % 11)
    return risk.population_stats(x, "generation", "score", ["fast", "slow"], "age")


@query("a39_diversity", "generation:i diversity:d",
       """SELECT a.generation, avg((abs(a.score - b.score) + abs(a.risk - b.risk)) / 2) AS diversity FROM trials a JOIN trials b ON a.generation = b.generation AND a.trial_id < b.trial_id GROUP BY 1""")
def _(t):
    return risk.diversity(t.trials, "generation", "trial_id", ["score", "risk"])


@query("a40_pnl_histogram", "symbol bin:i n:i", """SELECT g.symbol, g.bin, coalesce(n, 0) AS n FROM (SELECT symbol, unnest(range(0, 20)) AS bin FROM (SELECT DISTINCT symbol FROM closed_trades)) g LEFT JOIN
       (SELECT symbol, least(floor((pnl + 5000) / 500), 19) AS bin, count(*) AS n FROM closed_trades WHERE pnl BETWEEN -5000 AND 5000 GROUP BY 1, 2) h ON h.symbol = g.symbol AND h.bin = g.bin""")
def _(t):
    return m.histogram(t.closed_trades, "symbol", "pnl", -5000.0, 5000.0, 20)


@query("a40_clock_histogram", "symbol unit bin:i n:i",
       """SELECT g.symbol, 'hour' AS unit, g.bin, coalesce(n, 0) AS n FROM (SELECT symbol, unnest(range(0, 24)) AS bin FROM (SELECT DISTINCT symbol FROM ticks)) g LEFT JOIN (SELECT symbol, extract('hour' FROM ts) AS bin, count(*) AS n FROM ticks GROUP BY 1, 2) h ON h.symbol = g.symbol AND h.bin = g.bin
       UNION ALL SELECT symbol, 'weekday', extract('isodow' FROM ts) - 1, count(*) FROM ticks GROUP BY 1, 3""")
def _(t):
    return m.clock_counts(t.ticks, "symbol", "ts", "hour").withColumn("unit", F.lit("hour")).unionByName(
        m.clock_counts(t.ticks, "symbol", "ts", "weekday").withColumn("unit", F.lit("weekday")))


@query("a41_custom_risk", "symbol ts:t risk_adjusted:d vwap_20:d9 momentum_risk:d",
       f"""SELECT symbol, ts, (r - {DAILY!r}) / nullif({roll('stddev_samp', 'r', 30)}, 0) AS risk_adjusted, ({roll('sum', 'pv', 20)}) / ({roll('sum', 'volume', 20)}) AS vwap_20, close / ({roll('avg', 'close', 14)}) - 1 AS momentum_risk
       FROM (SELECT *, close / {lag('close')} - 1 AS r, close * volume AS pv FROM bars)""")
def _(t):
    return risk.custom_risk(t.bars_kept)


@query("a42_rolling_correlation", "a b ts:t corr:d",
       """WITH p AS (SELECT x.series_id AS a, y.series_id AS b, x.ts, x.ret AS xr, y.ret AS yr FROM returns x JOIN returns y ON x.ts = y.ts AND ((x.series_id = 'click' AND y.series_id IN ('purchase', 'view')) OR (x.series_id = 'error' AND y.series_id = 'signup')) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
       SELECT * FROM (SELECT a, b, ts, CASE WHEN count(*) OVER w = 30 THEN corr(xr, yr) OVER w END AS corr FROM p WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE abs(corr) > 0.3::DOUBLE""")
def _(t):
    watched = t.spark.createDataFrame([("click", "purchase"), ("click", "view"), ("error", "signup")], "a string, b string")
    return risk.rolling_correlation(t.returns_kept, watched, 30, 0.3)


@query("a42_group_exposure", "grp exposure:d4 over_limit",
       """SELECT CASE WHEN symbol IN ('S0', 'S1', 'S2') THEN 'majors' WHEN symbol IN ('S3', 'S4') THEN 'stable' END AS grp, sum(quantity * entry_price) AS exposure, sum(quantity * entry_price) > 100000000 AS over_limit FROM closed_trades WHERE symbol IN ('S0','S1','S2','S3','S4') GROUP BY 1""")
def _(t):
    return risk.group_exposure(t.closed_trades, {"majors": (["S0", "S1", "S2"], 1e8), "stable": (["S3", "S4"], 1e8)})


@query("a43_rollup_status", "exchange symbol points:i last_update:t", "SELECT exchange, symbol, count(*) AS points, max(ts) AS last_update FROM ticks GROUP BY ROLLUP (exchange, symbol)")
def _(t):
    return m.rollup_status(t.ticks)


@query("a43_rollup_timeframes", "exchange symbol timeframe points:i last_update:t",
       """SELECT exchange, symbol, timeframe, count(*) AS points, max(ts) AS last_update FROM (SELECT DISTINCT exchange, symbol, '1h' AS timeframe, date_trunc('hour', ts) AS ts FROM ticks
       UNION ALL SELECT DISTINCT exchange, symbol, '1d', date_trunc('day', ts) FROM ticks) GROUP BY ROLLUP (exchange, symbol, timeframe)""")
def _(t):
    bars = [t.bars_every("exchange", "symbol", unit=u).withColumn("timeframe", F.lit(f)) for u, f in (("hour", "1h"), ("day", "1d"))]
    return m.rollup_status(bars[0].unionByName(bars[1]), ("exchange", "symbol", "timeframe"))


@query("a44_prediction_quality", "symbol mse:d mae:d direction_accuracy:d bias:d variance:d confidence:d",
       "SELECT symbol, avg(pow(pred - actual, 2)) AS mse, avg(abs(pred - actual)) AS mae, avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0::DOUBLE ELSE 0.0 END) AS direction_accuracy, avg(pred) AS bias, var_pop(pred) AS variance, avg(abs(pred)) AS confidence FROM scored GROUP BY symbol")
def _(t):
    return m.prediction_quality(t.scored)


RUNS4 = "(SELECT symbol, epoch(ts) AS id, run, pred * (1 + 0.1::DOUBLE * run) + 0.01::DOUBLE * run * actual AS pred FROM scored, (SELECT unnest([0,1,2,3]) AS run))"


@query("a45_prediction_stability", "symbol mean_std:d prediction_range:d consistency:d",
       f"""SELECT s.symbol, mean_std, prediction_range, consistency FROM (SELECT symbol, avg(s) AS mean_std, max(hi) - min(lo) AS prediction_range FROM (SELECT symbol, id, stddev_pop(pred) AS s, min(pred) AS lo, max(pred) AS hi FROM {RUNS4} GROUP BY 1, 2) GROUP BY symbol) s
       JOIN (SELECT symbol, avg(c) AS consistency FROM (SELECT a.symbol, a.run, corr(a.pred, b.pred) AS c FROM {RUNS4} a JOIN {RUNS4} b ON a.symbol = b.symbol AND a.id = b.id AND b.run = 0 WHERE a.run > 0 GROUP BY 1, 2) GROUP BY symbol) c ON c.symbol = s.symbol""")
def _(t):
    run = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("run")
    runs = t.scored_kept.select("symbol", F.unix_seconds("ts").alias("id"), "pred", "actual", run)
    return m.stability_over_runs(runs.withColumn("pred", F.col("pred") * (1 + 0.1 * F.col("run")) + 0.01 * F.col("run") * F.col("actual")))


@query("a46_decision_boundary", "symbol i:i flip_rate:d",
       f"""WITH l AS (SELECT symbol, min(pred) AS lo, max(pred) AS hi FROM scored GROUP BY symbol), s AS (SELECT symbol, pred, lag(pred) OVER ({P}) AS prev FROM scored)
       SELECT s.symbol, i, avg(CASE WHEN (pred > th) <> (prev > th) THEN 1.0::DOUBLE ELSE 0.0 END) AS flip_rate FROM s JOIN (SELECT symbol, i, CASE WHEN i = 99 THEN hi ELSE lo + i * (hi - lo) / 99.0::DOUBLE END AS th FROM l, (SELECT unnest(range(0, 100)) AS i)) h ON h.symbol = s.symbol WHERE prev IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return m.boundary_stability(t.scored_kept)


@query("a46_decision_quartiles", "symbol q1:d q2:d q3:d", "SELECT symbol, quantile_cont(pred, 0.25) AS q1, quantile_cont(pred, 0.5) AS q2, quantile_cont(pred, 0.75) AS q3 FROM scored GROUP BY symbol")
def _(t):
    return quantiles(t.scored_kept, "symbol", "pred", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("a47_regime_sensitivity", "symbol regime mean_prediction:d std_prediction:d confidence:d",
       f"""WITH v AS (SELECT symbol, ts, coalesce({roll('stddev_samp', 'lr', 20)}, 0) AS vol, close FROM ({LR})), q AS (SELECT symbol, quantile_cont(vol, 0.25) AS q1, quantile_cont(vol, 0.75) AS q3 FROM v GROUP BY symbol),
       f AS (SELECT symbol, ts, (close - f) / f AS trend FROM (SELECT *, coalesce(m, first_value(m IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM ({BB}))),
       x AS (SELECT s.symbol, pred, unnest([CASE WHEN vol > q3 THEN 'high_volatility' END, CASE WHEN vol < q1 THEN 'low_volatility' END, CASE WHEN trend > 0 THEN 'uptrend' END, CASE WHEN trend < 0 THEN 'downtrend' END]) AS regime
       FROM scored s JOIN v ON v.symbol = s.symbol AND v.ts = s.ts JOIN q ON q.symbol = s.symbol JOIN f ON f.symbol = s.symbol AND f.ts = s.ts)
       SELECT symbol, regime, avg(pred) AS mean_prediction, stddev_pop(pred) AS std_prediction, avg(abs(pred)) AS confidence FROM x WHERE regime IS NOT NULL GROUP BY 1, 2""")
def _(t):
    x = ind.add_indicators(t.bars_kept, {"volatility": {"n": 20, "periods": 1}, "ma_deviation": {"n": 20}})
    x = settle(x.select("symbol", "ts", F.coalesce("volatility", F.lit(0.0)).alias("volatility"), F.col("ma_deviation").alias("trend")), "regimes")
    x = attach(x, quantiles(x, "symbol", "volatility", {"p25": 0.25, "p75": 0.75}), "symbol")
    return m.regime_sensitivity(t.scored_kept.join(x, ["symbol", "ts"]))


CLS = "CASE WHEN {c} > 0.01::DOUBLE THEN 1 WHEN {c} < -0.01::DOUBLE THEN -1 ELSE 0 END"


@query("a48_class_report", "symbol label:i true_positive:i precision:d recall:d",
       f"""SELECT symbol, label, count(*) FILTER (WHERE p = label AND a = label) AS true_positive, count(*) FILTER (WHERE p = label AND a = label) / nullif(count(*) FILTER (WHERE p = label), 0) AS precision,
       count(*) FILTER (WHERE p = label AND a = label) / nullif(count(*) FILTER (WHERE a = label), 0) AS recall FROM (SELECT symbol, {CLS.format(c='pred')} AS p, {CLS.format(c='actual')} AS a FROM scored), (SELECT unnest([-1, 0, 1]) AS label) GROUP BY 1, 2""")
def _(t):
    return m.class_report(t.scored)


@query("a48_confusion_matrix", "symbol predicted:i actual:i rows:i",
       f"SELECT symbol, {CLS.format(c='pred')} AS predicted, {CLS.format(c='actual')} AS actual, count(*) AS rows FROM scored GROUP BY 1, 2, 3")
def _(t):
    return m.confusion_matrix(t.scored)


@query("a49_market_snapshot", "symbol ts:t close:d volume:d volatility:d trend_sign:d",
       f"""SELECT symbol, ts, close, volume, vol AS volatility, sign(close - ma) AS trend_sign FROM (SELECT *, {roll('stddev_samp', 'lr', 20)} * sqrt(252) AS vol, {roll('avg', 'close', 20)} AS ma, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ({LR})) WHERE r = 1""")
def _(t):
    return m.market_snapshot(t.bars_kept)


@query("a50_class_weights", "symbol label:i weight:d",
       f"WITH n AS (SELECT symbol, {CLS.format(c='actual')} AS label, count(*) AS c FROM scored GROUP BY 1, 2) SELECT symbol, label, sum(c) OVER (PARTITION BY symbol) / (count(*) OVER (PARTITION BY symbol) * c) AS weight FROM n")
def _(t):
    a = F.col("actual")
    return m.class_weights(t.scored.withColumn("label", F.when(a > 0.01, 1).when(a < -0.01, -1).otherwise(0)), "label", "symbol")


@query("a51_expectancy", "symbol expectancy:d4 risk_reward:d",
       """SELECT symbol, p * w - q * l AS expectancy, w / l AS risk_reward FROM (SELECT symbol, count(*) FILTER (WHERE pnl > 0) / count(*) AS p, count(*) FILTER (WHERE pnl < 0) / count(*) AS q, avg(pnl) FILTER (WHERE pnl > 0) AS w, abs(avg(pnl) FILTER (WHERE pnl < 0)) AS l FROM closed_trades GROUP BY symbol)""")
def _(t):
    return m.trade_stats(t.closed_trades)


@query("a52_optimisation_summary", "objective generations:i initial:d final:d improvement:d",
       """WITH g AS (SELECT generation, max(score) AS s, max(risk) AS r FROM trials GROUP BY generation) SELECT 'score' AS objective, count(*) AS generations, arg_min(s, generation) AS initial, arg_max(s, generation) AS final, arg_max(s, generation) - arg_min(s, generation) AS improvement FROM g
       UNION ALL SELECT 'risk', count(*), arg_min(r, generation), arg_max(r, generation), arg_max(r, generation) - arg_min(r, generation) FROM g""")
def _(t):
    return risk.optimisation_summary(t.trials, "generation", ["score", "risk"])


@query("a52_generation_averages", "objective generation:i best:d average:d",
       "SELECT 'score' AS objective, generation, max(score) AS best, avg(score) AS average FROM trials GROUP BY generation UNION ALL SELECT 'risk', generation, max(risk), avg(risk) FROM trials GROUP BY generation")
def _(t):
    return risk.generation_averages(t.trials, "generation", ["score", "risk"])


@query("a53_metrics_per_period", "series_id unit period:t n:i sharpe:d sortino:d max_drawdown:d calmar:d",
       f"""WITH x AS (SELECT series_id, unit, ts, ret, CASE unit WHEN 'day' THEN date_trunc('day', ts) WHEN 'week' THEN date_trunc('week', ts) ELSE date_trunc('month', ts) END AS period FROM {R}, (SELECT unnest(['day', 'week', 'month']) AS unit)),
       c AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS cum FROM x WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series_id, unit, period ORDER BY ts)),
       d AS (SELECT series_id, unit, period, min(cum / peak - 1) AS low FROM (SELECT *, max(cum) OVER (PARTITION BY series_id, unit, period ORDER BY ts) AS peak FROM c) GROUP BY 1, 2, 3)
       SELECT x.series_id, x.unit, x.period, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(sqrt(avg(ret * ret) FILTER (WHERE ret < 0)), 0) * sqrt(252) AS sortino,
       any_value(low) AS max_drawdown, avg(ret) * 252 / nullif(abs(any_value(low)), 0) AS calmar FROM x LEFT JOIN d ON d.series_id = x.series_id AND d.unit = x.unit AND d.period = x.period GROUP BY 1, 2, 3""")
def _(t):
    return m.per_period(rets(t))
