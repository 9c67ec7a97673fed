"""Queries: anomalies, drift, regimes, simulation, sweeps and Pareto fronts."""

from pyspark.sql import functions as F

from tidewater.catalog.features import SENT, gauss, uni
from tidewater.catalog.indicators import LR
from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, lag, roll, rows
from tidewater.functions.scalars import uniform
from tidewater.operators import anomaly, features, metrics, regime, sweep, text
from tidewater.plans import skyline
from tidewater.session import settle

K = "OVER (PARTITION BY symbol)"


def z(c, src=K):
    return f"coalesce(abs(({c} - avg({c}) {src}) / nullif(stddev_pop({c}) {src}, 0)) > 3, false)"


@query("n01_z_anomalies", "symbol ts:t anomaly", f"SELECT symbol, ts, {z('close')} OR {z('volume')} AS anomaly FROM bars_with_outliers")
def _(t):
    return anomaly.z_anomalies(t.bars_with_outliers, "symbol", ["close", "volume"])


WAIT = "SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6::DOUBLE AS wait, event_type AS symbol FROM events"


@query("n02_fraud_rates", "symbol amount_anomaly:d time_anomaly:d fraud:d",
       f"""SELECT symbol, avg(a::INT::DOUBLE) AS amount_anomaly, avg(w::INT::DOUBLE) AS time_anomaly, avg((a OR w)::INT::DOUBLE) AS fraud FROM (SELECT symbol, {z('value')} AS a, {z('wait')} AS w FROM ({WAIT})) GROUP BY symbol""")
def _(t):
    f = anomaly.fraud_flags(t.events.withColumn("symbol", F.col("event_type")), "symbol", "value", "user_id")
    return anomaly.flag_rates(f, "symbol", ["amount_anomaly", "time_anomaly", "fraud"])


ENS = f"""SELECT b.*, {z('close')} OR {z('volume')} AS za, close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1) OR volume < v1 - 1.5 * (v3 - v1) OR volume > v3 + 1.5 * (v3 - v1) AS ia FROM
    (SELECT b.*, q1, q3, v1, v3 FROM bars_with_outliers b JOIN (SELECT symbol AS s, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, quantile_cont(volume, 0.25) AS v1, quantile_cont(volume, 0.75) AS v3 FROM bars_with_outliers GROUP BY 1) q ON q.s = b.symbol) b"""


@query("n03_ensemble_anomalies", "symbol z_anomaly:d iqr_anomaly:d anomaly:d", f"SELECT symbol, avg(za::INT::DOUBLE) AS z_anomaly, avg(ia::INT::DOUBLE) AS iqr_anomaly, avg((za OR ia)::INT::DOUBLE) AS anomaly FROM ({ENS}) GROUP BY symbol")
def _(t):
    e = anomaly.ensemble_anomalies(t.bars_with_outliers, "symbol", ["close", "volume"])
    return anomaly.flag_rates(e, "symbol", ["z_anomaly", "iqr_anomaly", "anomaly"])


@query("n04_reconstruction_anomalies", "symbol rows:i anomalies:i mean_error:d")
def _(t):
    r = anomaly.reconstruction_anomalies(t.bars_with_outliers, ["open", "high", "low", "close", "volume"])
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anomaly").alias("anomalies"), F.avg("error").alias("mean_error"))


ANOM = f"(SELECT *, {z('close')} OR {z('volume')} AS a FROM bars_with_outliers)"


@query("n05_anomaly_patterns", "symbol feature n:i mean:d std:d min:d max:d", " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS feature, count(*) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM {ANOM} WHERE a GROUP BY symbol" for c in ("close", "volume")))
def _(t):
    return anomaly.anomaly_patterns(anomaly.z_anomalies(t.bars_with_outliers, "symbol", ["close", "volume"]), "symbol", ["close", "volume"])


@query("n05_anomaly_clock", "symbol bin:i n:i", f"SELECT s.symbol, g.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol FROM {ANOM} WHERE a) s, (SELECT unnest(range(0, 24)) AS bin) g LEFT JOIN (SELECT symbol, extract('hour' FROM ts) AS bin, count(*) AS n FROM {ANOM} WHERE a GROUP BY 1, 2) h ON h.symbol = s.symbol AND h.bin = g.bin")
def _(t):
    a = anomaly.z_anomalies(t.bars_with_outliers, "symbol", ["close", "volume"]).where("anomaly")
    return metrics.clock_counts(settle(a, "anomalies"), "symbol", "ts", "hour")


@query("n06_ks_drift", "symbol distance:d n:i m:i critical:d drift",
       """WITH x AS (SELECT symbol, price AS v, ts >= TIMESTAMP '2024-01-16' AS live FROM ticks), c AS (SELECT symbol, count(*) FILTER (WHERE NOT live) AS n, count(*) FILTER (WHERE live) AS m FROM x GROUP BY symbol),
       e AS (SELECT symbol, v, sum(CASE WHEN live THEN 0 ELSE 1 END) OVER w AS a, sum(CASE WHEN live THEN 1 ELSE 0 END) OVER w AS b FROM x WINDOW w AS (PARTITION BY symbol ORDER BY v))
       SELECT c.symbol, max(abs(a / n - b / m)) AS distance, max(n) AS n, max(m) AS m, 1.628::DOUBLE * sqrt((max(n) + max(m)) / (max(n) * max(m))) AS critical, max(abs(a / n - b / m)) > 1.628::DOUBLE * sqrt((max(n) + max(m)) / (max(n) * max(m))) AS drift
       FROM e JOIN c ON c.symbol = e.symbol GROUP BY c.symbol""")
def _(t):
    return anomaly.ks_drift(t.ticks, "symbol", "price", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))


@query("n07_overall_regime", "symbol volatility:d trend:d9 regime",
       f"""SELECT symbol, v AS volatility, tr AS trend, CASE WHEN v > 0.2::DOUBLE THEN 'volatile' WHEN abs(tr) > 0.00001::DOUBLE THEN 'trending' ELSE 'ranging' END AS regime FROM (SELECT symbol, stddev_samp(lr) AS v, regr_slope(close, pos) / (avg(close) + 1e-8) AS tr FROM
       (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM ({LR})) GROUP BY symbol)""")
def _(t):
    return regime.overall_regime(t.bars_kept, 0.2, 0.00001)


ROLL = f"""SELECT symbol, ts, CASE WHEN vol > 0.18::DOUBLE THEN 'volatile' WHEN abs(slope / ma) > 0.002::DOUBLE THEN 'trending' ELSE 'ranging' END AS regime FROM (SELECT symbol, ts, {roll('stddev_samp', 'lr', 20)} AS vol, {roll('avg', 'close', 20)} AS ma,
    CASE WHEN pos >= 19 THEN regr_slope(close, pos) OVER {rows(20)} END AS slope FROM (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM ({LR})))"""


def labelled(t):
    return settle(regime.rolling_regime(t.bars_kept, 20, 0.18, 0.002).select("symbol", "ts", "regime"), "labelled")


@query("n07_rolling_regime", "symbol ts:t regime", ROLL)
def _(t):
    return regime.rolling_regime(t.bars_kept, 20, 0.18, 0.002)


@query("n08_sentiment_regime", "symbol volatility:d regime sentiment avg_polarity:d confidence:d",
       f"""SELECT symbol, v AS volatility, CASE WHEN v > 0.25::DOUBLE THEN 'high_volatility' WHEN v < 0.125::DOUBLE THEN 'low_volatility' ELSE 'medium_volatility' END AS regime, CASE WHEN p > 0.1::DOUBLE THEN 'bullish' WHEN p < -0.1::DOUBLE THEN 'bearish' ELSE 'neutral' END AS sentiment,
       p AS avg_polarity, 1 - abs(p) AS confidence FROM (SELECT symbol, stddev_pop(r) AS v FROM (SELECT symbol, close / {lag('close')} - 1 AS r FROM bars) GROUP BY symbol), (SELECT avg(polarity) AS p FROM ({SENT}))""")
def _(t):
    scores = text.sentiment(t.news, text.labelled_lexicon(t.news, t.read("labels")))
    return regime.sentiment_regime(t.bars_kept, scores, 0.25, 0.1)


@query("n09_cluster_performance", "regime:i bars:i volatility:d sharpe:d sortino:d win_rate:d profit_factor:d")
def _(t):
    return regime.cluster_performance(t.bars_kept)


@query("n10_volume_score", "symbol volume_score:d", "SELECT symbol, 1 / (1 + exp(-(arg_max(volume, ts) - avg(volume)) / stddev_pop(volume))) AS volume_score FROM bars GROUP BY symbol")
def _(t):
    return regime.overall_regime(t.bars_kept, 0.2, 0.00001)


CHG = f"SELECT *, {lag('regime')} AS prev FROM ({ROLL})"


@query("n11_regime_segments", "symbol regime start_ts:t end_ts:t bars:i",
       f"""SELECT symbol, any_value(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bars FROM (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> regime THEN 1 ELSE 0 END) OVER ({P}) AS seg FROM ({CHG})) GROUP BY symbol, seg""")
def _(t):
    return regime.regime_segments(labelled(t))


@query("n11_regime_transitions", "symbol previous regime n:i probability:d",
       f"SELECT symbol, prev AS previous, regime, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol, prev) AS probability FROM ({CHG}) WHERE prev IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return regime.transitions(labelled(t))


@query("n12_change_points", "symbol ts:t shift:d",
       f"""WITH s AS (SELECT symbol, ts, CASE WHEN count(*) OVER l = 24 AND count(*) OVER r = 24 THEN (avg(close) OVER r - avg(close) OVER l) / nullif(sqrt((var_samp(close) OVER l + var_samp(close) OVER r) / 24), 0) END AS shift FROM bars
       WINDOW l AS ({P} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), r AS ({P} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))
       SELECT symbol, ts, shift FROM (SELECT *, max(abs(shift)) OVER ({P} ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS top FROM s) WHERE abs(shift) = top AND abs(shift) > 2""")
def _(t):
    return regime.change_points(t.bars_kept)


@query("n13_volatility_label", "symbol ts:t risk",
       f"""WITH v AS (SELECT symbol, ts, {roll('stddev_samp', 'lr', 20)} * sqrt(252) AS v FROM ({LR})), q AS (SELECT symbol, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY symbol)
       SELECT v.symbol, ts, CASE WHEN v > q3 THEN 'high_risk' WHEN v < q1 THEN 'low_risk' WHEN v IS NOT NULL THEN 'normal' END AS risk FROM v JOIN q ON q.symbol = v.symbol""")
def _(t):
    return regime.volatility_label(t.bars_kept)


@query("n14_stress_test", "series_id var_99:d es_99:d worst:d",
       f"""WITH f AS (SELECT series_id, avg(ret) AS mu, stddev_pop(ret) AS sigma FROM returns WHERE ret IS NOT NULL GROUP BY series_id), s AS (SELECT series_id, mu + CASE WHEN scenario >= 1000 THEN 3 ELSE 1 END * sigma * {gauss('series_id', 'scenario', 'i', 7)} AS ret
       FROM f, (SELECT unnest(range(0, 1250)) AS scenario), (SELECT unnest(range(1, 25)) AS i)), q AS (SELECT series_id, quantile_cont(ret, 0.01) AS v FROM s GROUP BY series_id)
       SELECT s.series_id, max(v) AS var_99, avg(ret) FILTER (WHERE ret < v) AS es_99, min(ret) AS worst FROM s JOIN q ON q.series_id = s.series_id GROUP BY s.series_id""")
def _(t):
    return anomaly.stress_report(anomaly.monte_carlo(t.returns_kept))


@query("n14_liquidity_stress", "symbol stress:d",
       f"""WITH f AS (SELECT symbol, avg(ln(volume)) AS mu, stddev_pop(ln(volume)) AS sigma, avg(volume) AS mean FROM bars WHERE volume > 0 GROUP BY symbol) SELECT f.symbol, max(q) / max(mean) AS stress FROM f JOIN
       (SELECT symbol, quantile_cont(exp(mu + sigma * {gauss('symbol', 'i', 11)}), 0.01) AS q FROM f, (SELECT unnest(range(1, 1001)) AS i) GROUP BY symbol) d ON d.symbol = f.symbol GROUP BY f.symbol""")
def _(t):
    return anomaly.liquidity_stress(t.bars_kept)


@query("n15_stationarity", "symbol t_stat:d stationary",
       f"""SELECT symbol, (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t_stat, (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) < -2.86::DOUBLE AS stationary FROM
       (SELECT symbol, count(*) AS n, regr_sxx(d, l) AS sxx, regr_sxy(d, l) AS sxy, regr_syy(d, l) AS syy FROM (SELECT symbol, {lag('close')} AS l, close - {lag('close')} AS d FROM bars) WHERE l IS NOT NULL GROUP BY symbol)""")
def _(t):
    return anomaly.dickey_fuller(t.bars_kept)


@query("n16_autocorrelation", "symbol k:i autocorrelation:d", " UNION ALL ".join(
    f"SELECT symbol, {k} AS k, corr(close, l) AS autocorrelation FROM (SELECT symbol, close, {lag('close', k)} AS l FROM bars) GROUP BY symbol" for k in (1, 2, 5, 24)))
def _(t):
    return anomaly.autocorrelation(t.bars_kept, [1, 2, 5, 24])


@query("n16_normality", "series_id jarque_bera:d2 normal",
       """SELECT series_id, n / 6 * (s * s + k * k / 4) AS jarque_bera, n / 6 * (s * s + k * k / 4) < 5.991::DOUBLE AS normal FROM (SELECT series_id, count(ret)::DOUBLE AS n, skewness(ret) * (count(ret) - 2) / sqrt(count(ret)::DOUBLE * (count(ret) - 1)) AS s, kurtosis_pop(ret) AS k FROM returns WHERE ret IS NOT NULL GROUP BY series_id)""")
def _(t):
    return anomaly.normality(t.returns_kept.where("ret IS NOT NULL"), "series_id", "ret")


@query("n16_seasonality", "symbol unit slot:i mean:d n:i",
       "SELECT symbol, 'hour' AS unit, extract('hour' FROM ts) AS slot, avg(close) AS mean, count(*) AS n FROM bars GROUP BY 1, 3 UNION ALL SELECT symbol, 'weekday', extract('isodow' FROM ts) - 1, avg(close), count(*) FROM bars GROUP BY 1, 3")
def _(t):
    return anomaly.seasonality(t.bars, "symbol", "close")


@query("n17_forest_importance", "feature importance:d")
def _(t):
    x = features.direction_targets(t.bars_kept, 1)
    return anomaly.forest_importance(x, ["open", "high", "low", "close", "volume"], "target_return")


@query("n18_permutation_importance", "symbol feature importance:d",
       f"""WITH b AS (SELECT *, row_number() OVER ({P}) AS k, row_number() OVER (PARTITION BY symbol ORDER BY {uni('symbol', 'epoch_us(ts)', 5)}, ts) AS s FROM bars), j AS (SELECT b.symbol, b.close, b.volume, s.close AS sc, s.volume AS sv FROM b JOIN b s ON s.symbol = b.symbol AND s.s = b.k)
       SELECT symbol, 'close' AS feature, avg(abs(0.7::DOUBLE * (sc - close))) AS importance FROM j GROUP BY symbol UNION ALL SELECT symbol, 'volume', avg(abs(0.3::DOUBLE * (sv - volume))) FROM j GROUP BY symbol""")
def _(t):
    return anomaly.permutation_importance(t.bars_kept, ["close", "volume"], 0.7 * F.col("close") + 0.3 * F.col("volume"))


@query("n19_history_trends", "symbol performance_trend:d9 risk_trend:d9 stability:d9 last_performance:d9",
       """WITH h AS (SELECT symbol, date_trunc('month', exit_time) AS month, avg(ret) AS performance, stddev_pop(ret) AS risk FROM closed_trades GROUP BY 1, 2), m AS (SELECT symbol, month, performance, row_number() OVER w AS x, performance - lag(performance) OVER w AS dp, risk - lag(risk) OVER w AS dr,
       CASE WHEN count(*) OVER r = 10 THEN avg(performance) OVER r END AS pm, CASE WHEN count(*) OVER r = 10 THEN avg(risk) OVER r END AS rm FROM h WINDOW w AS (PARTITION BY symbol ORDER BY month), r AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
       SELECT symbol, regr_slope(pm, x) AS performance_trend, regr_slope(rm, x) AS risk_trend, (2 - stddev_pop(dp) - stddev_pop(dr)) / 2 AS stability, arg_max(performance, month) AS last_performance FROM m GROUP BY symbol""")
def _(t):
    h = t.closed_trades.groupBy("symbol", F.date_trunc("month", "exit_time").alias("month")).agg(F.avg("ret").alias("performance"), F.stddev_pop("ret").alias("risk"))
    return anomaly.history_trends(settle(h, "history"), "symbol", ["month"], F.year("month"), ["performance", "risk"])


@query("n20_volatility_change", "symbol current_volatility:d volatility_change:d confidence:d",
       f"""SELECT symbol, c AS current_volatility, (p - c) / c AS volatility_change, 1 - abs((p - c) / c) AS confidence FROM (SELECT symbol, stddev_pop(close) FILTER (WHERE r <= 20) AS c, arg_max(high - low, ts) AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) GROUP BY symbol)""")
def _(t):
    return anomaly.volatility_change(t.bars_kept.withColumn("predicted", F.col("high") - F.col("low")))


# -- sweeps -------------------------------------------------------------------------------
@query("g01_parameter_grid", "fast:i slow:i", "SELECT DISTINCT a.fast, b.slow FROM (SELECT DISTINCT fast FROM trials) a, (SELECT DISTINCT slow FROM trials) b")
def _(t):
    return sweep.parameter_grid(t.trials.agg(F.collect_set("fast").alias("fast"), F.collect_set("slow").alias("slow")))


@query("g02_random_parameters", "trial_id:i length:i threshold:d kind",
       f"SELECT trial_id, floor({uni('trial_id', repr("length"), 1)} * 46) + 5 AS length, {uni('trial_id', repr('threshold'), 1)} * 2 + 0.5::DOUBLE AS threshold, (['sma', 'ema', 'wma'])[CAST(floor({uni('trial_id', repr('kind'), 1)} * 3) AS INTEGER) + 1] AS kind FROM trials")
def _(t):
    return sweep.sample_parameters(t.trials, "trial_id", {"length": (5, 50, "int"), "threshold": (0.5, 2.5), "kind": ("pick", ["sma", "ema", "wma"])})


PARAMS = [(f, s) for f in (5, 10) for s in (20, 50)]


def strat(f, s):
    side = f"SELECT *, sign(({roll('avg', 'close', f)}) - ({roll('avg', 'close', s)})) AS sg FROM bars"
    return f"SELECT symbol, ts, {f} AS fast, {s} AS slow, {lag('sg')} * (close / {lag('close')} - 1) AS sr FROM ({side})"


STRAT = " UNION ALL ".join(strat(f, s) for f, s in PARAMS)


@query("g03_strategy_sweep", "fast:i slow:i symbol n:i total:d sharpe:d win_rate:d",
       f"SELECT fast, slow, symbol, count(*) AS n, sum(sr) AS total, avg(sr) / nullif(stddev_samp(sr), 0) * sqrt(252) AS sharpe, avg(CASE WHEN sr > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS win_rate FROM ({STRAT}) WHERE sr IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return sweep.sweep_report(sweep.ma_cross_returns(t.bars_kept, PARAMS))


REP = "SELECT fast, slow, count(*) AS trials, avg(score) AS mean, stddev_pop(score) AS std FROM trials GROUP BY 1, 2"


@query("g04_repeated_trials", "fast:i slow:i trials:i mean:d std:d", REP)
def _(t):
    return sweep.repeated_trials(t.trials, ["fast", "slow"])


@query("g04_best_combination", "fast:i slow:i mean:d", f"SELECT fast, slow, mean FROM ({REP}) ORDER BY mean DESC, fast DESC, slow DESC LIMIT 1")
def _(t):
    return sweep.best_combination(sweep.repeated_trials(t.trials, ["fast", "slow"]), ["fast", "slow"])


@query("g05_top_strategies", "trial_id:i score:d", "SELECT trial_id, score FROM trials ORDER BY score DESC, trial_id LIMIT 20")
def _(t):
    return t.trials.orderBy(F.desc("score"), "trial_id").limit(20)


@query("g06_sensitivity", "param value:i score:d risk:d", "SELECT 'fast' AS param, fast AS value, avg(score) AS score, avg(risk) AS risk FROM trials GROUP BY 2 UNION ALL SELECT 'slow', slow, avg(score), avg(risk) FROM trials GROUP BY 2")
def _(t):
    return sweep.sensitivity(t.trials, ["fast", "slow"], ["score", "risk"])


@query("g07_running_best", "generation:i trial_id:i best:d", "SELECT generation, trial_id, max(score) OVER (PARTITION BY generation ORDER BY trial_id) AS best FROM trials")
def _(t):
    return sweep.running_best(t.trials, "generation", "trial_id", "score")


def sobol_sql(names):
    u = lambda n, s: uni("trial_id", repr(n), repr(s), 3)
    f = lambda p, q: f"({p} + 2 * {q} + {p} * {q})"
    x = f"SELECT {f(u('p', 'a'), u('q', 'a'))} AS fa, {f(u('p', 'b'), u('q', 'b'))} AS fb, {f(u('p', 'b'), u('q', 'a'))} AS ab_p, {f(u('p', 'a'), u('q', 'b'))} AS ab_q FROM trials"
    v = "(sum(fa * fa + fb * fb) / (2.0::DOUBLE * count(*)) - pow(sum(fa + fb) / (2.0::DOUBLE * count(*)), 2))"
    return " UNION ALL ".join(f"SELECT '{n}' AS param, avg(fb * (ab_{n} - fa)) / {v} AS s1, avg(pow(fa - ab_{n}, 2)) / 2 / {v} AS st FROM ({x})" for n in names)


@query("g08_sobol_indices", "param s1:d st:d", sobol_sql(["p", "q"]))
def _(t):
    return sweep.sobol_indices(t.trials, "trial_id", ["p", "q"], lambda c: c["p"] + 2 * c["q"] + c["p"] * c["q"])


@query("g09_pareto_front", "cand_id:i obj1:d obj2:d", "SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.obj1 > c.obj1 AND d.obj2 > c.obj2)")
def _(t):
    return sweep.pareto_front(t.candidates, "cand_id", "obj1", "obj2")


@query("g09_pareto_front_weak", "cand_id:i obj1:d obj2:d", "SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.obj1 >= c.obj1 AND d.obj2 >= c.obj2 AND (d.obj1 > c.obj1 OR d.obj2 > c.obj2))")
def _(t):
    return sweep.pareto_front(t.candidates, "cand_id", "obj1", "obj2", strict=False)


THREE = "SELECT p_partkey AS cand_id, CAST(p_retailprice AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS c FROM part"
GOALS = ["a", "b", "c"]


def three(t):
    """Candidates with three objectives, all maximised."""
    return t.read("part").select(F.col("p_partkey").alias("cand_id"), F.col("p_retailprice").cast("double").alias("a"), F.col("p_size").cast("double").alias("b"),
                                 (F.col("p_partkey") * 7919 % 1009).cast("double").alias("c"))


def front_sql(source, strict):
    beats = "d.a > c.a AND d.b > c.b AND d.c > c.c" if strict else "d.a >= c.a AND d.b >= c.b AND d.c >= c.c AND (d.a > c.a OR d.b > c.b OR d.c > c.c)"
    return f"SELECT * FROM {source} c WHERE NOT EXISTS (SELECT 1 FROM {source} d WHERE {beats})"


@query("g09_front_of_three", "cand_id:i a:d b:d c:d", f"WITH k AS ({THREE}) {front_sql('k', True)}")
def _(t):
    return skyline.skyline(three(t), GOALS)


@query("g09_front_of_three_weak", "cand_id:i a:d b:d c:d", f"WITH k AS ({THREE}) {front_sql('k', False)}")
def _(t):
    return skyline.skyline(three(t), GOALS, strict=False)


PEELED = f"""WITH k AS ({THREE}), r0 AS ({front_sql('k', False)}), k1 AS (SELECT * FROM k ANTI JOIN r0 USING (cand_id)), r1 AS ({front_sql('k1', False)}), k2 AS (SELECT * FROM k1 ANTI JOIN r1 USING (cand_id)), r2 AS ({front_sql('k2', False)}),
       r AS (SELECT *, 0 AS rank FROM r0 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2)"""
GAPS = ", ".join(f"lead({o}) OVER w{o} - lag({o}) OVER w{o} AS g{o}, max({o}) OVER f - min({o}) OVER f AS r{o}" for o in GOALS)
BY = ", ".join(f"w{o} AS (PARTITION BY rank ORDER BY {o}, cand_id)" for o in GOALS)


@query("g11_crowding_of_three", "cand_id:i rank:i boundary crowding:d",
       f"""{PEELED}, g AS (SELECT *, {GAPS} FROM r WINDOW {BY}, f AS (PARTITION BY rank)) SELECT cand_id, rank, ga IS NULL OR gb IS NULL OR gc IS NULL AS boundary,
       CASE WHEN ga IS NOT NULL AND gb IS NOT NULL AND gc IS NOT NULL THEN coalesce(ga / nullif(ra, 0), 0) + coalesce(gb / nullif(rb, 0), 0) + coalesce(gc / nullif(rc, 0), 0) END AS crowding FROM g""")
def _(t):
    """Crowding distance inside each of the first three fronts."""
    c = sweep.crowding(skyline.fronts(three(t), GOALS, 3), ["rank"], "cand_id", GOALS)
    return c.withColumn("crowding", F.when(~F.col("boundary"), F.col("crowding")))


@query("g12_hypervolume_of_three", "share:d",
       f"""WITH k AS ({THREE}), f AS ({front_sql('k', False)}), m AS (SELECT max(a) AS a, max(b) AS b, max(c) AS c FROM k),
       s AS (SELECT {uni('id', repr('a'), 9)} * a AS a, {uni('id', repr('b'), 9)} * b AS b, {uni('id', repr('c'), 9)} * c AS c FROM m, (SELECT unnest(range(0, 10000)) AS id))
       SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.a >= s.a AND f.b >= s.b AND f.c >= s.c) THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM s""")
def _(t):
    """Share of the box from 0 to the best value of every objective that the front dominates."""
    c = three(t)
    top = c.agg(*[F.max(o).alias(o) for o in GOALS]).first()
    samples = t.spark.range(10_000).select("id", *[(uniform("id", F.lit(o), F.lit(9)) * top[o]).alias(o) for o in GOALS])
    return skyline.dominated_share(skyline.skyline(c, GOALS, strict=False), GOALS, samples)


DOM = "d.generation = c.generation AND d.score <= c.score AND d.risk <= c.risk AND (d.score < c.score OR d.risk < c.risk)"
RANKS = f"""r(trial_id, generation, score, risk, rank) AS (SELECT trial_id, generation, score, risk, 0 FROM trials c WHERE NOT EXISTS (SELECT 1 FROM trials d WHERE {DOM})
    UNION SELECT c.trial_id, c.generation, c.score, c.risk, r.rank + 1 FROM r JOIN trials c ON r.generation = c.generation AND r.score <= c.score AND r.risk <= c.risk AND (r.score < c.score OR r.risk < c.risk))"""
RANKED = f"WITH RECURSIVE {RANKS} SELECT trial_id, any_value(generation) AS generation, any_value(score) AS score, any_value(risk) AS risk, max(rank) AS rank FROM r GROUP BY trial_id"


@query("g10_front_ranks", "trial_id:i generation:i rank:i", RANKED)
def _(t):
    return sweep.front_ranks(t.trials, "generation", "score", "risk")


@query("g11_crowding", "trial_id:i rank:i boundary crowding:d",
       f"""WITH k AS ({RANKED}), g AS (SELECT *, lead(score) OVER a - lag(score) OVER a AS gs, lead(risk) OVER b - lag(risk) OVER b AS gr, max(score) OVER f - min(score) OVER f AS rs, max(risk) OVER f - min(risk) OVER f AS rr FROM k
       WINDOW a AS (PARTITION BY generation, rank ORDER BY score, trial_id), b AS (PARTITION BY generation, rank ORDER BY risk, trial_id), f AS (PARTITION BY generation, rank))
       SELECT trial_id, rank, gs IS NULL OR gr IS NULL AS boundary, CASE WHEN gs IS NOT NULL AND gr IS NOT NULL THEN coalesce(gs / nullif(rs, 0), 0) + coalesce(gr / nullif(rr, 0), 0) END AS crowding FROM g""")
def _(t):
    r = sweep.front_ranks(t.trials, "generation", "score", "risk")
    c = sweep.crowding(r, ["generation", "rank"], "trial_id", ["score", "risk"])
    return c.withColumn("crowding", F.when(~F.col("boundary"), F.col("crowding")))


@query("g12_hypervolume", "share:d hypervolume:d",
       f"""WITH f AS (SELECT * FROM trials c WHERE NOT EXISTS (SELECT 1 FROM trials d WHERE d.score <= c.score AND d.risk <= c.risk AND (d.score < c.score OR d.risk < c.risk))), b AS (SELECT max(score) * 1.1::DOUBLE AS rx, max(risk) * 1.1::DOUBLE AS ry, min(score) AS lx, min(risk) AS ly FROM f),
       s AS (SELECT lx + {uni('id', repr('x'), 9)} * (rx - lx) AS x, ly + {uni('id', repr('y'), 9)} * (ry - ly) AS y FROM b, (SELECT unnest(range(0, 10000)) AS id))
       SELECT h.share, h.share * (rx - lx) * (ry - ly) AS hypervolume FROM (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.score <= s.x AND f.risk <= s.y) THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM s) h, b""")
def _(t):
    flip = t.trials.withColumns({"a": -F.col("score"), "b": -F.col("risk")})
    front = settle(sweep.pareto_front(flip, "trial_id", "a", "b", strict=False).select("score", "risk"), "front")
    return sweep.hypervolume(front, "score", "risk")


@query("g13_cross_validation", "fast:i slow:i symbol score:d9 spread:d9",
       f"""WITH b AS (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, n - (5 - fold + 1) * (n // 6) AS s, n // 6 AS z FROM b, (SELECT unnest([1,2,3,4,5]) AS fold)), k AS (SELECT symbol, ts, fold FROM f WHERE p >= s AND p < s + z)
       SELECT fast, slow, symbol, avg(m) AS score, stddev_pop(m) AS spread FROM (SELECT fast, slow, r.symbol, fold, avg(sr) AS m FROM ({STRAT}) r JOIN k ON k.symbol = r.symbol AND k.ts = r.ts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def _(t):
    return sweep.cross_validated(sweep.ma_cross_returns(t.bars_kept, PARAMS), features.time_series_folds(t.bars_kept, 5))


@query("g14_convergence", "generation:i trial_id:i best:d converged",
       "SELECT generation, trial_id, best, coalesce(best - lag(best, 10) OVER (PARTITION BY generation ORDER BY trial_id) < 0.001::DOUBLE, false) AS converged FROM (SELECT generation, trial_id, max(score) OVER (PARTITION BY generation ORDER BY trial_id) AS best FROM trials)")
def _(t):
    return sweep.convergence(t.trials, "generation", "trial_id", "score")
