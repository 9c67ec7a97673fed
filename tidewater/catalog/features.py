"""Queries: resampling, features, scaling, sequences, splits, text, scalar functions, joins, top-k, set operations."""

from pyspark.sql import functions as F

from tidewater.catalog.ingest import BAR_SPEC, GRID
from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, lag, roll, rows
from tidewater.functions import scalars as fn
from tidewater.operators import features, resample, setops, text
from tidewater.plans.attach import attach
from tidewater.plans.joins import asof_join, interval_join
from tidewater.session import settle

FOUR = "time_bucket(INTERVAL 4 HOUR, ts)"


@query("f01_resample", "symbol ts:t open:d high:d low:d close:d volume:d",
       f"""SELECT symbol, {FOUR} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
       FROM bars GROUP BY symbol, {FOUR}""")
def _(t):
    return resample.resample(t.bars, "4 hours")


@query("f02_aggregate_every", "symbol ts:t mean_close:d spread:d", f"SELECT symbol, {FOUR} AS ts, avg(close) AS mean_close, max(high) - min(low) AS spread FROM bars GROUP BY symbol, {FOUR}")
def _(t):
    return resample.aggregate_every(t.bars, ["symbol"], "4 hours", {"mean_close": F.avg("close"), "spread": F.max("high") - F.min("low")})


@query("f03_ticks_to_bars", "symbol ts:t open:d high:d low:d close:d volume:d trades:i vwap:d8",
       """SELECT b.*, v.vwap FROM bars b JOIN (SELECT symbol, date_trunc('hour', ts) AS ts, sum(price * amount) / sum(amount) AS vwap FROM ticks GROUP BY 1, 2) v
       ON v.symbol = b.symbol AND v.ts = b.ts""")
def _(t):
    return resample.ticks_to_bars(t.ticks)


def cyc(x, n):
    return f"2 * pi() * ({x}) / {n}"


H, DW, MO = "extract('hour' FROM ts)", "(extract('isodow' FROM ts) - 1)", "extract('month' FROM ts)"


@query("f04_calendar_features", "symbol ts:t hour_sin:d hour_cos:d day_sin:d day_cos:d month_sin:d month_cos:d is_business_day day_progress:d",
       f"""SELECT symbol, ts, sin({cyc(H, 24)}) AS hour_sin, cos({cyc(H, 24)}) AS hour_cos, sin({cyc(DW, 7)}) AS day_sin, cos({cyc(DW, 7)}) AS day_cos,
       sin({cyc(MO, 12)}) AS month_sin, cos({cyc(MO, 12)}) AS month_cos, {DW} < 5 AS is_business_day, {H} * 3600 / 86400.0::DOUBLE AS day_progress FROM bars""")
def _(t):
    return features.calendar_features(t.bars)


@query("f05_price_derivatives", "symbol ts:t price_velocity:d price_acceleration:d",
       f"SELECT symbol, ts, v AS price_velocity, v - {lag('v')} AS price_acceleration FROM (SELECT *, close - {lag('close')} AS v FROM bars)")
def _(t):
    return features.price_derivatives(t.bars_kept)


@query("f06_volume_features", "symbol ts:t volume_ma:d volume_std:d volume_zscore:d",
       f"SELECT symbol, ts, m AS volume_ma, s AS volume_std, (volume - m) / nullif(s, 0) AS volume_zscore FROM (SELECT *, {roll('avg', 'volume', 20)} AS m, {roll('stddev_samp', 'volume', 20)} AS s FROM bars)")
def _(t):
    return features.volume_features(t.bars_kept)


@query("f07_range_features", "symbol ts:t daily_range:d daily_range_ma:d range_expansion:d",
       f"SELECT symbol, ts, r AS daily_range, m AS daily_range_ma, r / nullif(m, 0) AS range_expansion FROM (SELECT *, {roll('avg', 'r', 20)} AS m FROM (SELECT *, high - low AS r FROM bars))")
def _(t):
    return features.range_features(t.bars_kept)


@query("f08_futures_features", "symbol ts:t basis:d basis_pct:d funding_rate_change:d11 funding_rate_ma:d11 open_interest_change:d open_interest_ma:d implied_volatility:d",
       f"""WITH j AS (SELECT b.*, f.funding_rate, b.open AS index_price, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM
       (SELECT *, {lag('close')} AS pc FROM bars) b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.ts)
       SELECT symbol, ts, close - index_price AS basis, (close - index_price) / index_price * 100 AS basis_pct, funding_rate - {lag('funding_rate')} AS funding_rate_change,
       {roll('avg', 'funding_rate', 20)} AS funding_rate_ma, volume - {lag('volume')} AS open_interest_change, {roll('avg', 'volume', 20)} AS open_interest_ma,
       {roll('avg', 'tr', 20)} AS implied_volatility FROM j""")
def _(t):
    joined = asof_join(t.bars_kept, t.funding, "symbol", "ts", ["funding_rate"])
    joined = joined.withColumns({"index_price": F.col("open"), "open_interest": F.col("volume")})
    return features.futures_features(settle(joined, "futures"))


@query("f09_returns", "symbol ts:t ret:d log_ret:d cum_ret:d",
       f"""SELECT symbol, ts, ret, ln(1 + ret) AS log_ret, exp(sum(ln(1 + ret)) OVER ({P})) - 1 AS cum_ret FROM (SELECT symbol, ts, close / {lag('close')} - 1 AS ret FROM bars)""")
def _(t):
    return features.all_returns(t.bars_kept)


@query("f10_scalers", "symbol ts:t close_scaled:d volume_scaled:d high_scaled:d low_scaled:d",
       """SELECT b.symbol, ts, (close - m) / nullif(s, 0) AS close_scaled, (volume - vl) / nullif(vh - vl, 0) AS volume_scaled,
       (high - q2) / nullif(q3 - q1, 0) AS high_scaled, ln(1 + low) AS low_scaled FROM bars b JOIN (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s, min(volume) AS vl,
       max(volume) AS vh, quantile_cont(high, 0.25) AS q1, quantile_cont(high, 0.5) AS q2, quantile_cont(high, 0.75) AS q3 FROM bars GROUP BY symbol) f ON f.symbol = b.symbol""")
def _(t):
    return features.scale(t.bars_kept, "symbol", {"close": "standard", "volume": "minmax", "high": "robust", "low": "log1p"})


@query("f11_epsilon_normalise", "symbol ts:t close_scaled:d",
       "SELECT symbol, ts, (close - avg(close) OVER (PARTITION BY symbol)) / (stddev_samp(close) OVER (PARTITION BY symbol) + 1e-8) AS close_scaled FROM bars")
def _(t):
    return features.scale(t.bars_kept, "symbol", {"close": "epsilon"})


@query("f12_rolling_scale", "symbol ts:t price_scaled:d volume_log:d",
       f"""SELECT symbol, ts, (close - lo) / nullif(hi - lo, 0) AS price_scaled, ln(1 + volume) AS volume_log FROM
       (SELECT *, {roll('min', 'close', 100)} AS lo, {roll('max', 'close', 100)} AS hi FROM bars)""")
def _(t):
    return features.rolling_scale(t.bars_kept)


@query("f13_smoothing", "symbol ts:t smoothed:d", f"SELECT symbol, ts, {roll('avg', 'close', 3)} AS smoothed FROM bars")
def _(t):
    return features.moving_mean(t.bars_kept)


SEQ = f"row_number() OVER ({P}) AS rn"


def flat(df, steps=10):
    """Sequence digest for comparison: first and last cell, sum, length."""
    total = F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0])
    return df.withColumns({"first_x": F.col("x")[0][0], "last_x": F.element_at("x", -1)[0], "sum_x": total, "len": F.size("x")})


@query("f14_sequences", "symbol ts:t first_x:d last_x:d sum_x:d len:i y:d",
       f"""SELECT * FROM (SELECT symbol, ts, first_value(close) OVER w AS first_x, close AS last_x, sum(close) OVER w AS sum_x, count(*) OVER w AS len,
       lead(close) OVER ({P}) AS y FROM bars WINDOW w AS ({P} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE len = 10 AND y IS NOT NULL""")
def _(t):
    return flat(features.sequences(t.bars_kept, 10, ["close", "volume"]))


@query("f15_sequences_split", "symbol ts:t first_x:d last_x:d len:i y:d",
       f"""SELECT * FROM (SELECT symbol, ts, lag(close, 10) OVER ({P}) AS first_x, lag(close, 1) OVER ({P}) AS last_x, 10 AS len, close AS y FROM bars) WHERE first_x IS NOT NULL""")
def _(t):
    return flat(features.sequences(t.bars_kept, 10, ["close"], mode="split"))


@query("f16_sequences_inside_target", "symbol ts:t first_x:d last_x:d y:d",
       f"SELECT * FROM (SELECT symbol, ts, lag(volume, 9) OVER ({P}) AS first_x, volume AS last_x, close AS y FROM bars) WHERE first_x IS NOT NULL")
def _(t):
    return flat(features.sequences(t.bars_kept, 10, ["volume"], mode="inside"))


@query("f17_sequences_plain", "symbol ts:t first_x:d last_x:d len:i",
       f"SELECT * FROM (SELECT symbol, ts, lag(close, 9) OVER ({P}) AS first_x, close AS last_x, 10 AS len FROM bars) WHERE first_x IS NOT NULL")
def _(t):
    return flat(features.sequences(t.bars_kept, 10, ["close"], target=None, mode="plain"))


def uni(*parts):
    """SQL twin of the repeatable uniform number."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def gauss(*parts):
    return f"(sqrt(-2 * ln(({uni(*parts, repr('u'))} * 4294967296.0::DOUBLE + 0.5) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {uni(*parts, repr('v'))}))"


@query("f18_random_split", "split rows:i",
       f"SELECT CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split, count(*) AS rows FROM (SELECT {uni('trade_id', 42)} AS u FROM ticks) GROUP BY 1")
def _(t):
    s = features.hash_split(t.ticks, ["trade_id"], {"train": 0.7, "validation": 0.15, "test": 0.15})
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("f19_chronological_split", "symbol ts:t split",
       f"SELECT symbol, ts, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars)")
def _(t):
    return features.chronological_split(t.bars_kept)


@query("f20_time_series_folds", "symbol ts:t fold:i role",
       f"""WITH b AS (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
       f AS (SELECT *, n - (5 - fold + 1) * (n // 6) AS s, n // 6 AS z FROM b, (SELECT unnest([1,2,3,4,5]) AS fold))
       SELECT * FROM (SELECT symbol, ts, fold, CASE WHEN p < s - 3 THEN 'train' WHEN p >= s AND p < s + z THEN 'test' END AS role FROM f) WHERE role IS NOT NULL""")
def _(t):
    return features.time_series_folds(t.bars_kept, 5, gap=3)


@query("f21_batches", "symbol batch:i rows:i", f"SELECT symbol, (r - 1) // 32 AS batch, count(*) AS rows FROM (SELECT symbol, row_number() OVER ({P}) AS r FROM bars) GROUP BY 1, 2")
def _(t):
    return features.batches(t.bars_kept, 32).groupBy("symbol", "batch").agg(F.count(F.lit(1)).alias("rows"))


TARGET = f"SELECT symbol, ts, lead(close, 3) OVER ({P}) / close - 1 AS r FROM bars"


@query("f22_targets", "symbol ts:t target_return:d direction:d", f"SELECT symbol, ts, r AS target_return, sign(r) AS direction FROM ({TARGET})")
def _(t):
    return features.direction_targets(t.bars_kept, 3)


@query("f29_three_class_label", "symbol ts:t label:d", f"SELECT symbol, ts, CASE WHEN r > 0.02::DOUBLE THEN 1 WHEN r < -0.02::DOUBLE THEN -1 WHEN r IS NOT NULL THEN 0 END AS label FROM ({TARGET})")
def _(t):
    return features.direction_targets(t.bars_kept, 3, dead_band=0.02)


STOP = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
TOK = f"""SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 0 AND w NOT IN ({STOP})) AS tokens FROM news"""


@query("f23_tokens", "doc_id:i n_tokens:i n_distinct:i first_token",
       f"SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, tokens[1] AS first_token FROM ({TOK})")
def _(t):
    d = text.tokens(t.news)
    return d.withColumns({"n_tokens": F.size("tokens"), "n_distinct": F.size(F.array_distinct("tokens")), "first_token": F.get("tokens", F.lit(0))})


LEX = f"""SELECT word, 2 * avg(quality) - 1 AS polarity, avg(toxic) AS subjectivity FROM (SELECT quality, toxic, unnest(list_distinct(tokens)) AS word
    FROM ({TOK}) k JOIN labels l ON l.doc_id = k.doc_id) GROUP BY word"""
SENT = f"""SELECT doc_id, coalesce(avg(polarity), 0) AS polarity, coalesce(avg(subjectivity), 0) AS subjectivity, count(polarity) / count(*) AS confidence
    FROM (SELECT doc_id, unnest(tokens) AS word FROM ({TOK})) w LEFT JOIN ({LEX}) x ON x.word = w.word GROUP BY doc_id"""


@query("f24_sentiment", "doc_id:i polarity:d subjectivity:d confidence:d", SENT)
def _(t):
    return text.sentiment(t.news, text.labelled_lexicon(t.news, t.read("labels")))


@query("f25_sentiment_on_bars", "symbol ts:t close:d polarity:d texts:i",
       f"""SELECT b.symbol, b.ts, close, polarity, texts FROM bars b LEFT JOIN (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS ts,
       avg(polarity) AS polarity, count(*) AS texts FROM ({SENT}) GROUP BY 1) s ON s.ts = b.ts""")
def _(t):
    scores = text.sentiment(t.news, text.labelled_lexicon(t.news, t.read("labels")))
    stamped = scores.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 720) * 3600))
    return t.bars_kept.join(text.sentiment_bars(stamped), "ts", "left")


@query("f26_custom_features", "symbol ts:t body:d upper_wick:d", "SELECT symbol, ts, close - open AS body, high - greatest(open, close) AS upper_wick FROM bars")
def _(t):
    return features.with_custom(t.bars, {"body": F.col("close") - F.col("open"), "upper_wick": F.col("high") - F.greatest("open", "close")})


@query("f27_augmentation", "variant symbol ts:t close:d",
       f"""SELECT 'jitter' AS variant, symbol, ts, close * (1 + 0.01::DOUBLE * {gauss('symbol', 'epoch_us(ts)', 42)}) AS close FROM bars UNION ALL
       SELECT 'scale', symbol, ts, close * (1 + 0.1::DOUBLE * (2 * {uni('symbol', 42)} - 1)) FROM bars""")
def _(t):
    return features.augment(t.bars_kept, ["close", "volume"])


@query("f28_config_features", "symbol ts:t price_momentum:d volume_momentum:d volatility:d support:d resistance:d trend_strength:d",
       f"""SELECT symbol, ts, close / {lag('close', 10)} - 1 AS price_momentum, volume / {lag('volume', 10)} - 1 AS volume_momentum, {roll('stddev_samp', 'close', 20)} AS volatility,
       {roll('min', 'low', 20)} AS support, {roll('max', 'high', 20)} AS resistance, CASE WHEN pos >= 13 THEN abs(regr_slope(close, pos) OVER {rows(14)}) END AS trend_strength
       FROM (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM bars)""")
def _(t):
    return features.config_features(t.bars_kept)


@query("f28_volume_profile", "symbol bin:i volume:d bars:i",
       """SELECT b.symbol, least(floor((close - lo) / ((hi - lo) / 10)), 9) AS bin, sum(volume) AS volume, count(*) AS bars FROM bars b JOIN
       (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol) e ON e.symbol = b.symbol GROUP BY 1, 2""")
def _(t):
    return features.volume_profile(t.bars_kept)


@query("u04_custom_aggregate", "symbol ts:t trimmed_mean:d",
       f"SELECT symbol, {FOUR} AS ts, (sum(close) - min(close) - max(close)) / nullif(count(*) - 2, 0) AS trimmed_mean FROM bars GROUP BY symbol, {FOUR}")
def _(t):
    """A caller-defined aggregate as an expression over built-in aggregates."""
    expr = fn.ratio(F.sum("close") - F.min("close") - F.max("close"), F.count(F.lit(1)) - 2)
    return resample.aggregate_every(t.bars, ["symbol"], "4 hours", {"trimmed_mean": expr})


# -- scalar functions ---------------------------------------------------------------------
@query("x01_guarded_division", "trade_id:i l_partkey:i per_unit:d zero_as_minus_one:d",
       "SELECT trade_id, l_partkey, pnl / nullif(ret, 0) AS per_unit, CASE WHEN ret = 0 THEN -1 ELSE pnl / nullif(ret, 0) END AS zero_as_minus_one FROM closed_trades")
def _(t):
    return t.closed_trades.withColumns({"per_unit": fn.ratio("pnl", "ret"), "zero_as_minus_one": fn.ratio("pnl", "ret", on_zero=-1.0)})


@query("x02_dates", "trade_id:i millis:i day_of_week:i month:i day held_hours:d",
       """SELECT trade_id, epoch_ms(entry_time) AS millis, extract('isodow' FROM entry_time) - 1 AS day_of_week, extract('month' FROM entry_time) AS month,
       strftime(entry_time, '%Y-%m-%d') AS day, (epoch(exit_time) - epoch(entry_time)) / 3600.0::DOUBLE AS held_hours FROM closed_trades""")
def _(t):
    back = fn.parse_millis(F.unix_millis("entry_time"))
    return t.closed_trades.withColumns({
        "millis": F.unix_millis(back), "day_of_week": (F.dayofweek(back) + 5) % 7, "month": F.month(back), "day": F.date_format(back, "yyyy-MM-dd"),
        "held_hours": (F.unix_seconds("exit_time") - F.unix_seconds("entry_time")) / 3600.0})


@query("x03_symbol_names", "symbol clean joined valid",
       "SELECT DISTINCT symbol || '/usdt' AS symbol, upper(symbol) || '_USDT' AS clean, upper(symbol) || 'USDT' AS joined, true AS valid FROM bars")
def _(t):
    s = t.bars.select(F.concat("symbol", F.lit("/usdt")).alias("symbol")).distinct()
    return s.withColumns({"clean": fn.clean_symbol("symbol"), "joined": fn.clean_symbol("symbol", ""), "valid": fn.is_symbol("symbol")})


@query("x04_side_and_interval", "side frame_seconds:i order_ok rows:i",
       """SELECT side, CASE trade_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 END AS frame_seconds, trade_id % 3 <> 2 AS order_ok, count(*) AS rows FROM ticks GROUP BY 1, 2, 3""")
def _(t):
    k = F.col("trade_id") % 3
    raw = t.ticks.select(
        F.when(F.col("side") == "buy", " Long").otherwise("ASK").alias("s"), F.when(k == 0, "1m").when(k == 1, "1h").otherwise("7x").alias("f"),
        F.when(k == 2, "iceberg").otherwise("LIMIT").alias("o"))
    return raw.groupBy(fn.normal_side("s").alias("side"), fn.timeframe_seconds("f").alias("frame_seconds"), fn.is_order_type("o").alias("order_ok")).agg(F.count(F.lit(1)).alias("rows"))


@query("x05_arrays_maps", "trade_id:i last_bid:d spread_sum:d depth:d weighted:d",
       """SELECT trade_id, bid_px[-1] AS last_bid, list_sum([ask_px[i] - bid_px[i] FOR i IN [1,2,3,4,5]]) AS spread_sum, list_sum(qty[1:3]) AS depth,
       0.7::DOUBLE * price + 0.3::DOUBLE * amount AS weighted FROM order_book""")
def _(t):
    zero = F.lit(0.0)
    add = lambda a, x: a + x
    b = t.order_book.join(t.ticks.select("trade_id", "price", "amount"), "trade_id")
    weights = F.create_map(F.lit("price"), F.lit(0.7), F.lit("amount"), F.lit(0.3))
    values = F.create_map(F.lit("price"), F.col("price"), F.lit("amount"), F.col("amount"))
    return b.withColumns({
        "last_bid": F.element_at("bids", -1)["price"],
        "spread_sum": F.aggregate(F.zip_with("asks", "bids", lambda a, x: a["price"] - x["price"]), zero, add),
        "depth": F.aggregate(F.transform(F.slice("bids", 1, 3), lambda x: x["qty"]), zero, add),
        "weighted": F.aggregate(F.map_values(F.map_zip_with(weights, values, lambda k, w, v: w * v)), zero, add)})


@query("x06_json_and_hash", "event_id:i k:i digest",
       "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, md5(event_type || '-' || CAST(user_id AS VARCHAR)) AS digest FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.md5(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))).alias("digest"))


@query("x07_row_digest", "symbol rows:i digests:i", "SELECT symbol, count(*) AS rows, count(DISTINCT ts) AS digests FROM bars GROUP BY symbol")
def _(t):
    d = t.bars.withColumn("d", fn.row_digest("symbol", "ts", "open", "close")).groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("symbol").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("digests"))


# -- joins --------------------------------------------------------------------------------
@query("j01_left_join", "symbol ts:t close:d high_volume", "SELECT b.symbol, b.ts, close, v AS high_volume FROM bars b LEFT JOIN (SELECT symbol, ts, true AS v FROM bars WHERE volume > 20) f ON f.symbol = b.symbol AND f.ts = b.ts")
def _(t):
    flags = t.bars_kept.where("volume > 20").select("symbol", "ts", F.lit(True).alias("high_volume"))
    return t.bars_kept.join(flags, ["symbol", "ts"], "left")


@query("j02_benchmark_join", "series_id ts:t ret:d bench:d", "SELECT r.series_id, r.ts, ret, bench FROM returns r JOIN benchmark_ret b ON b.ts = r.ts WHERE ret IS NOT NULL AND bench IS NOT NULL")
def _(t):
    return t.returns_kept.join(t.benchmark_ret, "ts").na.drop("any")


@query("j03_asof_join", "symbol ts:t close:d funding_rate:d11", "SELECT b.symbol, b.ts, close, funding_rate FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.ts")
def _(t):
    return asof_join(t.bars_kept, t.funding, "symbol", "ts", ["funding_rate"])


@query("j03_asof_ticks_to_bars", "trade_id:i symbol price:d close:d",
       "SELECT t.trade_id, t.symbol, price, close FROM ticks t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close FROM bars) b ON b.symbol = t.symbol AND t.ts >= b.ts")
def _(t):
    done = t.bars_kept.select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "close")
    return asof_join(t.ticks, done, "symbol", "ts", ["close"], slice_seconds=3600)


@query("j04_align_symbols", "ts:t click:d view:d purchase:d signup:d error:d",
       "SELECT ts, " + ", ".join(f"max(close) FILTER (WHERE symbol = '{s}') AS {s}" for s in ("click", "view", "purchase", "signup", "error")) + " FROM bars GROUP BY ts")
def _(t):
    return setops.pivot_times(t.bars, ["click", "view", "purchase", "signup", "error"])


@query("j04_align_times", "ts:t symbol close:d", "SELECT a.ts, s.symbol, b.close FROM (SELECT DISTINCT ts FROM bars) a CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.ts = a.ts AND b.symbol = s.symbol")
def _(t):
    """Any number of symbols, as long rows."""
    return setops.align_times(t.bars_kept)


NULLED = """(SELECT CASE WHEN extract('hour' FROM ts) <> 3 THEN symbol END AS symbol, CASE WHEN extract('hour' FROM ts) <> 7 THEN ts END AS ts, volume, close FROM bars)"""


@query("c15_null_keys", "symbol rows:i dated:i volume:d last_sum:d median:d",
       f"""SELECT symbol, count(*) AS rows, count(ts) AS dated, sum(volume) AS volume, sum(volume) AS last_sum, quantile_cont(close, 0.5) AS median FROM {NULLED} GROUP BY symbol""")
def _(t):
    """Rows with a NULL key or a NULL time stay: they form a key of their own and come first."""
    from tidewater.plans.attach import quantiles
    from tidewater.plans.timeline import join_keys, lay_out, time_slice

    hour = F.hour("ts")
    df = t.bars_kept.select(F.when(hour != 3, F.col("symbol")).alias("symbol"), F.when(hour != 7, F.col("ts")).alias("ts"), "volume", "close")
    tl = lay_out(df, "symbol", ["ts"], time_slice("ts", 30 * 86400), back=5).running(total=("sum", "volume"))
    sums = tl.rows().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count("ts").alias("dated"), F.sum("volume").alias("volume"), F.max("total").alias("last_sum"))
    return join_keys(sums, quantiles(df, "symbol", "close", {"median": 0.5}), ["symbol"])


@query("j05_calendar_join", "symbol ts:t volume:d", f"SELECT g.symbol, g.ts, coalesce(b.volume, 0) AS volume FROM ({GRID}) g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts")
def _(t):
    from tidewater.operators.clean import on_calendar

    return on_calendar(t.bars_kept).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


@query("j06_interval_join", "trade_id:i symbol bars:i high:d",
       """SELECT trade_id, t.symbol, count(*) AS bars, max(high) AS high FROM ticks t JOIN bars b ON b.symbol = t.symbol AND b.ts > t.ts AND b.ts <= t.ts + INTERVAL 6 HOUR
       GROUP BY 1, 2""")
def _(t):
    e = t.ticks.select("trade_id", "symbol", F.col("ts").alias("entry_ts"))
    pairs = interval_join(e, t.bars_kept.select("symbol", "ts", "high"), "symbol", "entry_ts", "ts", 6 * 3600)
    return pairs.groupBy("trade_id", "symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"))


@query("j08_semi_join", "trade_id:i symbol", "SELECT trade_id, symbol FROM closed_trades WHERE symbol IN (SELECT symbol FROM closed_trades GROUP BY symbol HAVING sum(pnl) > 0)")
def _(t):
    good = t.closed_trades.groupBy("symbol").agg(F.sum("pnl").alias("p")).where("p > 0").select("symbol")
    return t.closed_trades.join(settle(good, "symbols"), "symbol", "left_semi")


@query("j09_anti_join", "symbol ts:t", "SELECT symbol, ts FROM bars WHERE extract('hour' FROM ts) % 6 <> 0")
def _(t):
    return setops.new_rows(t.bars_kept, t.bars_kept.where(F.hour("ts") % 6 == 0), ["symbol", "ts"])


@query("j10_dimension_join", "symbol ts:t limit_value:d", "SELECT b.symbol, ts, close * l AS limit_value FROM bars b JOIN (SELECT symbol, avg(volume) AS l FROM bars GROUP BY symbol) d ON d.symbol = b.symbol")
def _(t):
    dim = t.bars_kept.groupBy("symbol").agg(F.avg("volume").alias("l"))
    return attach(t.bars_kept, dim, "symbol").withColumn("limit_value", F.col("close") * F.col("l"))


@query("j11_covering_range", "symbol covers", "SELECT symbol, min(ts) <= TIMESTAMP '2024-01-05' AND max(ts) >= TIMESTAMP '2024-01-20' AS covers FROM bars GROUP BY symbol")
def _(t):
    m = t.bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return m.withColumn("covers", (F.col("a") <= F.lit("2024-01-05").cast("timestamp")) & (F.col("z") >= F.lit("2024-01-20").cast("timestamp")))


@query("j12_params_on_bars", "n:i symbol bars:i total:d",
       "SELECT n, symbol, count(*) AS bars, sum(close * n) AS total FROM bars, (SELECT DISTINCT fast AS n FROM trials) GROUP BY 1, 2")
def _(t):
    """Every bar once per parameter value that the trials used: the short list is exploded, there is no cross join."""
    ns = [r[0] for r in t.trials.select("fast").distinct().orderBy("fast").collect()]
    x = t.bars.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns])))
    return x.groupBy("n", "symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum(F.col("close") * F.col("n")).alias("total"))


@query("j13_time_bands", "factor:d rows:i volume:d",
       """SELECT CASE WHEN wd AND hm >= '08:25' AND hm < '08:35' THEN 0.5 WHEN wd AND hm >= '13:25' AND hm < '13:35' THEN 0.7 WHEN wd AND hm >= '00:00' AND hm < '08:00' THEN 1.2 ELSE 1.0 END AS factor,
       count(*) AS rows, sum(amount) AS volume FROM (SELECT *, strftime(ts, '%H:%M') AS hm, extract('isodow' FROM ts) <= 5 AS wd FROM ticks) GROUP BY 1""")
def _(t):
    x = setops.time_band_factor(t.ticks, "ts", [("08:25", "08:35", 0.5), ("13:25", "13:35", 0.7), ("00:00", "08:00", 1.2)])
    return x.groupBy("factor").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("volume"))


# -- sorts, top-k, set operations ---------------------------------------------------------
@query("sl01_sort", "trade_id:i entry_time:t pnl:d", "SELECT trade_id, entry_time, pnl FROM closed_trades ORDER BY entry_time DESC")
def _(t):
    return t.closed_trades.select("trade_id", "entry_time", "pnl").orderBy(F.desc("entry_time"))


@query("sl02_top_n", "cand_id:i obj1:d", "SELECT cand_id, obj1 FROM candidates ORDER BY obj1 DESC, cand_id LIMIT 10")
def _(t):
    return setops.top_rows(t.candidates, 10, F.desc("obj1"), "cand_id")


@query("sl03_most_common", "symbol count:i", "SELECT symbol, count(*) AS count FROM closed_trades GROUP BY symbol ORDER BY count DESC, symbol LIMIT 5")
def _(t):
    return setops.most_common(t.closed_trades, "symbol", 5)


@query("sl04_last_rows", "symbol ts:t close:d", f"SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 100")
def _(t):
    return setops.last_rows(t.bars_kept, "symbol", "ts", 100)


@query("sl05_best_row", "generation:i trial_id:i score:d", "SELECT generation, trial_id, score FROM trials QUALIFY row_number() OVER (PARTITION BY generation ORDER BY score DESC, trial_id) = 1")
def _(t):
    return setops.best_per_group(t.trials, ["generation"], "score", "trial_id", ["trial_id", "score"])


@query("sl06_tournament", "bucket:i trial_id:i score:d",
       f"""SELECT bucket, trial_id, score FROM (SELECT *, floor({uni('trial_id', 7)} * (n // 5)) AS bucket FROM trials, (SELECT count(*) AS n FROM trials))
       QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY score DESC, trial_id) = 1""")
def _(t):
    """Best of each pseudo-random sample of about five trials."""
    n = t.trials.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = t.trials.withColumn("bucket", F.floor(fn.uniform("trial_id", F.lit(7)) * F.floor(n / 5)))
    return setops.best_per_group(drawn, ["bucket"], "score", "trial_id", ["trial_id", "score"])


@query("sl07_capped_per_hour", "symbol trade_id:i", "SELECT symbol, trade_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts) AS r FROM ticks) WHERE r <= 2")
def _(t):
    return setops.capped_per_hour(t.ticks, "symbol", "ts", 2, ["ts"])


@query("s01_union", "symbol ts:t close:d page:i", "SELECT * FROM bars_with_repeats")
def _(t):
    first = t.bars_with_repeats.where("page = 1").drop("page")
    return setops.union_all(first.withColumn("page", F.lit(1)), t.bars_with_repeats.where("page = 2"))


@query("s02_distinct_times", "ts:t", "SELECT DISTINCT ts FROM bars")
def _(t):
    return t.bars.select("ts").distinct()


@query("s03_dedupe", "symbol ts:t first_close:d last_close:d", "SELECT symbol, ts, arg_min(close, page) AS first_close, arg_max(close, page) AS last_close FROM bars_with_repeats GROUP BY symbol, ts")
def _(t):
    from tidewater.operators.clean import dedupe

    x = t.bars_with_repeats.select("symbol", "ts", "close", "page")
    a = dedupe(x, ["symbol", "ts"], ["page"]).select("symbol", "ts", F.col("close").alias("first_close"))
    z = dedupe(x, ["symbol", "ts"], ["page"], keep="last").select("symbol", "ts", F.col("close").alias("last_close"))
    return a.join(z, ["symbol", "ts"])


@query("s04_difference", "symbol ts:t", "SELECT symbol, ts FROM bars EXCEPT SELECT symbol, ts FROM funding")
def _(t):
    return t.bars_kept.select("symbol", "ts").subtract(t.funding.select("symbol", "ts"))


@query("s05_intersection", "ts:t", "SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'view'")
def _(t):
    b = t.bars_kept
    return b.where("symbol = 'click'").select("ts").intersect(b.where("symbol = 'view'").select("ts"))
