"""Queries: sources, sinks, filters, validation."""

import uuid

from pyspark.sql import functions as F

from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import P, lag, roll
from tidewater.operators import clean, features, setops, validate
from tidewater.plans.timeline import time_slice
from tidewater.session import settle, shared_folder
from tidewater.sources import landed
from tidewater.sources.store import BarStore, covering, export

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
BAR_SPEC = "symbol ts:t open:d high:d low:d close:d volume:d"
BETWEEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


def folder(t):
    return f"{shared_folder(t.spark)}/tidewater/store-{uuid.uuid4().hex}"


def stored(t):
    """Bars and funding written to a fresh store."""
    store = BarStore(t.spark, folder(t))
    bars = t.bars_kept.withColumns({"data_type": F.lit("ohlcv"), "timeframe": F.lit("1h")})
    fund = t.funding.withColumns({"data_type": F.lit("funding"), "timeframe": F.lit("8h")})
    store.write(bars.unionByName(fund, allowMissingColumns=True))
    return store


@query("io01_read_parquet", BAR_SPEC, f"SELECT * FROM bars WHERE symbol = 'click' AND {BETWEEN}")
def _(t):
    return stored(t).read(symbol="click", timeframe="1h", data_types=["ohlcv"], start=START, end=END)


@query("io02_read_data_types", "data_type symbol ts:t close:d funding_rate:d11",
       """SELECT 'ohlcv' AS data_type, symbol, ts, close, NULL::DOUBLE AS funding_rate FROM bars WHERE symbol = 'view'
       UNION ALL SELECT 'funding', symbol, ts, NULL, funding_rate FROM funding WHERE symbol = 'view'""")
def _(t):
    return stored(t).read(symbol="view", data_types=["ohlcv", "funding"])


@query("io03_read_csv", BAR_SPEC, "SELECT * FROM bars")
def _(t):
    path = folder(t)
    out = t.bars.select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "open", "high", "low", "close", "volume")
    out.write.option("header", True).csv(path)
    return landed.read_bar_csv(t.spark, path)


@query("io04_read_yaml", "symbol timeframe ts:t open:d high:d low:d close:d volume:d",
       "SELECT *, '1h' AS timeframe FROM bars")
def _(t):
    """YAML dumps written from the bars, some symbols with ISO and some with nanosecond timestamps."""
    path = folder(t)
    iso = F.concat(F.lit("'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))
    tag = F.concat(F.lit("!!python/object/apply:timestamp\n  - "), (F.unix_micros("ts") * 1000).cast("string"), F.lit("\n  - null\n  - 10"))
    stamp = F.when(F.length("symbol") % 2 == 0, iso).otherwise(tag)
    field = lambda c: F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
    lines = [field("close"), field("high"), field("low"), field("open"), F.concat(F.lit("timestamp: "), stamp), field("volume")]
    docs = t.bars.select("symbol", F.concat(F.lit("- "), F.concat_ws("\n  ", *lines)).alias("value"))
    docs.write.partitionBy("symbol").text(path)
    return landed.read_bar_yaml(t.spark, path, timeframe="1h")


def ms(c="ts"):
    return F.unix_millis(c)


@query("io05_ingest_klines", BAR_SPEC, "SELECT * FROM bars")
def _(t):
    cells = F.array(ms().cast("double"), *[F.col(c) for c in validate.OHLCV])
    pages = t.bars.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(cells)).alias("body"))
    return landed.klines(pages.drop("d"))


@query("io06_ingest_trades", "trade_id:i symbol ts:t price:d amount:d side fee:d fee_currency",
       "SELECT *, price * amount * 0.001::DOUBLE AS fee, 'USDT' AS fee_currency FROM ticks")
def _(t):
    fee = F.struct((F.col("price") * F.col("amount") * 0.001).alias("cost"), F.lit("USDT").alias("currency"))
    body = F.to_json(F.struct(F.col("trade_id").alias("id"), ms().alias("timestamp"), "symbol", "price", "amount", "side", fee.alias("fee")))
    return landed.trades(t.ticks.select(body.alias("body")))


@query("io07_ingest_order_books", "symbol ts:t best_bid:d best_ask:d levels:i bid_qty:d",
       "SELECT symbol, ts, bid_px[1] AS best_bid, ask_px[1] AS best_ask, len(bid_px) AS levels, list_sum(qty) AS bid_qty FROM order_book")
def _(t):
    pairs = lambda c: F.transform(c, lambda x: F.array(x["price"], x["qty"])).alias(c)
    body = F.to_json(F.struct(ms().alias("timestamp"), "symbol", pairs("bids"), pairs("asks")))
    b = landed.order_books(t.order_book.select(body.alias("body")))
    return b.withColumns({
        "best_bid": F.col("bids")[0]["price"], "best_ask": F.col("asks")[0]["price"], "levels": F.size("bids"),
        "bid_qty": F.aggregate("bids", F.lit(0.0), lambda a, x: a + x["qty"])})


@query("io08_ingest_futures", "symbol ts:t close:d mark_price:d index_price:d open_interest:d",
       """SELECT symbol, ts, close, CASE WHEN extract('hour' FROM ts) % 2 = 0 THEN high ELSE close END AS mark_price,
       close AS index_price, CASE WHEN extract('hour' FROM ts) % 3 = 0 THEN volume ELSE 0 END AS open_interest FROM bars""")
def _(t):
    body = F.to_json(F.struct(
        ms().alias("timestamp"), "symbol", "close", F.when(F.hour("ts") % 2 == 0, F.col("high")).alias("mark"),
        F.when(F.hour("ts") % 3 == 0, F.col("volume")).alias("openInterest")))
    return landed.futures(t.bars.select(body.alias("body")))


@query("io09_ingest_funding", "symbol ts:t funding_rate:d11", "SELECT * FROM funding")
def _(t):
    row = F.struct(ms().alias("timestamp"), "symbol", F.col("funding_rate").alias("fundingRate"))
    pages = t.funding.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(row)).alias("body"))
    return landed.funding_history(pages)


@query("io10_write_parquet", "data_type symbol timeframe rows:i",
       """SELECT 'ohlcv' AS data_type, symbol, '1h' AS timeframe, count(*) AS rows FROM bars GROUP BY symbol
       UNION ALL SELECT 'funding', symbol, '8h', count(*) FROM funding GROUP BY symbol""")
def _(t):
    return stored(t).datasets().groupBy("data_type", "symbol", "timeframe").agg(F.sum("rows").alias("rows"))


@query("io11_export_formats", "format symbol rows:i volume:d",
       """SELECT format, symbol, count(*) AS rows, sum(volume) AS volume FROM bars,
       (VALUES ('parquet'), ('csv'), ('orc'), ('json')) f(format) GROUP BY format, symbol""")
def _(t):
    parts, bars = [], t.bars_kept.select("symbol", "ts", "close", "volume")
    for fmt in ("parquet", "csv", "orc", "json"):
        path = folder(t)
        export(bars, path, fmt)
        back = t.spark.read.schema(bars.schema).option("header", True).format(fmt).load(f"{path}/data")
        parts.append(back.withColumn("format", F.lit(fmt)))
    return setops.union_all(*parts).groupBy("format", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@query("io12_upsert", "symbol ts:t close:d",
       """SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM
       (SELECT symbol, ts, arg_max(close, page) AS close FROM bars_with_repeats GROUP BY symbol, ts)) WHERE r <= 500""")
def _(t):
    store = stored(t)
    fresh = t.bars_with_repeats.where("page = 2").drop("page").withColumns({"data_type": F.lit("ohlcv"), "timeframe": F.lit("1h")})
    store.upsert(fresh, keep_last=500)
    return store.read(data_types=["ohlcv"])


@query("io13_paged_backfill", "symbol ts:t close:d",
       "SELECT symbol, ts, arg_min(close, page) AS close FROM bars_with_repeats GROUP BY symbol, ts")
def _(t):
    return clean.dedupe(t.bars_with_repeats, ["symbol", "ts"], ["page"], keep="first")


@query("io14_prepared_cache", "symbol ts:t close:d", f"SELECT symbol, ts, close FROM bars WHERE symbol = 'click' AND {BETWEEN}")
def _(t):
    """The cached range that contains the request is found in the manifest, then filtered."""
    manifest = t.bars_kept.groupBy("symbol").agg(F.date_trunc("day", F.min("ts")).alias("start"), F.max("ts").alias("end"))
    hit = covering(manifest.withColumn("timeframe", F.lit("1h")), "click", "1h", START, END)
    return validate.in_range(t.bars_kept.where("symbol = 'click'"), "ts", START, END).join(hit.select("symbol"), "symbol", "left_semi")


@query("io15_list_datasets", "data_type symbol timeframe rows:i first_ts:t last_ts:t folder",
       """SELECT 'ohlcv' AS data_type, symbol, '1h' AS timeframe, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, 'p_data_type=ohlcv/p_symbol=' || symbol || '/p_timeframe=1h' AS folder FROM bars GROUP BY symbol
       UNION ALL SELECT 'funding', symbol, '8h', count(*), min(ts), max(ts), 'p_data_type=funding/p_symbol=' || symbol || '/p_timeframe=8h' FROM funding GROUP BY symbol""")
def _(t):
    return stored(t).datasets().withColumn("folder", F.regexp_extract("path", "p_data_type=.*", 0))


@query("io16_delete", "data_type symbol rows:i close:d",
       """SELECT 'ohlcv' AS data_type, symbol, count(*) AS rows, sum(close) AS close FROM bars WHERE symbol <> 'view' GROUP BY symbol
       UNION ALL SELECT 'funding', symbol, count(*), NULL::DOUBLE FROM funding GROUP BY symbol""")
def _(t):
    """Bars of one symbol are deleted; what is left is read back from the store."""
    store = stored(t)
    store.delete(symbol="view", data_type="ohlcv")
    return store.read().groupBy("data_type", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close"))


@query("io17_saved_scaler", "symbol ts:t close_scaled:d",
       """SELECT b.symbol, ts, (close - m) / nullif(s, 0) AS close_scaled FROM bars b JOIN
       (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s FROM bars GROUP BY symbol) f ON f.symbol = b.symbol""")
def _(t):
    fit = settle(features.fit_scaler(t.bars_kept, "symbol", ["close"]), "scaler")
    return t.bars_kept.join(fit, "symbol").withColumn("close_scaled", features.scaled("close", "standard"))


@query("io18_write_results", "symbol exit_time:t pnl:d", "SELECT symbol, exit_time, pnl FROM closed_trades")
def _(t):
    path = folder(t)
    out = t.closed_trades.select("symbol", "exit_time", "pnl")
    export(out, path, "csv")
    return t.spark.read.schema(out.schema).option("header", True).csv(f"{path}/data")


@query("io19_json_round_trip", BAR_SPEC, "SELECT * FROM bars")
def _(t):
    cols = ["symbol", "ts", *validate.OHLCV]
    as_text = t.bars.select(F.to_json(F.struct(*cols)).alias("j"))
    ddl = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    return as_text.select(F.from_json("j", ddl).alias("b")).select("b.*")


@query("io18_write_equity", "series_id ts:t equity:d4", "SELECT series_id, ts, equity FROM equity")
def _(t):
    """The equity curve of a run, as CSV and back."""
    path, curve = folder(t), t.equity_kept.select("series_id", "ts", "equity")
    export(curve, path, "csv")
    return t.spark.read.schema(curve.schema).option("header", True).csv(f"{path}/data")


@query("io18_write_trials", "trial_id:i generation:i score:d risk:d fast:i slow:i", "SELECT trial_id, generation, score, risk, fast, slow FROM trials")
def _(t):
    """Trial results as JSON objects with nested parameters, and back."""
    path = folder(t)
    nested = t.trials.select("trial_id", "generation", F.struct("fast", "slow").alias("params"), F.struct("score", "risk").alias("metrics"))
    export(nested, path, "json")
    return t.spark.read.schema(nested.schema).json(f"{path}/data").select("trial_id", "generation", "metrics.*", "params.*")


@query("io20_order_history", "trade_id:i symbol ts:t side price:d",
       f"SELECT * FROM ticks WHERE symbol = 'click' AND {BETWEEN}")
def _(t):
    """An audit log written as JSON events in folders by day, read again by day, symbol and time."""
    path = folder(t)
    events = t.ticks.select("trade_id", "symbol", "ts", "side", "price", F.to_date("ts").alias("day"))
    events.repartition("day").write.partitionBy("day").json(path)
    log = t.spark.read.schema(events.schema).json(path)
    days = F.col("day").between(F.to_date(F.lit(START)), F.to_date(F.lit(END)))
    return validate.in_range(log.where(days & (F.col("symbol") == "click")), "ts", START, END)


# -- filters and checks -------------------------------------------------------------------
@query("p01_time_range", BAR_SPEC, f"SELECT * FROM bars WHERE {BETWEEN}")
def _(t):
    return validate.in_range(t.bars, "ts", START, END)


@query("p02_numeric_columns", "symbol open:d high:d low:d close:d volume:d trades:i", "SELECT * FROM bars")
def _(t):
    return t.bars.select("symbol", *validate.numeric_columns(t.bars))


@query("p03_drop_null_rows", "symbol ts:t close:d", "SELECT * FROM bars_with_gaps WHERE close IS NOT NULL")
def _(t):
    return t.bars_with_gaps.na.drop("any")


@query("p04_trade_filter", "trade_id:i l_partkey:i symbol pnl:d", "SELECT * FROM closed_trades WHERE symbol IN ('S1', 'S7') AND pnl > 0")
def _(t):
    return t.closed_trades.where(F.col("symbol").isin("S1", "S7") & (F.col("pnl") > 0))


@query("p05_trade_outcome", "symbol outcome losses_incl_zero:i trades:i",
       """SELECT symbol, CASE WHEN pnl > 0 THEN 'win' WHEN pnl < 0 THEN 'loss' ELSE 'even' END AS outcome,
       sum(CASE WHEN pnl <= 0 THEN 1 ELSE 0 END) AS losses_incl_zero, count(*) AS trades FROM closed_trades GROUP BY 1, 2""")
def _(t):
    outcome = F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("even")
    return t.closed_trades.groupBy("symbol", outcome.alias("outcome")).agg(
        F.count_if(F.col("pnl") <= 0).alias("losses_incl_zero"), F.count(F.lit(1)).alias("trades"))


@query("p06_missing_ratio", "symbol close:d volume:d too_many",
       """SELECT symbol, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS close, avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END) AS volume,
       avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) > 0.1 AS too_many FROM bars_with_gaps GROUP BY symbol""")
def _(t):
    m = validate.missing_ratios(t.bars_with_gaps, ["close", "volume"], ["symbol"])
    return m.withColumn("too_many", F.col("close") > 0.1)


@query("p07_ohlc_consistency", "symbol inconsistent:i",
       """SELECT symbol, count(*) FILTER (WHERE NOT (low <= high AND low <= open AND low <= close AND high >= open AND high >= close)) AS inconsistent
       FROM bars_with_outliers GROUP BY symbol""")
def _(t):
    return validate.count_failures(t.bars_with_outliers, ["symbol"], {"inconsistent": validate.ohlc_ok()})


@query("p08_price_volume_signs", "symbol bad_price:i bad_volume:i",
       """SELECT symbol, count(*) FILTER (WHERE close - 105 <= 0) AS bad_price, count(*) FILTER (WHERE volume - 5 < 0) AS bad_volume
       FROM bars GROUP BY symbol""")
def _(t):
    shifted = t.bars.withColumns({"close": F.col("close") - 105, "volume": F.col("volume") - 5})
    return validate.count_failures(shifted, ["symbol"], {"bad_price": F.col("close") > 0, "bad_volume": F.col("volume") >= 0})


@query("p09_minimum_rows", "symbol enough", "SELECT symbol, count(*) >= 1000 AS enough FROM ticks GROUP BY symbol")
def _(t):
    return t.ticks.groupBy("symbol").agg((F.count(F.lit(1)) >= 1000).alias("enough"))


@query("p10_arrival_order", "symbol late_rows:i",
       """SELECT symbol, count(*) FILTER (WHERE ts < p) AS late_rows FROM (SELECT symbol, ts,
       lag(ts) OVER (PARTITION BY symbol ORDER BY trade_id % 13, trade_id) AS p FROM ticks) GROUP BY symbol""")
def _(t):
    arrived = t.ticks.withColumn("page", F.col("trade_id") % 13)
    return validate.out_of_order(arrived, "symbol", ["page", "trade_id"], "ts", F.col("page"))


@query("p11_time_gaps", "symbol gap_start:t gap_end:t gap_seconds:i",
       f"""SELECT * FROM (SELECT symbol, p AS gap_start, ts AS gap_end, epoch(ts) - epoch(p) AS gap_seconds FROM
       (SELECT symbol, ts, {lag('ts')} AS p FROM bars)) WHERE gap_seconds > 3600""")
def _(t):
    return validate.time_gaps(t.bars_kept, 3600)


@query("p12_price_jumps", "symbol ts:t change:d",
       f"SELECT * FROM (SELECT symbol, ts, close / {lag('close')} - 1 AS change FROM bars) WHERE abs(change) > 0.1::DOUBLE")
def _(t):
    return validate.price_jumps(t.bars_kept)


@query("p13_large_volumes", "symbol ts:t volume:d", "SELECT * FROM bars WHERE volume > 30")
def _(t):
    return t.bars.where("volume > 30")


@query("p14_zero_volume_runs", "symbol longest:i suspicious",
       f"""WITH f AS (SELECT symbol, volume = 0 AS z, row_number() OVER ({P}) - sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) OVER ({P}) AS g
       FROM bars_quiet_nights), r AS (SELECT symbol, g, count(*) FILTER (WHERE z) AS n FROM f GROUP BY symbol, g)
       SELECT symbol, max(n) AS longest, max(n) > 5 AS suspicious FROM r GROUP BY symbol""")
def _(t):
    return validate.zero_volume_runs(t.bars_quiet_nights)


@query("p15_tick_validity", "symbol valid:i invalid:i",
       """SELECT symbol, count(*) FILTER (WHERE price > 0 AND amount > 2 AND side IN ('buy', 'sell')) AS valid,
       count(*) FILTER (WHERE NOT (price > 0 AND amount > 2 AND side IN ('buy', 'sell'))) AS invalid FROM ticks GROUP BY symbol""")
def _(t):
    ticks = t.ticks.withColumn("amount", F.col("amount") - 2)
    return ticks.groupBy("symbol").agg(F.count_if(validate.tick_ok()).alias("valid"), F.count_if(~validate.tick_ok()).alias("invalid"))


@query("p16_book_validity", "symbol crossed:i",
       """SELECT symbol, count(*) FILTER (WHERE NOT list_max([CASE WHEN trade_id % 50 = 0 THEN b + 1 ELSE b END FOR b IN bid_px]) <= list_min(ask_px)) AS crossed
       FROM order_book GROUP BY symbol""")
def _(t):
    shift = F.when(F.col("trade_id") % 50 == 0, 1.0).otherwise(0.0)
    book = t.order_book.withColumn("bids", F.transform("bids", lambda b: F.struct((b["price"] + shift).alias("price"), b["qty"].alias("qty"))))
    return validate.count_failures(book, ["symbol"], {"crossed": validate.book_ok()})


@query("p17_futures_sanity", "symbol high_funding:i negative_oi:i",
       """SELECT f.symbol, count(*) FILTER (WHERE NOT abs(funding_rate * 100) <= 0.01::DOUBLE) AS high_funding,
       count(*) FILTER (WHERE (close - 100) * volume < 0) AS negative_oi FROM funding f JOIN bars b ON b.symbol = f.symbol AND b.ts = f.ts GROUP BY f.symbol""")
def _(t):
    interest = t.bars_kept.select("symbol", "ts", ((F.col("close") - 100) * F.col("volume")).alias("open_interest"))
    return validate.count_failures(t.funding.join(interest, ["symbol", "ts"]), ["symbol"], {
        "high_funding": F.abs(F.col("funding_rate") * 100) <= 0.01, "negative_oi": F.col("open_interest") >= 0})


@query("p18_correlated_features", "symbol a b corr:d",
       """SELECT symbol, 'high' AS a, 'low' AS b, corr(high, low) AS corr FROM bars GROUP BY symbol HAVING abs(corr(high, low)) > 0.2::DOUBLE
       UNION ALL SELECT symbol, 'high', 'close', corr(high, close) FROM bars GROUP BY symbol HAVING abs(corr(high, close)) > 0.2::DOUBLE
       UNION ALL SELECT symbol, 'low', 'close', corr(low, close) FROM bars GROUP BY symbol HAVING abs(corr(low, close)) > 0.2::DOUBLE""")
def _(t):
    return validate.correlated_pairs(t.bars, ["symbol"], ["high", "low", "close"], 0.2)


@query("p19_detect_data_type", "kind rows:i", "SELECT 'ohlcv' AS kind, count(*) AS rows FROM bars UNION ALL SELECT 'trades', count(*) FROM ticks UNION ALL SELECT 'orderbook', count(*) FROM order_book")
def _(t):
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(validate.detect_data_type(df.columns)))
             for df in (t.bars, t.ticks, t.order_book)]
    return setops.union_all(*parts)


@query("p20_quality_from_report", "symbol score:d",
       """WITH q AS (SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS z FROM bars_with_gaps GROUP BY symbol),
       o AS (SELECT b.symbol, count(*) FILTER (WHERE close < a - 1.5 * (z - a) OR close > z + 1.5 * (z - a)) AS outliers FROM bars_with_gaps b JOIN q ON q.symbol = b.symbol GROUP BY b.symbol)
       SELECT x.symbol, greatest(0.0, least(1.0, 1.0 - 0.2::DOUBLE * (CASE WHEN bad > 0 THEN 1 ELSE 0 END) - 0.1::DOUBLE * (CASE WHEN v > 0 THEN 1 ELSE 0 END) - m - 0.01::DOUBLE * outliers)) AS score
       FROM (SELECT symbol, count(*) FILTER (WHERE low > close) AS bad, count(*) FILTER (WHERE volume > 30) AS v,
       avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS m FROM bars_with_gaps GROUP BY symbol) x JOIN o ON o.symbol = x.symbol""")
def _(t):
    rep = t.bars_with_gaps.groupBy("symbol").agg(
        F.count_if(F.col("low") > F.col("close")).alias("bad"), F.count_if(F.col("volume") > 30).alias("v"),
        F.avg(F.col("close").isNull().cast("double")).alias("m"))
    rep = rep.join(validate.iqr_outlier_counts(t.bars_with_gaps, "symbol", "close"), "symbol")
    return rep.withColumn("score", validate.quality_from_report(
        (F.col("bad") > 0).cast("int"), (F.col("v") > 0).cast("int"), F.col("m"), F.col("outliers")))


@query("p21_quality_from_ratios", "symbol score:d",
       f"""WITH q AS (SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS z FROM bars_with_gaps GROUP BY symbol),
       o AS (SELECT b.symbol, count(*) FILTER (WHERE close < a - 1.5 * (z - a) OR close > z + 1.5 * (z - a)) AS outliers FROM bars_with_gaps b JOIN q ON q.symbol = b.symbol GROUP BY b.symbol)
       SELECT x.symbol, 0.4::DOUBLE * (1 - miss) + 0.3::DOUBLE * (1 - outliers / n) + 0.3::DOUBLE * (1 - gaps / n) AS score FROM (SELECT symbol, count(*)::DOUBLE AS n,
       avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS miss, count(*) FILTER (WHERE epoch(ts) - epoch(p) > 3600)::DOUBLE AS gaps
       FROM (SELECT *, {lag('ts')} AS p FROM bars_with_gaps) GROUP BY symbol) x JOIN o ON o.symbol = x.symbol""")
def _(t):
    gaps = validate.time_gaps(t.bars_with_gaps, 3600).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    base = t.bars_with_gaps.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("close").isNull().cast("double")).alias("miss"))
    j = base.join(gaps, "symbol", "left").join(validate.iqr_outlier_counts(t.bars_with_gaps, "symbol", "close"), "symbol")
    return j.withColumn("score", validate.quality_from_ratios(1 - F.col("miss"), F.col("outliers") / F.col("n"), F.coalesce("gaps", F.lit(0)) / F.col("n")))


@query("p22_custom_validators", "symbol wide_range:i odd_trades:i",
       "SELECT symbol, count(*) FILTER (WHERE NOT high - low < 20) AS wide_range, count(*) FILTER (WHERE NOT trades % 2 = 0) AS odd_trades FROM bars GROUP BY symbol")
def _(t):
    return validate.count_failures(t.bars, ["symbol"], {"wide_range": F.col("high") - F.col("low") < 20, "odd_trades": F.col("trades") % 2 == 0})


REPORT = f"""SELECT b.symbol, count(*) AS rows, count(*) FILTER (WHERE epoch(ts) - epoch(p) > 7200) AS gaps,
    count(*) FILTER (WHERE abs(close / pc - 1) > 0.1::DOUBLE) AS jumps,
    count(*) FILTER (WHERE close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1)) AS outliers,
    count(*) FILTER (WHERE high < close) AS bad
    FROM (SELECT *, {lag('ts')} AS p, {lag('close')} AS pc FROM bars_with_outliers) b JOIN (SELECT symbol, quantile_cont(close, 0.25) AS q1,
    quantile_cont(close, 0.75) AS q3 FROM bars_with_outliers GROUP BY symbol) q ON q.symbol = b.symbol GROUP BY b.symbol"""


@query("p23_validation_report", "symbol rows:i gaps:i jumps:i outliers:i is_valid score:d",
       f"""SELECT *, bad = 0 AS is_valid, greatest(0.0, 1 - 0.2::DOUBLE * (CASE WHEN bad > 0 THEN 1 ELSE 0 END) - 0.1::DOUBLE * ((CASE WHEN gaps > 0 THEN 1 ELSE 0 END)
       + (CASE WHEN jumps > 0 THEN 1 ELSE 0 END) + (CASE WHEN outliers > 0 THEN 1 ELSE 0 END)) - 0.01::DOUBLE * outliers) AS score FROM ({REPORT})""")
def _(t):
    return validate.validation_report(t.bars_with_outliers)


def leveled(level, bad, warn):
    flags = " + ".join(f"(CASE WHEN {w} > 0 THEN 1 ELSE 0 END)" for w in warn) or "0"
    out = "outliers" if level in ("advanced", "full") else "0"
    return f"""SELECT '{level}' AS level, symbol, {bad} = 0 AS is_valid, {flags} AS warnings, greatest(0.0, 1 - 0.2::DOUBLE * (CASE WHEN {bad} > 0 THEN 1 ELSE 0 END) - 0.1::DOUBLE * ({flags}) - 0.01::DOUBLE * {out}) AS score FROM ({REPORT})"""


@query("p23_validation_levels", "level symbol is_valid warnings:i score:d", " UNION ALL ".join([
    leveled("basic", "0", []), leveled("intermediate", "0", ["gaps"]), leveled("advanced", "0", ["gaps", "jumps", "outliers"]), leveled("full", "bad", ["gaps", "jumps", "outliers"])]))
def _(t):
    """Each level sees what the levels below it see, and more."""
    parts = [validate.validation_report(t.bars_with_outliers, level).select(F.lit(level).alias("level"), "symbol", "is_valid", F.size("warnings").alias("warnings"), "score")
             for level in ("basic", "intermediate", "advanced", "full")]
    return setops.union_all(*parts)


@query("p24_history_summary", "validations:i success_rate:d mean_score:d",
       f"""SELECT count(*) AS validations, avg(CASE WHEN bad = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS success_rate, avg(greatest(0.0, 1 - 0.2::DOUBLE * (CASE WHEN bad > 0 THEN 1 ELSE 0 END) - 0.1::DOUBLE * ((CASE WHEN gaps > 0 THEN 1 ELSE 0 END)
       + (CASE WHEN jumps > 0 THEN 1 ELSE 0 END) + (CASE WHEN outliers > 0 THEN 1 ELSE 0 END)) - 0.01::DOUBLE * outliers)) AS mean_score FROM ({REPORT})""")
def _(t):
    return validate.validation_summary(validate.validation_report(t.bars_with_outliers))


@query("p24_common_issues", "issue count:i",
       f"""SELECT * FROM (SELECT issue, count(*) AS count FROM (SELECT unnest([CASE WHEN bad > 0 THEN 'inconsistent OHLC' END, CASE WHEN gaps > 0 THEN 'time gaps' END,
       CASE WHEN outliers > 0 THEN 'outliers' END, CASE WHEN jumps > 0 THEN 'suspicious price changes' END]) AS issue FROM ({REPORT}))
       WHERE issue IS NOT NULL GROUP BY issue) ORDER BY count DESC, issue LIMIT 5""")
def _(t):
    return validate.common_issues(validate.validation_report(t.bars_with_outliers))


@query("p25_feature_coverage", "symbol coverage:d enough", "SELECT symbol, count(close) / count(*) AS coverage, count(close) / count(*) >= 0.9 AS enough FROM bars_with_gaps GROUP BY symbol")
def _(t):
    c = t.bars_with_gaps.groupBy("symbol").agg((F.count("close") / F.count(F.lit(1))).alias("coverage"))
    return c.withColumn("enough", F.col("coverage") >= 0.9)


@query("p26_run_constraints", "symbol trades:i worst:d",
       "SELECT symbol, count(*) AS trades, min(ret) AS worst FROM closed_trades GROUP BY symbol HAVING count(*) >= 30 AND abs(min(ret)) <= 0.2::DOUBLE")
def _(t):
    runs = t.closed_trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.min("ret").alias("worst"))
    return runs.where((F.col("trades") >= 30) & (F.abs("worst") <= 0.2))


@query("p28_market_filter", "symbol ts:t close:d",
       f"""WITH e AS (SELECT max(ts) - INTERVAL 24 HOUR AS a FROM bars), d AS (SELECT *, close / {lag('close')} - 1 AS r FROM bars),
       s AS (SELECT symbol FROM d, e WHERE ts > a GROUP BY symbol HAVING sum(volume) > 40 AND sum(trades) > 6 AND min(close) > 0.00001 AND max(close) < 100000 AND stddev_samp(r) <= 0.45::DOUBLE),
       o AS (SELECT symbol FROM order_book, e WHERE ts > a GROUP BY symbol HAVING avg((list_min(ask_px) - list_max(bid_px)) / ((list_min(ask_px) + list_max(bid_px)) / 2)) <= 0.00151::DOUBLE)
       SELECT symbol, ts, close FROM bars WHERE symbol IN (SELECT symbol FROM s) AND symbol IN (SELECT symbol FROM o)""")
def _(t):
    return validate.market_filter(t.bars_kept, t.order_book, min_volume=40, min_trades=6, min_price=0.00001, max_price=100_000, max_spread=0.00151, max_volatility=0.45)


@query("p29_parameter_bounds", "trial_id:i valid unknown:i",
       """SELECT trial_id, bool_and(lo IS NOT NULL AND value BETWEEN lo AND hi) AS valid, count(*) FILTER (WHERE lo IS NULL) AS unknown FROM
       (SELECT trial_id, 'fast' AS param, fast AS value FROM trials UNION ALL SELECT trial_id, 'slow', slow FROM trials) p
       LEFT JOIN (SELECT 'fast' AS param, 1 AS lo, 4 AS hi UNION ALL SELECT 'slow', 0, 5) b ON p.param = b.param GROUP BY trial_id""")
def _(t):
    params = t.trials.select("trial_id", F.col("fast").cast("long").alias("fast"), F.col("slow").cast("long").alias("slow"))
    bounds = t.spark.createDataFrame([("fast", 1, 4), ("slow", 0, 5)], "param string, lo long, hi long")
    return validate.within_bounds(validate.long_form(params, ["trial_id"], ["fast", "slow"], "param"), bounds, ["trial_id"])


# -- cleaning -----------------------------------------------------------------------------
GRID = """SELECT s.symbol, g.ts FROM (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol) s,
    LATERAL (SELECT unnest(generate_series(s.a, s.z, INTERVAL 1 HOUR)) AS ts) g"""


@query("c01_full_calendar", "symbol ts:t close:d", f"SELECT g.symbol, g.ts, b.close FROM ({GRID}) g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts")
def _(t):
    return clean.on_calendar(t.bars_kept)


FF = f"""last_value(close IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
BF = f"""first_value(close IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("c02_fill_forward_back", "symbol ts:t close:d", f"SELECT symbol, ts, coalesce({FF}, {BF}) AS close FROM bars_with_gaps")
def _(t):
    return clean.fill_forward_back(t.bars_with_gaps, ["close"])


def interpolated(x):
    return f"""WITH n AS (SELECT *, {x} AS x FROM bars_with_gaps), k AS (SELECT *, CASE WHEN close IS NOT NULL THEN x END AS kx FROM n),
    w AS (SELECT *, last_value(close IGNORE NULLS) OVER a AS pv, last_value(kx IGNORE NULLS) OVER a AS px,
    first_value(close IGNORE NULLS) OVER z AS nv, first_value(kx IGNORE NULLS) OVER z AS nx FROM k
    WINDOW a AS ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT symbol, ts, coalesce(close, pv + (nv - pv) * (x - px)::DOUBLE / nullif(nx - px, 0), pv) AS close FROM w"""


@query("c03_interpolate_rows", "symbol ts:t close:d", interpolated(f"row_number() OVER ({P})"))
def _(t):
    return clean.interpolate(t.bars_with_gaps, ["close"])


@query("c04_interpolate_time", "symbol ts:t close:d", interpolated("epoch(ts)"))
def _(t):
    return clean.interpolate(t.bars_with_gaps, ["close"], by_time=True)


@query("c05_fill_mean", "symbol ts:t close:d", "SELECT symbol, ts, coalesce(close, avg(close) OVER (PARTITION BY symbol)) AS close FROM bars_with_gaps")
def _(t):
    return clean.fill_statistic(t.bars_with_gaps, ["close"], "mean")


@query("c05_fill_median", "symbol ts:t close:d", "SELECT symbol, ts, coalesce(close, median(close) OVER (PARTITION BY symbol)) AS close FROM bars_with_gaps")
def _(t):
    return clean.fill_statistic(t.bars_with_gaps, ["close"], "median")


@query("c06_fill_strategies", "strategy symbol rows:i total:d",
       f"""SELECT 'drop' AS strategy, symbol, count(*) AS rows, sum(close) AS total FROM bars_with_gaps WHERE close IS NOT NULL GROUP BY symbol UNION ALL
       SELECT 'ffill', symbol, count(*), sum(c) FROM (SELECT symbol, coalesce({FF}, {BF}) AS c FROM bars_with_gaps) GROUP BY symbol UNION ALL
       SELECT 'mean', symbol, count(*), sum(c) FROM (SELECT symbol, coalesce(close, avg(close) OVER (PARTITION BY symbol)) AS c FROM bars_with_gaps) GROUP BY symbol UNION ALL
       SELECT 'median', symbol, count(*), sum(coalesce(close, m)) FROM bars_with_gaps JOIN (SELECT symbol, quantile_cont(close, 0.5) AS m FROM bars_with_gaps GROUP BY symbol) USING (symbol) GROUP BY symbol UNION ALL
       SELECT 'forward', symbol, count(*), sum(c) FROM (SELECT symbol, {FF} AS c FROM bars_with_gaps) GROUP BY symbol UNION ALL
       SELECT 'bfill', symbol, count(*), sum(c) FROM (SELECT symbol, {BF} AS c FROM bars_with_gaps) GROUP BY symbol""")
def _(t):
    parts = [clean.fill_missing(t.bars_with_gaps, ["close"], s).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total")).withColumn("strategy", F.lit(s)) for s in ("drop", "ffill", "mean", "median", "forward", "bfill")]
    return setops.union_all(*parts)


QQ = "SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM bars_with_outliers GROUP BY symbol"


@query("c07_iqr_clip", "symbol ts:t close:d",
       f"SELECT b.symbol, ts, least(greatest(close, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) AS close FROM bars_with_outliers b JOIN ({QQ}) q ON q.symbol = b.symbol")
def _(t):
    return clean.clip_iqr(t.bars_with_outliers, "symbol", ["close"])


@query("c08_iqr_outliers", "symbol outliers:i share:d",
       f"""SELECT b.symbol, count(*) FILTER (WHERE o) AS outliers, avg(CASE WHEN o THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT b.*, close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1) AS o
       FROM bars_with_outliers b JOIN ({QQ}) q ON q.symbol = b.symbol) b GROUP BY b.symbol""")
def _(t):
    return validate.iqr_outlier_counts(t.bars_with_outliers, "symbol", "close")


def z_smooth(sd, lo, hi, n):
    return f"""WITH z AS (SELECT *, abs((close - avg(close) OVER k) / nullif({sd}(close) OVER k, 0)) > 3 AS o, avg(close) OVER w AS m, count(close) OVER w AS c FROM bars_with_outliers
    WINDOW k AS (PARTITION BY symbol), w AS ({P} ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING))
    SELECT symbol, ts, o AS close_outlier, CASE WHEN o THEN CASE WHEN c = {n} THEN m END ELSE close END AS close FROM z"""


@query("c09_z_outliers_smoothed", "symbol ts:t close_outlier close:d", z_smooth("stddev_pop", 10, 9, 20))
def _(t):
    return clean.smooth_z_outliers(t.bars_with_outliers, ["close"], window=20)


@query("c10_z_outliers_sample", "symbol ts:t close_outlier close:d", z_smooth("stddev_samp", 2, 2, 5))
def _(t):
    return clean.smooth_z_outliers(t.bars_with_outliers, ["close"], window=5, sample=True)


@query("c11_fitted_outlier_replacer", "symbol ts:t close:d",
       f"""WITH s AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS d FROM bars GROUP BY symbol)
       SELECT b.symbol, ts, CASE WHEN abs(close - m) > 3 * d THEN avg(close) OVER (PARTITION BY b.symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE close END AS close
       FROM bars_with_outliers b JOIN s ON s.symbol = b.symbol""")
def _(t):
    return clean.replace_outliers(t.bars_with_outliers, clean.moments(t.bars_kept, "symbol", ["close"], False), ["close"])


@query("c11_fitted_fence_replacer", "symbol ts:t close:d",
       """WITH s AS (SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM bars GROUP BY symbol)
       SELECT b.symbol, ts, CASE WHEN close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1) THEN avg(close) OVER (PARTITION BY b.symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE close END AS close
       FROM bars_with_outliers b JOIN s ON s.symbol = b.symbol""")
def _(t):
    return clean.replace_beyond_fences(t.bars_with_outliers, clean.fences(t.bars_kept, "symbol", "close"), "close")


@query("c12_duplicates", "symbol rows:i distinct_rows:i duplicates:i duplicate_pct:d",
       """SELECT symbol, count(*) AS rows, count(DISTINCT ts) AS distinct_rows, count(*) - count(DISTINCT ts) AS duplicates, (count(*) - count(DISTINCT ts)) * 100.0::DOUBLE / count(*) AS duplicate_pct
       FROM (SELECT symbol, ts FROM bars_with_repeats) GROUP BY symbol""")
def _(t):
    return clean.duplicate_share(t.bars_with_repeats.select("symbol", "ts"), ["symbol"])


@query("c13_cleaning_report", "symbol rows:i gaps:i outliers:i missing:i corrected:i",
       f"""WITH z AS (SELECT *, abs((close - avg(close) OVER k) / nullif(stddev_pop(close) OVER k, 0)) > 3 AS o, {lag('ts')} AS p FROM bars_with_gaps WINDOW k AS (PARTITION BY symbol))
       SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE epoch(ts) - epoch(p) > 3600) AS gaps, count(*) FILTER (WHERE o) AS outliers,
       count(*) FILTER (WHERE close IS NULL) AS missing, count(*) FILTER (WHERE close IS NULL) AS corrected FROM z GROUP BY symbol""")
def _(t):
    return clean.cleaning_report(t.bars_with_gaps, clean.fill_forward_back(t.bars_with_gaps, ["close"]), ["close"])


@query("c14_cleaning_trends", "anomaly mean:d std:d trend:d",
       """SELECT symbol AS anomaly, avg(n) AS mean, stddev_pop(n) AS std, regr_slope(n, seq) AS trend FROM (SELECT symbol, extract('day' FROM ts)::DOUBLE AS seq,
       count(*) FILTER (WHERE close IS NULL)::DOUBLE AS n FROM bars_with_gaps GROUP BY 1, 2) GROUP BY symbol""")
def _(t):
    daily = t.bars_with_gaps.groupBy(F.col("symbol").alias("anomaly"), F.dayofmonth("ts").alias("seq")).agg(F.count_if(F.col("close").isNull()).alias("n"))
    return clean.cleaning_trends(daily)
