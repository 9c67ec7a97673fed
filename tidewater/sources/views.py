"""Market-shaped views over the driver tables, as Spark plans and as the SQL the oracles start from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import prepare, settle

# Order that makes closed trades unique (trade_id alone repeats).
TRADE_ORDER = ["exit_time", "entry_time", "trade_id", "l_partkey", "l_suppkey", "l_extendedprice"]
TRADE_ORDER_SQL = ", ".join(TRADE_ORDER)


class Tables:
    """Views for one table folder. ``*_kept`` properties are settled once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("trade_id"),
            F.col("event_type").alias("symbol"),
            F.concat(F.lit("x"), (F.col("user_id") % 2).cast("string")).alias("exchange"),
            "ts",
            (F.lit(100.0) + F.col("value")).alias("price"),
            (1 + F.col("event_id") % 10).cast("double").alias("amount"),
            F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        )

    def bars_every(self, *keys: str, unit: str = "hour") -> DataFrame:
        return (
            self.ticks.groupBy(*keys, F.date_trunc(unit, "ts").alias("bar"))
            .agg(
                F.min_by("price", "ts").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "ts").alias("close"),
                F.sum("amount").alias("volume"),
                F.count(F.lit(1)).alias("trades"),
            )
            .withColumnRenamed("bar", "ts")
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self.bars_every("symbol")

    @cached_property
    def bars_kept(self) -> DataFrame:
        return settle(self.bars, "bars")

    @cached_property
    def returns(self) -> DataFrame:
        from tidewater.operators.features import simple_returns

        return simple_returns(self.bars_kept).select(F.col("symbol").alias("series_id"), "ts", "ret")

    @cached_property
    def returns_kept(self) -> DataFrame:
        return settle(self.returns, "returns")

    @cached_property
    def equity_kept(self) -> DataFrame:
        from tidewater.operators.metrics import equity_curve

        return settle(equity_curve(self.returns_kept, damp=0.01), "equity")

    @cached_property
    def benchmark_ret(self) -> DataFrame:
        return self.returns_kept.groupBy("ts").agg(F.avg("ret").alias("bench"))

    @cached_property
    def closed_trades(self) -> DataFrame:
        li, o = self.read("lineitem"), self.read("orders")
        entry = F.least(F.col("o_orderdate"), F.col("l_shipdate")).cast("timestamp")
        exit_ = F.greatest(F.col("o_orderdate"), F.col("l_shipdate")).cast("timestamp")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
            entry.alias("entry_time"),
            exit_.alias("exit_time"),
            F.col("l_quantity").cast("double").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("entry_price"),
            (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).cast("double").alias("pnl"),
            (F.col("l_discount") - 0.05).cast("double").alias("ret"),
        )

    def trades_with(self, *cols: str) -> DataFrame:
        """Settled trades with only the order columns and ``cols``."""
        return settle(self.closed_trades.select("symbol", *TRADE_ORDER, *cols), "trades")

    @cached_property
    def funding(self) -> DataFrame:
        rate = F.round((F.col("close") - F.col("open")) / F.col("open") * 0.001, 8)
        return self.bars_kept.where(F.hour("ts") % 8 == 0).select("symbol", "ts", rate.alias("funding_rate"))

    @cached_property
    def order_book(self) -> DataFrame:
        level = F.array(*[F.lit(i) for i in range(1, 6)])

        def side(sign: int):
            return F.transform(
                level,
                lambda i: F.struct(
                    (F.col("price") + sign * 0.1 * i).alias("price"), (F.col("amount") * i).alias("qty")
                ),
            )

        return self.ticks.select("trade_id", "symbol", "ts", side(-1).alias("bids"), side(1).alias("asks"))

    @cached_property
    def candidates(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("cand_id"),
            F.col("p_retailprice").cast("double").alias("obj1"),
            F.col("p_size").cast("double").alias("obj2"),
        )

    @cached_property
    def news(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text", "lang")

    # Inputs the tables lack, made by rule -------------------------------------------------
    @cached_property
    def bars_with_gaps(self) -> DataFrame:
        """Close is missing at hours 3, 10 and 17."""
        return self.bars_kept.withColumn("close", F.when(F.hour("ts") % 7 != 3, F.col("close")))

    @cached_property
    def bars_with_outliers(self) -> DataFrame:
        hit = (F.dayofmonth("ts") * 24 + F.hour("ts")) % 97 == 0
        return self.bars_kept.withColumn("close", F.when(hit, F.col("close") * 10).otherwise(F.col("close")))

    @cached_property
    def bars_with_repeats(self) -> DataFrame:
        """Bars plus a re-sent, slightly different copy of every sixth hour (page 2)."""
        first = self.bars_kept.withColumn("page", F.lit(1))
        again = self.bars_kept.where(F.hour("ts") % 6 == 0).withColumns(
            {"close": F.col("close") + 1.0, "page": F.lit(2)}
        )
        return first.unionByName(again)

    @cached_property
    def bars_quiet_nights(self) -> DataFrame:
        quiet = F.hour("ts").between(1, 6)
        return self.bars_kept.withColumn("volume", F.when(quiet, 0.0).otherwise(F.col("volume")))

    @cached_property
    def scored(self) -> DataFrame:
        """Model output to evaluate: prediction = previous return, target = next return."""
        from tidewater.operators.features import prediction_table

        return prediction_table(self.bars_kept)

    @cached_property
    def scored_kept(self) -> DataFrame:
        return settle(self.scored, "scored")

    @cached_property
    def trials(self) -> DataFrame:
        """Optimiser trials: generation, two parameters, two objectives."""
        return self.read("part").select(
            F.col("p_partkey").alias("trial_id"),
            (F.col("p_partkey") % 10).alias("generation"),
            (F.col("p_size") % 5).alias("fast"),
            (F.col("p_partkey") % 7).alias("slow"),
            (F.col("p_retailprice") / 1000.0).cast("double").alias("score"),
            (F.col("p_size") / 50.0).cast("double").alias("risk"),
        )


_P = "PARTITION BY symbol ORDER BY ts"

# The same views for the oracles: name -> SQL over the driver tables or earlier views.
VIEW_SQL: dict[str, str] = {
    "ticks": """SELECT event_id AS trade_id, event_type AS symbol, 'x' || CAST(user_id % 2 AS VARCHAR) AS exchange, ts,
        100.0::DOUBLE + value AS price, CAST(1 + event_id % 10 AS DOUBLE) AS amount,
        CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events""",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, ts) AS close, sum(amount) AS volume, count(*) AS trades
        FROM ticks GROUP BY symbol, date_trunc('hour', ts)""",
    "returns": f"""SELECT symbol AS series_id, ts, close / lag(close) OVER ({_P}) - 1 AS ret FROM bars""",
    "equity": """SELECT series_id, ts, 10000.0::DOUBLE * exp(sum(ln(1 + 0.01::DOUBLE * coalesce(ret, 0)))
        OVER (PARTITION BY series_id ORDER BY ts)) AS equity FROM returns""",
    "benchmark_ret": "SELECT ts, avg(ret) AS bench FROM returns GROUP BY ts",
    "closed_trades": """SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_partkey, l_suppkey, l_extendedprice,
        'S' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol,
        CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side,
        CAST(least(o_orderdate, l_shipdate) AS TIMESTAMP) AS entry_time,
        CAST(greatest(o_orderdate, l_shipdate) AS TIMESTAMP) AS exit_time,
        CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice / l_quantity AS DOUBLE) AS entry_price,
        CAST(l_extendedprice * (l_discount - 0.05::DOUBLE) AS DOUBLE) AS pnl,
        CAST(l_discount - 0.05::DOUBLE AS DOUBLE) AS ret
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "funding": """SELECT symbol, ts, round((close - open) / open * 0.001::DOUBLE, 8) AS funding_rate FROM bars
        WHERE extract('hour' FROM ts) % 8 = 0""",
    "order_book": """SELECT trade_id, symbol, ts, price, amount,
        [price - 0.1::DOUBLE * i FOR i IN [1,2,3,4,5]] AS bid_px, [price + 0.1::DOUBLE * i FOR i IN [1,2,3,4,5]] AS ask_px,
        [amount * i FOR i IN [1,2,3,4,5]] AS qty FROM ticks""",
    "candidates": """SELECT p_partkey AS cand_id, CAST(p_retailprice AS DOUBLE) AS obj1,
        CAST(p_size AS DOUBLE) AS obj2 FROM part""",
    "news": "SELECT doc_id, text, lang FROM documents",
    "bars_with_gaps": """SELECT symbol, ts, open, high, low,
        CASE WHEN extract('hour' FROM ts) % 7 <> 3 THEN close END AS close, volume, trades FROM bars""",
    "bars_with_outliers": """SELECT symbol, ts, open, high, low, CASE WHEN (extract('day' FROM ts) * 24 +
        extract('hour' FROM ts)) % 97 = 0 THEN close * 10 ELSE close END AS close, volume, trades FROM bars""",
    "bars_with_repeats": """SELECT symbol, ts, open, high, low, close, volume, trades, 1 AS page FROM bars UNION ALL
        SELECT symbol, ts, open, high, low, close + 1.0::DOUBLE, volume, trades, 2 FROM bars
        WHERE extract('hour' FROM ts) % 6 = 0""",
    "bars_quiet_nights": """SELECT symbol, ts, open, high, low, close, CASE WHEN extract('hour' FROM ts) BETWEEN 1 AND 6
        THEN 0.0::DOUBLE ELSE volume END AS volume, trades FROM bars""",
    "scored": f"""SELECT symbol, ts, pred, actual FROM (SELECT symbol, ts, close / lag(close) OVER ({_P}) - 1 AS pred,
        lead(close) OVER ({_P}) / close - 1 AS actual FROM bars) WHERE pred IS NOT NULL AND actual IS NOT NULL""",
    "trials": """SELECT p_partkey AS trial_id, p_partkey % 10 AS generation, p_size % 5 AS fast, p_partkey % 7 AS slow,
        CAST(p_retailprice / 1000.0 AS DOUBLE) AS score, CAST(p_size AS DOUBLE) / 50.0::DOUBLE AS risk FROM part""",
}
