"""Typed rows from landed exchange messages and bar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions.scalars import parse_millis


def klines(df: DataFrame, body: str = "body") -> DataFrame:
    """``[[ms, o, h, l, c, v], ...]`` per row to one typed bar per entry."""
    k = df.withColumn("__k", F.explode(F.from_json(body, schemas.KLINES_JSON))).drop(body)
    names = ["open", "high", "low", "close", "volume"]
    return k.select(
        *[c for c in k.columns if c != "__k"],
        parse_millis(F.col("__k")[0]).alias("ts"),
        *[F.col("__k")[i + 1].alias(n) for i, n in enumerate(names)],
    )


def trades(df: DataFrame, body: str = "body") -> DataFrame:
    m = df.select(F.from_json(body, schemas.TRADE_JSON).alias("m"))
    return m.select(
        F.col("m.id").alias("trade_id"), "m.symbol", parse_millis(F.col("m.timestamp")).alias("ts"),
        "m.price", "m.amount", "m.side", F.col("m.fee.cost").alias("fee"), F.col("m.fee.currency").alias("fee_currency"),
    )


def _levels(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(x[0].alias("price"), x[1].alias("qty")))


def order_books(df: DataFrame, body: str = "body") -> DataFrame:
    m = df.select(F.from_json(body, schemas.BOOK_JSON).alias("m"))
    return m.select(
        "m.symbol", parse_millis(F.col("m.timestamp")).alias("ts"),
        _levels(F.col("m.bids")).alias("bids"), _levels(F.col("m.asks")).alias("asks"),
    )


def futures(df: DataFrame, body: str = "body") -> DataFrame:
    """Futures snapshots; a missing mark or index price is the close, missing open interest 0."""
    m = df.select(F.from_json(body, schemas.FUTURES_JSON).alias("m"))
    return m.select(
        "m.symbol", parse_millis(F.col("m.timestamp")).alias("ts"), "m.close",
        F.coalesce("m.mark", "m.close").alias("mark_price"), F.coalesce("m.index", "m.close").alias("index_price"),
        F.coalesce(F.col("m.openInterest"), F.lit(0.0)).alias("open_interest"),
        F.col("m.fundingRate").alias("funding_rate"),
    )


def funding_history(df: DataFrame, body: str = "body") -> DataFrame:
    m = df.select(F.explode(F.from_json(body, "array<struct<timestamp:bigint,symbol:string,fundingRate:double>>")).alias("m"))
    return m.select("m.symbol", parse_millis(F.col("m.timestamp")).alias("ts"), F.col("m.fundingRate").alias("funding_rate"))


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.BAR_CSV).option("header", True).csv(path)
    return raw.withColumn("ts", F.to_timestamp("timestamp")).drop("timestamp")


def read_bar_yaml(spark: SparkSession, path: str, timeframe: str | None = None) -> DataFrame:
    """Bars from YAML dumps named ``BASE_QUOTE_timeframe_...`` or kept in ``symbol=`` folders.

    Records start at ``- `` in column 0, so the text source splits the files into records itself
    and a large file is still read by many tasks. The timestamp is an ISO string or a
    nanosecond integer inside a tag; the integer is matched as text, nothing is unpickled.
    """
    raw = spark.read.option("lineSep", "\n- ").text(path).withColumn("file", F.col("_metadata.file_name"))
    number = lambda f: F.regexp_extract("value", rf"(?:^|\s){f}: ([-+0-9.eE]+)", 1)
    filled = lambda c: F.nullif(c, F.lit(""))
    iso = filled(F.regexp_extract("value", r"timestamp: '([0-9T:.\-]+)'", 1))
    nanos = filled(F.regexp_extract("value", r"\n\s*- ([0-9]{15,})", 1))
    ts = F.coalesce(F.to_timestamp(iso), F.timestamp_micros(F.expr("nanos div 1000")))
    parts = F.split(F.regexp_replace("file", r"\.ya?ml$", ""), "_")
    symbol = F.col("symbol") if "symbol" in raw.columns else F.concat_ws("_", parts[0], parts[1])
    rows = raw.where(F.col("value").contains("close: ") & F.col("value").contains("timestamp:"))
    return rows.withColumn("nanos", nanos.cast("long")).select(
        symbol.alias("symbol"), (F.lit(timeframe) if timeframe else parts[2]).alias("timeframe"), ts.alias("ts"),
        *[filled(number(f)).cast("double").alias(f) for f in ("open", "high", "low", "close", "volume")],
    )
