"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio


def ticks_to_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV, trade count and VWAP per symbol and time bucket; all aggregates combine map-side."""
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("__w"))
        .agg(
            F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trades"),
            F.sum(F.col("price") * F.col("amount")).alias("__pv"),
        )
        .withColumns({"ts": F.col("__w.start"), "vwap": ratio("__pv", "volume")})
        .drop("__w", "__pv")
    )


def resample(bars: DataFrame, width: str, last_columns: list[str] | None = None) -> DataFrame:
    """Coarser bars: open first, high max, low min, close last, volume sum, indicators last."""
    extra = [F.max_by(c, "ts").alias(c) for c in last_columns or []]
    return (
        bars.groupBy("symbol", F.window("ts", width).alias("__w"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), *extra,
        )
        .withColumn("ts", F.col("__w.start"))
        .drop("__w")
    )


def aggregate_every(df: DataFrame, keys: list[str], width: str, aggs: dict[str, Column]) -> DataFrame:
    """Any named aggregates per key and time bucket."""
    out = df.groupBy(*keys, F.window("ts", width).alias("__w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.withColumn("ts", F.col("__w.start")).drop("__w")
