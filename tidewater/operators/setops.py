"""Top-k, last-n, set operations and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.plans.timeline import join_keys, lay_out, time_slice
from tidewater.session import settle


def last_rows(df: DataFrame, keys: list[str] | str, ts: str, n: int, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Last ``n`` rows per key; NULL times come first.

    Rows are counted per key and time slice; only the last slices that together hold ``n`` rows are read again (the earliest
    of them bounds the scan), and only those rows are sorted, slice by slice.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = time_slice(ts, slice_seconds)
    after = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(*keys, part.alias("__slice")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__want", n - after)
    wanted = settle(counts.where("__want > 0").drop("__n"), "last-slices")
    first = wanted.agg(F.min("__slice"), F.count_if(F.col("__slice").isNull())).first()
    rows = df if first[0] is None or first[1] else df.where(F.col(ts) >= F.timestamp_seconds(F.lit(first[0] * slice_seconds)))
    rows = join_keys(rows.withColumn("__slice", part), wanted, [*keys, "__slice"])
    place = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(F.desc_nulls_last(ts)))
    return rows.withColumn("__place", place).where("__place <= __want").drop("__place", "__want", "__slice")


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """Global top n (each task keeps n rows, the driver plan merges them)."""
    return df.orderBy(*order).limit(n)


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).count().orderBy(F.desc("count"), col).limit(k)


def best_per_group(df: DataFrame, keys: list[str], score: str, tie: str, cols: list[str]) -> DataFrame:
    """Arg-max row per group as a partial aggregation; ties go to the smaller ``tie`` value."""
    pick = F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(tie)))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])


def capped_per_hour(df: DataFrame, key: str, ts: str, cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows per key and hour, in order (alert throttling)."""
    keyed = df.withColumn("__hour", F.date_trunc("hour", ts))
    tl = lay_out(keyed, [key, "__hour"], order, time_slice(ts, 60), positions=True)
    return tl.add(__keep=tl.pos < cap).rows().where("__keep").drop("__keep", "__hour")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def pivot_times(df: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """Union time axis with one column per named symbol; missing bars are NULL."""
    return df.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col(value))).alias(s) for s in symbols])


def align_times(df: DataFrame, value: str = "close") -> DataFrame:
    """(ts, symbol, value) for every timestamp of any symbol and every symbol; missing values are NULL.

    The symbols of one timestamp are gathered and the missing ones added from the list of all symbols, which is one row.
    """
    every = df.agg(F.array_sort(F.collect_set("symbol")).alias("every")).scalar()
    at = df.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", value))).alias("__seen"))
    return at.select("ts", F.explode(every).alias("symbol"), "__seen").select("ts", "symbol", F.element_at("__seen", F.col("symbol")).alias(value))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys), keys, "left_anti")


def time_band_factor(df: DataFrame, ts: str, periods: list[tuple[str, str, float]], default: float = 1.0) -> DataFrame:
    """Factor by time of day on weekdays; ``periods`` are (start HH:mm, end HH:mm, factor)."""
    clock, weekday = F.date_format(ts, "HH:mm"), F.dayofweek(ts).between(2, 6)
    factor: Column | None = None
    for start, end, value in periods:
        hit = weekday & (clock >= start) & (clock < end)
        factor = F.when(hit, F.lit(value)) if factor is None else factor.when(hit, F.lit(value))
    return df.withColumn("factor", factor.otherwise(F.lit(default)))
