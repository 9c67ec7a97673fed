"""Data checks: each is one aggregation or one shared timeline over all symbols."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalars import clamp, ratio
from tidewater.operators.features import bars_timeline
from tidewater.plans.attach import attach, quantiles
from tidewater.plans.timeline import lay_out, time_slice

PRICES = ["open", "high", "low", "close"]
OHLCV = PRICES + ["volume"]


def in_range(df: DataFrame, ts: str = "ts", start=None, end=None) -> DataFrame:
    """Rows between both ends, inclusive; a missing end is open."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def missing_ratios(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def long_form(df: DataFrame, keys: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot columns to (name, value) rows."""
    return df.unpivot(keys, cols, name, value)


def ohlc_ok() -> Column:
    o, h, l, c = (F.col(x) for x in PRICES)
    return (l <= h) & (l <= o) & (l <= c) & (h >= o) & (h >= c)


def count_failures(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Any number of named boolean checks in one pass: rows that fail each check."""
    return df.groupBy(*keys).agg(*[F.count_if(~c).alias(n) for n, c in checks.items()])


def out_of_order(df: DataFrame, key: str, arrival: list[str], ts: str, slice_by: Column) -> DataFrame:
    """Rows whose timestamp is before that of the row that arrived just before."""
    tl = lay_out(df, key, arrival, slice_by, back=1)
    return tl.add(__late=F.col(ts) < tl.lag(ts)).rows().groupBy(key).agg(F.count_if("__late").alias("late_rows"))


def time_gaps(df: DataFrame, seconds: int, key: str = "symbol") -> DataFrame:
    """Start, end and length of every silence longer than ``seconds``."""
    tl = bars_timeline(df, back=1, key=key)
    out = tl.add(gap_start=tl.lag("ts")).rows()
    out = out.withColumn("gap_seconds", F.unix_seconds("ts") - F.unix_seconds("gap_start"))
    return out.where(F.col("gap_seconds") > seconds).select(key, "gap_start", F.col("ts").alias("gap_end"), "gap_seconds")


def price_jumps(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    tl = bars_timeline(df, back=1)
    change = ratio(F.col("close"), tl.lag("close")) - 1
    return tl.add(change=change).rows().where(F.abs("change") > threshold)


def longest_run(df: DataFrame, key: str, order: list, slice_by: Column, hit: Column, out: str) -> DataFrame:
    """Longest unbroken run of rows where ``hit`` holds, per key.

    The run number of a row is the count of non-hits so far, a running scan; run lengths are an
    ordinary aggregation, so a run may cross any number of chunks.
    """
    tl = lay_out(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), key, order, slice_by)
    runs = tl.running(__run=("sum", (~F.col("__hit")).cast("long"))).rows()
    lengths = runs.groupBy(key, "__run").agg(F.count_if("__hit").alias("__len"))
    return lengths.groupBy(key).agg(F.max("__len").alias(out))


def zero_volume_runs(bars: DataFrame, limit: int = 5) -> DataFrame:
    out = longest_run(bars, "symbol", ["ts"], time_slice("ts", 30 * 86400), F.col("volume") == 0, "longest")
    return out.withColumn("suspicious", F.col("longest") > limit)


def tick_ok() -> Column:
    return (F.col("price") > 0) & (F.col("amount") > 0) & F.col("side").isin("buy", "sell")


def book_ok() -> Column:
    """Best bid not above best ask."""
    return F.array_max(F.transform("bids", lambda b: b["price"])) <= F.array_min(F.transform("asks", lambda a: a["price"]))


def correlated_pairs(df: DataFrame, keys: list[str], cols: list[str], threshold: float = 0.95) -> DataFrame:
    from tidewater.operators.metrics import correlation_pairs

    return correlation_pairs(df, keys, cols).where(F.abs("corr") > threshold)


def detect_data_type(columns: list[str]) -> str:
    """Kind of market data from column names alone."""
    have = set(columns)
    if {"open", "high", "low", "close", "volume"} <= have:
        return "futures" if have & {"funding_rate", "open_interest", "mark_price"} else "ohlcv"
    if {"price", "amount", "side"} <= have:
        return "trades"
    if {"bids", "asks"} <= have:
        return "orderbook"
    if "funding_rate" in have:
        return "funding"
    return "unknown"


def quality_from_report(errors: Column, warnings: Column, avg_missing: Column, outliers: Column) -> Column:
    return clamp(1.0 - errors * 0.2 - warnings * 0.1 - avg_missing - outliers * 0.01, 0.0, 1.0)


def quality_from_ratios(completeness: Column, outlier_ratio: Column, gap_ratio: Column) -> Column:
    return 0.4 * completeness + 0.3 * (1 - outlier_ratio) + 0.3 * (1 - gap_ratio)


def iqr_outlier_counts(df: DataFrame, key: str, col: str, k: float = 1.5) -> DataFrame:
    from tidewater.operators.clean import iqr_flags

    return iqr_flags(df, key, [col], k).groupBy(key).agg(
        F.count_if(f"{col}_outlier").alias("outliers"),
        F.avg(F.col(f"{col}_outlier").cast("double")).alias("share"),
    )


LEVELS = {"basic": 1, "intermediate": 2, "advanced": 3, "full": 4}


def validation_report(
    bars: DataFrame,
    level: str = "full",
    gap_seconds: int = 7200,
    price_threshold: float = 0.1,
    volume_threshold: float = 1000.0,
    max_missing: float = 0.1,
    custom: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per symbol with errors, warnings, missing ratios, outlier counts and a score.

    Levels are cumulative: basic (missing values, prices), intermediate (+ gaps), advanced
    (+ jumps, volumes, outliers), full (+ OHLC consistency). ``custom`` adds named row checks.
    """
    rank = LEVELS[level]
    tl = bars_timeline(bars, back=1)
    rows = tl.add(
        __gap=F.unix_seconds("ts") - F.unix_seconds(tl.lag("ts")),
        __jump=F.abs(ratio(F.col("close"), tl.lag("close")) - 1),
    ).rows()
    if rank >= 3:
        fences = quantiles(bars, "symbol", "close", {"__q1": 0.25, "__q3": 0.75})
        rows = attach(rows, fences, "symbol")
        iqr = F.col("__q3") - F.col("__q1")
        outlier = (F.col("close") < F.col("__q1") - 1.5 * iqr) | (F.col("close") > F.col("__q3") + 1.5 * iqr)
    else:
        outlier = F.lit(False)
    custom = custom or {}
    rep = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"__m_{c}") for c in OHLCV],
        F.count_if(reduce(or_, [F.col(p) <= 0 for p in PRICES])).alias("__bad_price"),
        F.count_if(F.col("__gap") > gap_seconds).alias("gaps"),
        F.count_if(F.col("__jump") > price_threshold).alias("jumps"),
        F.count_if(F.col("volume") > volume_threshold).alias("volumes"),
        F.count_if(outlier).alias("outliers"),
        F.count_if(~ohlc_ok()).alias("inconsistent"),
        *[F.count_if(~c).alias(f"__x_{n}") for n, c in custom.items()],
    )
    miss = [F.col(f"__m_{c}") for c in OHLCV]
    errors = [F.when(F.greatest(*miss) > max_missing, "too many missing values"), F.when(F.col("__bad_price") > 0, "non-positive price")]
    warnings = [F.when(F.col(f"__x_{n}") > 0, F.lit(n)) for n in custom]
    if rank >= 2:
        warnings.append(F.when(F.col("gaps") > 0, "time gaps"))
    if rank >= 3:
        warnings += [
            F.when(F.col("outliers") > 0, "outliers"),
            F.when(F.col("jumps") > 0, "suspicious price changes"),
            F.when(F.col("volumes") > 0, "suspicious volumes"),
        ]
    if rank >= 4:
        errors.append(F.when(F.col("inconsistent") > 0, "inconsistent OHLC"))
    compact = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    rep = rep.withColumns(
        {
            "errors": compact(errors),
            "warnings": compact(warnings),
            "missing": F.create_map(*[x for c in OHLCV for x in (F.lit(c), F.col(f"__m_{c}"))]),
            "avg_missing": sum(miss[1:], miss[0]) / len(miss),
        }
    )
    score = quality_from_report(F.size("errors"), F.size("warnings"), F.col("avg_missing"), F.col("outliers"))
    return rep.withColumns({"is_valid": F.size("errors") == 0, "score": score}).drop(
        *[c for c in rep.columns if c.startswith("__")]
    )


def validation_summary(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("validations"),
        F.avg(F.col("is_valid").cast("double")).alias("success_rate"),
        F.avg("score").alias("mean_score"),
    )


def common_issues(reports: DataFrame, k: int = 5) -> DataFrame:
    issues = reports.select(F.explode(F.concat("errors", "warnings")).alias("issue"))
    return issues.groupBy("issue").count().orderBy(F.desc("count"), "issue").limit(k)


def market_filter(
    bars: DataFrame, books: DataFrame, min_volume: float = 0.0, min_trades: int = 0, min_price: float = 0.0, max_price: float = float("inf"),
    max_spread: float = float("inf"), max_volatility: float = float("inf"),
) -> DataFrame:
    """Bars of the symbols whose last 24 hours pass every rule: volume, trades, price range, mean relative spread, return deviation."""
    returns = bars_timeline(bars, back=1)
    rows = returns.add(__r=ratio(F.col("close"), returns.lag("close")) - 1).rows()
    end = bars.agg(F.max("ts").alias("end")).scalar()
    day = F.col("ts") > end - F.expr("interval 24 hours")
    stats = rows.where(day).groupBy("symbol").agg(
        F.sum("volume").alias("v"), F.sum("trades").alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"), F.stddev("__r").alias("sd"))
    bid, ask = F.array_max(F.col("bids.price")), F.array_min(F.col("asks.price"))
    spread = books.where(day).groupBy("symbol").agg(F.avg((ask - bid) / ((ask + bid) / 2)).alias("spread"))
    good = stats.join(spread, "symbol").where(
        (F.col("v") > min_volume) & (F.col("n") > min_trades) & (F.col("lo") > min_price) & (F.col("hi") < max_price)
        & (F.col("spread") <= max_spread) & (F.col("sd") <= max_volatility))
    return bars.join(good.select("symbol"), "symbol", "left_semi")


def within_bounds(params: DataFrame, bounds: DataFrame, ids: list[str]) -> DataFrame:
    """All parameters of a candidate inside their bounds; an unknown parameter fails."""
    j = params.join(bounds, "param", "left")
    ok = F.col("lo").isNotNull() & F.col("value").between(F.col("lo"), F.col("hi"))
    return j.groupBy(*ids).agg(F.bool_and(ok).alias("valid"), F.count_if(F.col("lo").isNull()).alias("unknown"))
