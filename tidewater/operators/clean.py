"""Cleaning: calendars, gap filling, outlier handling, duplicates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio
from tidewater.operators.features import bars_timeline
from tidewater.plans.attach import attach, quantiles


def on_calendar(bars: DataFrame, step: str = "1 hour", key: str = "symbol") -> DataFrame:
    """Left join onto the full time grid between each symbol's first and last bar.

    The grid is expanded in two steps (days, then steps of a day), so no task builds a long array.
    """
    span = bars.groupBy(key).agg(F.min("ts").alias("__a"), F.max("ts").alias("__z"))
    days = span.withColumn(
        "__d", F.explode(F.sequence(F.date_trunc("day", "__a"), F.date_trunc("day", "__z"), F.expr("interval 1 day")))
    )
    grid = days.withColumn(
        "ts", F.explode(F.expr(f"sequence(__d, __d + interval 1 day - interval 1 microsecond, interval {step})"))
    )
    grid = grid.where(F.col("ts").between(F.col("__a"), F.col("__z"))).select(key, "ts")
    return grid.join(bars, [key, "ts"], "left")


def fill_forward_back(df: DataFrame, cols: list[str]) -> DataFrame:
    """Last known value, then for the head the first known one."""
    tl = bars_timeline(df)
    scans = {f"__f_{c}": ("last", c) for c in cols} | {f"__b_{c}": ("next", c) for c in cols}
    out = tl.running(**scans).rows()
    out = out.withColumns({c: F.coalesce(F.col(f"__f_{c}"), F.col(f"__b_{c}")) for c in cols})
    return out.drop(*scans)


def interpolate(df: DataFrame, cols: list[str], by_time: bool = False) -> DataFrame:
    """Linear between known neighbours by row number or by time; a NULL tail takes the last value."""
    tl = bars_timeline(df, positions=True)
    x = F.unix_micros("ts") if by_time else tl.pos
    tl = tl.add(__x=x)
    scans = {}
    for c in cols:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("__x").alias("x"), F.col(c).cast("double").alias("v")))
        scans |= {f"__p_{c}": ("last", point), f"__n_{c}": ("next", point)}
    out = tl.running(**scans).rows()

    def between(c: str) -> Column:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        share = ratio((F.col("__x") - p["x"]).cast("double"), (n["x"] - p["x"]).cast("double"))
        return F.coalesce(F.col(c), p["v"] + (n["v"] - p["v"]) * share, p["v"])

    return out.withColumns({c: between(c) for c in cols}).drop("__x", *scans)


def fill_statistic(df: DataFrame, cols: list[str], stat: str = "mean", key: str = "symbol") -> DataFrame:
    if stat == "mean":
        stats = df.groupBy(key).agg(*[F.avg(c).alias(f"__s_{c}") for c in cols])
    else:
        stats = None
        for c in cols:
            q = quantiles(df, key, c, {f"__s_{c}": 0.5})
            stats = q if stats is None else stats.join(q, key, "full")
    out = attach(df, stats, key)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__s_{c}")) for c in cols}).drop(*[f"__s_{c}" for c in cols])


def fill_one_way(df: DataFrame, cols: list[str], way: str) -> DataFrame:
    """``last`` known value (the head stays missing) or ``next`` known value (the tail stays missing)."""
    out = bars_timeline(df).running(**{f"__o_{c}": (way, c) for c in cols}).rows()
    return out.withColumns({c: F.col(f"__o_{c}") for c in cols}).drop(*[f"__o_{c}" for c in cols])


def fill_missing(df: DataFrame, cols: list[str], strategy: str) -> DataFrame:
    """Strategies: drop, interpolate, time, mean, median, ffill (forward, then back), forward, bfill (back only)."""
    actions = {
        "drop": lambda: df.na.drop("any", subset=cols),
        "interpolate": lambda: interpolate(df, cols),
        "time": lambda: interpolate(df, cols, by_time=True),
        "mean": lambda: fill_statistic(df, cols, "mean"),
        "median": lambda: fill_statistic(df, cols, "median"),
        "ffill": lambda: fill_forward_back(df, cols),
        "forward": lambda: fill_one_way(df, cols, "last"),
        "bfill": lambda: fill_one_way(df, cols, "next"),
    }
    return actions[strategy]()


# -- outliers -----------------------------------------------------------------------------
def _fences(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    fences = None
    for c in cols:
        q = quantiles(df, key, c, {f"__q1_{c}": 0.25, f"__q3_{c}": 0.75})
        fences = q if fences is None else fences.join(q, key, "full")
    return fences


def _fence(c: str, k: float) -> tuple[Column, Column]:
    q1, q3 = F.col(f"__q1_{c}"), F.col(f"__q3_{c}")
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def _drop_fences(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"__q{i}_{c}" for i in (1, 3) for c in cols])


def clip_iqr(df: DataFrame, key: str, cols: list[str], k: float = 3.0) -> DataFrame:
    out = attach(df, _fences(df, key, cols), key)
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), _fence(c, k)[0]), _fence(c, k)[1])) for c in cols})
    return _drop_fences(out, cols)


def iqr_flags(df: DataFrame, key: str, cols: list[str], k: float = 1.5) -> DataFrame:
    out = attach(df, _fences(df, key, cols), key)
    flags = {f"{c}_outlier": F.coalesce((F.col(c) < _fence(c, k)[0]) | (F.col(c) > _fence(c, k)[1]), F.lit(False)) for c in cols}
    return _drop_fences(out.withColumns(flags), cols)


def moments(df: DataFrame, key: str, cols: list[str], sample: bool) -> DataFrame:
    sd = F.stddev if sample else F.stddev_pop
    return df.groupBy(key).agg(*[a for c in cols for a in (F.avg(c).alias(f"__mu_{c}"), sd(c).alias(f"__sd_{c}"))])


def z_flags(df: DataFrame, key: str, cols: list[str], threshold: float = 3.0, sample: bool = False) -> DataFrame:
    out = attach(df, moments(df, key, cols, sample), key)
    z = lambda c: F.abs(ratio(F.col(c) - F.col(f"__mu_{c}"), F.col(f"__sd_{c}")))
    out = out.withColumns({f"{c}_outlier": F.coalesce(z(c) > threshold, F.lit(False)) for c in cols})
    return out.drop(*[f"__{p}_{c}" for p in ("mu", "sd") for c in cols])


def smooth_z_outliers(df: DataFrame, cols: list[str], threshold: float = 3.0, window: int = 20, sample: bool = False) -> DataFrame:
    """Replace z-score outliers by the centred rolling mean; NULL where that frame is not full."""
    tl = bars_timeline(z_flags(df, "symbol", cols, threshold, sample), back=window, ahead=window)
    lo, hi = -(window // 2), (window - 1) // 2
    return tl.add(
        **{c: F.when(F.col(f"{c}_outlier"), tl.centred(F.avg, c, lo, hi)).otherwise(F.col(c)) for c in cols}
    ).rows()


def fences(df: DataFrame, key: str, col: str) -> DataFrame:
    """Fit step of the quartile detector: first and third quartile per key."""
    return quantiles(df, key, col, {f"__q1_{col}": 0.25, f"__q3_{col}": 0.75})


def replace_beyond_fences(df: DataFrame, fitted: DataFrame, col: str, reach: float = 1.5, window: int = 5) -> DataFrame:
    """Transform step of the quartile detector: values beyond the fences become the trailing mean."""
    q1, q3 = F.col(f"__q1_{col}"), F.col(f"__q3_{col}")
    far = (F.col(col) < q1 - reach * (q3 - q1)) | (F.col(col) > q3 + reach * (q3 - q1))
    tl = bars_timeline(attach(df, fitted, "symbol").withColumn("__far", far), back=window)
    return tl.add(**{col: F.when(F.col("__far"), F.avg(col).over(tl.last(window))).otherwise(F.col(col))}).rows().drop("__far", f"__q1_{col}", f"__q3_{col}")


def replace_outliers(df: DataFrame, fitted: DataFrame, cols: list[str], threshold: float = 3.0, window: int = 5) -> DataFrame:
    """Transform step of a fitted detector: outliers become the trailing mean (any frame length)."""
    out = attach(df, fitted, "symbol")
    flags = {f"__o_{c}": F.abs(F.col(c) - F.col(f"__mu_{c}")) > threshold * F.col(f"__sd_{c}") for c in cols}
    tl = bars_timeline(out.withColumns(flags), back=window)
    tl = tl.add(**{c: F.when(F.col(f"__o_{c}"), F.avg(c).over(tl.last(window))).otherwise(F.col(c)) for c in cols})
    return tl.rows().drop(*flags, *[f"__{p}_{c}" for p in ("mu", "sd") for c in cols])


# -- duplicates ---------------------------------------------------------------------------
def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct rows and duplicate share per key; identical rows are folded map-side first."""
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys, *rest).agg(F.count(F.lit(1)).alias("__n"))
    out = folded.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    dup = F.col("rows") - F.col("distinct_rows")
    return out.withColumns({"duplicates": dup, "duplicate_pct": dup / F.col("rows") * 100})


def dedupe(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key in arrival order, as a partial aggregation instead of a sort per key."""
    payload = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.min_by if keep == "first" else F.max_by
    rank = F.struct(*order) if len(order) > 1 else order[0]
    out = df.groupBy(*keys).agg(pick(payload, rank).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in df.columns if c not in keys])


def cleaning_report(bars: DataFrame, cleaned: DataFrame, cols: list[str], expected_seconds: int = 3600) -> DataFrame:
    """Counts per symbol of gaps, outliers, missing values and corrected cells."""
    flags = z_flags(bars, "symbol", cols)
    tl = bars_timeline(flags, back=1)
    rows = tl.add(__gap=F.unix_seconds("ts") - F.unix_seconds(tl.lag("ts")) > expected_seconds).rows()
    before = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("__gap").alias("gaps"),
        sum((F.count_if(f"{c}_outlier") for c in cols[1:]), F.count_if(f"{cols[0]}_outlier")).alias("outliers"),
        sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull())).alias("missing"),
    )
    after = cleaned.groupBy("symbol").agg(
        sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull())).alias("missing_after")
    )
    return before.join(after, "symbol").withColumn("corrected", F.col("missing") - F.col("missing_after"))


def cleaning_trends(history: DataFrame) -> DataFrame:
    """Mean, spread and linear trend of anomaly counts per type over ``seq``."""
    return history.groupBy("anomaly").agg(
        F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("std"),
        F.regr_slope(F.col("n").cast("double"), F.col("seq").cast("double")).alias("trend"),
    )
