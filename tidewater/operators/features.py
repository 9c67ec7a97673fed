"""Model-ready features on bars: returns, calendar features, rolling statistics, targets, sequences, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import gaussian, ratio, uniform
from tidewater.plans.attach import attach, quantiles
from tidewater.plans.timeline import Timeline, lay_out, time_slice

BAR_SLICE = 30 * 86400


def bars_timeline(bars: DataFrame, back: int = 0, ahead: int = 0, key: str = "symbol", positions: bool = False, block: int = 0, gaps: bool = True) -> Timeline:
    return lay_out(bars, key, ["ts"], time_slice("ts", BAR_SLICE), back, ahead, positions=positions, block=block, gaps=gaps)


def simple_returns(bars: DataFrame, price: str = "close") -> DataFrame:
    tl = bars_timeline(bars, back=1)
    return tl.add(ret=ratio(F.col(price), tl.lag(price)) - 1).rows()


def all_returns(bars: DataFrame) -> DataFrame:
    """Simple, log and cumulative returns."""
    tl = bars_timeline(bars, back=1)
    prev = tl.lag("close")
    tl = tl.add(ret=ratio(F.col("close"), prev) - 1, log_ret=F.ln(F.col("close")) - F.ln(prev))
    return tl.running(__cum=("product", 1 + F.col("ret"))).rows().withColumn("cum_ret", F.col("__cum") - 1).drop("__cum")


def prediction_table(bars: DataFrame) -> DataFrame:
    """Naive momentum model output: prediction = last return, actual = next return."""
    tl = bars_timeline(bars, back=1, ahead=1)
    tl = tl.add(pred=ratio(F.col("close"), tl.lag("close")) - 1, actual=ratio(tl.lead("close"), F.col("close")) - 1)
    return tl.rows().where("pred IS NOT NULL AND actual IS NOT NULL").select("symbol", "ts", "pred", "actual")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Cyclic hour / weekday (Monday = 0) / month, business-day flag and share of the day elapsed."""
    t = F.col(ts)
    dow = (F.dayofweek(t) + 5) % 7

    def cyc(x: Column, period: int):
        angle = F.lit(2 * math.pi) * x / F.lit(period)
        return F.sin(angle), F.cos(angle)

    (hs, hc), (ds, dc), (ms, mc) = cyc(F.hour(t), 24), cyc(dow, 7), cyc(F.month(t), 12)
    return df.withColumns(
        {
            "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "month_sin": ms, "month_cos": mc,
            "is_business_day": dow < 5,
            "day_progress": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / F.lit(86400.0),
        }
    )


def price_derivatives(bars: DataFrame) -> DataFrame:
    tl = bars_timeline(bars, back=2)
    tl = tl.add(price_velocity=F.col("close") - tl.lag("close"))
    return tl.add(price_acceleration=F.col("price_velocity") - tl.lag("price_velocity")).rows()


def volume_features(bars: DataFrame, n: int = 20) -> DataFrame:
    tl = bars_timeline(bars, back=n)
    tl = tl.add(volume_ma=tl.full(F.avg, "volume", n), volume_std=tl.full(F.stddev, "volume", n))
    return tl.rows().withColumn("volume_zscore", ratio(F.col("volume") - F.col("volume_ma"), F.col("volume_std")))


def range_features(bars: DataFrame, n: int = 20) -> DataFrame:
    tl = bars_timeline(bars.withColumn("daily_range", F.col("high") - F.col("low")), back=n)
    tl = tl.add(daily_range_ma=tl.full(F.avg, "daily_range", n))
    return tl.rows().withColumn("range_expansion", ratio("daily_range", "daily_range_ma"))


def futures_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """Needs ``index_price``, ``funding_rate`` and ``open_interest`` next to the bars."""
    from tidewater.operators.indicators import true_range

    tl = bars_timeline(bars, back=n + 1)
    tl = tl.add(
        basis=F.col("close") - F.col("index_price"),
        basis_pct=ratio(F.col("close") - F.col("index_price"), F.col("index_price")) * 100,
        funding_rate_change=F.col("funding_rate") - tl.lag("funding_rate"),
        funding_rate_ma=tl.full(F.avg, "funding_rate", n),
        open_interest_change=F.col("open_interest") - tl.lag("open_interest"),
        open_interest_ma=tl.full(F.avg, "open_interest", n),
        __tr=true_range(tl),
    )
    return tl.add(implied_volatility=tl.full(F.avg, "__tr", n)).drop("__tr").rows()


def rolling_scale(bars: DataFrame, n: int = 100) -> DataFrame:
    """Rolling min-max price scaling and ``log(volume + 1)``."""
    tl = bars_timeline(bars, back=n)
    tl = tl.add(__lo=tl.full(F.min, "close", n), __hi=tl.full(F.max, "close", n))
    price = ratio(F.col("close") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return tl.add(price_scaled=price, volume_log=F.log1p("volume")).drop("__lo", "__hi").rows()


def moving_mean(bars: DataFrame, n: int = 3, col: str = "close") -> DataFrame:
    tl = bars_timeline(bars, back=n)
    return tl.add(smoothed=tl.full(F.avg, col, n)).rows()


def direction_targets(bars: DataFrame, horizon: int = 1, dead_band: float = 0.0) -> DataFrame:
    """Forward return, its sign, and the three-class label with a dead band."""
    tl = bars_timeline(bars, ahead=horizon)
    df = tl.add(target_return=ratio(tl.lead("close", horizon), F.col("close")) - 1).rows()
    r = F.col("target_return")
    label = F.when(r > dead_band, 1).when(r < -dead_band, -1).when(r.isNotNull(), 0)
    return df.withColumns({"direction": F.signum(r), "label": label})


def config_features(bars: DataFrame) -> DataFrame:
    """Price and volume momentum (10), volatility (20), trend strength (14), support and resistance (20)."""
    tl = bars_timeline(bars, back=21)
    tl = tl.add(
        price_momentum=ratio(F.col("close"), tl.lag("close", 10)) - 1,
        volume_momentum=ratio(F.col("volume"), tl.lag("volume", 10)) - 1,
        volatility=tl.full(F.stddev, "close", 20),
        support=tl.full(F.min, "low", 20),
        resistance=tl.full(F.max, "high", 20),
        __x=tl.pos.cast("double"),
    )
    slope = F.regr_slope(F.col("close"), F.col("__x")).over(tl.last(14))
    return tl.add(trend_strength=F.when(tl.pos >= 13, F.abs(slope))).drop("__x").rows()


def volume_profile(bars: DataFrame, bins: int = 10) -> DataFrame:
    """Traded volume per price bin and symbol."""
    edges = bars.groupBy("symbol").agg(F.min("close").alias("__lo"), F.max("close").alias("__hi"))
    x = attach(bars, edges, "symbol")
    b = F.least(F.floor((F.col("close") - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)), F.lit(bins - 1))
    return x.groupBy("symbol", b.alias("bin")).agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"))


# -- scaling ------------------------------------------------------------------------------
def fit_scaler(df: DataFrame, keys: list[str] | str, cols: list[str], robust: bool = False) -> DataFrame:
    """One row of location and scale statistics per key; ``robust`` adds exact quartiles."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__pop"), F.stddev(c).alias(f"{c}__std"),
            F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
        ]
    fit = df.groupBy(*keys).agg(*aggs)
    if robust:
        for c in cols:
            fit = fit.join(quantiles(df, keys, c, {f"{c}__q1": 0.25, f"{c}__q2": 0.5, f"{c}__q3": 0.75}), keys)
    return fit


def scaled(col: str, method: str) -> Column:
    """Transform column given the fitted statistics of :func:`fit_scaler` on the same row."""
    x = F.col(col)
    s = lambda stat: F.col(f"{col}__{stat}")
    unit = ratio(x - s("min"), s("max") - s("min"))
    return {
        "standard": lambda: ratio(x - s("mean"), s("pop")),
        "minmax": lambda: unit,
        "minmax_signed": lambda: unit * 2 - 1,
        "robust": lambda: ratio(x - s("q2"), s("q3") - s("q1")),
        "epsilon": lambda: (x - s("mean")) / (s("std") + 1e-8),
        "log1p": lambda: F.log1p(x),
        "percent": lambda: x / 100,
    }[method]()


def scale(df: DataFrame, keys: list[str] | str, methods: dict[str, str]) -> DataFrame:
    """Fit and transform: ``methods`` maps column to method; outputs ``<column>_scaled``."""
    fit = fit_scaler(df, keys, list(methods), robust="robust" in methods.values())
    out = attach(df, fit, keys)
    out = out.withColumns({f"{c}_scaled": scaled(c, m) for c, m in methods.items()})
    return out.drop(*[c for c in fit.columns if c not in ([keys] if isinstance(keys, str) else keys)])


# -- sequences ----------------------------------------------------------------------------
def sequences(bars: DataFrame, length: int, cols: list[str], target: str | None = "close", mode: str = "next") -> DataFrame:
    """Overlapping windows ``X[length, features]`` per row.

    mode ``next``: target is the row after the window; ``inside``: target is the window's last
    row; ``split``: windows of ``length + 1`` cut into X and the last row's target; ``plain``:
    no target.
    """
    ahead = 1 if mode == "next" else 0
    size = length + 1 if mode == "split" else length
    tl = bars_timeline(bars, back=size, ahead=ahead)
    w = tl.last(size)
    cell = F.array(*[F.col(c).cast("double") for c in cols])
    add = {"x": F.collect_list(cell).over(w)}
    if mode == "next":
        add["y"] = tl.lead(target)
    elif mode in ("inside", "split"):
        add["y"] = F.col(target)
    df = tl.add(**add, __full=tl.pos >= size - 1).rows().where("__full").drop("__full")
    if mode == "split":
        df = df.withColumn("x", F.slice("x", 1, length))
    return df.where("y IS NOT NULL") if mode == "next" else df


# -- splits -------------------------------------------------------------------------------
def hash_split(df: DataFrame, ids: list[str], shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Repeatable random split: every row decides alone from a hash of its id, no global sort."""
    u = uniform(*ids, F.lit(seed))
    expr, acc = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        acc += shares[name]
        expr = F.when(u < acc, name) if expr is None else expr.when(u < acc, name)
    return df.withColumn("split", expr.otherwise(names[-1]))


def chronological_split(bars: DataFrame, validation: float = 0.2) -> DataFrame:
    tl = bars_timeline(bars, positions=True)
    cut = F.floor(tl.total * F.lit(1 - validation))
    return tl.add(split=F.when(tl.pos < cut, "train").otherwise("validation")).rows()


def time_series_folds(bars: DataFrame, k: int = 5, gap: int = 0) -> DataFrame:
    """Expanding-window folds; every row is emitted once per fold it takes part in."""
    tl = bars_timeline(bars, positions=True)
    size = F.floor(tl.total / F.lit(k + 1))
    df = tl.add(__p=tl.pos, __size=size, __n=tl.total).rows().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("__n") - (F.lit(k) - F.col("fold") + 1) * F.col("__size")
    role = F.when(F.col("__p") < start - gap, "train").when(
        (F.col("__p") >= start) & (F.col("__p") < start + F.col("__size")), "test"
    )
    return df.withColumn("role", role).where("role IS NOT NULL").drop("__p", "__size", "__n")


def batches(bars: DataFrame, size: int = 32) -> DataFrame:
    tl = bars_timeline(bars, positions=True)
    return tl.add(batch=F.floor(tl.pos / size)).rows()


def with_custom(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Caller-supplied features: name -> column expression."""
    return df.withColumns(features)


def augment(df: DataFrame, cols: list[str], sigma: float = 0.01, scale_range: float = 0.1, seed: int = 42) -> DataFrame:
    """Jittered and rescaled copies of the rows; the factor is fixed per symbol."""
    factor = 1 + F.lit(scale_range) * (2 * uniform("symbol", F.lit(seed)) - 1)
    noise = lambda i: gaussian("symbol", F.unix_micros("ts"), F.lit(seed + i))
    jitter = df.withColumns({c: F.col(c) * (1 + F.lit(sigma) * noise(i)) for i, c in enumerate(cols)})
    scaled_ = df.withColumns({c: F.col(c) * factor for c in cols})
    return jitter.withColumn("variant", F.lit("jitter")).unionByName(scaled_.withColumn("variant", F.lit("scale")))
