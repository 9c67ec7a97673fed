"""Technical indicators as windows over one shared timeline.

Every indicator takes and returns a :class:`Timeline`; ``REACH`` tells how many earlier rows it
looks at, so :func:`add_indicators` can lay the bars out once for any set of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio
from tidewater.operators.features import bars_timeline
from tidewater.plans.timeline import Timeline, block_rows, free_of_nulls, lay_out, smoothing_reach, time_slice

PRICES = ("open", "high", "low", "close", "volume")

REGISTRY: dict[str, Callable[..., Timeline]] = {}
REACH: dict[str, Callable[..., int]] = {}
WEIGHTS: dict[str, Callable[..., list[float]]] = {}


def indicator(name: str, reach: Callable[..., int], weights: Callable[..., list[float]] | None = None):
    """Register an indicator with its look-back and, if it smooths, its smoothing weights."""

    def register(fn):
        REGISTRY[name], REACH[name] = fn, reach
        WEIGHTS[name] = weights or (lambda **_: [])
        return fn

    return register


def add_indicators(bars: DataFrame, wanted: dict[str, dict] | list[str]) -> DataFrame:
    """Add indicators by name; ``wanted`` maps registry names to keyword arguments."""
    wanted = {w: {} for w in wanted} if not isinstance(wanted, dict) else wanted
    unknown = sorted(set(wanted) - set(REGISTRY))
    if unknown:
        raise ValueError(f"unknown indicators {unknown}")
    back = max(REACH[n](**kw) for n, kw in wanted.items())
    block = max((block_rows(a) for n, kw in wanted.items() for a in WEIGHTS[n](**kw)), default=0)
    # Smoothing looks back whole blocks, and chained smoothing one block more per link.
    prices = [c for c in PRICES if c in bars.columns]
    gaps = not (block and free_of_nulls(bars, prices))
    tl = bars_timeline(bars, back=max(back, 4 * block), block=block, gaps=gaps)
    for name, kw in wanted.items():
        tl = REGISTRY[name](tl, **kw)
    return tl.rows()


# Indicator families: name -> members of the registry.
FAMILIES = {
    "momentum": ["rsi", "macd", "stochastic", "roc"],
    "trend": ["sma", "ema", "adx"],
    "volatility": ["bollinger", "atr", "volatility"],
    "volume": ["obv", "vwap_rolling", "mfi", "adl"],
}


def add_families(bars: DataFrame, families: list[str]) -> DataFrame:
    return add_indicators(bars, [i for f in families for i in FAMILIES[f]])


# -- shared pieces ------------------------------------------------------------------------
def true_range(tl: Timeline) -> Column:
    """``greatest`` skips the missing previous close of the first row."""
    pc = tl.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def gains_losses(tl: Timeline, col: str = "close") -> Timeline:
    """Up and down moves; a missing first move counts as 0."""
    tl, d = tl.add(__move=F.col(col) - tl.lag(col)), F.col("__move")
    return tl.add(__gain=F.when(d > 0, d).otherwise(F.lit(0.0)), __loss=F.when(d < 0, -d).otherwise(F.lit(0.0))).drop("__move")


def rsi_from(gain: Column, loss: Column) -> Column:
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def directional_moves(tl: Timeline) -> Timeline:
    tl = tl.add(__tr=true_range(tl), __up=F.col("high") - tl.lag("high"), __down=tl.lag("low") - F.col("low"))
    up, down = F.col("__up"), F.col("__down")
    return tl.add(
        __pdm=F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)),
        __ndm=F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)),
    ).drop("__up", "__down")


# -- moving averages ----------------------------------------------------------------------
@indicator("sma", lambda n=20, **_: n)
def sma(tl: Timeline, n: int = 20, col: str = "close", out: str | None = None) -> Timeline:
    return tl.add(**{out or f"sma_{n}": tl.full(F.avg, col, n)})


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


@indicator("ema", lambda n=20, **_: smoothing_reach(ema_alpha(n)), lambda n=20, **_: [ema_alpha(n)])
def ema(tl: Timeline, n: int = 20, col: str = "close", out: str | None = None) -> Timeline:
    """Exponential mean seeded with the first value."""
    return tl.smooth(whole=col in PRICES, **{out or f"ema_{n}": (col, ema_alpha(n))})


@indicator("ema_seeded", lambda n=20, **_: smoothing_reach(ema_alpha(n)) + n, lambda n=20, **_: [ema_alpha(n)])
def ema_seeded(tl: Timeline, n: int = 20, col: str = "close", out: str | None = None) -> Timeline:
    """Exponential mean seeded with the mean of the first ``n`` values; NULL before."""
    out = out or f"ema_seeded_{n}"
    return tl.smooth(**{out: (col, ema_alpha(n), n - 1, n)})


@indicator("macd", lambda slow=26, **_: 2 * smoothing_reach(ema_alpha(slow)), lambda fast=12, slow=26, signal=9, **_: [ema_alpha(fast), ema_alpha(slow), ema_alpha(signal)])
def macd(tl: Timeline, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close") -> Timeline:
    tl = tl.smooth(whole=col in PRICES, __f=(col, ema_alpha(fast)), __s=(col, ema_alpha(slow)))
    tl = tl.add(macd=F.col("__f") - F.col("__s")).drop("__f", "__s")
    tl = tl.smooth(whole=col in PRICES, macd_signal=("macd", ema_alpha(signal)))
    return tl.add(macd_histogram=F.col("macd") - F.col("macd_signal"))


@indicator("macd_cross", lambda **_: 2 * smoothing_reach(ema_alpha(26)) + 1, lambda **_: [ema_alpha(n) for n in (9, 12, 26)])
def macd_cross(tl: Timeline) -> Timeline:
    if "macd_signal" not in tl.df.columns:
        tl = macd(tl)
    tl = tl.add(__pm=tl.lag("macd"), __ps=tl.lag("macd_signal"))
    pm, ps, m, s = F.col("__pm"), F.col("__ps"), F.col("macd"), F.col("macd_signal")
    return tl.add(
        bullish_cross=F.coalesce((pm <= ps) & (m > s), F.lit(False)),
        bearish_cross=F.coalesce((pm >= ps) & (m < s), F.lit(False)),
    ).drop("__pm", "__ps")


# -- oscillators --------------------------------------------------------------------------
@indicator("rsi", lambda n=14, **_: n + 1)
def rsi(tl: Timeline, n: int = 14, out: str = "rsi") -> Timeline:
    tl = gains_losses(tl)
    tl = tl.add(__ag=tl.full(F.avg, "__gain", n), __al=tl.full(F.avg, "__loss", n))
    return tl.add(**{out: rsi_from(F.col("__ag"), F.col("__al"))}).drop("__gain", "__loss", "__ag", "__al")


@indicator("rsi_wilder", lambda n=14, **_: smoothing_reach(1 / n) + n + 1, lambda n=14, **_: [1 / n])
def rsi_wilder(tl: Timeline, n: int = 14, out: str = "rsi_wilder", head: float | None = 50.0) -> Timeline:
    """Wilder smoothing seeded with the mean of the first ``n`` moves; ``head`` while too short."""
    tl = gains_losses(tl)
    tl = tl.smooth(whole=True, __ag=("__gain", 1 / n, n, n), __al=("__loss", 1 / n, n, n))
    g, l = F.col("__ag"), F.col("__al")
    value = F.when(l == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(g, l)))
    value = F.when(tl.pos < n, F.lit(head)).otherwise(value)
    return tl.add(**{out: value}).drop("__gain", "__loss", "__ag", "__al")


@indicator("rsi_flags", lambda n=14, **_: n + 1)
def rsi_flags(tl: Timeline, n: int = 14, overbought: float = 70, oversold: float = 30) -> Timeline:
    if "rsi" not in tl.df.columns:
        tl = rsi(tl, n)
    return tl.add(overbought=F.col("rsi") >= overbought, oversold=F.col("rsi") <= oversold)


@indicator("stochastic", lambda k=14, d=3, **_: k + d)
def stochastic(tl: Timeline, k: int = 14, d: int = 3) -> Timeline:
    tl = tl.add(__lo=tl.full(F.min, "low", k), __hi=tl.full(F.max, "high", k))
    tl = tl.add(stoch_k=100 * ratio(F.col("close") - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")
    return tl.add(stoch_d=tl.full(F.avg, "stoch_k", d))


@indicator("roc", lambda n=12, **_: n)
def roc(tl: Timeline, n: int = 12) -> Timeline:
    tl = tl.add(__p=tl.lag("close", n))
    return tl.add(roc=ratio(F.col("close") - F.col("__p"), F.col("__p")) * 100).drop("__p")


@indicator("mfi", lambda n=14, **_: n + 1)
def mfi(tl: Timeline, n: int = 14) -> Timeline:
    tl = tl.add(__tp=typical_price())
    tl = tl.add(__d=F.col("__tp") - tl.lag("__tp"))
    d, flow = F.col("__d"), F.col("__tp") * F.col("volume")
    tl = tl.add(__up=F.when(d > 0, flow).otherwise(F.lit(0.0)), __down=F.when(d < 0, flow).otherwise(F.lit(0.0)))
    tl = tl.add(__p=tl.full(F.sum, "__up", n), __q=tl.full(F.sum, "__down", n))
    return tl.add(mfi=rsi_from(F.col("__p"), F.col("__q"))).drop("__tp", "__d", "__up", "__down", "__p", "__q")


# -- bands and ranges ---------------------------------------------------------------------
@indicator("bollinger", lambda n=20, **_: n)
def bollinger(tl: Timeline, n: int = 20, k: float = 2.0) -> Timeline:
    tl = tl.add(bb_mid=tl.full(F.avg, "close", n), __sd=tl.full(F.stddev, "close", n))
    mid, sd = F.col("bb_mid"), F.col("__sd")
    return tl.add(bb_upper=mid + k * sd, bb_lower=mid - k * sd, bb_width=ratio(2 * k * sd, mid)).drop("__sd")


@indicator("atr", lambda n=14, **_: n + 1)
def atr(tl: Timeline, n: int = 14, out: str = "atr") -> Timeline:
    tl = tl.add(true_range=true_range(tl))
    return tl.add(**{out: tl.full(F.avg, "true_range", n)})


@indicator("atr_wilder", lambda n=14, **_: smoothing_reach(1 / n) + n + 1, lambda n=14, **_: [1 / n])
def atr_wilder(tl: Timeline, n: int = 14) -> Timeline:
    tl = tl.add(__tr=true_range(tl))
    return tl.smooth(whole=True, atr_wilder=("__tr", 1 / n, n - 1, n)).drop("__tr")


# -- volume -------------------------------------------------------------------------------
@indicator("obv", lambda **_: 1)
def obv(tl: Timeline) -> Timeline:
    """On-balance volume; the first row counts its whole volume."""
    d = F.col("close") - tl.lag("close")
    step = F.when(tl.pos == 0, F.col("volume")).otherwise(F.signum(d) * F.col("volume"))
    return tl.add(__step=step).running(obv=("sum", "__step")).drop("__step")


@indicator("adl", lambda **_: 0)
def adl(tl: Timeline) -> Timeline:
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return tl.running(adl=("sum", ratio((c - l) - (h - c), h - l) * F.col("volume")))


@indicator("vwap_cumulative", lambda **_: 0)
def vwap_cumulative(tl: Timeline) -> Timeline:
    tl = tl.running(__pv=("sum", typical_price() * F.col("volume")), __v=("sum", "volume"))
    return tl.add(vwap_cumulative=ratio("__pv", "__v")).drop("__pv", "__v")


@indicator("vwap_rolling", lambda n=14, **_: n)
def vwap_rolling(tl: Timeline, n: int = 14) -> Timeline:
    tl = tl.add(__pv=typical_price() * F.col("volume"))
    return tl.add(vwap_rolling=ratio(tl.full(F.sum, "__pv", n), tl.full(F.sum, "volume", n))).drop("__pv")


def vwap_daily(bars: DataFrame) -> DataFrame:
    """VWAP restarted each day: the day is part of the key, so a hot symbol splits by day."""
    tl = lay_out(bars.withColumn("__day", F.date_trunc("day", "ts")), ["symbol", "__day"], ["ts"], time_slice("ts", 86400))
    tl = tl.running(__pv=("sum", typical_price() * F.col("volume")), __v=("sum", "volume"))
    return tl.rows().withColumn("vwap", ratio("__pv", "__v")).drop("__pv", "__v", "__day")


@indicator("volume_averages", lambda slow=20, **_: smoothing_reach(ema_alpha(slow)) + slow, lambda slow=20, **_: [ema_alpha(slow)])
def volume_averages(tl: Timeline, fast: int = 5, slow: int = 20) -> Timeline:
    """Volume SMA / EMA, relative volume, and the sign of fast against slow volume."""
    tl = tl.smooth(whole=True, volume_ema=("volume", ema_alpha(slow)))
    tl = tl.add(volume_sma=tl.full(F.avg, "volume", slow), __fast=tl.full(F.avg, "volume", fast))
    s = F.col("volume_sma")
    return tl.add(relative_volume=ratio(F.col("volume"), s), volume_trend=F.signum(F.col("__fast") - s)).drop("__fast")


# -- trend --------------------------------------------------------------------------------
@indicator("adx", lambda n=14, **_: 2 * n + 1)
def adx(tl: Timeline, n: int = 14) -> Timeline:
    """Rolling-sum directional index."""
    tl = directional_moves(tl)
    tl = tl.add(__str=tl.full(F.sum, "__tr", n), __sp=tl.full(F.sum, "__pdm", n), __sn=tl.full(F.sum, "__ndm", n))
    tl = tl.add(plus_di=100 * ratio("__sp", "__str"), minus_di=100 * ratio("__sn", "__str")).drop("__str", "__sp", "__sn")
    p, m = F.col("plus_di"), F.col("minus_di")
    tl = tl.add(__dx=100 * ratio(F.abs(p - m), p + m))
    return tl.add(adx=tl.full(F.avg, "__dx", n)).drop("__tr", "__pdm", "__ndm", "__dx")


@indicator("adx_wilder", lambda n=14, **_: smoothing_reach(1 / n) + n + 1, lambda n=14, **_: [1 / n])
def adx_wilder(tl: Timeline, n: int = 14, threshold: float = 25.0) -> Timeline:
    """Directional index whose DX is Wilder-smoothed from the first full window on."""
    tl = directional_moves(tl)
    ready = tl.pos >= n
    tl = tl.add(**{f"{c}_a": F.avg(c).over(tl.last(n)) for c in ("__tr", "__pdm", "__ndm")})
    di = lambda c: F.when(ready, 100 * ratio(F.col(c), F.col("__tr_a"), on_zero=0.0))
    tl = tl.add(plus_di_w=di("__pdm_a"), minus_di_w=di("__ndm_a")).drop("__tr_a", "__pdm_a", "__ndm_a")
    p, m = F.col("plus_di_w"), F.col("minus_di_w")
    tl = tl.add(__dx=F.when(ready, 100 * ratio(F.abs(p - m), p + m, on_zero=0.0)))
    tl = tl.smooth(adx_w=("__dx", 1 / n, n, 1))
    tl = tl.add(strong_trend=F.col("adx_w") >= threshold, bullish_trend=p > m, bearish_trend=m > p)
    return tl.drop("__tr", "__pdm", "__ndm", "__dx")


@indicator("ma_deviation", lambda n=20, **_: n)
def ma_deviation(tl: Timeline, n: int = 20) -> Timeline:
    """Deviation from the moving average; the head uses the first full average."""
    tl = tl.add(__ma=tl.full(F.avg, "close", n)).running(__fill=("next", "__ma"))
    return tl.add(ma_deviation=ratio(F.col("close") - F.col("__fill"), F.col("__fill"))).drop("__ma", "__fill")


@indicator("trend_sign", lambda n=20, **_: n)
def trend_sign(tl: Timeline, n: int = 20) -> Timeline:
    tl = tl.add(__x=tl.pos.cast("double"))
    slope = F.when(tl.pos >= n - 1, F.regr_slope(F.col("close"), F.col("__x")).over(tl.last(n)))
    tl = tl.add(__ma=tl.full(F.avg, "close", n), rolling_slope=slope)
    return tl.add(trend_sign=F.signum(F.col("close") - F.col("__ma"))).drop("__x", "__ma")


# -- volatility and momentum --------------------------------------------------------------
@indicator("volatility", lambda n=20, **_: n + 1)
def volatility(tl: Timeline, n: int = 20, periods: int = 252) -> Timeline:
    tl = tl.add(__lr=F.ln(F.col("close")) - F.ln(tl.lag("close")))
    return tl.add(volatility=tl.full(F.stddev, "__lr", n) * math.sqrt(periods)).drop("__lr")


@indicator("volatility_ratio", lambda n=20, **_: n + 1)
def volatility_ratio(tl: Timeline, n: int = 20) -> Timeline:
    tl = tl.add(__lr=F.ln(F.col("close")) - F.ln(tl.lag("close")))
    return tl.add(volatility_ratio=tl.full(F.stddev, "__lr", n) * tl.full(F.avg, "volume", n)).drop("__lr")


@indicator("price_sigma", lambda n=20, **_: n)
def price_sigma(tl: Timeline, n: int = 20) -> Timeline:
    return tl.add(price_sigma=tl.full(F.stddev, "close", n))


@indicator("custom_momentum", lambda n=10, **_: n)
def custom_momentum(tl: Timeline, n: int = 10) -> Timeline:
    move = (F.col("close") - tl.lag("close", n)) * (F.col("volume") - tl.lag("volume", n))
    return tl.add(custom_momentum=move)


def funding_trend(funding: DataFrame, n: int = 8) -> DataFrame:
    """Funding mean, its trend sign and the contrarian signal in {-1, 0, 1}."""
    tl = bars_timeline(funding, back=n)
    tl = tl.add(funding_ma=tl.full(F.avg, "funding_rate", n))
    tl = tl.add(funding_trend=F.signum(F.col("funding_rate") - F.col("funding_ma")))
    return tl.rows().withColumn("funding_signal", -F.col("funding_trend"))


def change_over(df: DataFrame, col: str, n: int, out: str) -> DataFrame:
    tl = bars_timeline(df, back=n)
    return tl.add(**{out: F.col(col) - tl.lag(col, n)}).rows()


