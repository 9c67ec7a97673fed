"""Trading signals as columns over indicator windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import clamp, ratio
from tidewater.operators import indicators as ind
from tidewater.operators.features import bars_timeline
from tidewater.plans.timeline import Timeline, block_rows, smoothing_reach


class Strategy:
    """Plug-in point: declare ``reach`` and turn a laid-out timeline into one with signal columns."""

    reach = 0
    block = 0  # smoothing block length, if the strategy smooths

    def signals(self, tl: Timeline) -> Timeline:
        raise NotImplementedError

    def run(self, bars: DataFrame) -> DataFrame:
        return self.signals(bars_timeline(bars, back=max(self.reach, 4 * self.block), block=self.block)).rows()


def crossed_up(tl: Timeline, fast: str, slow: str) -> Column:
    return (tl.lag(fast) <= tl.lag(slow)) & (F.col(fast) > F.col(slow))


def crossed_down(tl: Timeline, fast: str, slow: str) -> Column:
    return (tl.lag(fast) >= tl.lag(slow)) & (F.col(fast) < F.col(slow))


class MaCross(Strategy):
    """Buy / sell on a moving-average cross with enough volume."""

    def __init__(self, fast: int = 10, slow: int = 20, min_volume: float = 10.0):
        self.fast, self.slow, self.min_volume, self.reach = fast, slow, min_volume, slow + 1

    def signals(self, tl: Timeline) -> Timeline:
        tl = ind.sma(ind.sma(tl, self.fast, out="fast_ma"), self.slow, out="slow_ma")
        ok = F.col("volume") >= self.min_volume
        signal = F.when(ok & crossed_up(tl, "fast_ma", "slow_ma"), "buy").when(ok & crossed_down(tl, "fast_ma", "slow_ma"), "sell")
        return tl.add(signal=signal, volume_ok=ok)


class MeanReversion(Strategy):
    """Fade moves outside the Bollinger bands confirmed by RSI; the target is the middle band.

    ``stop`` is a share of price, or with ``atr_stop`` a multiple of ATR.
    """

    def __init__(self, n=20, k=2.0, rsi_n=14, overbought=70.0, oversold=30.0, stop=0.02, atr_stop=None, dynamic=False):
        self.n, self.k, self.rsi_n, self.overbought, self.oversold = n, k, rsi_n, overbought, oversold
        self.stop, self.atr_stop, self.dynamic = stop, atr_stop, dynamic
        self.reach = max(n, rsi_n + 1, 15)

    def signals(self, tl: Timeline) -> Timeline:
        tl = ind.rsi(tl, self.rsi_n)
        tl = tl.add(bb_mid=tl.full(F.avg, "close", self.n), __sd=tl.full(F.stddev, "close", self.n))
        mid, c = F.col("bb_mid"), F.col("close")
        width = self.k * (1 + ratio("__sd", "bb_mid")) if self.dynamic else F.lit(self.k)
        tl = tl.add(threshold=width, deviation=ratio(c - mid, mid))
        upper, lower = mid + F.col("threshold") * F.col("__sd"), mid - F.col("threshold") * F.col("__sd")
        sell = (c > upper) & (F.col("rsi") > self.overbought)
        buy = (c < lower) & (F.col("rsi") < self.oversold)
        side = F.when(sell, -1.0).when(buy, 1.0).otherwise(0.0)
        tl = tl.add(size=side, action=F.when(sell, "SELL").when(buy, "BUY").otherwise("HOLD"))
        hit = F.col("size") != 0
        if self.atr_stop is None:
            stop = c * (1 - F.col("size") * self.stop)
        else:
            tl = ind.atr(tl)
            stop = c - F.col("size") * F.col("atr") * self.atr_stop
        return tl.add(
            confidence=F.when(hit, F.least(F.abs("deviation") / self.k, F.lit(1.0))).otherwise(0.0),
            stop_loss=F.when(hit, stop), take_profit=F.when(hit, mid)).drop("__sd")


class TrendFollowing(Strategy):
    """EMA cross confirmed by ADX with an ATR stop."""

    def __init__(self, fast: int = 12, slow: int = 26, adx_min: float = 25.0, atr_stop: float = 2.0):
        self.fast, self.slow, self.adx_min, self.atr_stop = fast, slow, adx_min, atr_stop
        self.reach = smoothing_reach(ind.ema_alpha(slow)) + 1
        self.block = block_rows(ind.ema_alpha(slow))

    def signals(self, tl: Timeline) -> Timeline:
        tl = tl.smooth(fast_ema=("close", ind.ema_alpha(self.fast)), slow_ema=("close", ind.ema_alpha(self.slow)))
        tl = ind.adx(ind.atr(tl))
        strong = F.col("adx") > self.adx_min
        d = F.when(strong & crossed_up(tl, "fast_ema", "slow_ema"), 1).when(strong & crossed_down(tl, "fast_ema", "slow_ema"), -1).otherwise(0)
        tl = tl.add(direction=d)
        return tl.add(stop_loss=F.when(F.col("direction") != 0, F.col("close") - F.col("direction") * F.col("atr") * self.atr_stop))


class RsiMacd(Strategy):
    """Sum of the RSI zone and the MACD side, as -1, 0 or 1."""

    reach = 2 * smoothing_reach(ind.ema_alpha(26))
    block = block_rows(ind.ema_alpha(26))

    def signals(self, tl: Timeline) -> Timeline:
        tl = ind.macd(ind.rsi(tl))
        rsi = F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0)
        return tl.add(signal=F.signum(rsi + F.signum("macd_histogram")))


def threshold_orders(signals: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Signals strong enough to trade, with their side."""
    x = signals.where(F.abs("signal") >= minimum)
    return x.withColumn("side", F.when(F.col("signal") > 0, "long").otherwise("short"))


# -- position sizes -----------------------------------------------------------------------
def fixed_fraction_size(capital: float, price: Column, share: float = 0.02) -> Column:
    return capital * share / price


def stop_risk_size(capital: float, entry: Column, stop: Column, risk: float = 0.02) -> Column:
    return F.coalesce(ratio(F.lit(capital * risk), F.abs(entry - stop)), F.lit(0.0))


def confidence_size(portfolio: float, confidence: Column, risk: float = 0.02) -> Column:
    return portfolio * risk * confidence


def volatility_size(capital: float, price: Column, volatility: Column, drawdown: float = 0.2, cap: float = 10.0) -> Column:
    return F.least(ratio(F.lit(capital * drawdown), price * volatility), F.lit(cap))


# -- model signals ------------------------------------------------------------------------
def strategy_return(pred: Column, actual: Column, position: Column | None = None) -> Column:
    return (F.signum(pred) if position is None else position) * actual


def ensemble(predictions: DataFrame, weights: DataFrame, ids: list[str]) -> DataFrame:
    """Weighted mean of model predictions (long form: one row per model)."""
    j = predictions.join(weights, "model")
    return j.groupBy(*ids).agg((F.sum(F.col("weight") * F.col("pred")) / F.sum("weight")).alias("pred"))


def limit_fill(side: Column, limit: Column, high: Column, low: Column) -> Column:
    """Fill price of a limit order within a bar."""
    return F.when(side == "buy", F.least(limit, high)).otherwise(F.greatest(limit, low))


def order_problem(df_side="side", qty="quantity", price="price", kind="order_type") -> Column:
    """First rule an order breaks, NULL when valid."""
    return (
        F.when(~F.col(df_side).isin("buy", "sell"), "bad side")
        .when(~F.col(kind).isin("market", "limit", "stop_loss", "take_profit"), "bad type")
        .when(F.col(qty).isNull() | (F.col(qty) <= 0), "bad quantity")
        .when((F.col(kind) == "limit") & (F.col(price).isNull() | (F.col(price) <= 0)), "limit price missing")
    )


def adjusted(signal: Column, factor: float = 0.8) -> Column:
    return clamp(signal * factor, -1.0, 1.0)
