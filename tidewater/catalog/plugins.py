"""Queries: the places where callers plug in their own code."""

import pandas as pd
from pyspark.sql import functions as F

from tidewater.catalog.registry import query
from tidewater.catalog.sqltext import roll
from tidewater.catalog.streams import tick_stream
from tidewater.functions.scalars import ratio
from tidewater.operators import indicators, signals, sweep
from tidewater.streaming import streams


@query("u03_custom_objective", "trial_id:i ret:d9 risk:d9",
       "SELECT trial_id, fast * 0.3::DOUBLE - slow * 0.1::DOUBLE AS ret, abs(fast - slow) / 7.0::DOUBLE AS risk FROM trials")
def _(t):
    """A caller's Python objective, evaluated on batches of candidates."""

    def objectives(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"trial_id": p.trial_id, "ret": p.fast * 0.3 - p.slow * 0.1, "risk": (p.fast - p.slow).abs() / 7.0})

    return sweep.evaluate(t.trials.select("trial_id", "fast", "slow"), objectives, "trial_id long, ret double, risk double")


class Breakout(signals.Strategy):
    """Example plug-in: close at the 20-bar high or low."""

    reach = 20

    def signals(self, tl):
        tl = tl.add(top=tl.full(F.max, "high", 20), bottom=tl.full(F.min, "low", 20))
        return tl.add(signal=F.when(F.col("close") >= F.col("top"), 1).when(F.col("close") <= F.col("bottom"), -1).when(F.col("top").isNotNull(), 0))


@query("u05_custom_strategy", "symbol ts:t signal:d",
       f"SELECT symbol, ts, CASE WHEN close >= t THEN 1 WHEN close <= b THEN -1 WHEN t IS NOT NULL THEN 0 END AS signal FROM (SELECT *, {roll('max', 'high', 20)} AS t, {roll('min', 'low', 20)} AS b FROM bars)")
def _(t):
    return Breakout().run(t.bars_kept)


if "median_price_mean" not in indicators.REGISTRY:

    @indicators.indicator("median_price_mean", lambda n=10, **_: n)
    def median_price_mean(tl, n: int = 10):
        """Example of a registered indicator."""
        tl = tl.add(__mp=(F.col("high") + F.col("low")) / 2)
        tl = tl.add(median_price_mean=tl.full(F.avg, "__mp", n))
        return tl.add(median_distance=ratio(F.col("close"), F.col("median_price_mean")) - 1).drop("__mp")


@query("u06_custom_indicator", "symbol ts:t median_price_mean:d median_distance:d",
       f"SELECT symbol, ts, m AS median_price_mean, close / m - 1 AS median_distance FROM (SELECT *, {roll('avg', 'p', 10)} AS m FROM (SELECT *, (high + low) / 2 AS p FROM bars))")
def _(t):
    return indicators.add_indicators(t.bars_kept, ["median_price_mean"])


@query("st19_throttled_updates", "symbol rows:i", "SELECT symbol, count(*) AS rows FROM ticks GROUP BY symbol")
def _(t):
    """A long-running query on a fixed interval, stopped once it has caught up."""
    s = tick_stream(t)
    out = streams.AppendTable(t.spark, s.schema)
    q = streams.run_batches(s, "throttled", out, interval="200 milliseconds")
    q.processAllAvailable()
    q.stop()
    return out.table().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
