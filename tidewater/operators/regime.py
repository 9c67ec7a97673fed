"""Market regimes: rules, segments, transitions, change points, clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import logistic, ratio
from tidewater.operators import metrics as m
from tidewater.operators.features import bars_timeline
from tidewater.operators.indicators import add_indicators
from tidewater.plans.attach import attach, quantiles
from tidewater.plans.runs import runs
from tidewater.plans.timeline import time_slice
from tidewater.session import settle


def regime_label(volatility: Column, trend: Column, high_volatility: float, strong_trend: float) -> Column:
    return F.when(volatility > high_volatility, "volatile").when(F.abs(trend) > strong_trend, "trending").otherwise("ranging")


def rolling_regime(bars: DataFrame, n: int = 20, high_volatility: float = 0.02, strong_trend: float = 0.001) -> DataFrame:
    """Regime per bar from rolling log-return volatility and relative slope."""
    x = add_indicators(bars, {"volatility": {"n": n, "periods": 1}, "trend_sign": {"n": n}, "sma": {"n": n}})
    trend = ratio(F.col("rolling_slope"), F.col(f"sma_{n}"))
    return x.withColumn("regime", regime_label(F.col("volatility"), trend, high_volatility, strong_trend))


def overall_regime(bars: DataFrame, high_volatility: float, strong_trend: float) -> DataFrame:
    """One regime per symbol over its whole history."""
    tl = bars_timeline(bars, back=1)
    x = tl.add(__lr=F.ln(F.col("close")) - F.ln(tl.lag("close")), __x=tl.pos.cast("double")).rows()
    a = x.groupBy("symbol").agg(
        F.stddev("__lr").alias("volatility"), (F.regr_slope(F.col("close"), F.col("__x")) / (F.avg("close") + 1e-8)).alias("trend"),
        F.avg("volume").alias("__mv"), F.stddev_pop("volume").alias("__sv"), F.max_by("volume", "ts").alias("__lv"))
    z = ratio(F.col("__lv") - F.col("__mv"), F.col("__sv"))
    return a.withColumns({
        "regime": regime_label(F.col("volatility"), F.col("trend"), high_volatility, strong_trend),
        "volume_score": F.coalesce(logistic(z), F.lit(0.5))})


def sentiment_regime(bars: DataFrame, scores: DataFrame, volatility_threshold: float, sentiment_threshold: float) -> DataFrame:
    """Volatility level and mood from returns and the mean sentiment of all texts."""
    tl = bars_timeline(bars, back=1)
    v = tl.add(__r=ratio(F.col("close"), tl.lag("close")) - 1).rows().groupBy("symbol").agg(F.stddev_pop("__r").alias("volatility"))
    mood = settle(scores.agg(F.avg("polarity").alias("p"), F.avg("subjectivity").alias("s")), "mood")
    out = v.withColumns({"avg_polarity": mood.select("p").scalar(), "avg_subjectivity": mood.select("s").scalar()})
    level = F.when(F.col("volatility") > volatility_threshold, "high_volatility").when(
        F.col("volatility") < volatility_threshold / 2, "low_volatility").otherwise("medium_volatility")
    tone = F.when(F.col("avg_polarity") > sentiment_threshold, "bullish").when(F.col("avg_polarity") < -sentiment_threshold, "bearish").otherwise("neutral")
    return out.withColumns({"regime": level, "sentiment": tone, "confidence": 1 - F.abs("avg_polarity")})


def regime_segments(labelled: DataFrame) -> DataFrame:
    """Unbroken stretches of one regime: start, end, bars."""
    item = F.struct("regime", "ts")
    found = runs(labelled, "symbol", ["ts"], time_slice("ts", 30 * 86400), item, lambda a, b: F.coalesce(a["regime"] != b["regime"], F.lit(True)))
    return found.select("symbol", F.col("first.regime").alias("regime"), F.col("first.ts").alias("start_ts"), F.col("last.ts").alias("end_ts"), F.col("n").alias("bars"))


def _changes(labelled: DataFrame) -> DataFrame:
    tl = bars_timeline(labelled, back=1)
    prev = tl.lag("regime")
    return tl.add(previous=prev, __new=F.coalesce(F.col("regime") != prev, F.lit(True))).rows()


def transitions(labelled: DataFrame) -> DataFrame:
    """Counts and probabilities of moving from one regime to the next."""
    n = _changes(labelled).where("previous IS NOT NULL").groupBy("symbol", "previous", "regime").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("symbol", "previous").agg(F.sum("n").alias("t"))
    return n.join(total, ["symbol", "previous"]).withColumn("probability", F.col("n") / F.col("t"))


def change_points(bars: DataFrame, n: int = 24, threshold: float = 2.0) -> DataFrame:
    """Mean shifts: z-score between the windows before and after a bar, kept where it peaks locally."""
    tl = bars_timeline(bars, back=2 * n, ahead=2 * n)
    left, right = tl.window(-n, -1), tl.window(0, n - 1)
    full = (F.count("close").over(left) == n) & (F.count("close").over(right) == n)
    spread = F.sqrt((F.var_samp("close").over(left) + F.var_samp("close").over(right)) / n)
    tl = tl.add(shift=F.when(full, ratio(F.avg("close").over(right) - F.avg("close").over(left), spread)))
    peak = F.max(F.abs("shift")).over(tl.window(-n, n))
    return tl.add(__top=F.abs("shift") == peak).rows().where(F.col("__top") & (F.abs("shift") > threshold)).select("symbol", "ts", "shift")


def volatility_label(bars: DataFrame, n: int = 20) -> DataFrame:
    """high_risk / low_risk by the quartiles of each symbol's own volatility history."""
    x = settle(add_indicators(bars, {"volatility": {"n": n}}), "volatility")
    x = attach(x, quantiles(x, "symbol", "volatility", {"__q1": 0.25, "__q3": 0.75}), "symbol")
    label = F.when(F.col("volatility") > F.col("__q3"), "high_risk").when(F.col("volatility") < F.col("__q1"), "low_risk")
    return x.withColumn("risk", label.when(F.col("volatility").isNotNull(), "normal")).drop("__q1", "__q3")


def cluster_performance(bars: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Cluster bars by volatility and report return statistics per cluster."""
    x = add_indicators(bars, {"volatility": {"n": 20}})
    tl = bars_timeline(settle(x, "clusters"), back=1)
    x = tl.add(ret=ratio(F.col("close"), tl.lag("close")) - 1).rows().na.drop("any", subset=["ret", "volatility"])
    v = VectorAssembler(inputCols=["volatility"], outputCol="features").transform(x)
    labelled = KMeans(k=k, seed=seed).fit(v).transform(v)
    r = F.col("ret")
    return labelled.groupBy(F.col("prediction").alias("regime")).agg(
        F.count(F.lit(1)).alias("bars"), F.avg("volatility").alias("volatility"), m.sharpe(r, 0.02, sample=False).alias("sharpe"),
        m.sortino(r, 0.02, "rms_all").alias("sortino"), F.avg((r > 0).cast("double")).alias("win_rate"), m.omega(r).alias("profit_factor"))
