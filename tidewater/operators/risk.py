"""Risk scores, limits, alerts, fitness and population statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import clamp, ratio
from tidewater.operators import metrics as m
from tidewater.operators.features import bars_timeline
from tidewater.operators.indicators import add_indicators, typical_price
from tidewater.plans.attach import attach, quantiles, value_slices
from tidewater.plans.joins import asof_join
from tidewater.plans.timeline import lay_out, time_slice
from tidewater.session import settle


def futures_metrics(returns: DataFrame, funding: DataFrame, leverage: float, rf: float = 0.02) -> DataFrame:
    f = funding.withColumnRenamed("symbol", "series_id")
    j = asof_join(returns, f, "series_id", "ts", ["funding_rate"])
    lev = j.withColumn("lev", F.col("ret") * leverage)
    agg = lev.groupBy("series_id").agg(
        F.sum(F.col("funding_rate") * F.col("ret")).alias("funding_cost"),
        m.sharpe(F.col("lev") - F.lit(rf / m.YEAR), sample=False).alias("leveraged_sharpe"),
        m.sortino(F.col("lev"), rf, "pop_negative").alias("leveraged_sortino"))
    dd = m.drawdown_stats(m.drawdowns(returns.withColumn("ret", F.col("ret") * leverage)))
    return agg.join(dd.select("series_id", F.abs("max_drawdown").alias("leveraged_drawdown")), "series_id")


def volume_metrics(bars: DataFrame, n: int = 20) -> DataFrame:
    tl = bars_timeline(bars, back=n)
    tl = tl.add(__r=ratio(F.col("close"), tl.lag("close")) - 1, __rv=ratio(F.col("volume"), tl.full(F.avg, "volume", n)))
    tl = tl.running(__pv=("sum", typical_price() * F.col("volume")), __v=("sum", "volume"))
    x = settle(tl.rows().select("symbol", "__r", "__rv", ratio("__pv", "__v").alias("__vw")), "volume")
    x = attach(x, x.groupBy("symbol").agg(F.avg("__vw").alias("__mv")), "symbol")
    good = F.col("__r") * (F.col("__vw") - F.col("__mv")) > 0
    return x.groupBy("symbol").agg(
        F.avg("__rv").alias("avg_relative_volume"), F.corr("__r", "__rv").alias("volume_trend"),
        F.avg(F.when(good, F.abs("__r"))).alias("vwap_efficiency"))


def risk_scores(bars: DataFrame, market: float = 0.4, position: float = 0.3, volatility: float = 0.3, exposure: float = 0.5) -> DataFrame:
    """Weighted and normalised risk score per symbol."""
    tl = bars_timeline(bars, back=1)
    x = tl.add(
        __lr=F.ln(F.col("close")) - F.ln(tl.lag("close")), __sr=ratio(F.col("close"), tl.lag("close")) - 1,
        __vc=ratio(F.col("volume"), tl.lag("volume")) - 1).rows()
    a = x.groupBy("symbol").agg(
        F.stddev("__lr").alias("lv"), (F.avg(F.col("high") - F.col("low")) / F.avg("low")).alias("hl"),
        F.stddev("__sr").alias("sv"), F.avg(F.abs("__vc")).alias("vr"))
    weighted = F.least(F.lit(1.0), F.col("lv") * 10) * market + exposure * position + F.least(F.lit(1.0), F.col("hl") * 5) * volatility
    normal = clamp(F.col("sv") * volatility + F.col("vr") * market + exposure * position, 0.0, 1.0)
    return a.withColumns({"weighted": weighted, "normalised": normal})


def adjust_signal(signal: Column, factor: Column | float) -> Column:
    return clamp(signal * factor, -1.0, 1.0)


# Position limit factor per market regime; an unknown regime counts 0.5.
REGIME_FACTORS = {
    "high_risk_bearish": 0.5,
    "high_risk_bullish": 0.7,
    "bearish": 0.6,
    "bullish": 0.9,
    "low_risk_bullish": 1.0,
    "low_risk_bearish": 0.8,
    "neutral": 0.9,
}


def regime_factor(regime: Column) -> Column:
    pairs = [x for k, v in REGIME_FACTORS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), regime), F.lit(0.5))


def position_limits(
    bars: DataFrame, base_limit: float = 1.0, max_drawdown: float = 0.2, min_volume: float = 20.0, max_leverage: float = 3.0, sizing: str = "volatility"
) -> DataFrame:
    """Limits from regime, drawdown and liquidity; sizing ``fixed``, ``volatility`` or ``kelly``."""
    x = settle(add_indicators(bars, {"volatility": {"n": 20, "periods": 1}, "sma": {"n": 20}}), "limits")
    tl = bars_timeline(x, back=1)
    x = tl.add(__lr=F.ln(F.col("close")) - F.ln(tl.lag("close"))).running(__peak=("max", "close")).rows()
    lr = F.col("__lr")
    a = x.groupBy("symbol").agg(
        F.max(1 - F.col("close") / F.col("__peak")).alias("mdd"), F.avg("volume").alias("av"), F.stddev("__lr").alias("sd"),
        F.avg((lr > 0).cast("double")).alias("p"), (F.avg(F.when(lr > 0, lr)) / F.abs(F.avg(F.when(lr < 0, lr)))).alias("b"),
        F.max_by(F.struct("volatility", (F.col("close") > F.col("sma_20")).alias("up")), "ts").alias("now"))
    a = a.join(quantiles(x, "symbol", "volatility", {"q1": 0.25, "q3": 0.75}), "symbol")
    side = F.when(F.col("now.up"), "bullish").otherwise("bearish")
    level = F.when(F.col("now.volatility") > F.col("q3"), "high_risk_").when(F.col("now.volatility") < F.col("q1"), "low_risk_").otherwise("")
    a = a.withColumns({
        "regime": F.concat(level, side), "kelly": F.col("p") - (1 - F.col("p")) / F.col("b"),
        "risk_factor": F.when(F.col("mdd") > 0, F.least(F.lit(1.0), ratio(F.lit(max_drawdown), F.col("mdd")))).otherwise(F.lit(1.0)),
        "liquidity_factor": F.least(F.lit(1.0), F.col("av") / min_volume)})
    size = {
        "fixed": F.lit(1.0), "kelly": F.col("kelly"),
        "volatility": F.least(1 / F.greatest(F.col("sd"), F.lit(0.01)), F.lit(1.0))}[sizing]
    limit = base_limit * size * regime_factor(F.col("regime")) * F.col("risk_factor") * F.col("liquidity_factor")
    return a.withColumns({
        "max_position": F.least(limit, F.lit(base_limit)), "max_leverage": F.least(F.lit(max_leverage), max_leverage * F.col("risk_factor"))})


def alerts(metrics: DataFrame, key: str, thresholds: dict[str, float]) -> DataFrame:
    long = metrics.select(key, *thresholds).unpivot([key], list(thresholds), "metric", "value")
    pairs = [x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]
    out = long.withColumn("threshold", F.element_at(F.create_map(*pairs), F.col("metric")))
    return out.where(F.abs("value") > F.col("threshold"))


def fitness(runs: DataFrame, weights: dict[str, float], min_drawdown: float, min_trades: int, penalty: float) -> DataFrame:
    """Weighted score with penalties, and the normalised Sharpe / profit / drawdown score."""
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in weights.items()])
    cut = lambda hit: F.when(hit, F.lit(1 - penalty)).otherwise(F.lit(1.0))
    deep = cut(F.col("max_drawdown") < min_drawdown)
    normal = (
        0.3 * F.greatest(F.lit(0.0), F.col("sharpe_ratio")) / 3.0 + 0.4 * F.greatest(F.lit(0.0), F.col("total_profit_pct")) / 100.0
        + 0.3 * (1 - F.least(F.lit(1.0), F.abs("max_drawdown") / 50.0)))
    return runs.withColumns({"score": total * deep * cut(F.col("total_trades") < min_trades), "normalised": normal * deep})


def constrained_fitness(runs: DataFrame, weights: dict[str, float], limits: dict[str, tuple[float, float]]) -> Column:
    """Sum of weighted metrics minus a penalty per exceeded limit, never below 0."""
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in weights.items()])
    for name, (limit, penalty) in limits.items():
        score = score - F.when(F.col(name) > limit, F.lit(penalty)).otherwise(F.lit(0.0))
    return F.greatest(score, F.lit(0.0))


def population_stats(pop: DataFrame, key: str, score: str, genes: list[str], age: str) -> DataFrame:
    return pop.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"), F.max(score).alias("best"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        (reduce(lambda a, b: a + b, [F.stddev_pop(g) for g in genes]) / len(genes)).alias("gene_std"),
        F.avg(age).alias("avg_age"), F.max(age).alias("oldest"))


def diversity(pop: DataFrame, key: str, id_col: str, genes: list[str]) -> DataFrame:
    """Mean pairwise distance over genes, without forming pairs.

    For one gene the sum of all |a - b| is a rank-weighted sum of the sorted values, so one
    ordered pass per gene replaces n squared distances.
    """
    parts = None
    for i, g in enumerate(genes):
        x = value_slices(pop.select(key, id_col, F.col(g).cast("double").alias("v")), key, "v")
        tl = lay_out(x, key, ["v", id_col], F.col("__vs"), positions=True)
        n = F.col("__n")
        s = tl.add(__w=F.col("v") * (2 * tl.pos - tl.total + 1), __n=tl.total).rows().groupBy(key).agg(
            F.sum("__w").alias("__s"), F.max("__n").alias("__n"))
        d = s.select(key, ratio(2 * F.col("__s"), n * (n - 1)).alias(f"__d{i}"))
        parts = d if parts is None else parts.join(d, key)
    mean = reduce(lambda a, b: a + b, [F.col(f"__d{i}") for i in range(len(genes))]) / len(genes)
    return parts.select(key, mean.alias("diversity"))


def custom_risk(bars: DataFrame, rf: float = 0.02) -> DataFrame:
    tl = bars_timeline(bars, back=31)
    tl = tl.add(__r=ratio(F.col("close"), tl.lag("close")) - 1, __pv=F.col("close") * F.col("volume"))
    return tl.add(
        risk_adjusted=ratio(F.col("__r") - rf / m.YEAR, tl.full(F.stddev, "__r", 30)),
        vwap_20=ratio(tl.full(F.sum, "__pv", 20), tl.full(F.sum, "volume", 20)),
        momentum_risk=ratio(F.col("close"), tl.full(F.avg, "close", 14)) - 1).rows().drop("__r", "__pv")


def rolling_correlation(returns: DataFrame, watched: DataFrame, n: int = 30, threshold: float = 0.7) -> DataFrame:
    """Rolling correlation of the watched pairs (columns a, b), where it exceeds the threshold.

    Only listed pairs are formed: the return of ``a`` is looked up by symbol, that of ``b`` by
    (symbol, time).
    """
    r = returns.where("ret IS NOT NULL")
    x = r.select("ts", F.col("series_id").alias("a"), F.col("ret").alias("xr")).join(settle(watched, "watched"), "a")
    y = r.select("ts", F.col("series_id").alias("b"), F.col("ret").alias("yr"))
    pairs = settle(x.join(y, ["b", "ts"]), "pairs")
    tl = lay_out(pairs, ["a", "b"], ["ts"], time_slice("ts", 30 * 86400), back=n)
    c = F.when(tl.pos >= n - 1, F.corr("xr", "yr").over(tl.last(n)))
    return tl.add(corr=c).rows().where(F.abs("corr") > threshold)


def group_exposure(trades: DataFrame, groups: dict[str, tuple[list[str], float]]) -> DataFrame:
    name, cap = None, None
    for g, (symbols, limit) in groups.items():
        hit = F.col("symbol").isin(*symbols)
        name = F.when(hit, g) if name is None else name.when(hit, g)
        cap = F.when(hit, F.lit(limit)) if cap is None else cap.when(hit, F.lit(limit))
    x = trades.withColumns({"grp": name, "cap": cap}).where("grp IS NOT NULL")
    out = x.groupBy("grp").agg(F.sum(F.col("quantity") * F.col("entry_price")).alias("exposure"), F.max("cap").alias("cap"))
    return out.withColumn("over_limit", F.col("exposure") > F.col("cap"))


def generation_averages(trials: DataFrame, generation: str, objectives: list[str]) -> DataFrame:
    """Best and mean of every objective per generation."""
    each = F.inline(F.array(*[F.struct(F.lit(o).alias("objective"), F.col(o).alias("value")) for o in objectives]))
    return trials.select(generation, each).groupBy("objective", generation).agg(F.max("value").alias("best"), F.avg("value").alias("average"))


def optimisation_summary(trials: DataFrame, generation: str, objectives: list[str]) -> DataFrame:
    best = trials.groupBy(generation).agg(*[F.max(o).alias(o) for o in objectives])
    long = best.unpivot([generation], objectives, "objective", "value")
    first, last = F.min_by("value", generation), F.max_by("value", generation)
    return long.groupBy("objective").agg(
        F.count(F.lit(1)).alias("generations"), first.alias("initial"), last.alias("final"), (last - first).alias("improvement"))
