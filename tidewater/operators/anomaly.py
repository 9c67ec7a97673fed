"""Anomalies, drift, statistical tests, simulation and importance."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import gaussian, ratio, uniform
from tidewater.operators import metrics as m
from tidewater.operators.clean import iqr_flags, z_flags
from tidewater.operators.features import bars_timeline
from tidewater.plans.attach import attach, quantiles, value_slices
from tidewater.operators.setops import last_rows
from tidewater.plans.timeline import join_keys, lay_out, time_slice
from tidewater.session import settle


def any_flag(cols: list[str]) -> Column:
    return reduce(or_, [F.col(f"{c}_outlier") for c in cols])


def z_anomalies(df: DataFrame, key: str, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Rows where any column is more than ``threshold`` population deviations from its mean."""
    return z_flags(df, key, cols, threshold).withColumn("anomaly", any_flag(cols)).drop(*[f"{c}_outlier" for c in cols])


def waiting_times(df: DataFrame, user: str, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Seconds since the previous row of the same user."""
    tl = lay_out(df, user, order or [ts], time_slice(ts, 86400), back=1)
    return tl.add(wait=(F.unix_micros(ts) - F.unix_micros(tl.lag(ts))) / 1e6).rows()


def fraud_flags(events: DataFrame, key: str, amount: str, user: str, threshold: float = 3.0) -> DataFrame:
    """Amount and waiting-time anomalies and their union."""
    x = settle(waiting_times(events, user), "waits")
    x = z_flags(x, key, [amount, "wait"], threshold)
    return x.withColumnsRenamed({f"{amount}_outlier": "amount_anomaly", "wait_outlier": "time_anomaly"}).withColumn(
        "fraud", F.col("amount_anomaly") | F.col("time_anomaly"))


def flag_rates(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def ensemble_anomalies(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Z-score and IQR detectors and their union."""
    x = z_flags(df, key, cols).withColumn("z_anomaly", any_flag(cols)).drop(*[f"{c}_outlier" for c in cols])
    x = iqr_flags(x, key, cols).withColumn("iqr_anomaly", any_flag(cols)).drop(*[f"{c}_outlier" for c in cols])
    return x.withColumn("anomaly", F.col("z_anomaly") | F.col("iqr_anomaly"))


def reconstruction_anomalies(df: DataFrame, cols: list[str], k: int = 2, threshold: float = 0.1) -> DataFrame:
    """Squared distance to the first ``k`` principal components; a linear autoencoder."""
    v = VectorAssembler(inputCols=cols, outputCol="__raw").transform(df)
    v = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(v)
    v = model.transform(v)
    axes = model.pc.toArray()  # features x k, a handful of numbers
    x, p = vector_to_array("__x"), vector_to_array("__p")
    back = [reduce(add, [p[j] * float(axes[i][j]) for j in range(k)]) for i in range(len(cols))]
    error = reduce(add, [F.pow(x[i] - back[i], 2) for i in range(len(cols))]) / len(cols)
    return v.withColumn("error", error).withColumn("anomaly", F.col("error") > threshold).drop("__raw", "__x", "__p")


def anomaly_patterns(df: DataFrame, key: str, cols: list[str], flag: str = "anomaly") -> DataFrame:
    """Per feature: mean, deviation, min, max among the anomalies."""
    x = df.where(flag).select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "feature", "value")
    return x.groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


# -- drift and tests ----------------------------------------------------------------------
def ks_drift(df: DataFrame, key: str, col: str, live: Column, c_alpha: float = 1.628) -> DataFrame:
    """Kolmogorov-Smirnov distance between training and live rows per key; drift at p < 0.01.

    Equal values are folded first; the two distribution functions are then running counts along
    the values, laid out evenly by value.
    """
    folded = df.select(key, F.col(col).cast("double").alias("v"), live.alias("__live")).where("v IS NOT NULL").groupBy(key, "v").agg(
        F.count_if(~F.col("__live")).alias("n0"), F.count_if("__live").alias("n1"))
    folded = settle(folded, "values")
    tl = lay_out(value_slices(folded, key, "v"), key, ["v"], F.col("__vs"))
    x = tl.running(c0=("sum", "n0"), c1=("sum", "n1")).rows()
    x = attach(x, folded.groupBy(key).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")), key)
    out = x.groupBy(key).agg(
        F.max(F.abs(ratio("c0", "t0") - ratio("c1", "t1"))).alias("distance"), F.max("t0").alias("n"), F.max("t1").alias("m"))
    critical = c_alpha * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m")))
    return out.withColumns({"critical": critical, "drift": F.col("distance") > critical})


def dickey_fuller(bars: DataFrame, col: str = "close", critical: float = -2.86) -> DataFrame:
    """t statistic of the lagged level in ``Δx = a + b·x[-1]``."""
    tl = bars_timeline(bars, back=1)
    x = tl.add(__l=tl.lag(col), __d=F.col(col) - tl.lag(col)).rows().where("__l IS NOT NULL")
    y, z = F.col("__d"), F.col("__l")
    s = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx(y, z).alias("sxx"), F.regr_sxy(y, z).alias("sxy"), F.regr_syy(y, z).alias("syy"))
    b = F.col("sxy") / F.col("sxx")
    se = F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return s.withColumn("t_stat", b / se).withColumn("stationary", F.col("t_stat") < critical)


def autocorrelation(bars: DataFrame, lags: list[int], col: str = "close") -> DataFrame:
    """Correlation with the value k rows earlier, all lags in one pass."""
    tl = bars_timeline(bars, back=max(lags))
    x = tl.add(**{f"__l{k}": tl.lag(col, k) for k in lags}).rows()
    parts = [F.struct(F.lit(k).alias("k"), F.corr(col, f"__l{k}").alias("autocorrelation")) for k in lags]
    return x.groupBy("symbol").agg(F.array(*parts).alias("p")).select("symbol", F.inline("p"))


def normality(df: DataFrame, key: str, col: str) -> DataFrame:
    """Jarque-Bera statistic from population skewness and excess kurtosis; normal below 5.991."""
    n, s, k = F.count(col), F.skewness(col), F.kurtosis(col)
    out = df.groupBy(key).agg((n / 6 * (s * s + k * k / 4)).alias("jarque_bera"))
    return out.withColumn("normal", F.col("jarque_bera") < 5.991)


def seasonality(df: DataFrame, key: str, col: str, ts: str = "ts") -> DataFrame:
    """Mean by hour of day and by weekday, one aggregation for both."""
    unit = F.inline(F.array(
        F.struct(F.lit("hour").alias("unit"), F.hour(ts).alias("slot")),
        F.struct(F.lit("weekday").alias("unit"), ((F.dayofweek(ts) + 5) % 7).alias("slot"))))
    return df.select(key, col, unit).groupBy(key, "unit", "slot").agg(F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n"))


# -- simulation ---------------------------------------------------------------------------
def monte_carlo(returns: DataFrame, scenarios: int = 1000, horizon: int = 24, extreme_share: float = 0.25, seed: int = 7) -> DataFrame:
    """Simulated return paths per series: normal, plus a share at three times the deviation.

    Paths are generated inside rows from repeatable random numbers, so there is no shuffle and a
    recomputed task yields the same scenarios.
    """
    fit = returns.where("ret IS NOT NULL").groupBy("series_id").agg(F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sigma"))
    extra = int(scenarios * extreme_share)
    x = fit.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios + extra - 1))))
    scale = F.when(F.col("scenario") >= scenarios, 3.0).otherwise(1.0)
    draw = lambda i: F.col("mu") + scale * F.col("sigma") * gaussian("series_id", "scenario", i, F.lit(seed))
    return x.withColumn("path", F.transform(F.sequence(F.lit(1), F.lit(horizon)), draw))


def stress_report(paths: DataFrame) -> DataFrame:
    """VaR 99, expected shortfall, worst step and deepest drawdown over all scenarios."""
    steps = settle(paths.select("series_id", F.explode("path").alias("ret")), "steps")
    q = settle(quantiles(steps, "series_id", "ret", {"var_99": 0.01}), "q")
    tail = attach(steps, q, "series_id").groupBy("series_id").agg(
        F.max("var_99").alias("var_99"), F.avg(F.when(F.col("ret") < F.col("var_99"), F.col("ret"))).alias("es_99"), F.min("ret").alias("worst"))
    simple = F.transform("path", lambda r: F.exp(r) - 1)
    dd = paths.groupBy("series_id").agg(F.max(-m.path_drawdown(simple)).alias("max_drawdown"))
    return tail.join(dd, "series_id")


def liquidity_stress(bars: DataFrame, draws: int = 1000, seed: int = 11) -> DataFrame:
    """First percentile of log-normal volume draws against the mean volume."""
    fit = bars.where("volume > 0").groupBy("symbol").agg(
        F.avg(F.ln("volume")).alias("mu"), F.stddev_pop(F.ln("volume")).alias("sigma"), F.avg("volume").alias("mean"))
    x = fit.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    x = x.withColumn("v", F.exp(F.col("mu") + F.col("sigma") * gaussian("symbol", "i", F.lit(seed))))
    q = quantiles(settle(x, "draws"), "symbol", "v", {"p01": 0.01})
    return fit.join(q, "symbol").withColumn("stress", F.col("p01") / F.col("mean"))


# -- importance ---------------------------------------------------------------------------
def forest_importance(df: DataFrame, cols: list[str], target: str, trees: int = 100, seed: int = 42) -> DataFrame:
    v = VectorAssembler(inputCols=cols, outputCol="features").transform(df.na.drop("any", subset=[*cols, target]))
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=5, seed=seed).fit(v)
    weights = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(cols, weights)], "feature string, importance double")


def permutation_importance(bars: DataFrame, cols: list[str], model: Column, seed: int = 5) -> DataFrame:
    """Mean absolute change of ``model`` when one feature is shuffled within its symbol.

    The shuffle is a second layout of the same rows by a random number; rows of equal position
    are joined, a one-to-one join on (symbol, position).
    """
    order = [F.col("__u"), F.col("ts")]
    base = settle(bars.withColumn("__u", uniform("symbol", F.unix_micros("ts"), F.lit(seed))), "base")
    by_time = bars_timeline(base, positions=True)
    by_time = by_time.add(__k=by_time.pos).rows()
    shuffled = lay_out(base.select("symbol", "ts", "__u", *cols), "symbol", order, F.floor(F.col("__u") * 64), positions=True)
    shuffled = shuffled.add(__k=shuffled.pos).rows().select("symbol", "__k", *[F.col(c).alias(f"__s_{c}") for c in cols])
    j = settle(by_time.join(shuffled, ["symbol", "__k"]).withColumn("__base", model), "shuffled")
    parts = []
    for c in cols:
        swapped = j.withColumn(c, F.col(f"__s_{c}")).withColumn("__new", model)
        parts.append(swapped.groupBy("symbol").agg(F.avg(F.abs(F.col("__new") - F.col("__base"))).alias("importance")).withColumn("feature", F.lit(c)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def history_trends(history: DataFrame, key: str, order: list[str], slice_by: Column, cols: list[str], window: int = 10) -> DataFrame:
    """Slope of each rolling mean over the history, and stability ``1 - std(differences)``."""
    tl = lay_out(history, key, order, slice_by, back=window)
    d = {f"__d_{c}": F.col(c) - tl.lag(c) for c in cols}
    x = tl.add(__x=tl.pos.cast("double"), **d, **{f"__ma_{c}": tl.full(F.avg, c, window) for c in cols}).rows()
    return x.groupBy(key).agg(
        *[F.regr_slope(F.col(f"__ma_{c}"), F.col("__x")).alias(f"{c}_trend") for c in cols],
        (reduce(add, [1 - F.stddev_pop(f"__d_{c}") for c in cols]) / len(cols)).alias("stability"),
        *[F.max_by(c, "__x").alias(f"last_{c}") for c in cols])


def volatility_change(bars: DataFrame, n: int = 20) -> DataFrame:
    """Deviation of the last window against a prediction column ``predicted``."""
    recent = last_rows(bars, "symbol", "ts", n).groupBy("symbol").agg(F.stddev_pop("close").alias("current_volatility"))
    out = join_keys(bars.groupBy("symbol").agg(F.max_by("predicted", "ts").alias("predicted_volatility")), recent, ["symbol"])
    c = ratio(F.col("predicted_volatility") - F.col("current_volatility"), F.col("current_volatility"))
    return out.withColumns({"volatility_change": c, "confidence": 1 - F.abs(c)})
