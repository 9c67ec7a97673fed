"""Quantiles, metrics and invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import metrics as m
from tidewater.operators.indicators import add_indicators
from tidewater.plans.attach import quantiles

# The fixed ten-return example.
RETURNS = [0.01, -0.02, 0.03, -0.01, 0.02, 0.01, -0.03, 0.02, -0.01, 0.01]
PNL = [100, -50, 150, -30, 80, 40, -100, 60, -20, 30]


def series(spark, values):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, ret double")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 2)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("hot", 1.0)] * 50, "k string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    got = {r["k"]: r for r in quantiles(df, "k", "v", probs).collect()}
    for name, p in probs.items():
        assert got["k"][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-9)
        assert got["hot"][name] == 1.0


def test_quantiles_on_many_rows(spark, small_chunks):
    df = spark.range(300_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 300_007).cast("double").alias("v"))
    v = (np.arange(300_000) * 7919) % 300_007
    r = quantiles(df, "k", "v", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.percentile(v, [1, 50, 99]))


def test_fixed_returns(spark):
    s = series(spark, RETURNS)
    v = m.value_at_risk(s, levels=(0.95,)).first()
    assert v["var_95"] == pytest.approx(-0.0255)
    assert v["cvar_95"] <= v["var_95"]
    r = s.groupBy("series_id").agg(
        F.stddev("ret").alias("sd"), F.stddev_pop("ret").alias("sp"), m.skew_corrected("ret").alias("sk"),
        m.kurtosis_corrected("ret").alias("ku"), m.total_return().alias("t")).first()
    assert r["sd"] == pytest.approx(0.0194650684)
    assert r["sp"] == pytest.approx(0.0184661853)
    assert r["sk"] == pytest.approx(-0.4135538183)
    assert r["ku"] == pytest.approx(-0.9511196400)
    assert r["t"] == pytest.approx(0.0286553489)


def test_drawdowns(spark):
    dd = m.drawdowns(series(spark, RETURNS))
    cum = np.cumprod(1 + np.array(RETURNS))
    want = cum / np.maximum.accumulate(cum) - 1
    got = [r["dd"] for r in dd.orderBy("ts").collect()]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert max(got) <= 0
    assert m.drawdown_duration(dd).first()["mean_duration"] >= 1


def test_constant_returns_have_no_ratio(spark):
    s = series(spark, [0.01] * 10)
    r = s.groupBy("series_id").agg(
        F.stddev("ret").alias("sd"), m.sharpe(F.col("ret")).alias("sharpe"), m.sortino(F.col("ret")).alias("sortino"), m.omega(F.col("ret")).alias("omega")).first()
    assert r["sd"] == pytest.approx(0, abs=1e-12)
    assert r["sortino"] is None and r["omega"] is None


def test_risk_report_is_complete(spark):
    s = series(spark, RETURNS)
    t = spark.createDataFrame([("s", float(p)) for p in PNL], "symbol string, pnl double")
    r = m.risk_report(s, t, m.drawdowns(s)).first().asDict()
    assert len(r) == 19 and all(v is not None for v in r.values())
    assert r["win_rate"] == 0.6
    assert r["profit_factor"] == pytest.approx(460 / 200)


def test_indicator_ranges(spark, small_chunks):
    rng = np.random.default_rng(7)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 200)))
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=200, freq="h"), "open": p, "high": p * 1.01, "low": p * 0.99, "close": p, "volume": 1000.0})
    got = add_indicators(spark.createDataFrame(pdf), ["rsi", "rsi_wilder", "stochastic", "mfi", "adx", "atr", "bollinger"]).toPandas()
    assert len(got) == 200
    for c in ("rsi", "rsi_wilder", "mfi", "adx"):
        v = got[c].dropna()
        assert len(v) and v.between(0, 100).all(), c
    assert (got["atr"].dropna() > 0).all()
    b = got.dropna(subset=["bb_mid"])
    assert ((b.bb_lower <= b.bb_mid) & (b.bb_mid <= b.bb_upper)).all()
    with pytest.raises(ValueError):
        add_indicators(spark.createDataFrame(pdf), ["nonsense"])
