"""Registered queries against their oracle SQL at the smallest scale, and the driver contract."""

import pytest

from check_oracles import SF, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = [
    "io01_read_parquet", "io04_read_yaml", "io12_upsert", "p11_time_gaps", "p14_zero_volume_runs", "p23_validation_report", "c01_full_calendar",
    "c03_interpolate_rows", "c07_iqr_clip", "f01_resample", "f14_sequences", "f24_sentiment", "j03_asof_join", "w04_macd", "w06_rsi_wilder", "w20_adx_wilder",
    "t02_mean_reversion_signal", "t13_trailing_stop", "t15_non_overlapping", "t16_portfolio_replay", "a07_drawdown_periods", "a17_streaks", "a46_decision_boundary",
    "n06_ks_drift", "n11_regime_segments", "g03_strategy_sweep", "g11_crowding", "g12_hypervolume", "st05_tumbling_bars", "st09_incremental_rsi",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    msg = compare(queries()[name](spark, SF), con, oracle_sql()[name])
    assert not msg or msg.startswith(" "), msg


def test_same_answer_for_any_chunk_size(spark, con, small_chunks):
    for name in ("w28_indicator_set", "a05_drawdowns"):
        msg = compare(queries()[name](spark, SF), con, oracle_sql()[name])
        assert not msg or msg.startswith(" "), msg


def test_contract(spark):
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) > 200
    assert entry(spark).count() > 0
