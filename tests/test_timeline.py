"""Chunked windows and scans against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.plans.joins import asof_join, interval_join
from tidewater.plans.timeline import lay_out, time_slice


def frame(n=300, seed=1):
    rng = np.random.default_rng(seed)
    sym = np.where(rng.random(n) < 0.7, "HOT", rng.choice(["B", "C"], n))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(40 * 86400, n, replace=False)), unit="s")
    x = rng.normal(100, 10, n)
    return pd.DataFrame({"symbol": sym, "ts": ts, "x": x, "gap": np.where(rng.random(n) < 0.4, np.nan, x)})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))) if "gap" in pdf else df


def same(got, want, cols):
    got = got.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "ts"]).reset_index(drop=True)
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_bounded_frames(spark, small_chunks):
    pdf = frame()
    tl = lay_out(to_spark(spark, pdf), "symbol", ["ts"], time_slice("ts", 86400), back=12, ahead=3)
    got = tl.add(m=tl.full(F.avg, "x", 10), l=tl.lag("x", 12), n=tl.lead("x", 3), p=tl.pos, t=tl.total).rows()
    g = pdf.groupby("symbol")
    want = pdf.assign(
        m=g["x"].transform(lambda s: s.rolling(10).mean()), l=g["x"].shift(12), n=g["x"].shift(-3), p=g.cumcount(), t=g["x"].transform("size"))
    assert got.count() == len(pdf)
    same(got, want, ["m", "l", "n", "p", "t"])


@pytest.mark.parametrize("back", [0, 5])
def test_running_scans(spark, small_chunks, back):
    pdf = frame(seed=2)
    tl = lay_out(to_spark(spark, pdf), "symbol", ["ts"], time_slice("ts", 86400), back=back)
    got = tl.running(s=("sum", "x"), m=("max", "x"), b=("max<", "x"), f=("last", "gap"), n=("next", "gap"), c=("count", "gap")).rows()
    g = pdf.groupby("symbol")
    want = pdf.assign(
        s=g["x"].cumsum(), m=g["x"].cummax(), b=g["x"].transform(lambda s: s.cummax().shift()), f=g["gap"].ffill(), n=g["gap"].bfill(),
        c=g["gap"].transform(lambda s: s.notna().cumsum()))
    same(got, want, ["s", "m", "b", "f", "n", "c"])


@pytest.mark.parametrize("block", [0, 260])
def test_smoothing_matches_the_recurrence(spark, block):
    spark.conf.set("tidewater.chunk.rows", "100")
    try:
        pdf = frame(n=900, seed=3)
        tl = lay_out(to_spark(spark, pdf), "symbol", ["ts"], time_slice("ts", 86400), back=600, block=block)
        got = tl.smooth(e=("x", 2 / 13), w=("x", 1 / 7, 6, 7)).rows()
        g = pdf.groupby("symbol")["x"]

        def wilder(s):
            out = s.copy() * np.nan
            y = s.iloc[:7].mean()
            for i in range(6, len(s)):
                y = y if i == 6 else s.iloc[i] / 7 + y * 6 / 7
                out.iloc[i] = y
            return out

        want = pdf.assign(e=g.transform(lambda s: s.ewm(span=12, adjust=False).mean()), w=g.transform(wilder))
        same(got, want, ["e", "w"])
    finally:
        spark.conf.unset("tidewater.chunk.rows")


def test_a_hot_key_is_split(spark, small_chunks):
    pdf = frame()
    tl = lay_out(to_spark(spark, pdf), "symbol", ["ts"], time_slice("ts", 86400), back=4)
    sizes = tl.df.groupBy(*tl.part).count().toPandas()
    assert sizes["count"].max() <= 7 + 4
    assert len(sizes[sizes.symbol == "HOT"]) >= 20


def test_asof_and_interval_joins(spark, small_chunks):
    left, right = frame(seed=4), frame(n=80, seed=5)[["symbol", "ts", "x"]].rename(columns={"x": "rate"})
    got = asof_join(to_spark(spark, left), spark.createDataFrame(right), "symbol", "ts", ["rate"], slice_seconds=86400)
    want = pd.concat([
        pd.merge_asof(l, right[right.symbol == s][["ts", "rate"]], on="ts") for s, l in left.sort_values("ts").groupby("symbol")])
    same(got, want, ["x", "rate"])
    e = spark.createDataFrame(left[["symbol", "ts"]].rename(columns={"ts": "entry_ts"}))
    got = interval_join(e, spark.createDataFrame(right), "symbol", "entry_ts", "ts", 7200).count()
    m = left[["symbol", "ts"]].merge(right, on="symbol", suffixes=("", "_r"))
    d = (m.ts_r - m.ts).dt.total_seconds()
    assert got == int(((d > 0) & (d <= 7200)).sum())


def test_smoothing_over_missing_values_is_the_pandas_mean(spark):
    import numpy as np
    import pandas as pd

    from tidewater.plans.timeline import lay_out, smoothing_reach

    r = np.random.default_rng(4)
    alpha, n = 2 / 13, 900
    frames = []
    for key, missing in (("a", 0.0), ("b", 0.3), ("c", 0.8)):
        x = 100 + r.normal(size=n).cumsum()
        x[r.random(n) < missing] = np.nan
        x[:3] = np.nan
        frames.append(pd.DataFrame({"k": key, "i": range(n), "x": x, "want": pd.Series(x).ewm(alpha=alpha, adjust=False).mean()}))
    rows = pd.concat(frames)
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "k string, i long, x double, want double")
    for chunk in (300, 16_384):
        tl = lay_out(df, "k", ["i"], F.floor(F.col("i") / 50), back=smoothing_reach(alpha), chunk_rows=chunk)
        out = tl.smooth(y=("x", alpha)).rows().toPandas()
        assert len(out) == 3 * n and out.y.isna().equals(out.want.isna())
        assert np.nanmax(np.abs(out.y - out.want)) < 1e-5


def test_null_keys_and_times_stay(spark):
    from tidewater.plans.attach import quantiles
    from tidewater.plans.timeline import lay_out

    rows = [("a" if i % 5 else None, i if i % 9 else None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    for chunk in (7, 50, 16_384):
        tl = lay_out(df, "k", ["i"], F.floor(F.col("i") / 30), back=3, chunk_rows=chunk).running(s=("sum", "x"), p=("product", F.lit(1.0)))
        out = tl.rows().toPandas()
        assert len(out) == 200 and out.p.eq(1).all()
        assert sorted(out.groupby("k", dropna=False).s.max()) == sorted([sum(x for k, _, x in rows if k), sum(x for k, _, x in rows if not k)])
    assert quantiles(df, "k", "x", {"m": 0.5}).count() == 2


def test_running_product_keeps_losses(spark):
    from tidewater.plans.timeline import lay_out

    df = spark.createDataFrame([(1, i, r) for i, r in enumerate([0.1, -1.0, 0.1, -1.5])] + [(2, i, r) for i, r in enumerate([0.5, -1.5, 1.0])], "k int, i long, r double")
    out = lay_out(df, "k", ["i"], F.floor(F.col("i") / 2), back=1, chunk_rows=2).running(c=("product", 1 + F.col("r"))).rows().orderBy("k", "i").collect()
    assert [round(x.c, 9) for x in out] == [1.1, 0.0, 0.0, 0.0, 1.5, -0.75, -1.5]


def test_latest_table_survives_retry_and_restart(spark, tmp_path):
    from tidewater.streaming.streams import LatestTable

    batches = [spark.createDataFrame(rows, "k string, ts long, v int") for rows in ([("a", 1, 1), ("b", 1, 2)], [("b", 2, 3)], [("c", 1, 4)])]
    new = lambda: LatestTable(spark, ["k"], "ts", batches[0].schema, path=str(tmp_path / "latest"))
    table = new()
    for epoch in (0, 1, 1):  # batch 1 is run again
        table(batches[epoch], epoch)
    table = new()  # a restart runs the last batch once more
    for epoch in (1, 2):
        table(batches[epoch], epoch)
    assert sorted(tuple(r) for r in table.table().collect()) == [("a", 1, 1), ("b", 2, 3), ("c", 1, 4)]


def test_day_state_covers_a_day_of_minute_bars(spark, small_chunks):
    from datetime import datetime, timedelta

    from tidewater.operators.metrics import day_state

    start, rows = datetime(2024, 1, 1, 5), []
    for i in range(2 * 1440):
        if i % 3:  # with gaps
            rows.append(("A", start + timedelta(minutes=i), 100.0 + i % 977, 90.0 - i % 853, 95.0 + i % 31, 1.0 + i % 7))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double, volume double")
    got = sorted(day_state(bars).collect(), key=lambda r: r.ts)
    assert len(got) == len(rows)
    lo = 0
    for k, r in enumerate(got):
        while rows[lo][1] < rows[k][1] - timedelta(days=1):
            lo += 1
        day = rows[lo:k + 1]
        assert (r.last, r.high_24h, r.low_24h, r.volume_24h) == (rows[k][4], max(x[2] for x in day), min(x[3] for x in day), sum(x[5] for x in day))
        assert abs(r.change_24h - (rows[k][4] - day[0][4]) / day[0][4]) < 1e-12
