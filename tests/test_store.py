"""The versioned bar store: changes read back, untouched files stay, conflicts and failed changes leave nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.session import shared_folder
from tidewater.sources.store import BarStore, StoreConflict

START = dt.datetime(2024, 1, 1)
SCHEMA = "data_type string, symbol string, timeframe string, ts timestamp, close double"


def rows(symbols, hours, close=1.0):
    return [("ohlcv", s, "1h", START + dt.timedelta(hours=h), close + h) for s in symbols for h in hours]


@pytest.fixture
def store(spark, tmp_path):
    return BarStore(spark, f"{shared_folder(spark)}/{tmp_path.name}-{tmp_path.parent.name}")


def paths(store, version=None):
    return {(r.symbol, r.path) for r in store.datasets(version).collect()}


def test_changes_are_read_back(spark, store):
    assert store.version() == 0 and store.datasets().count() == 0
    assert store.write(spark.createDataFrame(rows(["a/b", "c", None], range(5)), SCHEMA)) == 1
    first = paths(store)
    new = spark.createDataFrame(rows(["c", "d"], range(3, 8), 100.0), SCHEMA).withColumn("extra", F.lit("x"))
    assert store.upsert(new, keep_last=4) == 2
    got = {(r.symbol, r.ts.hour): (r.close, r.extra) for r in store.read().collect()}
    assert got == {**{(s, h): (1.0 + h, None) for s in ("a/b", None) for h in range(5)}, **{("c", h): (100.0 + h, "x") for h in range(4, 8)}, **{("d", h): (100.0 + h, "x") for h in range(4, 8)}}
    assert {p for p in paths(store) if p[0] in ("a/b", None)} == {p for p in first if p[0] in ("a/b", None)}
    assert store.read(version=1).count() == 15 and {p for p in first if p[0] == "c"}.isdisjoint(paths(store))
    assert store.delete(symbol="a/b") == 3
    assert {r.symbol for r in store.read().select("symbol").distinct().collect()} == {"c", "d", None}
    assert store.read(symbol="c", start="2024-01-01 05:00:00", end="2024-01-01 06:00:00").count() == 2
    assert store.read(symbol="zz").count() == 0
    assert store.write(spark.createDataFrame(rows(["c"], [0]), SCHEMA), mode="overwrite") == 4
    assert store.read(symbol="c").count() == 1 and store.read(symbol="d").count() == 4
    listed = {r.symbol: (r.rows, r.first_ts.hour) for r in store.datasets().collect()}
    assert listed["d"] == (4, 4) and listed["c"] == (1, 0)


def test_a_late_writer_conflicts_and_an_upsert_starts_again(spark, store, monkeypatch):
    store.write(spark.createDataFrame(rows(["a"], range(3)), SCHEMA))
    other = BarStore(spark, store.root)
    with pytest.raises(StoreConflict):
        store._commit(0, store.datasets(), spark.createDataFrame([], SCHEMA).schema)
    real, raced = store._commit, []

    def late(base, manifest, schema):
        if not raced:
            raced.append(other.write(spark.createDataFrame(rows(["b"], range(2)), SCHEMA)))
        return real(base, manifest, schema)

    monkeypatch.setattr(store, "_commit", late)
    assert store.upsert(spark.createDataFrame(rows(["a"], [7]), SCHEMA)) == 3
    assert {(r.symbol, r.ts.hour) for r in store.read().collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 7), ("b", 0), ("b", 1)}


def test_a_failed_change_leaves_the_store_as_it_was(spark, store, monkeypatch):
    store.write(spark.createDataFrame(rows(["a"], range(3)), SCHEMA))
    before = paths(store)
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame(rows(["a"], [9]), SCHEMA))
    assert store.version() == 1 and paths(store) == before and store.read().count() == 3


def test_empty_and_unknown(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.delete(symbol="x") == 0
    assert store.write(spark.createDataFrame([], SCHEMA)) == 1 and store.read().count() == 0
