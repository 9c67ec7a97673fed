"""One small test per finding of round 4."""

import random

from tidewater.streaming import streams


def test_a_hot_slot_is_joined_in_pieces(spark, tmp_path, monkeypatch):
    """No row of the state holds a whole slot, all pairs are found, also over two batches, and passed state goes."""
    monkeypatch.setattr(streams, "PIECE", 16, raising=False)
    r = random.Random(6)
    first = [(i, "a", 1000 + r.randrange(5_000_000) / 1e6) for i in range(1400)]
    first += [(1400 + i, r.choice(["a", "b", None]), 1000 + r.randrange(600) / 10) for i in range(200)]
    second = [(2000 + i, "a", 1061 + r.randrange(100) / 10) for i in range(40)] + [(3000, "a", 90_000.0), (3001, None, 90_000.0), (3002, "a", None)]
    rows, path = first + second, f"{tmp_path}/ticks"
    for part in (first, second):
        df = spark.createDataFrame(part, "id long, symbol string, x double").selectExpr("id", "symbol", "timestamp_micros(cast(round(x * 1e6) as long)) AS ts")
        df.coalesce(1).write.mode("append").parquet(path)
    ticks = streams.read_stream(spark, path, df.schema)
    joined = streams.nearest_books(ticks, ticks.withColumnRenamed("id", "book_id"), 10)
    root = f"{tmp_path}/out"
    run = joined.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    state = [s for p in run.recentProgress for s in p["stateOperators"]]
    assert state[0]["numRowsUpdated"] >= 2 * 1400 // streams.PIECE
    assert state[-1]["numRowsTotal"] <= 4
    micros = [(i, s, None if x is None else round(x * 1e6)) for i, s, x in rows]
    want = [(i, j) for i, s, x in micros for j, u, y in micros if s is not None and s == u and None not in (x, y) and y <= x <= y + 10_000_000]
    got = [(x.id, x.book_id) for x in spark.read.parquet(f"{root}/data").collect()]
    assert sorted(got) == sorted(want)
    assert max(len(x) for x in streams.bundled(spark.read.parquet(path), ["symbol"], "ts").toPandas()["id"]) <= streams.PIECE


def test_landed_pairs_have_only_the_columns_of_the_answer(spark, monkeypatch):
    """Times served the join and are not written with every pair."""
    from check_oracles import SF, compare, connect

    from __spark_entry__ import oracle_sql, queries

    seen, old = [], streams.run_once
    monkeypatch.setattr(streams, "run_once", lambda stream, *a, **k: seen.append(stream.columns) or old(stream, *a, **k))
    name = "st17_stream_stream_join"
    message = compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
    assert not message or message.startswith(" ")
    assert seen == [["trade_id", "book_id", "symbol"]]
