"""One small test per finding of round 3."""

from check_oracles import SF, compare, connect

from __spark_entry__ import oracle_sql, queries


def against_sql(spark, name):
    """What differs; a note that begins with a blank is no difference."""
    msg = compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
    return "" if msg.startswith(" ") else msg


def test_stress_report_has_the_drawdown(spark):
    from tidewater.operators import anomaly

    paths = spark.createDataFrame([("a", [0.1, -0.2, 0.05]), ("a", [0.0, 0.0]), ("b", [0.1])], "series_id string, path array<double>")
    got = {r.series_id: r.max_drawdown for r in anomaly.stress_report(paths).collect()}
    assert abs(got["a"] - (1 - 2.718281828459045 ** -0.2)) < 1e-12 and got["b"] == 0


def test_stress_test_equals_its_sql(spark):
    assert not against_sql(spark, "n14_stress_test")


def test_books_are_met_by_slot_not_by_symbol(spark):
    """Pairs equal the SQL, also at slot edges, and the join compares trades with the books of two slots only."""
    from tidewater.session import shared_folder
    from tidewater.streaming import streams

    path = f"{shared_folder(spark)}/near"
    rows = [(i, s, x) for i, (s, x) in enumerate([("a", 0.0), ("a", 0.5), ("a", 9.999999), ("a", 10.0), ("a", 10.5), ("a", 19.0), ("a", 20.0), ("b", 10.0), ("b", 31.0), (None, 10.0)])]
    df = spark.createDataFrame(rows, "id long, symbol string, x double").selectExpr("id", "symbol", "timestamp_micros(cast(round((1000 + x) * 1e6) as long)) AS ts")
    df.write.mode("overwrite").parquet(path)
    ticks = streams.read_stream(spark, path, df.schema, files_per_batch=100)
    books = streams.read_stream(spark, path, df.schema, files_per_batch=100).withColumnRenamed("id", "book_id")
    joined = streams.nearest_books(ticks, books, 10)
    assert set(joined.columns) == {"id", "symbol", "ts", "book_id", "book_ts"}
    keys = joined._jdf.queryExecution().analyzed().toString()
    assert "(__slot#" in keys and "= __book_slot#" in keys
    got = {(r.id, r.book_id) for r in streams.run_once(joined, "near").collect()}
    want = {(i, j) for i, s, x in rows for j, u, y in rows if s is not None and s == u and y <= x <= y + 10}
    assert got == want


def test_at_most_takes_a_fixed_number_of_passes(spark, small_chunks):
    """Long trades over many chunks, entries that close at once, a NULL key and equal entry times."""
    import random

    from pyspark.sql import functions as F

    from tidewater.operators import trades

    r, rows = random.Random(5), []
    for i in range(400):
        a = r.randrange(150)
        rows.append((r.choice(["x", "x", "x", "y", None]), i, a, a + r.choice([0, 0, 1, 2, 40, 90])))
    df = spark.createDataFrame(rows, "symbol string, trade_id long, a long, z long").select(
        "symbol", "trade_id", F.timestamp_seconds("a").alias("entry_time"), F.timestamp_seconds("z").alias("exit_time"))
    for most in (1, 3):
        want = set()
        for key in ("x", "y", None):
            open_ = []
            for a, z, i in sorted((a, z, i) for s, i, a, z in rows if s == key):
                open_ = [x for x in open_ if x > a]
                if len(open_) < most:
                    open_.append(z)
                    want.add((key, i))
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"lanes{most}", "")
        got = {(x.symbol, x.trade_id) for x in trades.at_most(df, most, slice_seconds=7).collect()}
        jobs = len(tracker.getJobIdsForGroup(f"lanes{most}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", "")
        assert got == want and jobs <= 20 + 20 * most


def test_non_overlapping_with_trades_that_close_at_once(spark, small_chunks):
    from pyspark.sql import functions as F

    from tidewater.operators import trades

    rows = [("x", i, i // 2, i // 2) for i in range(5)] + [("x", 5, 2, 30)] + [("x", i, i - 3, i - 2) for i in range(6, 20)]
    df = spark.createDataFrame(rows, "symbol string, trade_id long, a long, z long").select(
        "symbol", "trade_id", F.timestamp_seconds("a").alias("entry_time"), F.timestamp_seconds("z").alias("exit_time"))
    assert sorted(x.trade_id for x in trades.non_overlapping(df, slice_seconds=3).collect()) == [0, 1, 2, 3, 4, 5]


def test_sentiment_is_the_same_with_a_lexicon_too_large_to_send(spark):
    """Null, empty and repeated texts, repeated ids, words unknown to the lexicon; no word of a text is shuffled where the lexicon is sent."""
    from tidewater.operators import text

    news = spark.createDataFrame(
        [(1, "Good good, bad! the unknown"), (2, "bad"), (2, "good rare"), (3, "the"), (4, None), (5, ""), (6, "nothing known"), (7, "rare rare none")], "doc_id long, text string")
    lexicon = spark.createDataFrame(
        [("good", 1.0, 0.5, 9), ("bad", -1.0, 0.25, 5), ("rare", 0.5, 1.0, 1), ("none", None, None, 1)], "word string, polarity double, subjectivity double, texts long")
    rows = lambda df: sorted((r.doc_id, round(r.polarity, 9), round(r.subjectivity, 9), round(r.confidence, 9)) for r in df.collect())
    whole = rows(text.sentiment(news, lexicon))
    assert whole == [(1, 0.333333333, 0.416666667, 0.75), (2, 0.166666667, 0.583333333, 1.0), (6, 0.0, 0.0, 0.0), (7, 0.5, 1.0, 0.666666667)]
    for local in (0, 1, 2, 3):
        assert rows(text.sentiment(news, lexicon, local=local)) == whole
    plan = text.sentiment(news, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" in plan and "word" not in plan.split("Aggregate [doc_id")[1].split("]")[0]


def test_running_metrics_reads_its_trades_from_one_written_table(spark, monkeypatch):
    from tidewater.catalog import streams as catalog

    seen, old = [], catalog.landed
    monkeypatch.setattr(catalog, "landed", lambda t, df, *a, **k: seen.append(df) or old(t, df, *a, **k))
    assert not against_sql(spark, "st12_running_metrics")
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_toxicity_learns_from_every_labelled_row(spark):
    """Log odds and rows are those of all labelled rows, several blocks train side by side, and the result still separates."""
    import numpy as np
    import random

    from tidewater.llm import toxicity

    r, docs, labels = random.Random(9), [], []
    for i in range(900):
        w = [f"w{r.randrange(2000)}" for _ in range(30)]
        if i % 6 == 0:
            w[r.randrange(30)] = r.choice(["grimble", "vex", f"only{i}"])
            w[r.randrange(30)] = "snark"
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = lambda c: c % 3 == 1
    rows = toxicity.labelled(docs, labels, held, block=100)
    assert rows.count() == 601 and rows.select("block").distinct().count() > 3
    learn = rows.filter("not check")
    n = [learn.filter(f"label = {x}").count() for x in (0, 1)]
    odds = toxicity.log_odds(learn.select("label", "text"), n)
    seen = np.zeros((2, toxicity.PAD + 1))
    for row in learn.collect():
        import pyarrow as pa

        ids, _ = toxicity.features(toxicity.Batch(pa.array([row.text]), toxicity.LETTERS, toxicity.PREFIXES))
        seen[row.label, np.unique(ids)] += 1
    want = np.log((seen[1] + 3 * n[1] / sum(n)) / n[1]) - np.log((seen[0] + 3 * n[0] / sum(n)) / n[0])
    assert np.allclose(odds, want)
    out = toxicity.score(docs, toxicity.train(docs, labels, held_out=held, block=100), to="p").filter("doc_id % 3 = 1").collect()
    assert sum((x.p >= 0.5) == (x.doc_id % 6 == 0) for x in out) >= 0.95 * len(out)


def test_trades_and_books_meet_once_per_slot(spark, tmp_path):
    """The state holds a row per symbol and slot, not per trade, and every pair is still found."""
    import random

    from tidewater.streaming import streams

    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), 1000 + r.randrange(3000) / 100) for i in range(400)] + [(400, "a", None)]
    df = spark.createDataFrame(rows, "id long, symbol string, x double").selectExpr("id", "symbol", "timestamp_micros(cast(round(x * 1e6) as long)) AS ts", "array(id) AS parts")
    path = f"{tmp_path}/slots"
    df.coalesce(1).write.mode("overwrite").parquet(path)
    ticks = streams.read_stream(spark, path, df.schema)
    joined = streams.nearest_books(ticks, ticks.withColumnRenamed("id", "book_id").drop("parts"), 10)
    assert joined.columns == ["id", "symbol", "ts", "parts", "book_id", "book_ts"]
    root = f"{tmp_path}/out"
    run = joined.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(s["numRowsUpdated"] for p in run.recentProgress for s in p["stateOperators"]) <= 3 * (3 + 2 * 3) + 3
    got = [(x.id, x.book_id) for x in spark.read.parquet(f"{root}/data").collect()]
    want = [(i, j) for i, s, x in rows for j, u, y in rows if s is not None and s == u and None not in (x, y) and y <= x <= y + 10]
    assert sorted(got) == sorted(want)
