"""Importance resampling against plain Python, selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from tidewater.llm import resampling
from tidewater.llm.wordbytes import ALPHABETIC, Words
from tidewater.llm.words import LETTERS


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def features(text, width):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, width=1, share=(10, 100), least=20, buckets=10_000):
    """{row number: (n_features, weight, score, rank)}"""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text, width):
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * float(sum(s) + buckets) / ((a + 1) * float(sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        f = features(text, width)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((i for i in range(len(docs)) if len(words_of(docs[i][1])) >= least), key=lambda i: (-rows[i][3], docs[i][0] is None, docs[i][0] or 0))
    place = {i: n + 1 for n, i in enumerate(able[:len(able) * share[0] // share[1]])}
    return {i: (*row, place.get(i)) for i, *row in rows}


def corpus(n=250):
    r = random.Random(11)
    say = lambda k: " ".join(r.choice(["Straße", "x1", "été", *(f"w{r.randrange(300)}" for _ in range(3))]) for _ in range(k))
    docs = [(i, say(r.randrange(0, 90))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (n + 3, "long" * 50_000 + " " + say(30_000)), (None, say(40)), (n + 4, "a\x00b")]
    return docs, [say(60) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("width", [1, 2])
def test_resampling_is_the_plain_version(spark, monkeypatch, width):
    monkeypatch.setattr(resampling, "GROUP", 60)  # several rounds of selection
    docs, target = corpus()
    df = spark.createDataFrame([(d, x, "w", 7) for d, x in docs], "doc_id long, text string, weight string, rank int").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = {(r.doc_id): (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(df, bench, width=width).collect()}
    want = {docs[i][0]: v for i, v in plain(docs, target, width).items()}
    assert got == want
    drawn = resampling.drawn(df, resampling.resample(df, bench, width=width))
    assert drawn.columns == df.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(k for k, v in want.items() if v[3])


def test_repeated_rows_and_ids(spark):
    text = "one two three four five six seven eight nine ten " * 3
    df = spark.createDataFrame([(1, text)] * 7 + [(2, text + "more"), (2, text), (3, "short")], "doc_id long, text string")
    rows = resampling.resample(df, spark.createDataFrame([("ten nine",)], "text string"), share=(50, 100)).collect()
    assert len(rows) == 10
    ranks = [r["rank"] for r in rows if r["rank"] is not None]
    assert sorted(ranks) == [1, 2, 3, 4]
    assert resampling.drawn(df, resampling.resample(df, df, share=(1, 2))).count() == 4
    assert resampling.drawn(df, resampling.resample(df, df, share=(1, 1))).count() == 9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    some = spark.createDataFrame([("a", "w " * 30), ("b", "v " * 30)], "doc_id string, text string")
    assert resampling.resample(none, some).count() == 0
    assert sorted(r["rank"] for r in resampling.resample(some, none, share=(1, 1)).collect()) == [1, 2]


@pytest.mark.parametrize("n, k", [(1, 1), (900, 1), (900, 417)])
def test_selection_is_sorting(spark, monkeypatch, n, k):
    monkeypatch.setattr(resampling, "GROUP", 90)
    r = random.Random(n + k)
    rows = [(r.randrange(40), None if r.random() < 0.1 else str(r.randrange(500))) for _ in range(n)]
    keys = spark.createDataFrame(rows, "a long, b string").repartition(7)
    want = sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    assert resampling.kth_key(keys, k) == want[k - 1]


def test_word_bytes_and_crc():
    texts = ["Ab c9-é", None, "", "A" * 64 + " " + "B" * 65, "x"]
    words = Words(pa.array(texts).slice(0, 4), LETTERS)
    assert words.strings().to_pylist() == [w for t in texts[:4] for w in words_of(t)] and words.bounds.tolist() == [0, 3, 3, 3, 5]
    for k in (1, 2, 3):
        assert words.crc32(*words.runs(k)).tolist() == [zlib.crc32(" ".join(words_of(t)[i:i + k]).encode()) for t in texts[:4] for i in range(len(words_of(t)) - k + 1)]
    assert Words(pa.array(["a1b"]), ALPHABETIC).strings().to_pylist() == ["a", "b"]
