"""Importance resampling towards a target distribution.

Features are runs of 1 to ``width`` consecutive words, hashed into buckets by crc32. Bucket counts of all documents and of
the target become an array of gains; a document's weight is the floored mean of its features' gains. Adding Gumbel noise
made from a hash of its id and taking the highest scores draws without replacement in proportion to the weights.

The cutoff score is found by weighted median-of-medians selection: every group of keys reports its median and its size,
the weighted median of these splits the keys, and the side that can't hold the cutoff (a quarter of all keys at least) is
left out, until the cutoff is hit or one group is left. Only keys up to the cutoff are sorted.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

Nulls and edge cases: a null or empty text has no features, weight 0, and is never drawn (nor is any text below
``least_words`` words); a null id takes noise from the seed alone and comes after all other ids in ties; rows that repeat
(id, text) have equal keys and are drawn in any order, never more than asked for; rows that repeat an id with several texts
are told apart by a hash of the text; an empty target gives gains from the smoothing alone; empty tables give no
rows; further columns are ignored by ``resample`` and carried along by ``drawn``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import drop_written, keyed, same_document, settled
from tidewater.llm.wordbytes import Words
from tidewater.llm.words import LETTERS, slices

BUCKETS, WIDTH, LEAST_WORDS, SEED = 10_000, 1, 20, "2024"
#: Keys of one group: its median is one row for the driver. This many keys at most are sorted to end the selection.
GROUP = 1 << 16


def _feature_buckets(words: Words, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature; rows ascend within each run length."""
    row_of = np.repeat(np.arange(len(words)), np.diff(words.bounds))
    rows, found = [], []
    for k in range(1, width + 1):
        first, length = words.runs(k)
        rows.append(row_of[first])
        found.append(words.crc32(first, length) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket; every task sends its sums, at most one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                total += np.bincount(_feature_buckets(Words(batch.column(0).slice(i, j - i), LETTERS), width, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    summed = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored, scaled log ratio of its smoothed shares in target and source."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: str, doc_id: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight and score of every row."""
    source = keyed(docs, id_col, text_col).withColumn("id_text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    numbers = ["n_words", "n_features", "weight", "score"]
    schema = T.StructType([source.schema["doc_id"], source.schema["text_key"], *(T.StructField(c, T.LongType()) for c in numbers)])

    def run(batches):
        gain = shared.value
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                words = Words(part.column(2), LETTERS)
                rows, found = _feature_buckets(words, width, len(gain))
                n = np.bincount(rows, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                at = 0
                for k in range(1, width + 1):
                    ends = at + np.concatenate(([0], np.cumsum(np.maximum(np.diff(words.bounds) - k + 1, 0))))
                    sums = np.concatenate(([0], np.cumsum(gain[found[at:ends[-1]]])))
                    total += sums[ends[1:] - at] - sums[ends[:-1] - at]
                    at = int(ends[-1])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                score = weight + np.array([noise(seed, x) for x in part.column(3).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (np.diff(words.bounds), n, weight, score))],
                                                 names=["doc_id", "text_key", *numbers])

    return source.select("doc_id", "text_key", "text", "id_text").mapInArrow(run, schema)


def kth_key(keys: DataFrame, k: int) -> tuple:
    """The ``k``-th smallest row of ``keys`` (from 1) in the order of its columns, by weighted median of medians."""
    cols = keys.columns
    order = [(c, "ascending") for c in cols]
    key = F.struct(*cols)

    def literal(row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, keys.schema)])

    def medians(batches):
        def middle(held):
            t = pa.Table.from_batches(held)
            at = pc.sort_indices(t, sort_keys=order, null_placement="at_start")[len(t) // 2].as_py()
            one = t.slice(at, 1)
            return pa.RecordBatch.from_arrays([*(one[c].combine_chunks() for c in cols), pa.array([len(t)], pa.int64())], names=[*cols, "size"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= GROUP:
                yield middle(held)
                held, n = [], 0
        if n:
            yield middle(held)

    size = T.StructField("size", T.LongType())
    live = written = keys
    n = n_written = keys.count()
    while n > GROUP:
        found = live.mapInArrow(medians, T.StructType([*keys.schema.fields, size])).sort(*cols).collect()
        seen, half = 0, (n + 1) // 2
        for row in found:
            seen += row["size"]
            pivot = row[:len(cols)]
            if seen >= half:
                break
        side = F.when(key < literal(pivot), -1).when(key == literal(pivot), 0).otherwise(1)
        counts = {r["side"]: r["count"] for r in live.groupBy(side.alias("side")).count().collect()}
        below, equal = counts.get(-1, 0), counts.get(0, 0)
        if below < k <= below + equal:
            return tuple(pivot)
        if k <= below:
            live, n = live.filter(key < literal(pivot)), below
        else:
            live, n, k = live.filter(key > literal(pivot)), n - below - equal, k - below - equal
        if 2 * n <= n_written:  # what is left is read again in every round
            live = settled(live, "live-keys")
            if written is not keys:
                drop_written(keys.sparkSession, written)
            written, n_written = live, n
    last = live.sort(*cols).offset(k - 1).limit(1).first()
    if written is not keys:
        drop_written(keys.sparkSession, written)
    return tuple(last)


def ranked(rows: DataFrame, cols: list[str], to: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``cols``: sorted by range, then counted per partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).cast("int")
    offsets, before = {}, 0
    for r in placed.groupBy(part.alias("p")).count().sort("p").collect():  # one row a partition
        offsets[r["p"]] = before
        before += r["count"]
    if not offsets:
        return placed.withColumn(to, F.lit(None).cast("long")).drop("__at")
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return placed.withColumn(to, (F.element_at(table, part) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__at")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight, score and rank of every row; the rank is null for rows not drawn.

    Of the N rows with ``least_words`` words, floor(N * share[0] / share[1]) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, target_text_col, width, buckets))
    rows = scored(docs, gain, width, seed, id_col, text_col)
    rows = settled(rows.withColumns({"__neg": -F.col("score"), "__none": F.col("doc_id").isNull()}), "scored")
    able = F.col("n_words") >= least_words
    k = share[0] * rows.filter(able).count() // share[1]
    out = ["doc_id", "text_key", "n_words", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    cols = ["__neg", "__none", "doc_id", "text_key"]
    cutoff = kth_key(rows.filter(able).select(*cols), k)
    within = F.struct(*cols) <= F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(cutoff, cols)])
    won = ranked(rows.filter(able & within), cols)
    won = won.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # equal keys may stand beyond the last place
    return won.select(*out, "rank").unionByName(rows.filter(~(able & within)).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` drew, with all their columns as they were; of equal rows as many as were drawn."""
    taken = ranks.filter("rank is not null").groupBy("doc_id", "text_key").count().select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("count").alias("__n"))
    text_key = F.xxhash64(docs[text_col].cast("string"))
    joined = docs.join(taken, docs[id_col].eqNullSafe(F.col("__id")) & (text_key == F.col("__key")))
    place = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(1)))
    return joined.withColumn("__place", place).filter("__place <= __n").select(*[docs[c] for c in docs.columns])
