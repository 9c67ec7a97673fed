"""Nearest neighbours by largest inner product with a forest of hash prefixes.

Every tree gives a vector a string of 64 hash bits (signs of random projections, after the lift that turns inner
products into angles) and keeps the strings sorted. A query descends in every tree to the longest prefix it shares with
any row; then all trees ascend together, one bit at a time, until the rows that share a prefix of that length number at
least ``enough`` over all trees. Those rows are compared exactly.

``enough`` is measured, not guessed: a bounded sample of queries is compared with all rows by brute force, and the
smallest number that reaches the wanted recall on it is taken. On vectors without structure this can be most of the
table; on clustered ones it is small. Queries whose prefixes at the partitioning depth hold too few rows go on to a
coarser partitioning, in the end to all rows.

A tree's sorted strings are partitioned by their first bits, and a part above ``CHUNK`` rows is dealt to several tasks,
which each see its queries. Only the ``k`` + 1 smallest ids of equal vectors are indexed: further copies can never be
among the nearest.

Nulls and edge cases: vectors that are null, zero, of another length than the most common one or that hold a null or a
non-finite number take no part; ties go to the smaller id; a row is never its own neighbour, a copy of it is; fewer
candidates than ``k`` give fewer rows; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import settled

BITS, TREES, CHUNK, LEVELS = 64, 16, 8192, 24
#: Queries of the sample on which recall is measured.
SAMPLE = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    fine = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).filter(
        "vec is not null and vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    dims = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.filter(F.size("vec") == (dims["d"] if dims else 0))


class Forest:
    def __init__(self, dims: int, longest: float, seed: int = 11):
        self.planes = np.random.default_rng(seed).normal(size=(TREES, dims + 1, BITS))
        self.longest = longest

    def codes(self, vecs: np.ndarray, query: bool) -> np.ndarray:
        """(trees, rows) hash strings as unsigned integers."""
        norm = np.linalg.norm(vecs, axis=1, keepdims=True)
        scale = np.maximum(norm, 1e-300) if query else self.longest
        lift = np.zeros_like(norm) if query else np.sqrt(np.maximum(1 - (norm / self.longest) ** 2, 0))
        x = np.hstack([vecs / scale, lift])
        out = np.empty((TREES, len(vecs)), np.uint64)
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for t, p in enumerate(self.planes):
            out[t] = ((x @ p > 0) * weights).sum(1, dtype=np.uint64)
        return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def prefix(codes: np.ndarray, bits: int) -> np.ndarray:
    return codes >> np.uint64(BITS - bits) if bits else np.zeros_like(codes)


def spans(sorted_codes: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the sorted array that share ``bits`` leading bits with each code."""
    if bits == 0:
        return np.zeros(len(codes), int), np.full(len(codes), len(sorted_codes))
    low = (codes >> np.uint64(BITS - bits)) << np.uint64(BITS - bits)
    high = low | np.uint64((1 << (BITS - bits)) - 1)
    return np.searchsorted(sorted_codes, low, "left"), np.searchsorted(sorted_codes, high, "right")


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products whose rounding does not depend on the place of a row, so equal vectors tie."""
    return (rows * query[None, :]).sum(axis=1)


def best(query: np.ndarray, vecs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` nearest rows, ties to smaller ids."""
    rough = vecs @ query
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        some = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        some = np.arange(len(rough))
    score = exact(query, vecs[some])
    order = np.lexsort((ids[some], -score))[:k]
    return ids[some][order], score[order]


def _dealt(df: DataFrame, forest, depth: int, query: bool, extra: list[str]) -> DataFrame:
    """One row per tree: (tree, part, code, *extra)."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    fields = {"vec_id": "long", "vec": "array<double>", "level": "int"}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = shared.value.codes(matrix(batch.column("vec")), query)
            for t in range(TREES):
                part = prefix(codes[t], depth).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(part), pa.array(codes[t].view(np.int64)), *(batch.column(c) for c in extra)],
                    names=["tree", "part", "code", *extra])

    return df.mapInArrow(run, "tree int, part long, code long, " + ", ".join(f"{c} {fields[c]}" for c in extra))


def _cells(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the number of the chunk pair: rows of a crowded part are dealt to chunks, and met by every query chunk."""
    key = ["tree", "part"]
    sizes = index.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).alias("row_chunks"))
    asked = queries.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).alias("query_chunks"))
    both = settled(sizes.join(asked, key), "cells")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = index.join(both, key).withColumn("row_chunk", deal("row_chunks")).withColumn("query_chunk", all_of("query_chunks"))
    queries = queries.join(both, key).withColumn("query_chunk", deal("query_chunks")).withColumn("row_chunk", all_of("row_chunks"))
    return index.drop("row_chunks", "query_chunks"), queries.drop("row_chunks", "query_chunks")


CELL = ["tree", "part", "row_chunk", "query_chunk"]


def _sorted_codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = rows["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes, kind="stable")
    return codes[order], order


def stop_levels(index: DataFrame, queries: DataFrame, depth: int, enough: int) -> DataFrame:
    """(vec_id, level): the longest common length at which the rows of all trees number ``enough``; null if none from ``depth`` on."""
    columns = [f"c{i}" for i in range(LEVELS)]

    def count(rows: pa.Table, asked: pa.Table) -> pa.Table:
        codes, _ = _sorted_codes(rows)
        mine = asked["code"].to_numpy().view(np.uint64)
        made = []
        for i in range(LEVELS):
            a, b = spans(codes, mine, min(depth + i, BITS))
            made.append(pa.array((b - a).astype(np.int64)))
        return pa.table([asked["vec_id"], *made], names=["vec_id", *columns])

    rows, asked = _cells(index.select("tree", "part", "code", "vec_id"), queries.select("tree", "part", "code", "vec_id"))
    counted = rows.groupBy(*CELL).cogroup(asked.groupBy(*CELL)).applyInArrow(count, "vec_id long, " + ", ".join(f"{c} long" for c in columns))
    sums = counted.groupBy("vec_id").agg(*[F.sum(c).alias(c) for c in columns])
    level = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        level = F.when(F.col(c) >= enough, F.lit(depth + i)).otherwise(level)
    if depth == 0:
        level = F.coalesce(level, F.lit(0))
    return sums.select("vec_id", level.alias("level"))


def gather(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the ``k`` best rows of every chunk among those within the query's stop level."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        codes, order = _sorted_codes(rows)
        vecs, ids = matrix(rows["vec"])[order], rows["vec_id"].to_numpy()[order]
        mine, wanted = asked["code"].to_numpy().view(np.uint64), matrix(asked["vec"])
        levels, names = asked["level"].to_numpy(), asked["vec_id"].to_numpy()
        out = [], [], []
        for level in np.unique(levels):
            for i in np.flatnonzero(levels == level):
                a, b = spans(codes, mine[i:i + 1], int(level))
                found, score = best(wanted[i], vecs[a[0]:b[0]], ids[a[0]:b[0]], k)
                for o, x in zip(out, (np.full(len(found), names[i]), found, score)):
                    o.append(x)
        joined = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64))], names=["query", "vec_id", "score"])

    rows, asked = _cells(index, queries)
    return rows.groupBy(*CELL).cogroup(asked.groupBy(*CELL)).applyInArrow(search, "query long, vec_id long, score double")


def first_ranks(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def measure(rows: DataFrame, sample: list, forest, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sampled queries: how many rows of all trees share at least x bits (sample, 65), and the lengths shared with the true ``k`` nearest."""
    ids = np.array([r["vec_id"] for r in sample])
    vecs = np.array([r["vec"] for r in sample])
    shared = rows.sparkSession.sparkContext.broadcast((forest, ids, vecs))

    def run(batches):
        forest, ids, vecs = shared.value
        mine = forest.codes(vecs, True)
        for batch in batches:
            x, names = matrix(batch.column("vec")), batch.column("vec_id").to_numpy()
            if not len(names):
                continue
            codes = forest.codes(x, False)
            for q in range(len(ids)):
                differ = codes ^ mine[:, q:q + 1]
                same = np.full(differ.shape, BITS)
                some = differ > 0
                same[some] = BITS - 1 - (np.frexp((differ[some] >> np.uint64(11)).astype(np.float64) + 0.5)[1] + 10)
                same = np.clip(same, 0, BITS)
                counts = np.bincount(same.ravel(), minlength=BITS + 1)[::-1].cumsum()[::-1]
                near, score = best(vecs[q], x, names, k + 1)
                at = np.searchsorted(np.sort(names), near)
                longest = same.max(0)[np.argsort(names)][at]
                yield pa.RecordBatch.from_pydict({"query": [int(ids[q])], "counts": [counts.tolist()], "near": [
                    [{"score": float(s), "vec_id": int(n), "bits": int(b)} for n, s, b in zip(near, score, longest)]]}, schema=pa.schema([
                        ("query", pa.int64()), ("counts", pa.list_(pa.int64())), ("near", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("bits", pa.int32())])))]))

    made = settled(rows.mapInArrow(run, "query long, counts array<long>, near array<struct<score:double,vec_id:long,bits:int>>"), "recall")
    counts = {r["query"]: r[1:] for r in made.groupBy("query").agg(*[F.sum(F.get("counts", F.lit(i))) for i in range(BITS + 1)]).collect()}
    near = made.select("query", F.explode("near").alias("n")).select("query", "n.*").filter("vec_id <> query")
    bits: dict[int, list[int]] = {}
    for r in first_ranks(near, k).collect():  # at most SAMPLE * k rows
        bits.setdefault(r["query"], []).append(r["bits"])
    names = [q for q in counts if q in bits]
    width = max((len(bits[q]) for q in names), default=0)
    return np.array([counts[q] for q in names], np.int64).reshape(len(names), BITS + 1), np.array([bits[q] + [-1] * (width - len(bits[q])) for q in names]).reshape(len(names), width)


def choose(counts: np.ndarray, bits: np.ndarray, recall: float) -> tuple[int, int]:
    """(enough, depth): the fewest rows that reach ``recall`` on the sample, and a partitioning depth that suits most stops."""
    if not len(counts):
        return 1, 0
    enough = 64
    while True:
        reach = counts >= enough
        stop = np.where(reach.any(1), BITS - reach[:, ::-1].argmax(1), 0)
        real = bits >= 0
        if (bits[real] >= np.repeat(stop, real.sum(1))).mean() >= recall or not reach.any():
            return enough, int(max(np.quantile(stop, 0.02), 0))
        enough = int(math.ceil(enough * 1.25))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row with ``is_query`` (on ``vec_id``)."""
    fine = settled(usable(vectors, id_col, vec_col), "vectors")
    shape = fine.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    forest = Forest(shape[0] or 1, math.sqrt(shape[1] or 1.0), seed)
    copies = Window.partitionBy("vec").orderBy("vec_id")
    kept = settled(fine.distinct().withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "vec"), "indexed")
    asked = fine.filter(is_query).groupBy("vec").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vec")
    asked = settled(asked, "asked")
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(SAMPLE).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    enough, depth = choose(*measure(kept, sample, forest, k), recall)
    depth = min(depth, max(int(math.log2(max(kept.count(), 1) / 64)), 0) if depth else 0)
    found, left = None, asked
    while True:
        index = _dealt(kept, forest, depth, False, ["vec_id", "vec"])
        queries = settled(_dealt(left, forest, depth, True, ["vec_id", "vec"]), "query-codes")
        levels = settled(stop_levels(index, queries, depth, enough), "levels")
        done = levels.filter("level is not null")
        hits = gather(index, queries.join(done, "vec_id"), k + 1).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        hits = settled(first_ranks(hits, k + 1), "hits")
        found = hits if found is None else found.unionByName(hits)
        if depth == 0:
            break
        left = settled(left.join(done.select("vec_id"), "vec_id", "left_anti"), "left")
        if left.isEmpty():
            break
        depth = max(depth - 2, 0)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    ids = fine.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q_vec")).distinct()
    groups = asked.join(lists, asked["vec_id"] == lists["query"]).select("vec", "near")
    own = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    out = ids.join(groups, ids["q_vec"] == groups["vec"]).select("query_id", F.posexplode(own).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
