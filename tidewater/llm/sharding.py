"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by their first id. The smallest capacity that lets ``n_shards`` contiguous
shards hold all groups is found by binary search, each candidate checked greedily along the prefix sums of the group
sizes. The prefix sums stay distributed: the driver holds a bounded grid of exact group ends, a lower greedy walk (cuts
only at known ends) and an upper one (cuts anywhere in gaps not yet resolved) bracket the capacity, and only the gaps
that can still hold a cut are resolved by the next job. Within the capacity the cuts are then evened out.

Nulls and edge cases: a null text counts as empty (size 1, checksum 0); null ids come first; equal texts, so also
repeated rows, share a shard; a group above a sixteenth of all bytes sets the capacity and the other shards share the
rest evenly; fewer groups than shards leave shards empty; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import settled

#: Rows of a block, the unit in which slots are numbered.
BLOCK_ROWS = 1024
#: Cells of one refinement, and so the most rows that a job sends to the driver.
CELLS = 8192


def with_prefix_sums(groups: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``groups`` with ``end``: the sum of ``size`` up to and including the row, in the order of ``order``."""
    spark = groups.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = settled(groups.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), f"{name}-ranged")
    totals = parts.groupBy("part").agg(F.sum(size).alias("sum"))  # as many rows as partitions
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = F.sum(size).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.join(F.broadcast(totals.select("part", before.alias("before"))), "part")
    return settled(out.withColumn("end", F.col("before") + running).drop("before", "part"), name)


class Ends:
    """Known group ends, sorted, and which gaps between them may hide further ends."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.known, self.open = groups, np.array([0, total], np.int64), np.array([True])

    def floor(self, x: int) -> int:
        return int(self.known[np.searchsorted(self.known, x, "right") - 1])

    def ceil(self, x: int) -> int:
        return int(self.known[np.searchsorted(self.known, x, "left")])

    def hopeful(self, x: int) -> int:
        """``x`` itself inside an unresolved gap, else the end before it."""
        i = int(np.searchsorted(self.known, x, "right")) - 1
        return x if i < len(self.open) and self.open[i] and self.known[i] < x else int(self.known[i])

    def refine(self, wanted: list[tuple[int, int]]) -> bool:
        """Resolves the open gaps that meet the ``wanted`` stretches further; False if there is none."""
        merged: list[list[int]] = []
        for i in np.flatnonzero(self.open):
            a, b = int(self.known[i]), int(self.known[i + 1])
            if any(a < hi and lo < b for lo, hi in wanted):
                if merged and merged[-1][1] == a:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
        if not merged:
            return False
        while len(merged) > 64:  # the closest stretches become one, so that the expression stays short
            gap = min(range(len(merged) - 1), key=lambda j: merged[j + 1][0] - merged[j][1])
            merged[gap:gap + 2] = [[merged[gap][0], merged[gap + 1][1]]]
        each, cell, inside = CELLS // len(merged), F.lit(None).cast("long"), F.lit(False)
        for j, (a, b) in enumerate(merged):
            here = (F.col("end") > a) & (F.col("end") < b)
            inside = inside | here
            cell = F.when(here, j * each + F.floor((F.col("end") - a) / ((b - a) / each)).cast("long")).otherwise(cell)
        found = self.groups.filter(inside).groupBy(cell.alias("cell")).agg(F.min("end"), F.max("end"), F.count("*")).collect()
        known, opened = {int(x): bool(o) for x, o in zip(self.known, [*self.open, False])}, set()
        for a, b in merged:
            for x in list(known):
                if a <= x < b:
                    known[x] = False
        for _, low, high, n in found:
            known[low] = n > 2
            known.setdefault(high, False)
        self.known = np.array(sorted(known), np.int64)
        self.open = np.array([known[int(x)] for x in self.known[:-1]])
        return True


def _smallest(low: int, high: int, good) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def greedy(step, capacity: int, n: int, total: int) -> list[int]:
    """Cuts of the greedy walk: each shard takes all it can hold; fewer than ``n`` cuts or a last cut below ``total`` mean failure."""
    cuts, at = [], 0
    for _ in range(n):
        to = step(min(at + capacity, total))
        if to <= at:
            break
        at = to
        cuts.append(at)
    return cuts + [at] * (n - len(cuts))


def minimax_cuts(groups: DataFrame, n: int) -> tuple[int, list[int]]:
    """(capacity, n cuts): the smallest feasible capacity over ``groups.end`` and cut positions that respect it."""
    total = groups.agg(F.max("end")).first()[0] or 0
    if total == 0:
        return 0, [0] * n
    ends = Ends(groups, total)
    ends.refine([(0, total)])
    while True:
        low = _smallest(-(-total // n), total, lambda c: greedy(ends.hopeful, c, n, total)[-1] == total)
        high = _smallest(low, total, lambda c: greedy(ends.floor, c, n, total)[-1] == total)
        if low == high or not ends.refine(list(zip(greedy(ends.floor, low, n, total), (x + 1 for x in greedy(ends.hopeful, high, n, total))))):
            break
    latest = [total] * (n + 1)  # the k-th cut may not come before latest[k], else the rest does not fit
    for k in range(n, 0, -1):
        latest[k - 1] = ends.ceil(max(latest[k] - high, 0))
    cuts, at = [], 0
    for k in range(1, n):
        target = at + (total - at) / (n - k + 1)
        near = {ends.floor(int(target)), ends.ceil(min(int(target) + 1, total)), latest[k], ends.floor(min(at + high, total))}
        at = min((x for x in near if max(latest[k], at) <= x <= at + high), key=lambda x: (abs(x - target), x))
        cuts.append(at)
    return high, [*cuts, total]


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes plus 1), text_crc32, shard and slot (gapless from 0 in every shard) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                               F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("first"))
    groups = with_prefix_sums(groups, ["first", "key"], "bytes", "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    shard_of = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    groups = groups.withColumn("shard", shard_of.cast("int"))
    counted = {r["shard"]: r["n"] for r in groups.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}
    blocks = F.array(*[F.lit(-(-counted.get(k, 0) // BLOCK_ROWS) or 1) for k in range(n_shards)])
    placed = rows.join(groups.select("key", "shard"), "key").drop("key")
    dealt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.get(blocks, F.col("shard")))
    placed = settled(placed.withColumn("block", dealt), "shard-placed")
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return placed.join(sizes, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + row - 1).cast("long").alias("slot"))
