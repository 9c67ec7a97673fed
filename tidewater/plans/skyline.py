"""Points no other point dominates, over any number of objectives (all maximised), without comparing all pairs.

Every objective is cut at a few quantiles, which gives a grid of cells. A cell is dropped whole if another occupied cell lies
beyond it in every objective; that is decided on the list of occupied cells, whose number is bounded. The points of the
other cells are reduced to the skyline of each task, and each cell is then compared only with cells that are not worse in
any objective, a block of points at a time, while the points it is compared with stream past.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.timeline import join_keys
from tidewater.session import settle

#: Cells of the grid, at most; points of a cell that are compared together.
CELLS, BLOCK = 4096, 4096


def undominated(points: np.ndarray, strict: bool) -> np.ndarray:
    """Mask of the rows that no other row dominates; ``strict``: a dominator is better everywhere."""
    keep = np.ones(len(points), bool)
    for i in np.argsort(-points.sum(1), kind="stable"):
        if keep[i]:
            some = np.flatnonzero(keep)
            keep[some[dominated_by(points[some], points[i], strict)]] = False
    return keep


def dominated_by(points: np.ndarray, other: np.ndarray, strict: bool) -> np.ndarray:
    if strict:
        return (other > points).all(1)
    return (other >= points).all(1) & (other > points).any(1)


def open_cells(cells: np.ndarray, cuts: int) -> np.ndarray:
    """Mask of the occupied cells that no occupied cell beats in every coordinate."""
    k = cells.shape[1]
    grid = np.zeros((cuts + 2,) * k, bool)
    grid[tuple(cells.T)] = True
    for axis in range(k):  # occupied at or beyond, along every axis
        grid = np.flip(np.logical_or.accumulate(np.flip(grid, axis), axis=axis), axis)
    return ~grid[tuple(cells.T + 1)]


def _matrix(batch, cols) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(np.float64)


def skyline(cands: DataFrame, objectives: list[str], strict: bool = True) -> DataFrame:
    """The rows of ``cands`` on the front; rows with a NULL objective are never on it, equal rows stay together."""
    k = len(objectives)
    cuts = max(1, int(CELLS ** (1 / k)) - 1)
    names = [f"__o{i}" for i in range(k)]
    points = cands.select(*[F.col(o).cast("double").alias(n) for o, n in zip(objectives, names)]).na.drop().distinct()
    points = settle(points, "points")
    at = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = points.agg(*[F.percentile_approx(n, at, 1000).alias(n) for n in names]).first()
    if found[0] is None:
        return cands.limit(0)
    edges = [sorted(set(c)) for c in found]

    def index(name, values):
        return F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: v <= F.col(name)))

    cell = F.array(*[index(n, e) for n, e in zip(names, edges)])
    placed = points.withColumn("__cell", cell)
    occupied = np.array([r[0] for r in placed.select("__cell").distinct().collect()])  # CELLS at most
    live = occupied[open_cells(occupied, cuts)]
    code = F.aggregate("__cell", F.lit(0).cast("long"), lambda s, x: s * (cuts + 1) + x)
    number = lambda c: int(np.ravel_multi_index(c, (cuts + 1,) * k))
    placed = placed.withColumn("__c", code).where(F.col("__c").isin([number(c) for c in live]))

    def local(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n > 8 * BLOCK:
                held, n = [reduced(held)], 0
        if held:
            yield reduced(held)

    def reduced(held):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return t.filter(pa.array(undominated(_matrix(t, names), strict)))

    schema = ", ".join(f"{n} double" for n in names) + ", __c long"
    rows = settle(placed.select(*names, "__c").mapInArrow(local, schema), "local")
    sizes = {r["__c"]: r["n"] for r in rows.groupBy("__c").agg(F.count(F.lit(1)).alias("n")).collect()}
    live = live[[number(c) in sizes for c in live]]
    # a cell meets the cells that are nowhere worse; beating it everywhere is no longer possible
    meets = [(number(x), number(y)) for x in live for y in live[(live >= x).all(1)]]
    pairs = cands.sparkSession.createDataFrame([(b, a, s) for a, b in meets for s in range(-(-sizes[a] // BLOCK))], "__c long, __a long, __s int")
    blocks = rows.select(*names, F.col("__c").alias("__a"), F.pmod(F.xxhash64(*names), F.lit(1 << 30)).alias("__h"))
    count = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, -(-n // BLOCK))]) if sizes else None
    blocks = blocks.withColumn("__s", (F.col("__h") % count[F.col("__a")]).cast("int")).select(*names, "__a", "__s", F.lit(0).alias("__kind"))
    others = rows.join(F.broadcast(pairs), "__c").select(*names, "__a", "__s", F.lit(1).alias("__kind"))  # CELLS squared rows at most
    n = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = blocks.unionByName(others).repartition(n, "__a", "__s").sortWithinPartitions("__a", "__s", "__kind")

    def merge(batches):
        now, own = None, None
        for batch in batches:
            a, s, kind = (batch.column(c).to_numpy() for c in ("__a", "__s", "__kind"))
            edge = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(batch)]
            for i, j in zip(edge[:-1], edge[1:]):
                if i == j:
                    continue
                part = _matrix(batch.slice(i, j - i), names)
                if (a[i], s[i]) != now:
                    if own is not None:
                        yield out(own)
                    now, own = (a[i], s[i]), np.zeros((0, k))
                if kind[i] == 0:
                    own = np.concatenate((own, part))
                else:
                    for other in part[undominated(part, strict)]:
                        own = own[~dominated_by(own, other, strict)]
        if own is not None:
            yield out(own)

    def out(own):
        return pa.RecordBatch.from_arrays([pa.array(own[:, i]) for i in range(k)], names=names)

    front = settle(both.mapInArrow(merge, ", ".join(f"{n} double" for n in names)), "front")
    keyed = cands.withColumns({n: F.col(o).cast("double") for o, n in zip(objectives, names)})
    return join_keys(keyed, front.withColumn("__on", F.lit(True)), names).drop("__on", *names)


def fronts(cands: DataFrame, objectives: list[str], most: int, strict: bool = False) -> DataFrame:
    """The first ``most`` fronts with their ``rank`` (from 0), peeled one after the other."""
    left, found = settle(cands, "peel"), []
    for rank in range(most):
        front = settle(skyline(left, objectives, strict).withColumn("rank", F.lit(rank)), "front")
        found.append(front)
        if rank + 1 < most:
            values = front.select(*objectives).distinct()
            same = None
            for o in objectives:
                same = left[o].eqNullSafe(values[o]) if same is None else same & left[o].eqNullSafe(values[o])
            left = settle(left.join(values, same, "left_anti"), "peel")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dominated_share(front: DataFrame, objectives: list[str], samples: DataFrame) -> DataFrame:
    """(share): the share of ``samples`` (id and one column per objective, bounded) that a front point is at least as good as everywhere."""
    sample = samples.select("id", *objectives).toPandas()  # the number of samples is a parameter
    shared = front.sparkSession.sparkContext.broadcast((sample["id"].to_numpy(), sample[objectives].to_numpy(float)))

    def run(batches):
        ids, free = shared.value
        for batch in batches:
            part = _matrix(batch, objectives)
            hit = np.zeros(len(free), bool)
            for p in part[undominated(part, False)]:
                hit |= (p >= free).all(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit])], names=["id"])
            ids, free = ids[~hit], free[~hit]

    hits = front.select(*[F.col(o).cast("double").alias(o) for o in objectives]).mapInArrow(run, "id long").distinct()
    return hits.agg((F.count(F.lit(1)) / F.lit(float(max(len(sample), 1)))).alias("share"))
