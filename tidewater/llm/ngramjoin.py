"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its five-word shingles. Shingle hashes fall into ``GROUPS`` groups; the counts per group make
the document a point, and the sum of coordinate minima of two points bounds the overlap of their sets from above. R-trees
over the points (packed by sort-tile-recursion, corners holding coordinate maxima) are joined from the root down, a pair
of nodes goes on only while its bound can still reach the wanted overlap, and surviving pairs are verified on the sets.

Points of unrelated texts of one length are almost equally far apart, so one tree over a whole corpus prunes nothing.
Trees are therefore built per routing bucket: two sets that reach the threshold share one of their first
``n - ceil(0.8 n) + 1`` shingles in any common order, so every set is routed by these. The order puts very common shingles
last (a bounded set of hashes, chosen by count; any choice gives the same links), which keeps passages that many
documents share from making large buckets.

Equal sets are one node. Groups of near copies are first tied to pivots (a few rounds, only across components): each bucket
names a node of its largest component, and every node is compared with the pivot its buckets vote for, small ones above large ones; only pairs in buckets that still span several components reach the trees. A bucket above ``LEAF_BLOCK`` rows
is dealt to pairs of blocks. What the trees let through is verified in two waves, the ``NEAREST`` pairs of every node first:
in a group of near copies these already tie the group. No link between different sets is lost: a pair is skipped only if
both ends are already in one component. Links are followed between components, not between nodes, so that the many links
of two components count once.

Nulls and edge cases: a null, empty or blank text has the empty set, is linked with nothing and its component is its own
id; with fewer than five words the whole sequence is the one shingle; repeated ids with several texts are separate
nodes; null ids sort first; repeated rows and equal texts share a node; empty tables give no rows; further columns are
ignored by ``join`` and carried along by ``keep_first``. Sets and shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, keyed, picked, settled
from tidewater.llm.words import NOT_BLANK, Batch, mix, shingles, slices

GROUPS, LEAF, LEAF_BLOCK, STAR_ROUNDS = 256, 16, 256, 4
#: A shingle in this many sets counts as common, as long as at most COMMON_MOST of them do (16 MB to broadcast).
COMMON, COMMON_MOST = 3, 1 << 21
#: Rows of an Arrow batch: whole sets and points of two nodes are in every row of a pair.
BATCH_ROWS = 500
#: Hashes that a task gathers before it hands them on.
GATHER = 250_000
#: Pairs of a node that the trees have verified first, by how far their bound exceeds the required overlap.
NEAREST = 4
_U = np.uint64


def required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest overlap with which sets of ``n`` and ``m`` elements reach a Jaccard similarity of 0.8."""
    return (4 * (n + m) + 8) // 9


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def node_of(s: np.ndarray) -> int:
    """Identity of a set: a sum over its elements, so that it does not depend on their order."""
    total = mix(s ^ _U(0x5BD1E995)).sum(dtype=np.uint64) + _U(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(column: pa.Array):
    """(row, sorted set) of every row of a text column, in slices of bounded size."""
    for i, j in slices(column):
        yield from zip(range(i, j), shingles(Batch(column.slice(i, j - i), NOT_BLANK)))


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, node, counts) of keyed documents; ``counts`` are GROUPS 4-byte integers."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, node, counts = [], [], []
            for _, s in _sets(batch.column(1)):
                n.append(len(s))
                node.append(node_of(s))
                counts.append(np.bincount((s >> _U(56)).astype(np.int64), minlength=GROUPS).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "text_key", "n", "node", "counts"])

    return docs.mapInArrow(run, f"doc_id {id_type}, text_key long, n long, node long, counts binary")


def common_shingles(docs: DataFrame, ranges: int) -> np.ndarray:
    """Sorted 40-bit heads of shingles that many sets have among the lower part of their hashes."""
    bits = int(ranges).bit_length() - 1

    def parts(flat):
        values = np.sort(np.concatenate(flat) >> _U(24))
        edges = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) << _U(40 - bits))
        some = [r for r in range(ranges) if edges[r] < edges[r + 1]]
        low = (values & _U((1 << (40 - bits)) - 1)).astype(np.uint32 if bits >= 8 else np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([low[edges[r]:edges[r + 1]].tobytes() for r in some], pa.binary())], names=["range", "heads"])

    def emit(batches):
        flat, size, seen = [], 0, set()
        for batch in batches:
            for _, s in _sets(batch.column(1)):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    flat.append(s[:2 * prefix_length(len(s)) + 8].copy())  # else the whole set is kept
                    size += len(flat[-1])
                    if size > GATHER:
                        yield parts(flat)
                        flat, size = [], 0
                        seen = set() if len(seen) > 500_000 else seen
        if flat:
            yield parts(flat)

    def count(key, batches):
        kind = np.uint32 if bits >= 8 else np.uint64
        flat = [np.frombuffer(x.as_py(), kind) for b in batches for x in b.column(1)]
        heads, n = np.unique(np.concatenate(flat), return_counts=True)
        some = n >= COMMON
        heads = heads[some].astype(np.int64) | (key[0].as_py() << (40 - bits))
        yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(n[some])], names=["head", "n"])

    def whole(key, rows):
        return pa.Table.from_batches(count(key, rows.to_batches()))

    found = settled(docs.mapInArrow(emit, "range long, heads binary").groupBy("range").applyInArrow(whole, "head long, n long"), "common")
    sizes = sorted(found.groupBy(F.floor(F.log2("n")).alias("e")).count().collect(), key=lambda r: -r["e"])
    least, total = None, 0
    for r in sizes:  # the most frequent ones first, as many as may be broadcast
        total += r["count"]
        if total > COMMON_MOST:
            break
        least = max(2 ** r["e"], COMMON)
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(found.filter(F.col("n") >= least).select("head").toArrow()["head"].to_numpy().view(np.uint64))


def routes(docs: DataFrame, common: np.ndarray, ranges: int) -> DataFrame:
    """(shingle, node): routing shingles that at least two nodes have, common ones always."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    bits = int(ranges).bit_length() - 1

    def emit(batches):
        common = shared.value

        def rare_parts(rare, owners):
            h, node = np.concatenate(rare), np.concatenate(owners)
            order = np.argsort(h)
            h, node = h[order], node[order]
            edges = np.searchsorted(h >> _U(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                a, b = edges[r], edges[r + 1]
                if a < b:
                    yield r, h[a:b].tobytes(), node[a:b].tobytes()

        def batch_of(rows, often, often_nodes):
            rows = list(rows)
            n = len(rows)
            h = np.concatenate(often).view(np.int64) if often else np.zeros(0, np.int64)
            owner = np.concatenate(often_nodes) if often_nodes else np.zeros(0, np.int64)
            nothing = [None] * n
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows] + [None] * len(h), pa.int64()), pa.array([r[1] for r in rows] + [None] * len(h), pa.binary()),
                pa.array([r[2] for r in rows] + [None] * len(h), pa.binary()), pa.concat_arrays([pa.array(nothing, pa.int64()), pa.array(h)]),
                pa.concat_arrays([pa.array(nothing, pa.int64()), pa.array(owner)])], names=["range", "hashes", "nodes", "shingle", "node"])

        rare, owners, often, often_nodes, size, seen = [], [], [], [], 0, set()
        for batch in batches:
            for _, s in _sets(batch.column(1)):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(s))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s >> _U(24)), len(common) - 1)
                    is_common = common[at] == s >> _U(24)
                    low = s[~is_common][:p]
                    high = s[is_common][:p - len(low)]
                else:
                    low, high = s[:p], s[:0]
                rare.append(low.copy())
                owners.append(np.full(len(low), node, np.int64))
                if len(high):
                    often.append(high.copy())
                    often_nodes.append(np.full(len(high), node, np.int64))
                size += p
                if size > GATHER:
                    yield batch_of(rare_parts(rare, owners), often, often_nodes)
                    rare, owners, often, often_nodes, size = [], [], [], [], 0
                    seen = set() if len(seen) > 500_000 else seen
        if rare:
            yield batch_of(rare_parts(rare, owners), often, often_nodes)

    def meet(rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows["hashes"]])
        node = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows["nodes"]])
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node = h[new], node[new]
        same = h[1:] == h[:-1]
        some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        return pa.table([pa.array(h[some].view(np.int64)), pa.array(node[some])], names=["shingle", "node"])

    made = settled(docs.mapInArrow(emit, "range long, hashes binary, nodes binary, shingle long, node long"), "routes")
    rare = made.filter("range is not null").select("range", "hashes", "nodes").groupBy("range").applyInArrow(meet, "shingle long, node long")
    often = made.filter("range is null").select("shingle", "node").distinct()
    out = settled(rare.unionByName(often), "members")
    drop_written(docs.sparkSession, made)
    return out


def distinct_buckets(members: DataFrame) -> DataFrame:
    """One shingle of all that route the same nodes, and none that routes a single node."""
    spans = members.groupBy("shingle").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = settled(spans.filter("size > 1").groupBy("size", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle"), "buckets")
    out = settled(members.join(kept, "shingle").select("shingle", "node"), "members")
    drop_written(members.sparkSession, members)
    return out


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements): packed sorted sets of ``nodes`` (node, doc_id, text_key), one row per node."""
    wanted = picked(settled(nodes.select("node", F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key")), "wanted"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["n_id"]) & (docs["text_key"] == wanted["n_key"])).select("node", "text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in _sets(batch.column(1))], pa.binary())], names=["node", "elements"])

    return texts.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), GROUPS)


def within_bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and summed coordinate minima allow the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("counts").alias("ac"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("counts").alias("bc"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                n, m = t.column("an").to_numpy(), t.column("bn").to_numpy()
                bound = np.minimum(matrix(t.column("ac")), matrix(t.column("bc"))).sum(1)
                yield t.select(["a", "b"]).filter(pa.array(bound >= required(n, m)))

    sized = pairs.join(left, "a").join(right, "b").filter("5 * an >= 4 * bn and 5 * bn >= 4 * an")
    return sized.select("a", "b", "an", "bn", "ac", "bc").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""

    def run(batches):
        for t in batches:
            good = []
            for x, y in zip(t.column("x"), t.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    asked = settled(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    sets = sets.join(picked(asked), "node", "left_semi")
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, by neighbour minima and pointer jumping."""
    spark = links.sparkSession
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hop = labels.select(F.col("node").alias("h"), F.col("label").alias("hl"))
        nxt = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        nxt = nxt.join(hop, nxt["label"] == hop["h"]).select("node", "old", F.least("label", "hl").alias("label"))
        nxt = settled(nxt, "labels")
        moving = not nxt.filter("old <> label").isEmpty()
        drop_written(spark, labels)
        labels = nxt.drop("old")
        if not moving:
            return labels


def tied(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after ``links``: what they tie are components, so many links between the same two count once."""
    spark = links.sparkSession
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        ends = ends.join(known, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    ends = ends.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).filter("a <> b").distinct()
    moved = components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = labels.select("node", "label").unionByName(moved.select(F.col("label").alias("node"), "label")).distinct()
    out = settled(every.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "tied")
    drop_written(spark, labels, moved)
    return out


def pack(vecs: np.ndarray, rows: np.ndarray, dim: int = 0) -> list[np.ndarray]:
    """Sort-tile-recursion: leaves of at most LEAF rows that are close in their coordinates."""
    if len(rows) <= LEAF:
        return [rows]
    spread = vecs[rows].max(0) - vecs[rows].min(0)
    order = rows[np.argsort(vecs[rows, int(spread.argmax())], kind="stable")]
    half = (len(order) // 2 + LEAF - 1) // LEAF * LEAF
    half = min(max(half, 1), len(order) - 1)
    return pack(vecs, order[:half], dim + 1) + pack(vecs, order[half:], dim + 1)


def tree(vecs: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
    """Levels from the leaves up; a node is (corner of maxima, smallest size, largest size, children or rows)."""
    level = [(vecs[r].max(0), sizes[r].min(), sizes[r].max(), r) for r in pack(vecs, rows)]
    leaf = True
    while len(level) > 1:
        level = [(np.max([c[0] for c in some], axis=0), min(c[1] for c in some), max(c[2] for c in some), (leaf, some))
                 for some in (level[i:i + 8] for i in range(0, len(level), 8))]
        leaf = False
    return (leaf, level[0])


def tree_join(vecs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of rows of different labels whose bound reaches the required overlap; ``right`` None joins ``left`` with itself."""
    a = tree(vecs, sizes, left)
    b = a if right is None else tree(vecs, sizes, right)
    out, todo = [], [(a, b)]
    while todo:
        (x_leaf, x), (y_leaf, y) = todo.pop()
        if 5 * x[2] < 4 * y[1] or 5 * y[2] < 4 * x[1] or np.minimum(x[0], y[0]).sum() < required(x[1], y[1]):
            continue
        if x_leaf and y_leaf:
            p, q = x[3], y[3]
            bound = np.minimum(vecs[p][:, None, :], vecs[q][None, :, :]).sum(2)
            fits = (bound >= required(sizes[p][:, None], sizes[q][None, :])) & (labels[p][:, None] != labels[q][None, :])
            out += [(int(p[i]), int(q[j])) for i, j in np.argwhere(fits) if x is not y or i < j]
        elif y_leaf or not x_leaf:
            kids = [(x[3][0], c) for c in x[3][1]]
            if x is y:
                todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            else:
                todo += [(k, (y_leaf, y)) for k in kids]
        else:
            todo += [((x_leaf, x), (y[3][0], c)) for c in y[3][1]]
    return out


def ranked(x: np.ndarray, y: np.ndarray, vecs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of every pair of rows (x, y) among the pairs of either end, the better one; the largest bound for its size first."""
    slack = np.empty(len(x))
    for i in range(0, len(x), 4096):
        p, q = x[i:i + 4096], y[i:i + 4096]
        slack[i:i + 4096] = np.minimum(vecs[p], vecs[q]).sum(1) / required(sizes[p], sizes[q])
    place = np.full(len(x), len(x), np.int64)
    for end in (x, y):
        order = np.lexsort((-slack, end))
        first = np.searchsorted(end[order], end[order])
        place[order] = np.minimum(place[order], np.arange(len(x)) - first)
    return place


def tree_candidates(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, place) that the trees of all buckets let through; members: (shingle, node, label).

    A pair that shares several buckets comes from the first of them only, so near copies do not repeat it per bucket.
    """
    routed = members.groupBy("node").agg(F.sort_array(F.collect_set("shingle")).alias("routed"))  # at most a fifth of its set
    sizes = members.groupBy("shingle").agg(F.ceil(F.count("*") / LEAF_BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "shingle").join(nodes.select("node", "n", "counts").join(routed, "node"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "counts", "routed")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")

    def bucket(t: pa.Table):
        if len(t) < 2:
            return []
        own, node = t["own"].to_numpy(), t["node"].to_numpy()
        vecs, sizes, labels = matrix(t["counts"]), t["n"].to_numpy(), t["label"].to_numpy()
        first = t["i"][0].as_py()
        if t["j"][0].as_py() == first:
            found = tree_join(vecs, sizes, labels, np.arange(len(t)), None)
        else:
            left, right = np.flatnonzero(own == first), np.flatnonzero(own != first)
            found = tree_join(vecs, sizes, labels, left, right) if len(left) and len(right) else []
        here, routed = t["shingle"][0].as_py(), [np.array(x, np.int64) for x in t["routed"].to_pylist()] if found else []
        found = [(x, y) for x, y in found if np.intersect1d(routed[x], routed[y], assume_unique=True)[0] == here]
        if not found:
            return []
        x, y = np.array(found, np.int64).T
        return zip(np.minimum(node[x], node[y]).tolist(), np.maximum(node[x], node[y]).tolist(), ranked(x, y, vecs, sizes).tolist())

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            keys = [t[c].to_numpy() for c in ("shingle", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *cuts.tolist()]
            held = t.slice(edges[-1])
            yield from emit(t, edges)
        if held is not None and len(held):
            yield from emit(held, [0, len(held)])

    def emit(t, edges):
        pairs = {p for a, b in zip(edges[:-1], edges[1:]) for p in bucket(t.slice(a, b - a))}
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b", "place"])

    return rows.mapInArrow(run, "a long, b long, place long").groupBy("a", "b").agg(F.min("place").alias("place"))


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if labels is None:
        return pairs
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return pairs.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).drop("a_label", "b_label")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that span several components, with their labels."""
    if labels is None:
        rows = members.withColumn("label", F.col("node"))
    else:
        rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    span = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    return rows.join(span.select("shingle"), "shingle").select("shingle", "node", "label")


def bucket_pivots(open_: DataFrame, round_: int) -> DataFrame:
    """(shingle, size, p_label, p_node): of each bucket a node of its largest component, another one in every round."""
    parts = open_.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node")).alias("p"))
    best = parts.groupBy("shingle").agg(F.sum("n").alias("size"), F.max(F.struct("n", F.xxhash64("label", F.lit(round_)).alias("h"), "label", F.col("p.node").alias("node"))).alias("b"))
    return best.select("shingle", "size", F.col("b.label").alias("p_label"), F.col("b.node").alias("p_node"))


def one_pivot(asked: DataFrame) -> DataFrame:
    """(a, b): every node with one pivot, so a round has no more pairs than nodes.

    A bucket's vote counts the less the more nodes it has: what many documents share says little about any two of them.
    """
    votes = asked.groupBy("node", "p_node").agg(F.sum(1 / F.col("size")).alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct("n", "p_node")).alias("best")).select("node", F.col("best.p_node").alias("p_node"))
    return best.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame | None, int]:
    """Labels after those of ``pairs`` that reach the threshold, and how many do."""
    found = settled(verified(pairs, sets), "links")
    new = found.count()
    if new:
        labels = tied(labels, found)
    drop_written(pairs.sparkSession, found)
    return labels, new


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n (set size), node, component (smallest linked node; null without words) and component_id of every row."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        return _joined(spark, keyed(docs, id_col, text_col))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _joined(spark, source: DataFrame) -> DataFrame:
    base = settled(points(source), "points")
    nodes = settled(base.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n"), F.first("counts").alias("counts"))
                    .select("node", "first.*", "n", "counts"), "nodes")
    elements = nodes.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(8, int(elements // 1_000_000).bit_length())
    members = distinct_buckets(routes(source, common_shingles(source, ranges), ranges))
    sets = settled(shingle_sets(source, nodes.join(members.select("node").distinct(), "node", "left_semi")), "sets")
    labels, round_, total = None, 0, 0
    while round_ <= STAR_ROUNDS:
        open_ = settled(labelled(members, labels), "open")
        if open_.isEmpty():
            break
        if round_ < STAR_ROUNDS:
            pivots = bucket_pivots(open_, round_)
            pairs = one_pivot(open_.join(pivots, "shingle").filter("label <> p_label"))
            pairs = within_bound(pairs, nodes)
        else:
            pairs = tree_candidates(open_, nodes)
        pairs = settled(pairs, "pairs")
        drop_written(spark, open_)
        if round_ < STAR_ROUNDS:
            labels, new = linked(pairs, sets, labels)
        else:
            labels, _ = linked(pairs.filter(F.col("place") < NEAREST), sets, labels)
            rest = settled(apart(pairs.filter(F.col("place") >= NEAREST), labels), "pairs")
            labels, new = linked(rest, sets, labels)
            drop_written(spark, rest)
        drop_written(spark, pairs)
        total += new
        if round_ < STAR_ROUNDS and new * 20 < total + 1:
            round_ = STAR_ROUNDS - 1  # further pivots will hardly help: to the trees
        round_ += 1
    named = nodes.select("node", "doc_id")
    if labels is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("component"))
    named = settled(named, "named")
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = settled(named.join(firsts, "component").select("node", "component", "component_id"), "components")
    drop_written(spark, sets)
    filled = base.filter("n > 0").join(named, "node").select("doc_id", "text_key", "n", "node", "component", "component_id")
    blank = base.filter("n = 0").select("doc_id", "text_key", "n", "node", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(blank)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component (smallest id, then text hash); rows without words all stay."""
    joined = settled(join(docs, id_col, text_col), "joined")
    kept = joined.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    text = docs[text_col].cast("string")
    key = F.xxhash64(text)
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    blank = F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""
    stays = docs.filter(~blank).join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")) & (key == F.col("_kept_key")))
    return stays.dropDuplicates(["_kept_id", "_kept_key"]).select(*[docs[c] for c in docs.columns]).unionByName(docs.filter(blank))
