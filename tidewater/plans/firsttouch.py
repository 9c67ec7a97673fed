"""First row of an ordered series that meets a condition, for many starting points, without joining them to the rows between.

A row has two values ``a`` and ``b``. A search that starts behind a row asks for the first later row with ``a <= fa`` or
``b <= fb``, or whose place ``at`` lies beyond ``until``. With ``trail`` 1 (or 2) the bound ``fa`` (``fb``) rises to the
largest ``top_a`` (``top_b``) of the rows passed so far, which is a trailing stop.

All of this folds: a block of rows is met by a search exactly if its smallest ``a`` is below the bound on entering, or if
a row inside falls below the top of an earlier row inside, whatever the bound on entering. So each chunk of the series
becomes a binary tree of such folds; a search climbs to the first block that is met and descends to the row. Searches
that leave their chunk go on over the folds of whole chunks, which are a far shorter series of the same kind, and then
enter the one chunk that meets them. Work and shuffled rows follow the number of searches and rows, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.timeline import CHUNK_ROWS, CHUNK_SETTING, lay_out
from tidewater.session import settle

#: Place of the row that ends every series; no search goes beyond it.
END = 1 << 62
_STEP = ["last_at", "a", "b", "top_a", "top_b", "in_a", "in_b"]
_SEARCH = ["until", "fa", "fb", "trail"]


@dataclass
class Level:
    last: np.ndarray
    a: np.ndarray
    b: np.ndarray
    top_a: np.ndarray
    top_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def folded(self) -> Level:
        """The level above: every two neighbours as one block."""
        x, y = [Level(*(v[i::2] for v in vars(self).values())) for i in (0, 1)]
        return Level(
            np.maximum(x.last, y.last), np.minimum(x.a, y.a), np.minimum(x.b, y.b), np.maximum(x.top_a, y.top_a), np.maximum(x.top_b, y.top_b),
            x.in_a | y.in_a | (y.a <= x.top_a), x.in_b | y.in_b | (y.b <= x.top_b))


@dataclass
class Searches:
    until: np.ndarray
    fa: np.ndarray
    fb: np.ndarray
    trail: np.ndarray

    def meets(self, level: Level, some: np.ndarray, at: np.ndarray) -> np.ndarray:
        trail = self.trail[some]
        return ((level.a[at] <= self.fa[some]) | (level.b[at] <= self.fb[some]) | (level.last[at] > self.until[some])
                | (level.in_a[at] & (trail == 1)) | (level.in_b[at] & (trail == 2)))

    def passes(self, level: Level, some: np.ndarray, at: np.ndarray) -> None:
        trail = self.trail[some]
        self.fa[some] = np.where(trail == 1, np.maximum(self.fa[some], level.top_a[at]), self.fa[some])
        self.fb[some] = np.where(trail == 2, np.maximum(self.fb[some], level.top_b[at]), self.fb[some])


def build(rows: Level) -> list[Level]:
    """Levels from the rows up to one block, padded by rows that meet nothing and change nothing."""
    n = len(rows.a)
    pad = (1 << max(n - 1, 0).bit_length()) - n
    fill = [np.iinfo(np.int64).min, np.inf, np.inf, -np.inf, -np.inf, False, False]
    levels = [Level(*(np.concatenate((v, np.full(pad, f, v.dtype))) for v, f in zip(vars(rows).values(), fill)))]
    while len(levels[-1].a) > 1:
        levels.append(levels[-1].folded())
    return levels


def search(levels: list[Level], start: np.ndarray, asked: Searches) -> np.ndarray:
    """Row that meets each search from ``start`` on, -1 for none; raises the bounds of trailing searches on the way."""
    at, height = start.copy(), np.full(len(start), -1)
    live = np.flatnonzero(at < len(levels[0].a))
    for k, level in enumerate(levels):
        live = live[at[live] < len(level.a)]
        tried = live if k == len(levels) - 1 else live[at[live] & 1 == 1]  # an even block goes up with its neighbour
        met = asked.meets(level, tried, at[tried])
        height[tried[met]] = k
        missed = tried[~met]
        asked.passes(level, missed, at[missed])
        at[missed] += 1
        live = live[height[live] < 0]
        at[live] >>= 1
    for k in range(len(levels) - 1, 0, -1):
        some = np.flatnonzero(height == k)
        left = at[some] * 2
        met = asked.meets(levels[k - 1], some, left)
        asked.passes(levels[k - 1], some[~met], left[~met])
        at[some] = np.where(met, left, left + 1)
        height[some] = k - 1
    return np.where(height == 0, at, -1)


def first_met(searches: DataFrame, steps: DataFrame, key: str, slice_width: int) -> DataFrame:
    """The first step after each search that meets it.

    ``steps``: key, at, a, b, bar (struct), optionally top_a and top_b. ``searches``: key, at, until, fa, fb, trail, e (struct).
    Returns key, e, fa and fb on meeting, ``met_at``, ``bar`` (the step), ``seen`` (the last step passed, NULL if none) and
    ``chunk``; every series ends with a step at ``END`` whose bar is NULL. A key without steps gives no rows.
    """
    steps = steps.withColumns({c: F.lit(None).cast("double") for c in ("top_a", "top_b") if c not in steps.columns})
    steps = steps.withColumns({"last_at": F.col("at"), "in_a": F.lit(False), "in_b": F.lit(False)})
    ends = steps.select(key).distinct().withColumns({"at": F.lit(END), "last_at": F.lit(END)})
    searches = searches.withColumn("seen", F.lit(None).cast(steps.schema["bar"].dataType))
    return _walk(searches, steps.unionByName(ends, allowMissingColumns=True), key, slice_width)


def _walk(searches: DataFrame, steps: DataFrame, key: str, slice_width: int) -> DataFrame:
    """Chunks of equally many steps; a search belongs to the chunk of the step after it, however many searches there are."""
    asked = searches.withColumn("kind", F.lit(1))
    both = steps.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    size = int(both.sparkSession.conf.get(CHUNK_SETTING, str(CHUNK_ROWS)))
    tl = lay_out(both, key, ["at", "kind"], F.floor(F.col("at") / F.lit(slice_width)))
    tl = tl.running(__steps=("count", F.when(F.col("kind") == 0, 1)))
    before = F.coalesce(F.col("__steps"), F.lit(0)) - F.when(F.col("kind") == 0, 1).otherwise(0)
    rows = settle(tl.add(chunk=F.floor(before / size)).rows().drop("__steps"), "first-touch")
    return _finish(rows.where("kind = 1").drop("kind", *_STEP, "bar"), rows.where("kind = 0").drop(*_SEARCH, "e", "seen"), key)


def _finish(searches: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Searches with a chunk: first inside it, then over the folds of later chunks, then inside the chunk that is met."""
    out = settle(_within(searches, chunks, key), "first-touch")
    found = out.where("kind = 1")
    left = out.where("kind = 2")
    if not left.isEmpty():
        folds = out.where("kind = 0").select(key, F.col("chunk").alias("at"), *_STEP, "bar")
        asked = left.select(key, F.col("chunk").alias("at"), *_SEARCH, "e", "seen")
        inner = _walk(asked, folds, key, 100_000).select(key, F.col("met_at").alias("chunk"), F.lit(-END).alias("at"), *_SEARCH, "e", "seen")
        inner = settle(inner, "first-touch")
        wanted = settle(inner.select(key, "chunk").distinct(), "wanted")
        held = chunks.join(wanted.select(F.col(key).alias("__k"), F.col("chunk").alias("__c")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("chunk") == F.col("__c")), "left_semi")
        found = found.unionByName(_within(inner, held, key).where("kind = 1"))
    return found.select(key, "chunk", "met_at", *_SEARCH, "e", "bar", "seen")


def _within(searches: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One pass over chunks: kind 0 is the fold of a chunk, 1 a search that is met, 2 one that leaves its chunk, 3 one of a key without steps."""
    rows = chunks.withColumn("kind", F.lit(0)).unionByName(searches.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    bar, e = rows.schema["bar"].dataType, rows.schema["e"].dataType
    schema = T.StructType([
        rows.schema[key], T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("met_at", T.LongType()),
        T.StructField("last_at", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in _STEP[1:5]), *(T.StructField(c, T.BooleanType()) for c in _STEP[5:]),
        T.StructField("until", T.LongType()), T.StructField("fa", T.DoubleType()), T.StructField("fb", T.DoubleType()), T.StructField("trail", T.IntegerType()),
        T.StructField("e", e), T.StructField("bar", bar), T.StructField("seen", bar)])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(key, "chunk", "kind", "at", *_STEP, *_SEARCH, "e", "bar", "seen").repartition(n, key, "chunk").sortWithinPartitions(key, "chunk", "kind", "at")

    def numbers(batch, name, empty):
        return batch.column(name).fill_null(empty).to_numpy(zero_copy_only=False)

    def level(t) -> Level:
        return Level(*(numbers(t, c, x) for c, x in zip(_STEP, [0, np.inf, np.inf, -np.inf, -np.inf, False, False])))

    def made(like, arrow, **cols):
        """A batch of ``like`` rows: the given columns, all others NULL."""
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(like, f.type)).cast(f.type) for f in arrow], schema=arrow)

    def run(batches):
        arrow = now = held = None
        group: list = []

        def ready():
            bars = pa.Table.from_batches(group).combine_chunks() if group else None
            at = bars.column("at").to_numpy() if bars else np.zeros(0, np.int64)
            return bars, at, build(level(bars)) if bars else []

        def fold(bars, levels):
            top, last = levels[-1], bars.slice(len(bars) - 1)
            cols = {c: pa.array(v) for c, v in zip(_STEP, vars(top).values())}
            return made(1, arrow, **{key: pa.array([now[0]], arrow.field(key).type), "chunk": pa.array([now[1]]), "kind": pa.array([0]), "bar": last.column("bar").combine_chunks(), **cols})

        def answer(part, bars, at, levels):
            asked = Searches(numbers(part, "until", END), numbers(part, "fa", -np.inf).copy(), numbers(part, "fb", -np.inf).copy(), numbers(part, "trail", 0))
            start = np.searchsorted(at, part.column("at").to_numpy(), "right")
            row = search(levels, start, asked) if levels else np.full(len(part), -1)
            met = row >= 0
            passed = np.where(met, row, len(at)) - 1  # the step before the one that is met
            seen = part.column("seen")
            if bars is not None:
                pool = pa.concat_arrays([bars.column("bar").combine_chunks(), seen])
                seen = pool.take(pa.array(np.where(passed >= start, passed, len(at) + np.arange(len(part)))))
            found = bars.column("bar").combine_chunks().take(pa.array(np.maximum(row, 0), mask=~met)) if bars is not None else pa.nulls(len(part), seen.type)
            met_at = pa.array(at[np.maximum(row, 0)] if len(at) else np.zeros(len(part), np.int64), mask=~met)
            return made(len(part), arrow, **{key: part.column(key)}, chunk=part.column("chunk"), kind=pa.array(np.where(met, 1, 2 if levels else 3), pa.int32()), met_at=met_at,
                        until=part.column("until"), fa=pa.array(asked.fa), fb=pa.array(asked.fb), trail=part.column("trail"), e=part.column("e"), bar=found, seen=seen)

        for batch in batches:
            if not len(batch):
                continue
            if arrow is None:
                types = {f.name: f.type for f in batch.schema}
                arrow = pa.schema([(f.name, types.get(f.name, pa.int64())) for f in schema])
            keys, chunk, kind = batch.column(key), batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:]):
                ident = (keys[a].as_py(), int(chunk[a]))
                if ident != now:
                    if group:
                        held = held or ready()
                        yield fold(held[0], held[2])
                    now, group, held = ident, [], None
                first = a + int(np.searchsorted(kind[a:b], 1))
                if first > a:
                    group.append(batch.slice(a, first - a))
                if first < b:
                    held = held or ready()
                    yield answer(batch.slice(first, b - first), *held)
        if group:
            held = held or ready()
            yield fold(held[0], held[2])

    return rows.mapInArrow(run, schema)
