"""Source divergence audit with frequent-pattern trees of term rows.

Per language the terms in at least ``LEAST_DOCS`` documents are kept. Every source gives every kept term a smoothed integer
share p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); sources differ by the sum of floor((p - q)^2 / (p + q)) over all kept terms.

Most terms do not occur in most sources, so no dense table is made. With f for that fraction and 0 for the share of an absent term,

    sum f(p, q) = V f(0, 0) + sum over terms of A (f(p, 0) - f(0, 0)) + sum over terms of B (f(0, q) - f(0, 0))
                  + sum over terms of both (f(p, q) - f(p, 0) - f(0, q) + f(0, 0))

The two middle sums need only the histogram of counts of one source. For the last one, every term's nonzero counts, ordered by
source, are inserted into a tree with the number of terms that have the same row: a node is one source and count, terms with
equal beginnings share a path, and each pair of a node and one of its ancestors adds its correction once, times the number of
terms below. Rows are range-partitioned by path, so that equal beginnings meet in one task and no beginning is one task's alone;
cutting a tree between tasks only repeats some shared nodes.

All arithmetic is on integers. Shares are long values: f is at most SCALE, its sum over all terms below 2^62.

Nulls and edge cases: a null text has no terms; a null language or source is the empty string; repeated rows count each;
every occurring source is reported against every other source of its language, with 0 where nothing is kept; a language
with one source has no pairs; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settled
from tidewater.llm.wordbytes import ALPHABETIC, Words
from tidewater.llm.words import slices

LEAST_DOCS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Rows of partial counts that a task gathers before it sends them on.
HELD = 400_000


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term; counted per batch before the shuffle."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def counted(part: pa.RecordBatch) -> pa.Table:
        words = Words(part.column(2), ALPHABETIC)
        terms = words.strings().dictionary_encode()
        codes: dict[tuple, int] = {}
        group = np.array([codes.setdefault(g, len(codes)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], np.int64)
        langs, sources = [pa.array([g[k] for g in codes], pa.string()) for k in (0, 1)]
        size = max(len(terms.dictionary), 1)
        row = np.repeat(np.arange(len(words)), np.diff(words.bounds))
        pair, n = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)  # one entry per document and term
        key, at = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
        total, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        here = pa.array(key // size)
        return pa.table([langs.take(here), sources.take(here), terms.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(total), pa.array(docs, pa.int64())], names=names)

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i, j in slices(batch.column(2)):
                held.append(counted(batch.slice(i, j - i)))
                n += len(held[-1])
                if n > HELD:
                    held = [merged(held)]
                    n = len(held[0])
                    if n > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)

    made = source.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), exact for counts of any size; ``kept`` is not 0."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * cast({count} + 2 as decimal(18, 0))) div cast({total} + 2 * {kept} as decimal(18, 0))")


def fraction(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def shared_prefixes(offsets: np.ndarray, source: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per path the number of leading (source, share) entries it has in common with the path before it."""
    size = np.diff(offsets)
    common = np.zeros(len(size), np.int64)
    alive, depth = np.arange(1, len(size)), 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        x, y = offsets[alive] + depth, offsets[alive - 1] + depth
        alive = alive[(source[x] == source[y]) & (p[x] == p[y])]
        depth += 1
        common[alive] = depth
    return common


def tree_corrections(offsets: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ancestor's source, node's source, correction) summed over the tree of the sorted paths of one language.

    A node begins at a path that leaves the path before it at or above the node's depth, and lasts until the next such path.
    """
    size, common = np.diff(offsets), shared_prefixes(offsets, source, p)
    before = np.concatenate(([0], np.cumsum(terms)))
    kinds = int(source.max(initial=-1)) + 1
    keys, values = [], []
    for depth in range(1, int(size.max(initial=0))):
        begins = np.flatnonzero(common <= depth)
        below = before[np.concatenate((begins[1:], [len(size)]))] - before[begins]
        some = size[begins] > depth
        begins, below = begins[some], below[some]
        step = max(1, (1 << 18) // depth)
        for i in range(0, len(begins), step):
            node = offsets[begins[i:i + step]]
            above = node[:, None] + np.arange(depth)
            node = (node + depth)[:, None]
            x, x0, y, y0 = p[above], zero[above], p[node], zero[node]
            f = fraction(x, y) - fraction(x, y0) - fraction(x0, y) + fraction(x0, y0)
            k, v = summed((source[above] * kinds + source[node]).ravel(), (f * below[i:i + step, None]).ravel())
            keys.append(k)
            values.append(v)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, v = summed(np.concatenate(keys), np.concatenate(values))
    return k // kinds, k % kinds, v


def joint_corrections(paths: DataFrame) -> DataFrame:
    """(lang, source, item, value) from trees of (lang, path, terms), one direction of each pair."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            langs = batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                lists = batch.column(1).slice(a, b - a)
                flat = lists.flatten()
                offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                names = flat.field("source").dictionary_encode()
                p, zero = (flat.field(c).to_numpy() for c in ("p", "zero"))
                x, y, v = tree_corrections(offsets, names.indices.to_numpy().astype(np.int64), p, zero, batch.column(2).slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(lang[a])].as_py()] * len(v), pa.string()), names.dictionary.take(pa.array(x)),
                                                  names.dictionary.take(pa.array(y)), pa.array(v, pa.int64())], names=["lang", "source", "item", "value"])

    return ordered.mapInArrow(run, "lang string, source string, item string, value long")


def single_corrections(sources: DataFrame) -> DataFrame:
    """(lang, source, item, value) of absent terms and of terms that one side has; both directions of each pair.

    ``sources``: lang, source, zero, kept, histogram array<struct<p, terms>>, others array<struct<source, zero>>.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                others = [o for o in row["others"] if o["source"] != row["source"]]
                if not others:
                    continue
                z, q = row["zero"], np.array([o["zero"] for o in others], np.int64)
                none = fraction(np.int64(z), q)
                value = np.zeros(len(q), np.int64)
                for h in range(0, len(row["histogram"] or []), 256):
                    part = row["histogram"][h:h + 256]
                    p, terms = (np.array([x[c] for x in part], np.int64)[:, None] for c in ("p", "terms"))
                    value += ((fraction(p, q[None, :]) - none) * terms).sum(0)
                names, n = [o["source"] for o in others], len(others)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"]] * 2 * n, pa.string()), pa.array([row["source"]] * n + names, pa.string()), pa.array(names + [row["source"]] * n, pa.string()),
                    pa.array(np.concatenate((value + row["kept"] * none, value)), pa.int64())], names=["lang", "source", "item", "value"])

    return sources.select("lang", "source", "zero", "kept", "histogram", "others").mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank (value descending, item ascending, from 1).

    Part ``pair``: divergence of a source from every other source of its language. Part ``term``: the ``top`` terms of a source
    that it uses more than its language does.
    """
    counts = term_counts(docs, lang_col, source_col, text_col)
    rows = settled(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
                   .filter(F.col("docs") >= least_docs).select("lang", "term", "sources"), "term-rows")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    entries = rows.select("lang", "term", F.inline("sources"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = settled(rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("sources.n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_total")), "langs")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = settled(groups.withColumn("zero", F.when(F.col("kept") > 0, share("0L", "total", "kept")).otherwise(F.lit(1).cast("long"))), "groups")

    q = rows.join(langs, "lang").withColumn("in_lang", F.aggregate("sources.n", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("q", share("in_lang", "lang_total", "kept"))
    entries = q.select("lang", "term", "q", F.inline("sources")).join(groups.select("lang", "source", "total", "kept", "zero"), ["lang", "source"])
    entries = settled(entries.withColumn("p", share("n", "total", "kept")).select("lang", "source", "term", "p", "q", "zero"), "entries")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    rows_of = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
    paths = settled(rows_of.groupBy("lang", "path").agg(F.count("*").alias("terms")), "paths")
    joint = joint_corrections(paths)
    histogram = entries.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("histogram"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("others"))
    single = single_corrections(groups.join(histogram, ["lang", "source"], "left").join(others, "lang"))
    values = single.unionByName(joint).unionByName(joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
