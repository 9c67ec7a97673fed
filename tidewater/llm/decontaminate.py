"""Benchmark decontamination with DataFrame functions only.

A hash set of all normalised benchmark n-grams is broadcast (its size is checked first), every token window of
every document is probed against it inside one generated-code stage, the few surviving windows are compared
word by word with the benchmark, and the hit spans or whole documents are removed.

Words are maximal runs of letters and digits (every non-ASCII character counts as a letter), A-Z lower-cased.
A window is ``n`` consecutive words of a benchmark item; an item with fewer words, but at least one, is a single
window of its own length.

Nulls and edge cases: a null or empty text has no words and no hits; a null id is an id like any other; rows that
repeat (id, text) each get the same answer; an empty benchmark or document table gives no hits; further columns of
the inputs are ignored, or carried along by the two ``remove`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, keyed, let, same_document, settled

#: Word characters in a text whose A-Z are not yet lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct n-gram hashes that may be broadcast: 2 million longs are about 64 MB as a hash relation. Above it the
#: windows are shuffled to the set instead.
BROADCAST_GRAMS = 2_000_000


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), ascii_lower)


def windows_of(words: Column, n: int) -> Column:
    """Hashes of all windows of ``n`` words, in order of their first word."""
    return let(words, lambda ws: F.when(F.size(ws) >= n, F.transform(
        F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))))


def benchmark_grams(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, size, gram, gram_hash) of all benchmark windows; ``gram`` is the words joined by spaces."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col).cast("string")).alias("ws")).filter(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(n))
    starts = items.select("item_id", "ws", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("i"))
    gram = F.slice("ws", F.col("i"), F.col("size"))
    return starts.select("item_id", "size", F.array_join(gram, " ").alias("gram"), F.xxhash64(gram).alias("gram_hash")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified occurrences: (doc_id, text_key, start, size, item_id), ``start`` counted in words from 0."""
    grams = settled(benchmark_grams(benchmark, n, item_col, item_text_col), "grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most n numbers
    source = keyed(docs, id_col, text_col)
    # explode with "outer" and a gram that is never null: else the optimizer repeats both expressions in filters below the probe
    found = []
    for size in sizes or [n]:
        known = grams.filter(F.col("size") == size).select("gram_hash").distinct()
        small = known.count() <= BROADCAST_GRAMS
        probe = (source.select("doc_id", "text_key", words_of(F.col("text")).alias("ws"))
                 .select("doc_id", "text_key", "ws", windows_of(F.col("ws"), size).alias("hashes"))
                 .select("doc_id", "text_key", "ws", F.posexplode_outer("hashes").alias("start", "gram_hash")))
        if not small:  # shuffle bare hashes, not the word arrays
            probe = probe.withColumn("ws", F.slice("ws", F.col("start") + 1, size))
        hits = probe.join(F.broadcast(known) if small else known, "gram_hash", "left_semi")
        words = F.slice("ws", F.col("start") + 1, size) if small else F.col("ws")
        found.append(hits.select("doc_id", "text_key", "start", F.lit(size).alias("size"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("gram")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.join(grams.select("gram", "size", "item_id"), ["gram", "size"]).select("doc_id", "text_key", "start", "size", "item_id")


def covered(spans: Column) -> Column:
    """Number of words inside any of the (start, size) spans."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["size"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("total"))

    return F.aggregate(F.array_sort(spans), first, step, lambda acc: acc["total"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, spans, items and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    hits = find_hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col)
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    base = keyed(docs, id_col, text_col).select("doc_id", "text_key", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return (base.join(by_doc, same_document(base, by_doc), "left")
            .select(base["doc_id"], base["text_key"], "n_words", n_hit.alias("n_hit"), "spans",
                    F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def _with_report(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` joined to its report; the columns of ``docs`` come back as they were, whatever their names."""
    back = [docs[c] for c in docs.columns]
    on = docs[id_col].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == found["text_key"])
    return docs.join(found, on, how), back


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents."""
    bad = report(docs, benchmark, n, share, id_col, text_col).filter("contaminated").select("doc_id", "text_key").distinct()
    joined, back = _with_report(docs, bad, id_col, text_col, "left_anti")
    return joined.select(*back)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word taken out of the text; separators and all other words stay byte for byte."""
    found = (report(docs, benchmark, n, 20, id_col, text_col).filter("n_hit > 0").groupBy("doc_id", "text_key").agg(F.first("spans").alias("_hit_spans")))
    joined, back = _with_report(docs, found, id_col, text_col, "left")
    text = docs[text_col].cast("string")
    hit = F.array_distinct(F.flatten(F.transform("_hit_spans", lambda s: F.sequence(s["start"] + 1, s["start"] + s["size"]))))

    def rebuilt(parts):
        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts["gaps"])), lambda i: F.concat(
            F.element_at(parts["gaps"], i),
            F.when((i <= F.size(parts["words"])) & ~F.array_contains(parts["hit"], i), F.get(parts["words"], i - 1)).otherwise(F.lit("")))), "")

    parts = F.struct(F.split(text, WORD, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), hit.alias("hit"))
    new = F.when(F.col("_hit_spans").isNull(), text).otherwise(let(parts, rebuilt))
    return joined.select(*[new.alias(text_col) if c == text_col else b for c, b in zip(docs.columns, back)])
