"""Line dedup with content-defined chunks of lines.

A rolling hash over line hashes cuts every document into chunks: some lines always end a chunk, some always start one,
chosen by their hash alone, so an inserted passage is cut the same way wherever it stands. Several independent cuttings
are made, since one of them alone may miss the first or last line of a passage. A line of many words is a chunk of its
own. So that no passage depends on how its lines happen to be cut, the shortest run of lines with ``min_words`` words
from every line on, and up to every line, is a chunk too: a repeated passage of whole lines with that many words holds
such a run around each of its lines. Chunks that occur at more than one place of different texts are compared byte by
byte with their first occurrence (smallest id); matching ones are marked, and marked stretches of at least ``min_words``
words are removed. Where a chunk overlaps its own first occurrence, as in a line repeated many times, only the lines
after that are marked, so the first occurrence stays whole.

Copies of a whole document are left to the near-duplicate operator: the same place in an equal text is not a repetition.

Nulls and edge cases: a null text stays null, an empty one empty; a null id sorts first; lines end at newline only;
repeated rows are equal texts and get equal results; very long texts are read line by line; a document whose lines all
go becomes the empty text; empty tables give no rows; further columns are carried along by ``clean``.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common
from tidewater.llm.common import keyed, picked, settled

#: Words from which a line is a chunk of its own, words that a removed stretch has at least, independent cuttings.
LONG_LINE, MIN_WORDS, CUTTINGS = 25, 40, 8
_MASK, _BASE = (1 << 128) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


@lru_cache(4096)
def _power(n: int) -> int:
    return pow(_BASE, n, _MASK + 1)


def full_runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first line, number of lines) of the shortest run with ``min_words`` words from every line on and up to every line."""
    out, last, inside = [], 0, 0
    for first, n in enumerate(words):
        while last < len(words) and inside < min_words:
            inside += words[last]
            last += 1
        if inside < min_words:
            break
        out.append((first, max(last - first, 1)))
        inside -= n
    first, inside = 0, 0
    for last, n in enumerate(words):
        inside += n
        while first < last and inside - words[first] >= min_words:
            inside -= words[first]
            first += 1
        if inside >= min_words:
            out.append((first, last + 1 - first))
    return list(dict.fromkeys(out))


def chunks(text: str, long_line: int = LONG_LINE, cuttings: int = CUTTINGS, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(first line, number of lines, 128-bit rolling hash) of all chunks with several lines, one long line or just enough words."""
    lines = text.split("\n")
    hashes = [int.from_bytes(blake2b(x.encode(), digest_size=16).digest(), "big") for x in lines]
    words = [len(x.split()) for x in lines]
    long = [n >= long_line for n in words]
    out = [(i, 1, hashes[i]) for i in range(len(lines)) if long[i]]
    for k in range(cuttings):
        first, rolled = 0, 0
        for i, h in enumerate(hashes):
            bits = h >> 4 * k
            if i > first and (long[i] or bits & 3 == 0):  # a line that starts a chunk
                if i - first > 1:
                    out.append((first, i - first, rolled))
                first, rolled = i, 0
            rolled = (rolled * _BASE + h) & _MASK
            if long[i] or bits & 12 == 0:  # a line that ends a chunk
                if i - first > 0:
                    out.append((first, i + 1 - first, rolled))
                first, rolled = i + 1, 0
        if len(hashes) - first > 1:
            out.append((first, len(hashes) - first, rolled))
    before = [0]
    for h in hashes:
        before.append((before[-1] * _BASE + h) & _MASK)
    out += [(first, n, (before[first + n] - before[first] * _power(n)) & _MASK) for first, n in full_runs(words, min_words)]
    return list(dict.fromkeys(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, at, lines, high, low) of every chunk of the keyed documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for r in range(0, batch.num_rows, 256):
                part = batch.slice(r, 256)
                rows, at, lines, high, low = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    if not text.is_valid:
                        continue
                    for first, n, h in chunks(text.as_py(), min_words=min_words):
                        rows.append(i)
                        at.append(first)
                        lines.append(n)
                        high.append(_signed(h >> 64))
                        low.append(_signed(h & (1 << 64) - 1))
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), pa.array(at, pa.int32()), pa.array(lines, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                    names=["doc_id", "text_key", "at", "lines", "high", "low"])

    return docs.mapInArrow(run, f"doc_id {id_type}, text_key long, at int, lines int, high long, low long")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, spans): chunks of a document that equal an earlier chunk byte for byte, as (at, lines) without lines of that earlier chunk."""
    occ = settled(occurrences(docs, min_words), "chunks")
    place, whole = F.struct("text_key", "at"), F.struct("doc_id", "text_key", "at", "lines")
    firsts = occ.groupBy("high", "low").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min(whole).alias("first")).filter("a <> b")
    firsts = settled(firsts.select(F.col("high").alias("f_high"), F.col("low").alias("f_low"), "first"), "chunk-firsts")
    hits = occ.join(firsts, (F.col("high") == F.col("f_high")) & (F.col("low") == F.col("f_low")))
    shared = F.when(F.col("text_key") == F.col("first.text_key"), F.greatest(F.col("first.at") + F.col("first.lines") - F.col("at"), F.lit(0))).otherwise(0)
    hits = hits.filter((F.col("text_key") != F.col("first.text_key")) | (F.col("at") != F.col("first.at"))).select(*occ.columns, shared.alias("skip"), F.lit(False).alias("is_first"))
    marked = hits.unionByName(firsts.select("first.*", F.col("f_high").alias("high"), F.col("f_low").alias("low"), F.lit(0).alias("skip"), F.lit(True).alias("is_first")))
    by_doc = settled(marked.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "lines", "high", "low", "skip", "is_first")).alias("marks")), "chunk-marks")
    by_doc = by_doc.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "marks")
    ids = settled(by_doc.select(F.col("m_id").alias("p_id"), F.col("m_key").alias("p_key")), "chunk-docs")
    some = docs.join(picked(ids), docs["doc_id"].eqNullSafe(F.col("p_id")) & (docs["text_key"] == F.col("p_key")), "left_semi")
    texts = some.join(by_doc, some["doc_id"].eqNullSafe(by_doc["m_id"]) & (some["text_key"] == by_doc["m_key"]))
    texts = texts.select("doc_id", "text_key", F.split("text", "\n", -1).alias("all_lines"), F.explode("marks").alias("m"))
    texts = texts.select("doc_id", "text_key", "m.*", F.array_join(F.slice("all_lines", F.col("m.at") + 1, F.col("m.lines")), "\n").alias("chunk"))
    texts = settled(texts.distinct(), "chunk-texts")
    first = texts.filter("is_first").select(F.col("high").alias("r_high"), F.col("low").alias("r_low"), F.col("chunk").alias("r_chunk"))
    same = texts.filter("not is_first").join(first, (F.col("high") == F.col("r_high")) & (F.col("low") == F.col("r_low"))).filter(F.col("chunk") == F.col("r_chunk"))
    return same.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct((F.col("at") + F.col("skip")).alias("at"), (F.col("lines") - F.col("skip")).alias("lines"))).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str, int]:
    """``text`` without marked stretches of at least ``min_words`` words, and how many lines went."""
    lines = text.split("\n")
    marked = bytearray(len(lines))
    for at, n in spans:
        marked[at:at + n] = b"\1" * n
    kept, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and marked[j] == marked[i]:
            j += 1
        if not marked[i] or sum(len(x.split()) for x in lines[i:j]) < min_words:
            kept += lines[i:j]
        i = j
    return "\n".join(kept), len(lines) - len(kept)


def clean(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed: str = "_removed_lines") -> DataFrame:
    """``docs`` with cleaned texts and the number of removed lines in the column ``removed``."""
    spans = settled(repeated(keyed(docs, id_col, text_col), min_words), "chunk-spans").select(F.col("doc_id").alias("_span_id"), F.col("text_key").alias("_span_key"), F.col("spans").alias("_spans"))
    names = docs.columns
    docs = docs.withColumn(text_col, docs[text_col].cast("string"))
    of_doc = docs[id_col].eqNullSafe(F.col("_span_id")) & (F.xxhash64(docs[text_col]) == F.col("_span_key"))
    if spans.count() <= common.PICK_MOST:  # texts without a span are not shuffled
        ids = F.broadcast(spans.select("_span_id", "_span_key"))
        some, rest = docs.join(ids, of_doc, "left_semi"), docs.join(ids, of_doc, "left_anti")
        some = some.join(spans, some[id_col].eqNullSafe(spans["_span_id"]) & (F.xxhash64(some[text_col]) == spans["_span_key"])).select(*[some[c] for c in names], "_spans")
        rows = some.unionByName(rest.withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType)))
    else:
        rows = docs.join(spans, of_doc, "left").select(*[docs[c] for c in names], "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{removed}` int"
    where = names.index(text_col)

    def run(batches):
        for batch in batches:
            for r in range(0, batch.num_rows, 1024):
                part = batch.slice(r, 1024)
                texts, gone = [], []
                for text, marks in zip(part.column(where), part.column(len(names))):
                    if not marks.is_valid:
                        texts.append(text.as_py())
                        gone.append(0)
                        continue
                    new, n = cut(text.as_py(), [(m["at"], m["lines"]) for m in marks.as_py()], min_words)
                    texts.append(new)
                    gone.append(n)
                columns = [part.column(i) if i != where else pa.array(texts, pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32())], names=[*names, removed])

    return rows.mapInArrow(run, schema)
