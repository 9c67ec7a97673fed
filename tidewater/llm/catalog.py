"""Registered queries of the numbered operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, chat_sql, decontaminate, sharding, urls
from tidewater.llm import queries_corpus, queries_models, queries_text  # noqa: F401
from tidewater.llm.common import table
from tidewater.llm.registry import ORACLES, QUERIES, query  # noqa: F401


def joined_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


@query
def op1_shard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sixteen shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Budgeted chat windows of every conversation, digests of what is read back from them."""
    probe = "\\### Assistant: </turn> ok"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    windows = chat.format_windows(turns.unionByName(own))
    back = windows.select(
        "conv_id", "window", F.slice(chat.read_window(F.col("text")), F.col("n_repeated") + 1, 2 ** 31 - 1).alias("turns"),
        chat.read_targets(F.col("text"), F.col("targets")).alias("loss"), F.length("text").cast("long").alias("chars"))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.flatten(F.col("w.loss")), "")
    said = F.transform(F.flatten(F.col("w.turns")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.select("conv_id", F.size(said).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """13-word benchmark windows in every document."""
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        joined_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and the text decoded from them, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_link_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page: path rules, else trust and distrust of its host."""
    return urls.judge(table(spark, folder, "pages"))


ORACLES["op2_chat"] = chat_sql.SQL

ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) JOIN grams USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
