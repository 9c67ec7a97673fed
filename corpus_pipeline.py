"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination and tokenising of ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, linededup, ngramjoin
from tidewater.llm import toxicity as toxic
from tidewater.llm.common import settled, table
from tidewater.llm.queries_models import held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    net = toxic.train(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    lang = "lang" if "lang" in docs.columns else None
    scored = toxic.score(docs, net, lang_col=lang, to="_toxic_score", flag="_toxic_flag")
    return scored.filter(~F.col("_toxic_flag")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier document; those of which nothing is left go."""
    cleaned = linededup.clean(docs, removed="_removed_lines")
    changed = F.col("_removed_lines") > 0
    kept = cleaned.filter(~changed | (F.col("text") != ""))
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return ngramjoin.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and whether decoding them gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids="_ids", decoded="_decoded")
    return made.select("doc_id", "source", F.col("_ids").alias("ids"), F.size("_ids").cast("long").alias("n_tokens"),
                       (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: No SQL: a trained classifier, content-defined chunks and a transducer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
