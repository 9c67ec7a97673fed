"""Queries of the trained operators and of the vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import neighbours, pseudolikelihood, toxicity
from tidewater.llm.common import settled, table
from tidewater.llm.registry import query


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    net = toxicity.train(docs, table(spark, folder, "labels"), held_out=held_out)
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic")


@query
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty nearest rows of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Summed log probabilities of every document's tokens under a network trained on all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = settled(pseudolikelihood.word_counts(docs), "word-counts")
    return pseudolikelihood.score(docs, pseudolikelihood.train(docs, counts=counts), counts=counts, keep_text=False)
