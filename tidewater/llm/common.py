"""Helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import settle

#: Letters of the ASCII alphabet; other letters keep their case everywhere in this folder.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only; the built-in ``lower`` is used where a word is pure ASCII, since it is far faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, text_key): a key that also tells apart rows which repeat an id with another text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of (doc_id, text_key)."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes settled tables that no later step reads, so that a long job does not pile them up."""
    jvm = spark._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    return settle(df, f"llm-{name}")


#: Ids that are broadcast to pick their rows out of a larger table (some 20 MB); more are joined by a shuffle.
PICK_MOST = 250_000


def picked(ids: DataFrame) -> DataFrame:
    """``ids`` for a join, to be broadcast if they are few; ``ids`` should be a settled table."""
    return F.broadcast(ids) if ids.count() <= PICK_MOST else ids
