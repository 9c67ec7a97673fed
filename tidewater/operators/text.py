"""News text: tokens, lexicon sentiment, sentiment per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import STOP_WORDS, clean_text, words
from tidewater.session import settle


def tokens(news: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    return news.withColumn("tokens", words("text", stop))


#: Lexicon words that every task gets; words beyond, the rarest, are joined by a shuffle.
LOCAL_WORDS = 200_000


def sentiment(news: DataFrame, lexicon: DataFrame, *keep: str, local: int = LOCAL_WORDS) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words of a text, and the share of words known.

    Texts meet the most frequent words of the lexicon (its column ``texts``, if it has one) where they are read, so what is
    shuffled is one row of sums per document. Only a lexicon of more than ``local`` words takes a second pass, in which
    the other words of the texts are counted per document and joined with the rest of the lexicon.
    """
    lexicon = settle(lexicon if "texts" in lexicon.columns else lexicon.withColumn("texts", F.lit(1)), "lexicon")
    doc = ["doc_id", *keep]
    said = _words(news.select(*doc, F.split(clean_text("text"), r"\s+").alias("__t")))
    frequent, rest = _by_frequency(lexicon, local)
    held = F.broadcast(frequent.select(F.col("word").alias("__w"), "polarity", "subjectivity"))
    sums = lambda n: [F.sum(n * F.col("polarity")).alias("p"), F.sum(n * F.col("subjectivity")).alias("s"), F.sum(F.when(F.col("polarity").isNotNull(), n)).alias("known")]
    out = said.join(held, F.col("word") == F.col("__w"), "left").groupBy(*doc).agg(*sums(F.lit(1)), F.count(F.lit(1)).alias("n"))
    if rest is not None:
        other = said.join(held, F.col("word") == F.col("__w"), "left_anti").groupBy(*doc, "word").agg(F.count(F.lit(1)).alias("m"))
        more = other.join(rest.select("word", "polarity", "subjectivity"), "word").groupBy(*doc).agg(*sums(F.col("m"))).withColumn("n", F.lit(0).cast("long"))
        out = out.unionByName(more).groupBy(*doc).agg(*[F.sum(c).alias(c) for c in ("p", "s", "known", "n")])
    return out.select(
        *doc,
        F.coalesce(F.col("p") / F.col("known"), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.col("s") / F.col("known"), F.lit(0.0)).alias("subjectivity"),
        F.coalesce(F.col("known") / F.col("n"), F.lit(0.0)).alias("confidence"),
    )


def _words(split: DataFrame) -> DataFrame:
    """A row per word of the array ``__t``; the outer form keeps Spark from cleaning every text again to test for empty arrays."""
    rows = split.select(*[c for c in split.columns if c != "__t"], F.explode_outer("__t").alias("word"))
    return rows.where((F.length("word") > 0) & ~F.col("word").isin(*STOP_WORDS))


def _by_frequency(lexicon: DataFrame, local: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words, at most ``local``, and the others; words of one level of frequency stay together."""
    level = F.floor(F.log2(F.col("texts").cast("double")) * 8)
    least, total = None, 0
    for at, n in sorted(lexicon.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > local:
            return (lexicon.where(F.lit(False)) if least is None else lexicon.where(level >= least)), (lexicon if least is None else lexicon.where(level < least))
        least = at
    return lexicon, None


def labelled_lexicon(news: DataFrame, labels: DataFrame) -> DataFrame:
    """Word polarity in [-1, 1] and subjectivity in [0, 1] from document labels, and the number of labelled texts."""
    docs = _words(news.join(labels, "doc_id").select("quality", "toxic", F.array_distinct(F.split(clean_text("text"), r"\s+")).alias("__t")))
    return docs.groupBy("word").agg(
        (2 * F.avg("quality") - 1).alias("polarity"), F.avg("toxic").cast("double").alias("subjectivity"), F.count(F.lit(1)).alias("texts"))


def sentiment_bars(scores: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mean sentiment per time bucket; scores carry ``ts``."""
    return scores.groupBy(F.window("ts", width).alias("__w")).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"), F.count(F.lit(1)).alias("texts")
    ).withColumn("ts", F.col("__w.start")).drop("__w")
