"""URL filters: path rules first, link-graph propagation for the rest.

Hosts that allow rules vouch for are trusted seeds, hosts that block rules hit are blocked seeds, each with the share
of its pages as weight. Personalised PageRank carries trust forward along links between hosts and distrust backward
(who links to a blocked host is suspect). A host is blocked when its distrust exceeds its trust.

Nulls and edge cases: a url that is null or lacks ``://`` has an empty host and path; the empty host takes no part in
the graph and its pages are allowed unless a rule fits; null or broken html has no links; repeated pages and links
count as often as they stand; hosts without seeds or links are allowed; empty tables give no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, UPPER, drop_written, settled

#: Fixed rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (host, path) with the longest fitting ``rule`` and its ``rule_verdict``, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer rules are asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links): links between different hosts; relative links stay inside a host and carry nothing."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    target = F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("http:"), F.col("link")))).otherwise(host_of(F.col("link")))
    return (links.select(F.col("host").alias("source"), target.alias("target"))
            .filter("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("links")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps of both personalised PageRanks, which share every job.

    Each step is a join and a sum by host with partial sums before the shuffle. Its result is a table in the shared
    folder, so a lost executor costs one step at most.
    """
    spark = edges.sparkSession
    both = edges.select("source", "target", "links", F.lit("trust").alias("kind")).unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "links", F.lit("distrust").alias("kind")))
    out = both.groupBy("kind", "source").agg(F.sum("links").alias("all_links"))
    both = settled(both.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("links") / F.col("all_links")).alias("share")), "host-edges")
    seeds = settled(seeds.selectExpr("host", "stack(2, 'trust', trust_seed, 'distrust', distrust_seed) as (kind, seed)").filter("seed > 0"), "host-seeds")
    start = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    score, older = start, None
    for _ in range(rounds):
        given = both.join(score, (both["kind"] == score["kind"]) & (both["source"] == score["host"])).select(
            both["kind"], F.col("target").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        nxt = settled(start.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
        if older is not None:
            drop_written(spark, older)
        score = older = nxt
    take = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return score.groupBy("host").agg(take("trust"), take("distrust"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    url = F.col(url_col).cast("string")
    known = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    ruled = apply_rules(known, rules)
    edges = host_edges(ruled)
    rows = settled(ruled.drop("html"), "pages")
    hit = lambda kind: F.count(F.when(F.col("rule_verdict") == kind, 1)).alias(kind)
    hosts = rows.filter("host <> ''").groupBy("host").agg(hit("allow"), hit("block"), F.count("*").alias("n"))
    seeds = hosts.select("host", (F.col("allow") / F.col("n")).alias("trust_seed"), (F.col("block") / F.col("n")).alias("distrust_seed"))
    scores = settled(propagate(edges, seeds, damping, rounds), "host-verdicts").withColumnRenamed("host", "scored")
    judged = rows.join(scores, rows["host"] == scores["scored"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("rule_verdict", F.when(distrust > trust, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
