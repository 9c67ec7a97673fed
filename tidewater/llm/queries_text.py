"""Queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import linededup, ngramjoin
from tidewater.llm.common import table
from tidewater.llm.registry import ORACLES, query


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without passages that stand in an earlier one."""
    cleaned = linededup.clean(table(spark, folder, "documents").select("doc_id", "text"), removed="n_removed")
    return cleaned.select("doc_id", "text", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle set size and component of every document."""
    joined = ngramjoin.join(table(spark, folder, "documents"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


ORACLES["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT a AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
