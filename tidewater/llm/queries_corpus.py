"""Queries of the operators that look at a corpus as a whole: divergence of sources, languages, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import divergence, language, resampling
from tidewater.llm.common import table
from tidewater.llm.registry import ORACLES, query


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most overused terms."""
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


def unseen(doc_id: Column) -> Column:
    """Rows whose languages are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@query
def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, held_out=unseen)
    found = language.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", unseen(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Tenth of all documents drawn towards the distribution of the benchmark texts."""
    rows = resampling.resample(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: The remainders of all byte values come from the same eight steps as in any bitwise crc32.
ORACLES["op13_resampling"] = r"""
WITH RECURSIVE steps(k, b, c) AS (SELECT 0, b, b FROM (SELECT unnest(generate_series(0, 255)) AS b)
      UNION ALL SELECT k + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
split AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT side, r, unnest(w) AS w FROM split),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(0, len(h) // 2 - 1), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, tab),
placed AS (SELECT side, r, bucket FROM each JOIN hashed USING (w)),
counts AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(generate_series(0, 9999)) AS b)
      LEFT JOIN (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY 1) ON bucket = b),
sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g FROM counts, sums),
weighed AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features,
      CASE WHEN n IS NULL THEN 0 ELSE g // n - CASE WHEN g % n < 0 THEN 1 ELSE 0 END END AS weight,
      CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM split LEFT JOIN weighed USING (r) WHERE side = 'd'),
n AS (SELECT 10 * count(*) // 100 AS k FROM scored WHERE n_features >= 20),
sorted AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) END AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
       CAST(CASE WHEN place <= k THEN place END AS BIGINT) AS rank FROM sorted, n
"""

ORACLES["op11_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM each GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::BIGINT AS v, sum(in_lang)::BIGINT AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*) AS c FROM each SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM groups LEFT JOIN used USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (sizes.n + 2 * v) AS p, 1 + (1000000000 * (in_lang + 2)) // (langs.n + 2 * v) AS q
      FROM kept JOIN langs USING (lang) JOIN sizes USING (lang) LEFT JOIN used USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 10
"""
