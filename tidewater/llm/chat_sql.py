"""Oracle SQL of the chat windows: the same spans, history and template written with SQL windows."""

BUDGET, HISTORY, HISTORY_TOKENS = 512, 2, 128


def _length(role: str, text: str) -> str:
    escaped = f"replace(replace(replace({text}, '\\', '\\b'), '</turn>', '\\e'), '<turn ', '\\s')"
    name = f"replace(replace(replace(replace(replace({role}, '\\', '\\b'), '</turn>', '\\e'), '<turn ', '\\s'), '>', '\\g'), chr(10), '\\n')"
    return f"({len('<turn >') + 1 + len('</turn>') + 1} + length({name}) + length({escaped}))"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
     UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens FROM c),
h AS (SELECT conv_id, text AS sys_text, tokens AS sys_tokens FROM t WHERE pos = 0 AND role = 'system'),
u AS (SELECT t.*, greatest({BUDGET - HISTORY_TOKENS} - coalesce(sys_tokens, 0), 1) AS room,
      coalesce(sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM t LEFT JOIN h ON h.conv_id = t.conv_id WHERE NOT (pos = 0 AND sys_text IS NOT NULL)),
s AS (SELECT *, (start + tokens - 1) // room AS slice, start // room < (start + tokens - 1) // room AS crosses FROM u),
b AS (SELECT conv_id, slice, min(pos) AS all_first, min(pos) FILTER (WHERE NOT crosses) AS inner_first, sum(tokens) AS total FROM s GROUP BY 1, 2),
w AS (SELECT s.*, CASE WHEN crosses OR total <= room THEN all_first ELSE inner_first END AS span FROM s JOIN b ON b.conv_id = s.conv_id AND b.slice = s.slice),
x AS (SELECT DISTINCT conv_id, span FROM w),
seen AS (SELECT w.role, w.text, x.conv_id, sum(w.tokens) OVER (PARTITION BY x.conv_id, x.span ORDER BY back) AS used
         FROM x CROSS JOIN (SELECT unnest(generate_series(1, {HISTORY})) AS back) JOIN w ON w.conv_id = x.conv_id AND w.pos = x.span - back),
chars AS (SELECT conv_id, {_length('role', 'text')} AS n FROM w UNION ALL SELECT conv_id, {_length('role', 'text')} FROM seen WHERE used <= {HISTORY_TOKENS}
          UNION ALL SELECT h.conv_id, {_length("'system'", 'sys_text')} * greatest((SELECT count(*) FROM x WHERE x.conv_id = h.conv_id), 1) FROM h),
f AS (SELECT conv_id, sum(n) AS formatted FROM chars GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(any_value(formatted) AS BIGINT) AS formatted_chars
FROM t JOIN f ON f.conv_id = t.conv_id GROUP BY t.conv_id
"""
