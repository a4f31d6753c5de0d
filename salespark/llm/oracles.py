"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len AS k, array_to_string(w[i:i + len - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)
),
occ AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM pos p JOIN win ON win.k = p.k AND win.g = p.g),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id
),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# Turns by prefix sums: half of the room left by system turn and history is a bucket; turns of half the room or more
# stand alone; a window repeats the system turn and up to 256 tokens before its span.
SQL["op2_chat_formatting"] = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
placed AS (
  SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + 1 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS idx FROM raw
),
led AS (SELECT conv_id, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS sys FROM placed WHERE idx = 1),
room AS (SELECT conv_id, sys, greatest(CAST(floor((768 - sys) / 2) AS BIGINT), 64) AS half FROM led),
at_start AS (
  SELECT p.*, sys, half, p.idx = 1 AND sys > 0 AS system_turn,
    greatest(sum(tokens) OVER (PARTITION BY p.conv_id ORDER BY idx) - tokens - sys, 0) AS start
  FROM placed p JOIN room USING (conv_id)
),
sized AS (
  SELECT *, tokens >= half AND NOT system_turn AS big, start // half AS bucket,
    length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'))
      + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:')) + 14 AS chars
  FROM at_start
),
spans AS (
  SELECT *, 2 * sum(CAST(big AS INT)) OVER (PARTITION BY conv_id ORDER BY idx) - CAST(big AS INT) AS run FROM sized
),
firsts AS (SELECT conv_id, bucket, run, min(start) AS s, min(idx) AS first_idx FROM spans GROUP BY ALL),
repeated AS (
  SELECT f.conv_id, sum(t.chars) AS chars FROM firsts f JOIN spans t
    ON t.conv_id = f.conv_id AND t.idx < f.first_idx AND (t.system_turn OR f.s - t.start <= 256)
  GROUP BY f.conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t.chars) + coalesce(any_value(r.chars), 0) AS BIGINT) AS formatted_chars
FROM spans t LEFT JOIN repeated r USING (conv_id) GROUP BY t.conv_id
"""

SQL["op7_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
five AS (SELECT h, unnest(range(8)) AS i FROM f),
letters AS (
  SELECT h, i, CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT) AS v FROM five
),
base32 AS (
  SELECT h, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v >> 15 AS INT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INT) + 1, 1), '' ORDER BY i) AS digest
  FROM letters GROUP BY h
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (h) JOIN base32 USING (h)
"""

# Bytes as pairs of hex digits; islands of covered bytes are counted by their beginnings.
SQL["op9_substring_dedup"] = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
o AS (SELECT g, min(doc_id) AS owner FROM s GROUP BY g),
r AS (SELECT doc_id, i FROM s JOIN o USING (g) WHERE owner < doc_id),
stretches AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM r
),
numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM stretches),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM spans
),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) || CASE WHEN final THEN substr(x, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS y
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_TERMS = rf"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

SQL["op12_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM d WHERE len(t) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
posting AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posting CROSS JOIN total GROUP BY term
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // CAST(words AS BIGINT))))) AS BIGINT) AS score
  FROM posting JOIN weight USING (term) JOIN asked USING (term) CROSS JOIN total GROUP BY item_id, doc_id
),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10
"""
