"""SQL that repeats the queries SQL can express; it follows the definitions, not the methods.

Where SQL is too slow on whole tables (a row for each of a document's 50-byte strings), or cannot say the
query, tests/llm compares with brute force.
"""

from __future__ import annotations

import math

from flowhunt.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, _tokens

_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _license_scan() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM words, unnest(range(1, len(ws) + 1)) u(i) "
        f"WHERE ws[i] = '{p[0]}' AND ws[i : i + {len(p) - 1}] = {p!r}"
        for p, label in ((phrase.split(), label) for phrase, label in PHRASES)
    )
    templates = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {t!r} AS tokens, {math.ceil(THRESHOLD * len(t))} AS need"
        for t, label in ((_tokens(body), label) for label, body in TEMPLATES)
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT doc_id, {words.format(lower.format('body'))} AS ws FROM texts),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, {words.format(lower.format('line'))} AS ws FROM texts, unnest(string_split(body, chr(10))) u(line)),
templates AS ({templates}),
blocks AS (SELECT doc_id, label, len(list_intersect(tokens, ws)) AS shared, len(tokens) AS size, need
           FROM lines, templates WHERE list_has_any(ws, tokens)),
added AS (SELECT doc_id, label, max(shared / size) AS best FROM blocks WHERE shared >= need GROUP BY doc_id, label),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS score FROM places UNION ALL SELECT doc_id, label, best FROM added),
joined AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM every GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN joined USING (doc_id)
"""


_HARD_NEGATIVES = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""


# CRC-32 of each different feature, byte by byte from its definition.
_IMPORTANCE = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
runs AS (
  SELECT row, array_to_string(ws[i : i + n - 1], ' ') AS feature FROM texts, unnest([1, 2, 3]) a(n), unnest(range(1, len(ws) - n + 2)) b(i)),
target_runs AS (
  SELECT array_to_string(ws[i : i + n - 1], ' ') AS feature FROM items, unnest([1, 2, 3]) a(n), unnest(range(1, len(ws) - n + 2)) b(i)),
steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step
  FROM range(256) u(b)),
every AS (SELECT DISTINCT feature FROM (SELECT feature FROM runs UNION ALL SELECT feature FROM target_runs)),
hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(0, strlen(feature)), lambda i: CAST('0x' || substr(hex(feature), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, step[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM every, steps),
s AS (SELECT bucket, count(*) AS n FROM runs JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_runs JOIN hashed USING (feature) GROUP BY bucket),
gain AS (
  SELECT b AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) u(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weights AS (
  SELECT row, count(*) AS n_features, sum(gain) AS weight FROM runs JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(ws) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= 5 * (SELECT count(*) FROM scored WHERE able) // 100 THEN place END AS rank FROM ranked
"""


ORACLE = {
    "op2_exact_dedup": _EXACT_DEDUP,
    "op4_license_scan": _license_scan(),
    "op11_importance_resampling": _IMPORTANCE,
    "op13_hard_negatives": _HARD_NEGATIVES,
}
