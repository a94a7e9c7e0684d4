"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LINES = """
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS line_row, pos, line,
         lower_ascii AS key
  FROM (
    SELECT doc_id, pos, parts[pos] AS line,
           regexp_replace(regexp_replace(
             translate(parts[pos], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') AS lower_ascii
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
         LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos)
  )
),
frequent AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) >= 10
)
"""

OP5 = (
    _LINES
    + """
SELECT l.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY l.doc_id
"""
)


#: Every 50-byte window of every text, as hexadecimal digits.
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(CAST(sum(b - a) AS BIGINT), 0) AS n_removed, count(a) AS n_spans, sha256(unhex(any_value(k))) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, n
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product codes by comparing every part with every entry, round after round."""
    assign = """a{r} AS MATERIALIZED (
  SELECT id, p, x, e, d FROM (
    SELECT id, p, x, e, d, row_number() OVER (PARTITION BY id, p ORDER BY d, e) AS k FROM (
      SELECT q.id, q.p, q.x, b.e,
             list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) AS d
      FROM q JOIN b{r} b ON q.p = b.p)) WHERE k = 1)"""
    # the remainder of a division that rounds down is never negative
    update = """b{s} AS MATERIALIZED (
  WITH t AS (SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (
         SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i),
       m AS (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM t GROUP BY p, e)
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m ON m.p = b.p AND m.e = b.e)"""
    steps = []
    for r in range(rounds):
        steps += [assign.format(r=r), update.format(r=r, s=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
q AS MATERIALIZED (SELECT id, p, list_transform(v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}], lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x
      FROM k, (SELECT unnest(range(0, {parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x FROM q WHERE id <= {entries}),
{("," + chr(10)).join(steps)},
c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (id), h
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op7_suffix_dedup": OP7, "op12_vector_codes": vector_codes()}
