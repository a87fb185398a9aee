"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{pattern}'), [])"


def similarity(n: int = 4, percent: int = 85) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words('text', SPACED)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least({n}, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS r(k) WHERE len(w) > 0),
  n AS (SELECT d.doc_id, CAST(count(s.g) AS BIGINT) AS n_shingles FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
  pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  edges AS (SELECT u, v FROM pairs JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n_shingles + y.n_shingles - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.v FROM reach AS r JOIN edges AS e ON r.b = e.u)
  SELECT n.doc_id, n.n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n_shingles"""


def decontamination(window: int = 13) -> str:
    return f"""WITH d AS (SELECT doc_id, {words('text', ALNUM)} AS w FROM documents), b AS (SELECT item_id, {words('text', ALNUM)} AS w FROM benchmark),
  p AS (SELECT DISTINCT item_id, least({window}, len(w)) AS n, array_to_string(w[k:k + least({window}, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS r(k) WHERE len(w) > 0),
  grams AS (SELECT d.doc_id, k, l.n, array_to_string(w[k:k + l.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM p) AS l, unnest(range(1, len(w) - l.n + 2)) AS r(k)),
  o AS (SELECT grams.doc_id, k, grams.n, item_id FROM grams JOIN p ON grams.n = p.n AND grams.g = p.g),
  hits AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM o, unnest(range(0, n)) AS q(j) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) AS i GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def line_dedup() -> str:
    token, masked = SPACED, r"[^\x20\x09\x0B-\x0D]*[0-9][^\x20\x09\x0B-\x0D]*"
    quarters = " UNION ALL ".join(
        f"SELECT doc_id, k, n, n || ' ' || array_to_string(w[1:3], ' ') || chr(1) || {q} || ' ' || array_to_string(list_concat(list_concat(w[1:n * {q} // 4], ['<*>']), w[n * {q + 1} // 4 + 1:n]), ' ') AS key FROM t WHERE n >= 12"
        for q in range(4)
    )
    return f"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL),
  t AS (SELECT doc_id, k, w, len(w) AS n FROM (SELECT doc_id, k, regexp_extract_all(regexp_replace(line, '{masked}', '<*>', 'g'), '{token}') AS w FROM l) AS x WHERE len(w) >= 4),
  keys AS (SELECT doc_id, k, n, n || ' ' || array_to_string(w[1:3], ' ') || chr(2) || array_to_string(w, ' ') AS key FROM t UNION ALL {quarters}),
  often AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key, n HAVING count(DISTINCT doc_id) >= greatest(2, CASE WHEN n >= 20 THEN 2 WHEN n >= 8 THEN 3 ELSE 6 END)),
  gone AS (SELECT DISTINCT doc_id, key FROM keys JOIN often USING (key) WHERE doc_id > first),
  cut AS (SELECT DISTINCT keys.doc_id, keys.k FROM keys JOIN gone ON keys.doc_id = gone.doc_id AND keys.key = gone.key),
  kept AS (SELECT l.doc_id, count(*) AS n_lines, count(cut.k) AS n_dropped, string_agg(line, chr(10) ORDER BY l.k) FILTER (WHERE cut.k IS NULL) AS text FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.k = cut.k GROUP BY l.doc_id)
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped FROM documents AS d LEFT JOIN kept ON d.doc_id = kept.doc_id"""
