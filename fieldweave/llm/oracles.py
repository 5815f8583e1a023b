"""SQL for the queries that SQL can express; long repeated byte strings take it too long, so op1 is tested by brute force alone."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"


def _gram(n: int) -> str:
    """n consecutive words from w on, joined by blanks; null past the end."""
    return " || ' ' || ".join(["w", *[f"lead(w, {j}) OVER o" for j in range(1, n)]])


_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
j AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 AND page_id <> m THEN m END AS refers_to FROM p JOIN f USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""

_OP6 = f"""
WITH dl AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM dl),
bl AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, least(13, len(ws)) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM bl),
bw AS ({" UNION ".join(f"SELECT item_id, n, k FROM (SELECT item_id, n, {_gram(n)} AS k FROM b WHERE n = {n} WINDOW o AS (PARTITION BY item_id ORDER BY i)) AS x WHERE k IS NOT NULL" for n in range(1, 14))}),
dw AS ({" UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, k FROM (SELECT doc_id, i, {_gram(n)} AS k FROM d WHERE {n} IN (SELECT n FROM bw) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) AS x WHERE k IS NOT NULL" for n in range(1, 14))}),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) AS x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM hits) AS x GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dl LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '')"

_OP9 = f"""
WITH c AS (SELECT page_id, (DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER) AS fetched, {_HOST} AS host FROM pages),
names AS (SELECT DISTINCT 'host' AS kind, host AS pattern, 'spam' AS category FROM c WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'domain', split_part(host, '.', -2) || '.' || split_part(host, '.', -1), 'tracker' FROM c WHERE host LIKE '%.%'),
digits AS (SELECT *, instr('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 AS a, instr('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1 AS b FROM names),
spans AS (SELECT kind, pattern, category, DATE '2024-01-01' + (b * 7)::INTEGER AS f, CASE WHEN a < 8 THEN DATE '2024-01-01' + (b * 7 + 90)::INTEGER END AS t FROM digits WHERE a < 12
  UNION ALL SELECT kind, pattern, category, DATE '2024-01-01' + (b * 7 + 150)::INTEGER, NULL FROM digits WHERE a < 4),
hits AS (SELECT DISTINCT page_id, fetched, host, kind, pattern, category FROM c JOIN spans ON ((kind = 'host' AND pattern = host) OR (kind = 'domain' AND (pattern = host OR host LIKE '%.' || pattern))) AND f <= fetched AND (t IS NULL OR fetched < t)),
cats AS (SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY page_id)
SELECT page_id, fetched, host, coalesce(categories, '') AS categories, coalesce(n_entries, 0) AS n_entries, n_entries IS NOT NULL AS blocked FROM c LEFT JOIN cats USING (page_id)
"""

_OP10 = f"""
WITH RECURSIVE dl AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM dl WHERE len(ws) >= 4),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, {_gram(4)} AS k FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)) AS x WHERE k IS NOT NULL
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM dl WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT dl.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, dl.doc_id) AS component_id, dl.doc_id = coalesce(component_id, dl.doc_id) AS kept FROM dl LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

ORACLES = {"op5_arc_to_warc": _OP5, "op6_decontamination": _OP6, "op9_url_lists": _OP9, "op10_minhash": _OP10}
