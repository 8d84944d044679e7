"""SQL that DuckDB runs for operators whose exact result SQL can express, at the cost of comparing everything with everything."""

WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(len(w), 5) - 1), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z),
m AS (SELECT doc_id, min(z) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.x = m.doc_id) AS n_links, doc_id = class_id AS kept FROM m
"""



def _repeats(n: int) -> str:
    """Common tables: s{n} the repeated windows of n bytes, r{n} their runs, c{n} the bytes and runs of each text."""
    return f"""
b{n} AS (SELECT doc_id, o, substr(h, 2 * o + 1, {4 * n}) AS h, least({n}, len(h) // 2 - {n - 1} - o) AS n FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1}, {n})) AS o FROM d WHERE len(h) >= {2 * n})),
w{n} AS (SELECT doc_id, o + i AS i, md5(substr(h, 2 * i + 1, {2 * n})) AS k FROM (SELECT doc_id, o, h, unnest(range(0, n)) AS i FROM b{n})),
t{n} AS (SELECT k FROM w{n} GROUP BY k HAVING count(*) > 1),
s{n} AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n}, TRUE) AS fresh FROM w{n} SEMI JOIN t{n} USING (k)),
r{n} AS (SELECT doc_id, min(i) AS a, max(i) + {n} AS b FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s{n}) GROUP BY doc_id, run),
c{n} AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r{n} GROUP BY doc_id)"""


SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),{_repeats(400)},{_repeats(240)},
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM r400 UNION ALL SELECT doc_id, max(b), 1 << 30 FROM r400 GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c400.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c400.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.h, CASE WHEN c400.n_spans IS NULL THEN d.h ELSE '' END))) AS kept_sha256, CAST(coalesce(c240.n_removed, 0) AS BIGINT) AS n_passage
FROM d LEFT JOIN c400 USING (doc_id) LEFT JOIN c240 USING (doc_id) LEFT JOIN k USING (doc_id)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS z FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.z),
m AS (SELECT vec_id, min(z) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""

#: For pages as these tables have them: one article each, with headings and paragraphs of
#: inline markup. A reference cut off before its semicolon counts, as in HTML.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>((?s:.)*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(replace(a, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), chr(1)) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter([trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN b], lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
