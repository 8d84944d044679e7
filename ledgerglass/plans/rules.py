"""The 38 release rules as a report over a release made of the given tables, in which about half of the rules are broken somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import release, tables
from .registry import query, table

_MARK = f"{tables.MARK}TB0{tables.MARK}"
#: The release's tables in SQL that both engines read; what is nested is put together from plain columns.
_TABLES = {
    "sections": f"""SELECT concat('1.', CAST(doc_id AS STRING), '.') AS code, doc_id, CASE WHEN doc_id % 97 = 5 THEN '' ELSE concat('t', source) END AS title, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS INT) AS char_count, doc_id % 211 = 3 AS no_file,
length(coalesce(text, '')) < 100 AS is_stub, CAST(doc_id % 100 AS DOUBLE) / 100 AS coverage, CASE WHEN doc_id % 10 = 0 THEN CAST(2 + doc_id % 7 AS INT) END AS cols, doc_id % 130 <> 0 AS lossless, CASE WHEN doc_id % 4 = 0 THEN concat('附表', CAST(doc_id % 9 AS STRING)) END AS annex,
doc_id % 36 = 0 AS missing, CASE WHEN doc_id % 5 = 0 THEN 3 END AS annex_from, doc_id % 6 = 0 AS prior_review, CASE WHEN doc_id % 12 = 0 THEN 'x' END AS prior_review_evidence, CASE WHEN doc_id % 10 = 0 THEN 'a {_MARK}' ELSE 'a' END AS clause, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS tables_spliced FROM documents""",
    "previous_sections": "SELECT concat('1.', CAST(doc_id AS STRING), '.') AS code, length(coalesce(text, '')) < 100 AND doc_id % 50 <> 1 AS is_stub FROM documents",
    "products": "SELECT CAST(p_partkey AS STRING) AS code, CASE WHEN p_size % 10 = 0 THEN 'D07A' ELSE 'A01B' END AS atc, CASE WHEN p_partkey % 15 = 0 THEN 'OTHER' ELSE 'PO' END AS route, p_size % 10 = 5 AS is_combo, concat(upper(p_name), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' (X)' END) AS inn, p_partkey % 45 = 1 AS unresolved, p_partkey % 11 <> 0 AS has_insert FROM part",
    "ingredients": "SELECT upper(p_name) AS inn, min(p_size) % 2 = 1 AS subset, array_agg(DISTINCT concat('1.', CAST(p_size AS STRING), '.')) AS sections, array_agg(CAST(p_partkey AS STRING)) AS products FROM part GROUP BY p_name",
    "manifest": "SELECT concat('1.', CAST(doc_id AS STRING), '.') AS code, doc_id % 211 = 3 AS no_file, CAST(length(coalesce(text, '')) AS INT) AS char_count, concat('f', CAST(doc_id AS STRING)) AS file, md5(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 100 = 0 THEN '2026-03-01' ELSE '2026-01-01' END AS effective FROM documents",
    "files": "SELECT concat('f', CAST(doc_id AS STRING)) AS file, CASE WHEN doc_id % 77 = 0 THEN 'other' ELSE md5(coalesce(text, '')) END AS sha256 FROM documents",
    "events": "SELECT concat('1.', CAST(doc_id AS STRING), '.') AS code, CASE WHEN doc_id % 300 = 1 THEN 'fetch_failed' ELSE 'fetch_stale' END AS kind FROM documents",
    "pending": "SELECT concat('1.', CAST(doc_id AS STRING), '.') AS section, '2026-02-01' AS effective FROM documents WHERE doc_id % 50 = 0",
    "dosage": "SELECT concat('DRUG', upper(source)) AS inn, 'direct' AS kind, concat('1.', CAST(doc_id AS STRING), '.') AS section, concat(substr(coalesce(text, ''), 5, 20), CASE WHEN doc_id % 90 = 0 THEN 'zzqq' ELSE '' END) AS quote FROM documents WHERE doc_id % 9 = 0",
    "labels": "SELECT CAST(s_suppkey AS INT) AS id, concat('L', CAST(s_suppkey AS STRING)) AS licence, s_name AS text, substr(s_name, 3, 4) AS quote FROM supplier",
    "licences": "SELECT concat('L', CAST(s_suppkey AS STRING)) AS licence, CASE WHEN s_suppkey % 50 = 7 THEN 'other' ELSE s_name END AS dosage FROM supplier",
    "procedures": "SELECT concat('s', CAST(s_suppkey AS STRING)) AS code, s_suppkey % 3 <> 0 AS subset FROM supplier",
    "sources": "SELECT DISTINCT source AS name, CASE WHEN source = 'src3' THEN '' ELSE md5(source) END AS sha256, '2026' AS fetched_at FROM documents",
    "heads": "SELECT DISTINCT p_name AS name FROM part",
    "annexes": "SELECT DISTINCT concat('附表', CAST(doc_id % 9 AS STRING)) AS name, concat('u', CAST(doc_id % 9 AS STRING)) AS url FROM documents WHERE doc_id % 4 = 0",
    "annex_manifest": "SELECT DISTINCT concat('附表', CAST(doc_id % 9 AS STRING)) AS name, CASE WHEN doc_id % 9 = 3 THEN 'old' ELSE concat('u', CAST(doc_id % 9 AS STRING)) END AS url FROM documents",
    "annex_files": "SELECT DISTINCT concat('附表', CAST(doc_id % 9 AS STRING)) AS name FROM documents WHERE doc_id % 9 <> 5",
    "index": "SELECT 100 * count(*) AS bytes, count(*) AS entries FROM part",
    "header": "SELECT min(p_brand) AS first, max(p_brand) AS last FROM part",
}
_NAMES = ["small ring", "red widget"]
POLICY = release.Policy(
    columns=["Brand#1", "Brand#9"], canaries=_NAMES, prefixes=["1.7."], preserve=[*_NAMES, "blue gear"], procedure_canaries=["s1", "s2"], blocked_procedures=["s4", "s9"], aliases={"small ring": "tiny ring"}, seeds=["1.5.", "1.60."], prose=["1.10.", "1.3."],
    annex_of={"1.4.": "附表4", "1.8.": "附表8"}, columns_of={"1.10.": 5, "1.20.": 8}, sources=["src0", "src3"],
)
_UPPER = ", ".join(f"'{n.upper()}'" for n in _NAMES)
_KEPT = ", ".join(f"'{n.upper()}'" for n in POLICY.preserve)

#: Whether each rule holds, said on the tables above.
_HOLDS = {
    1: "(SELECT count(*) FROM products) BETWEEN 0.9 * (SELECT count(*) FROM customer) AND 1.1 * (SELECT count(*) FROM customer)",
    2: "(SELECT bool_and(first = 'Brand#1' AND last = 'Brand#9') FROM header)",
    3: "(SELECT count(*) >= 500 FROM sections)",
    4: "NOT EXISTS (SELECT 1 FROM manifest WHERE NOT no_file AND char_count = 0)",
    5: "NOT EXISTS (SELECT 1 FROM sections WHERE NOT no_file AND text <> '' AND title = '' AND char_count < 20)",
    7: "(SELECT avg(CAST(unresolved AS DOUBLE)) <= 0.02 FROM products)",
    8: "(SELECT coalesce(avg(CAST(route = 'OTHER' AS DOUBLE)), 0) <= 0.05 FROM (SELECT DISTINCT unnest(products) AS code FROM ingredients WHERE subset) JOIN products USING (code))",
    11: "(SELECT bytes < 307200 AND entries > 200 FROM \"index\")",
    13: f"(SELECT count(*) = 2 FROM ingredients WHERE subset AND inn IN ({_UPPER}))",
    14: f"NOT EXISTS (SELECT 1 FROM (SELECT split_part(inn, ' (', 1) AS base, inn FROM products WHERE atc = 'D07A' AND NOT is_combo) WHERE base IN ({_KEPT}) GROUP BY base HAVING count(DISTINCT inn) > 1 AND bool_or(inn = base))",
    15: "NOT EXISTS (SELECT 1 FROM sections s JOIN previous_sections p USING (code) WHERE s.is_stub AND NOT p.is_stub)",
    16: "(SELECT bool_or(starts_with(c, '1.5.') OR starts_with('1.5.', c)) AND bool_or(starts_with(c, '1.60.') OR starts_with('1.60.', c)) FROM (SELECT unnest(sections) AS c FROM ingredients WHERE subset))",
    17: "NOT EXISTS (SELECT 1 FROM sections WHERE NOT no_file AND coverage < 0.7 AND starts_with(code, '1.7.'))",
    18: "NOT EXISTS (SELECT 1 FROM sections WHERE regexp_matches(text, '[豈-﫿]'))",
    19: "NOT EXISTS (SELECT 1 FROM ingredients WHERE regexp_matches(inn, '^[A-Z].*[㐀-鿿]'))",
    20: "NOT EXISTS (SELECT 1 FROM sections WHERE cols IS NOT NULL AND NOT lossless)",
    21: "NOT EXISTS (SELECT 1 FROM sections WHERE code IN ('1.10.', '1.3.') AND cols IS NOT NULL)",
    22: "(SELECT bool_or(code = '1.4.' AND annex = '附表4' AND NOT missing) AND bool_or(code = '1.8.' AND annex = '附表8' AND NOT missing) FROM sections)",
    23: "(SELECT count(annex_from) <= 25 FROM sections)",
    24: "NOT EXISTS (SELECT 1 FROM sections WHERE prior_review AND coalesce(prior_review_evidence, '') = '')",
    25: "(SELECT count(DISTINCT name) = 2 FROM sources WHERE name IN ('src0', 'src3') AND sha256 <> '')",
    26: "(SELECT bool_or(code = '1.10.' AND cols = 5) AND bool_or(code = '1.20.' AND cols = 8) FROM sections)",
    27: "NOT EXISTS (SELECT 1 FROM dosage d JOIN sections s ON s.code = d.section WHERE NOT contains(regexp_replace(s.text, '\\s+', '', 'g'), regexp_replace(d.quote, '\\s+', '', 'g')))",
    28: "NOT EXISTS (SELECT 1 FROM dosage a JOIN (SELECT DISTINCT inn FROM dosage) b ON a.inn <> b.inn AND regexp_matches(lower(a.quote), '(^|[^a-z])' || lower(b.inn) || '([^a-z]|$)'))",
    29: "(SELECT count(*) = 0 OR count(*) BETWEEN 0.9 * (SELECT count(*) FROM nation) AND 1.1 * (SELECT count(*) FROM nation) FROM procedures)",
    30: "(SELECT count(*) = 2 FROM procedures WHERE subset AND code IN ('s1', 's2'))",
    31: "NOT EXISTS (SELECT 1 FROM procedures WHERE subset AND code IN ('s4', 's9'))",
    32: f"(SELECT sum(tables_spliced) = count(*) FILTER (WHERE contains(clause, '{_MARK}')) AND count(*) FILTER (WHERE contains(clause, '{_MARK}') AND cols IS NULL OR contains(text, '{_MARK}')) = 0 FROM sections)",
    33: "NOT EXISTS (SELECT 1 FROM labels l JOIN licences c USING (licence) WHERE l.text <> c.dosage OR NOT contains(l.text, l.quote))",
    34: "NOT EXISTS (SELECT 1 FROM sections WHERE contains(clause, chr(10)))",
    35: "NOT EXISTS (SELECT 1 FROM heads WHERE upper(name) = 'SMALL RING') OR EXISTS (SELECT 1 FROM heads WHERE contains(upper(name), 'TINY RING'))",
    36: "NOT EXISTS (SELECT 1 FROM annexes a LEFT JOIN annex_manifest m USING (name) LEFT JOIN annex_files f USING (name) WHERE a.url IS DISTINCT FROM m.url OR f.name IS NULL)",
    37: "NOT EXISTS (SELECT 1 FROM sections WHERE annex IS NOT NULL AND missing AND annex NOT IN ('附表十六之二', '附表九之六'))",
    38: "(SELECT avg(CAST(h AS DOUBLE)) >= 0.9 FROM (SELECT i.inn, bool_or(coalesce(has_insert, FALSE)) AS h FROM (SELECT inn, unnest(products) AS code FROM ingredients WHERE subset) i LEFT JOIN products USING (code) GROUP BY i.inn))",
    39: "NOT EXISTS (SELECT 1 FROM ingredients WHERE regexp_matches(inn, '[,，、；;]\\s*$|\\d+\\s*(MG|ML|MCG|GM|IU|%)') OR (inn LIKE '%)' AND NOT contains(inn, '(')))",
    40: "NOT EXISTS (SELECT 1 FROM manifest m LEFT JOIN files f USING (file) WHERE NOT no_file AND (f.sha256 IS NULL OR f.sha256 <> m.sha256))",
    41: "NOT EXISTS (SELECT 1 FROM events WHERE kind = 'fetch_failed')",
    42: "NOT EXISTS (SELECT 1 FROM pending p JOIN manifest m ON m.code = p.section WHERE m.effective >= p.effective)",
}


@query("WITH " + ", ".join(f'"{n}" AS ({sql})' for n, sql in _TABLES.items()) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS id, {holds} AS passed" for i, holds in _HOLDS.items()))
def release_rules(spark, sf_dir):
    """Every rule of a release, and whether it holds."""
    given = {n: table(spark, sf_dir, n) for n in ("documents", "part", "supplier")}
    made = {}
    for name, sql in _TABLES.items():
        used = next(t for t in given if f"FROM {t}" in sql)
        made[name] = spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {used}", f"FROM {{{used}}}"), **{used: given[used]})
    one = lambda c, *fields: F.when(F.col(c).isNotNull(), F.array(F.struct(*fields)))
    made["sections"] = made["sections"].withColumns({"tables": one("cols", "cols", "lossless"), "annexes": one("annex", F.col("annex").alias("name"), "missing"), "clauses": F.array("clause")})
    made["products"] = made["products"].withColumn("inn_keys", F.array("inn"))
    made["labels"] = made["labels"].select("id", F.array("licence").alias("licences"), "text", F.array("quote").alias("adjust"))
    made["header"] = made["header"].select(F.array("first", "last").alias("columns"))
    previous = release.Previous(products=table(spark, sf_dir, "customer").count(), procedures=table(spark, sf_dir, "nation").count(), annexes=10)
    return release.check(made, POLICY, previous).select("id", "passed")
