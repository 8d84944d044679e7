"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch_search, near_names, search
from .registry import query, table

_FIELDS = [search.Field("name", "name", 100, 95, 50), search.Field("brand", "brand", 80, 75, 40), search.Field("kinds", "kind", 78, 70, 38, True)]


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.split("p_type", " ").alias("kinds"))


def _score(field: str, q: str, exact: int, prefix: int, inside: int) -> str:
    h = f"lower({field})"
    return f"CASE WHEN {h} = '{q}' THEN {exact} WHEN starts_with({h}, '{q}') THEN {prefix} WHEN contains({h}, '{q}') THEN {inside} ELSE 0 END"


_SEARCH = f"""WITH s AS (SELECT p_partkey, p_name, {_score('p_name', 'br', 100, 95, 50)} AS a, {_score('p_brand', 'br', 80, 75, 40)} AS b, (SELECT max({_score('x', 'br', 78, 70, 38)}) FROM (SELECT unnest(string_split(p_type, ' ')) AS x)) AS c FROM part)
SELECT p_partkey, p_name AS name, CAST(greatest(a, b, c) AS INTEGER) AS score, CASE WHEN a >= b AND a >= c THEN 'name' WHEN b >= c THEN 'brand' ELSE 'kind' END AS field FROM s WHERE greatest(a, b, c) > 0"""


@query(_SEARCH)
def search_parts(spark, sf_dir):
    """All parts with a hit for `br`; the field that scores best."""
    return search.search(_parts(spark, sf_dir), " BR ", _FIELDS, limit=None).select("p_partkey", "name", "score", "field")


@query(f"SELECT * FROM ({_SEARCH}) ORDER BY score DESC, name, p_partkey LIMIT 10")
def search_top10(spark, sf_dir):
    """The ten best: a top-k report."""
    hits = search.search(_parts(spark, sf_dir), "br", _FIELDS, limit=None)
    return hits.orderBy(F.desc("score"), "name", "p_partkey").limit(10).select("p_partkey", "name", "score", "field")


@query("SELECT c_custkey, c_name AS name, 10 AS score, c_name AS matched FROM customer WHERE levenshtein(lower(c_name), 'customer#00000x') <= 1 OR levenshtein(lower(c_name), 'customer#000000012') <= 1")
def search_fuzzy(spark, sf_dir):
    """Names at most one edit away from either of two misspelt ones."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    both = search.fuzzy(c, "Customer#00000x", ["name"], limit=None).union(search.fuzzy(c, "CUSTOMER#000000012", ["name"], limit=None))
    return both.distinct().select("c_custkey", "name", "score", "matched")


@query("SELECT count(*) AS n FROM part WHERE contains(lower(p_type), 'steel')")
def other_scope_count(spark, sf_dir):
    """How many hits the wider index has where the narrow one has none."""
    wide = _parts(spark, sf_dir)
    _, n = search.search_with_fallback(wide.where("p_partkey < 0"), "steel", _FIELDS, ["name"], wider=wide)
    return spark.createDataFrame([(n,)], "n bigint")


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黃"
_PLAIN, _WIDE = "0123456789", "０１２３４５６７８９"


def _misspelt(name: str, key: str) -> str:
    """SQL for a name with something done to it that depends on its key: a character changed, left out or put in, two changed over, or only its case."""
    return f"""CASE {key} % 5 WHEN 0 THEN concat(substr({name}, 1, 3), 'x', substr({name}, 5)) WHEN 1 THEN concat(substr({name}, 1, 2), substr({name}, 4)) WHEN 2 THEN concat(substr({name}, 1, 1), 'q', substr({name}, 2))
WHEN 3 THEN concat(substr({name}, 2, 1), substr({name}, 1, 1), substr({name}, 3)) ELSE upper({name}) END"""


_PEOPLE = "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT -1 - s_suppkey AS key, s_name AS name FROM supplier"
_MISSPELT = f"SELECT {_misspelt('name', 'abs(key)')} AS term FROM people UNION ALL SELECT substr(name, 1, 4) AS term FROM people UNION ALL SELECT substr(name, 1, 17) AS term FROM people"


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    people = c.union(table(spark, sf_dir, "supplier").selectExpr("-1 - s_suppkey AS key", "s_name AS name"))
    terms = people.selectExpr(f"{_misspelt('name', 'abs(key)')} AS term").union(people.selectExpr("substr(name, 1, 4)")).union(people.selectExpr("substr(name, 1, 17)"))
    return people, terms


@query(
    f"""WITH people AS ({_PEOPLE}), terms AS (SELECT DISTINCT term FROM ({_MISSPELT}))
SELECT term, key, name, 10 AS score FROM terms JOIN people ON length(term) >= 5 AND abs(length(term) - length(name)) <= 1 AND levenshtein(lower(name), lower(term)) <= 1"""
)
def near_name_join(spark, sf_dir):
    """For every misspelt name and every beginning of 17 or 4 characters, all names at most one edit away."""
    people, terms = _people(spark, sf_dir)
    return near_names.near_names(people, "key", "name", terms, "term")


@query(
    f"""WITH people AS ({_PEOPLE}), terms AS (SELECT DISTINCT term FROM ({_MISSPELT}))
SELECT term, key, name, 10 AS score FROM terms JOIN people ON length(term) >= 5 AND abs(length(term) - length(name)) <= 2 AND levenshtein(lower(substr(name, 1, length(term) + 1)), lower(term)) <= 1"""
)
def near_name_ahead(spark, sf_dir):
    """The same for terms that are still being typed: a name may go on for one character more."""
    people, terms = _people(spark, sf_dir)
    return near_names.near_names(people, "key", "name", terms, "term", ahead=True)


#: The nine fields of a drug, of parts. Lists are arrays in both dialects; {a} and {z} begin and end one.
_DRUGS = f"""SELECT concat('d', p_partkey) AS key, p_name AS name, {{a}}concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)){{z}} AS aliases, {{a}}translate(p_name, '{_LATIN}', '{_HAN}'){{z}} AS zh_names,
{{a}}p_brand{{z}} AS originators, {{a}}concat(p_brand, ' ', p_type), p_type{{z}} AS brands_en, {{a}}concat(translate(lower(p_type), '{_LATIN}', '{_HAN}'), translate(CAST(p_size AS STRING), '{_PLAIN}', '{_WIDE}'), '毫克'){{z}} AS brands_zh,
{{a}}concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 7 AS STRING), '.'){{z}} AS sections, {{a}}concat('D', lpad(CAST(p_size AS STRING), 2, '0'), upper(substr(p_name, 1, 2))){{z}} AS atc,
CASE WHEN p_size % 2 = 0 THEN {{a}}split_part(p_name, ' ', 1), split_part(p_name, ' ', 2){{z}} END AS components, FALSE AS first_choice FROM part"""
#: The five fields of a procedure, of suppliers.
_PROCEDURES = f"""SELECT concat('p', s_suppkey) AS key, concat(CAST(51000 + s_suppkey AS STRING), 'C') AS code, concat('液態氮', translate(CAST(s_suppkey AS STRING), '{_PLAIN}', substr('{_HAN}', 1, 10)), '治療') AS procedure_name, s_name AS procedure_name_en,
{{a}}concat('照光', CAST(s_nationkey AS STRING)), concat('Small Procedure ', CAST(s_suppkey % 50 AS STRING)){{z}} AS synonyms, concat('限皮膚科；note of ', s_name, ' and what it says besides') AS note, s_suppkey % 3 = 0 AS first_choice FROM supplier"""
#: Whole names, beginnings, insides, Han, codes and sections with and without dots, words of notes, and what matches nothing.
_ASKED = f"""SELECT p_name AS term FROM part UNION SELECT upper(substr(p_name, 1, 3)) FROM part UNION SELECT substr(p_name, 3, 4) FROM part UNION SELECT substr(p_name, 2, 2) FROM part UNION SELECT translate(substr(p_name, 1, 2), '{_LATIN}', '{_HAN}') FROM part
UNION SELECT translate(substr(p_name, 2, 5), '{_LATIN}', '{_HAN}') FROM part UNION SELECT concat(CAST(p_size AS STRING), '.1') FROM part UNION SELECT concat(CAST(p_size AS STRING), '.2.') FROM part UNION SELECT concat('d', lpad(CAST(p_size AS STRING), 2, '0')) FROM part
UNION SELECT concat(' ', p_brand, '  ', p_type) FROM part UNION SELECT concat(translate(CAST(p_size AS STRING), '{_PLAIN}', '{_WIDE}'), '毫') FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT s_name FROM supplier UNION SELECT substr(s_name, 12) FROM supplier
UNION SELECT CAST(51000 + s_suppkey AS STRING) FROM supplier UNION SELECT concat('治療', s_nationkey) FROM supplier UNION SELECT concat('照光', CAST(s_nationkey AS STRING)) FROM supplier UNION SELECT lower(p_brand) FROM part
UNION SELECT * FROM (VALUES ('51'), ('液'), ('a'), ('note of'), ('皮膚'), ('procedure 1'), ('nowhere'), (''), ('  '), (NULL)) v(term)"""


def _entries(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in ("part", "supplier")}

    def own(sql):
        sql = sql.replace("{a}", "array(").replace("{z}", ")").replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}")
        return spark.sql(sql, **{k: v for k, v in tables.items() if f"{{{k}}}" in sql})

    entries = own(_DRUGS).unionByName(own(_PROCEDURES), allowMissingColumns=True).withColumn("shown", F.coalesce("name", "procedure_name"))
    return entries, own(_ASKED)


def _ranked_sql(k: int) -> str:
    d, p, asked = (x.replace("{a}", "[").replace("{z}", "]") for x in (_DRUGS, _PROCEDURES, _ASKED))
    values = []
    for i, f in enumerate(batch_search.ALL_FIELDS):
        row = f"{i} AS family, '{f.label}' AS field, {f.exact} AS exact, {f.prefix} AS prefix, {f.inside} AS inner_"
        source = "d" if i < len(search.DRUG_FIELDS) else "p"
        values.append(f"SELECT key, {row}, unnest({f.column}) AS value, generate_subscripts({f.column}, 1) AS place FROM {source}" if f.many else f"SELECT key, {row}, {f.column} AS value, 1 AS place FROM {source}")
    form = rf"trim(regexp_replace(lower(translate({{}}, '{_WIDE}', '{_PLAIN}')), '\s+', ' ', 'g'))"
    return f"""WITH d AS ({d}), p AS ({p}), e AS (SELECT key, name, FALSE AS first_choice FROM d UNION ALL SELECT key, procedure_name, first_choice FROM p),
v AS (SELECT *, {form.format('value')} AS form FROM ({' UNION ALL '.join(values)}) WHERE value IS NOT NULL), f AS (SELECT * FROM v WHERE form <> ''),
q AS (SELECT term AS given, {form.format('term')} AS term FROM (SELECT DISTINCT term FROM ({asked}))),
h AS (SELECT given, key, family, field, place, value, CASE WHEN field = 'section' AND rtrim(form, '.') = rtrim(term, '.') THEN exact WHEN form = term THEN exact WHEN starts_with(form, term) THEN CASE WHEN field = 'code' AND length(term) < 3 THEN 0 ELSE prefix END WHEN contains(form, term) THEN inner_ ELSE 0 END AS score FROM q JOIN f ON contains(form, term) OR (field = 'section' AND rtrim(form, '.') = rtrim(term, '.')) WHERE term <> ''),
b AS (SELECT given, key, max(score) AS score, arg_max(field, (score, -family, -place)) AS field, arg_max(value, (score, -family, -place)) AS value FROM h WHERE score > 0 GROUP BY given, key),
r AS (SELECT given, key, name, score + CAST(first_choice AS INTEGER) AS score, field, CASE WHEN field = 'note' THEN substr(value, 1, 40) ELSE value END AS matched FROM b JOIN e USING (key))
SELECT given AS term, CAST(row_number() OVER (PARTITION BY given ORDER BY score DESC, name, key) AS INTEGER) AS rank, key, name, score, field, matched FROM r QUALIFY row_number() OVER (PARTITION BY given ORDER BY score DESC, name, key) <= {k}"""


@query(_ranked_sql(10))
def ranked_terms(spark, sf_dir):
    """The ten best drugs and procedures of every term, over all fourteen fields: a top-k report of each term."""
    entries, terms = _entries(spark, sf_dir)
    return batch_search.batch_search(entries, "key", "shown", batch_search.ALL_FIELDS, terms, "term", 10, "first_choice")


_HALF_SPELT = """SELECT p_name AS term FROM part UNION SELECT concat(substr(p_name, 1, 2), 'x', substr(p_name, 4)) FROM part UNION SELECT concat(substr(p_name, 1, 3), substr(p_name, 5), ' ') FROM part
UNION SELECT concat(substr(p_name, 1, 1), 'zz', substr(p_name, 2)) FROM part UNION SELECT substr(p_name, 1, 4) FROM part UNION SELECT concat('q', substr(p_name, 2, 3)) FROM part UNION SELECT upper(concat(split_part(p_name, ' ', 2), 's ', split_part(p_name, ' ', 1))) FROM part"""


@query(
    f"""WITH e AS (SELECT p_partkey, p_name, concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS alias FROM part), t AS (SELECT DISTINCT term, lower(trim(term)) AS q FROM ({_HALF_SPELT})),
h AS (SELECT term, p_partkey, p_name, CASE WHEN p_name = q THEN 100 WHEN starts_with(p_name, q) THEN 95 WHEN contains(p_name, q) THEN 50 ELSE 0 END AS a, CASE WHEN alias = q THEN 100 WHEN starts_with(alias, q) THEN 90 WHEN contains(alias, q) THEN 48 ELSE 0 END AS b, alias FROM t JOIN e ON contains(p_name, q) OR contains(alias, q)),
r AS (SELECT term, p_partkey, p_name AS name, greatest(a, b) AS score, CASE WHEN a >= b THEN 'name' ELSE 'alias' END AS field, CASE WHEN a >= b THEN p_name ELSE alias END AS matched FROM h),
n AS (SELECT term, p_partkey, p_name AS name, 10 AS score, levenshtein(p_name, q) <= 1 AS by_name, alias FROM t ANTI JOIN r USING (term) JOIN e ON length(q) >= 5 AND (levenshtein(p_name, q) <= 1 OR levenshtein(alias, q) <= 1)),
b AS (SELECT * FROM r UNION ALL SELECT term, p_partkey, name, score, CASE WHEN by_name THEN 'name' ELSE 'alias' END, CASE WHEN by_name THEN name ELSE alias END FROM n)
SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY score DESC, name, p_partkey) AS INTEGER) AS rank, p_partkey, name, score, field, matched FROM b QUALIFY rank <= 10"""
)
def ranked_or_near(spark, sf_dir):
    """The ten best parts of every term by name and by name turned round, and near misses where a term has no hit: a top-k report of each term."""
    part = table(spark, sf_dir, "part")
    entries = part.selectExpr("p_partkey", "p_name AS name", "array(concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))) AS aliases")
    terms = spark.sql(_HALF_SPELT.replace("FROM part", "FROM {part}"), part=part)
    fields = [f for f in search.DRUG_FIELDS if f.column in ("name", "aliases")]
    hits = batch_search.batch_search(entries, "p_partkey", "name", fields, terms, "term")
    return batch_search.near_where_none(hits, entries, "p_partkey", "name", fields, terms, "term")
