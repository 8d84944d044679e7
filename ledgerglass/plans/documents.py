"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textnorm
from ..operators import aggregates, clauses, diffing, dosage, gates, keywords, mentions, scans, tables
from .registry import query, table


@query("SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, s[1] AS first_sentence, s[-1] AS last_sentence FROM (SELECT doc_id, list_filter([trim(x) FOR x IN regexp_extract_all(text, '[^.!?\\n]+[.!?]?|[.!?]')], lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = diffing.sentences(F.col("text"), r"(?<=[.!?])|\n+")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"), F.try_element_at("s", F.lit(-1)).alias("last_sentence"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(The|Le|Der|El) ') THEN 1 WHEN regexp_matches(line, '^\\s*[A-C]') THEN 2 END AS level FROM l WHERE trim(line) <> ''),
c AS (SELECT *, sum(CAST(level IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no) AS idx FROM k)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(coalesce(arg_min(level, no) FILTER (WHERE level IS NOT NULL), 0) AS INTEGER) AS level, string_agg(line, chr(10) ORDER BY no) AS text FROM c GROUP BY doc_id, idx"""
)
def clause_split(spark, sf_dir):
    markers = [(1, r"^\s*(The|Le|Der|El) "), (2, r"^\s*([A-C])")]
    return clauses.split_clauses(table(spark, sf_dir, "documents"), "doc_id", "text", markers).select("doc_id", "idx", "level", "text")


@query(
    """WITH k AS (SELECT doc_id, text, unnest(range(length(text))) AS p FROM documents WHERE contains(text, ' was')),
h AS (SELECT doc_id, text, p FROM k WHERE substr(text, p + 1, 4) = ' was'),
g AS (SELECT doc_id, min(p) AS pos FROM h WHERE NOT contains(substr(text, CAST(greatest(p - 6, 0) + 1 AS BIGINT), CAST(least(p, 6) AS BIGINT)), 'th') GROUP BY doc_id)
SELECT doc_id, pos IS NOT NULL AS flagged, CAST(pos AS INTEGER) AS pos, CASE WHEN pos IS NOT NULL THEN trim(replace(substr(text, greatest(pos - 22, 0) + 1, pos + 26 - greatest(pos - 22, 0)), chr(10), ' ')) END AS quote FROM documents LEFT JOIN g USING (doc_id)"""
)
def keyword_flags_negation(spark, sf_dir):
    """The first ` was` with no `th` in the six characters before it."""
    d = clauses.extract_flags(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", {"flagged": [" was"]}, ["th"])
    return d.select("doc_id", "flagged", F.col("flagged_ev.pos").alias("pos"), F.col("flagged_ev.quote").alias("quote"))


@query(
    """WITH t AS (SELECT doc_id, lower(text) AS text FROM documents), n AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{6,12})', 1)) AS name FROM benchmark)
SELECT doc_id, name FROM t JOIN n ON name <> '' AND regexp_matches(text, '(^|[^a-z])' || name || '([^a-z]|$)')"""
)
def mention_matrix(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "([A-Za-z]{6,12})", 1)).alias("name")).where("name <> ''").distinct()
    return mentions.mention_matrix(table(spark, sf_dir, "documents"), "doc_id", "text", names, "name")


@query(
    """WITH s AS (SELECT doc_id AS code, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS text FROM documents), n AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{6,12})', 1)) AS name FROM benchmark),
m AS (SELECT name, code, regexp_matches(title, '(^|[^a-z])' || name || '([^a-z]|$)') AS listed FROM s JOIN n ON name <> '' AND regexp_matches(text, '(^|[^a-z])' || name || '([^a-z]|$)'))
SELECT name, count(*) FILTER (WHERE listed) AS n_listed, count(*) FILTER (WHERE NOT listed) AS n_referenced FROM m GROUP BY name"""
)
def mention_index(spark, sf_dir):
    """How many texts have a name in their first line, their title, and how many only after it."""
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "([A-Za-z]{6,12})", 1)).alias("name")).where("name <> ''").distinct()
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code"), F.substring_index("text", "\n", 1).alias("title"), "text")
    found = mentions.listed_or_referenced(sections, names, "name")
    return found.groupBy("name").agg(F.count_if("listed").alias("n_listed"), F.count_if(~F.col("listed")).alias("n_referenced"))


@query(
    r"""WITH q AS (SELECT doc_id, text, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(text, '[^.\n]+[.\n]?')], lambda x: length(x) >= 6 AND contains(x, 'idiot')) AS q FROM documents)
SELECT doc_id, len(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '[\s.,;]', '', 'g')) >= 40 AS substantive,
CAST(CASE WHEN len(q) = 1 AND regexp_replace(q[1], '[。；;]+$', '') = regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[。；;]+$', '') THEN 0 ELSE len(q) END AS INTEGER) AS n_quotes FROM q"""
)
def adjust_quotes(spark, sf_dir):
    """Sentences with a word, from texts of some substance; none where the text is nothing but that sentence."""
    t = F.col("text")
    body = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", ""), r"[\s.,;]", "")
    quotes = dosage.adjust_quotes(t, "idiot", r"[^.\n]+[.\n]?")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(body) >= 40).alias("substantive"), F.size(quotes).alias("n_quotes"))


@query(
    r"""WITH x AS (SELECT lang, text, lower(regexp_replace(text, '[\s。，、；：.,;:]+', '', 'g')) AS norm, doc_id FROM documents),
g AS (SELECT lang, norm, count(*) AS n, arg_max(text, (length(text), -doc_id)) AS text, min(doc_id) AS first_seen FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_seen) AS rank FROM g)
SELECT lang, md5(norm) AS norm, md5(text) AS text, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4"""
)
def indication_topk(spark, sf_dir):
    """The four commonest texts of each language, without regard to punctuation, white space and case."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text", F.lit(0).alias("state"))
    norm = F.lower(F.regexp_replace("text", r"[\s。，、；：.,;:]+", ""))
    out = aggregates.common_texts(d, ["lang"], "text", norm, "state", "doc_id")
    return out.select("lang", F.md5(F.col("norm").cast("binary")).alias("norm"), F.md5(F.col("text").cast("binary")).alias("text"), "n", "rank")


@query(
    """WITH x AS (SELECT lang, md5(text) AS text, source AS licence_no, doc_id FROM documents),
f AS (SELECT lang, text, licence_no, min(doc_id) AS seen FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY seen) AS k FROM f),
c AS (SELECT lang, text, count(*) AS n_products FROM x GROUP BY ALL)
SELECT c.lang AS inn, c.text AS quote_id, n_products, (SELECT string_agg(licence_no, ',' ORDER BY k) FROM r WHERE r.lang IS NOT DISTINCT FROM c.lang AND r.text = c.text AND k <= 6) AS licences FROM c"""
)
def label_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("lang").alias("inn"), F.md5(F.col("text").cast("binary")).alias("text"), F.col("source").alias("licence_no"), F.lit("b").alias("brand"), F.col("doc_id").alias("ordinal"))
    return dosage.label_dosage(rows).select("inn", F.col("text").alias("quote_id"), "n_products", F.array_join("licences", ",").alias("licences"))


#: Texts with what the patterns look for, and near misses: a number of a notice is no telephone number.
_TYPED = [
    (-1, "A123456789 is an id, XA123456789 is none"), (-2, "call 0912-345-678 or 0912 345 679"), (-3, "文號第0930060063號"), (-4, "病歷號：A12345"), (-5, "病歷號碼："), (-6, "出生日期：86/9/1"),
    (-7, "出生日期："), (-8, "write to someone@example.org, or other@example.org"), (-9, "key sk-" + "a1B2" * 6), (-10, "ghp_" + "x9" * 12), (-11, "github_pat_" + "y_8" * 8), (-12, "sk-short"), (-13, "-----BEGIN RSA PRIVATE KEY-----"), (-14, "nothing here"),
]
_WITH_TYPED = "t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _TYPED) + ") v(doc_id, text))"


def _with_typed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(_TYPED, "doc_id long, text string"))


def _found(kind: str, pattern: str, group: int = 1) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, substr(regexp_extract(text, '{pattern}', {group}), 1, 40) AS found FROM t WHERE regexp_matches(text, '{pattern}')"


_PERSONAL_SQL = [
    _found("national_id", r"(^|[^A-Za-z0-9])([A-Z][12]\d{8})([^0-9]|$)", 2), _found("mobile", r"(^|[^第\d])(09\d{2}[- ]?\d{3}[- ]?\d{3})([^\d號]|$)", 2), _found("record_number", r"(病歷號碼?\s*[：:]\s*[A-Za-z0-9]{4,})"),
    _found("birth_date", r"(出生日期\s*[：:]\s*\d{2,4}[/年-]\d{1,2})"), _found("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
]
_SECRET_SQL = [_found("api_key", r"(ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,})"), _found("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)")]


@query(f"WITH {_WITH_TYPED} " + " UNION ALL ".join(_PERSONAL_SQL))
def pii_scan(spark, sf_dir):
    return scans.scan(_with_typed(spark, sf_dir), "doc_id", "text", {k: scans.PATTERNS[k] for k in scans.PERSONAL})


@query(f"WITH {_WITH_TYPED} " + " UNION ALL ".join(_SECRET_SQL))
def secret_scan(spark, sf_dir):
    return scans.scan(_with_typed(spark, sf_dir), "doc_id", "text", {k: scans.PATTERNS[k] for k in scans.SECRET})


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scans.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN contains(lower(html), t) THEN t END FOR t IN ['<script', 'javascript:', 'eval(', 'document.cookie']], lambda x: x IS NOT NULL), ',') AS denied FROM pages")
def denied_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(scans.denied_tokens(F.col("html")), ",").alias("denied"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc FROM documents")
def nfc_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(textnorm.nfc("text").cast("binary")).alias("nfc"))


@query("SELECT doc_id, md5(nfc_normalize(text)) = md5(text) AS unchanged, regexp_matches(text, '[?？□�]') AS mojibake FROM documents")
def mojibake(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", textnorm.is_nfc("text").alias("unchanged"), textnorm.has_mojibake("text").alias("mojibake"))


@query("SELECT p_partkey, lower(p_name) || ' ab1' AS term, CAST(length(p_name) + 8 AS INTEGER) AS width FROM part")
def nfkc_query(spark, sf_dir):
    """A name with full-width letters after it, which become plain ones and are two columns wide each."""
    name = F.concat("p_name", F.lit("　ＡＢ１"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(textnorm.nfkc(name)).alias("term"), textnorm.display_width(name).alias("width"))


@query("SELECT p_partkey, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(lower(p_type), ' ')], ' ') AS shown FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", textnorm.title_case(F.lower("p_type")).alias("shown"))


def _two_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("old"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A new first sentence. "), "text")).otherwise(F.col("text")).alias("new"))


@query(
    r"""WITH n AS (SELECT doc_id, len(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(replace(coalesce(text, ''), '.', '。'), '[^。；：！？\n]*[。；：！？]|[^。；：！？\n]+')], lambda x: x <> '')) AS n, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 1 ELSE 0 END AS a FROM documents)
SELECT doc_id, CAST(a AS INTEGER) AS sent_added, CAST(0 AS INTEGER) AS sent_removed, CAST(n AS INTEGER) AS sent_equal, round_even(a / greatest(2.0 * (n + a), 2.0), 4) AS change_ratio, CAST(a AS INTEGER) AS n_hunks FROM n"""
)
def sentence_diff(spark, sf_dir):
    """A sentence more in every third text; sentences end with a full stop here."""
    rows = _two_versions(spark, sf_dir)
    ideographic = lambda c: F.replace(F.col(c), F.lit("."), F.lit("。"))
    return rows.select("doc_id", diffing.sentence_diff(ideographic("old"), ideographic("new")).alias("d")).select("doc_id", "d.sent_added", "d.sent_removed", "d.sent_equal", "d.change_ratio", F.size("d.hunks").alias("n_hunks"))


@query()
def coverage(spark, sf_dir):
    """How much of a text is left when its second half comes first and a line in front has gone; a text of one line is cut in its middle."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("l")).withColumn("h", F.floor(F.size("l") / 2).cast("int"))
    kept = F.concat(F.slice("l", F.col("h") + 1, F.size("l")), F.slice("l", 1, F.least("h", F.lit(1))), F.slice("l", 3, F.greatest(F.col("h") - 2, F.lit(0))))
    half = F.floor(F.length("text") / 2).cast("int")
    turned = F.concat(F.substring(F.col("text"), half + 1, F.length("text")), F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 3).cast("int")))
    return d.select("doc_id", clauses.coverage("text", F.when(F.col("h") > 0, F.array_join(kept, "\n")).otherwise(turned)).alias("coverage"))


#: Rules as they are written, with and without negators, at both ends of a negator's reach, with words that begin alike.
_RULES = [
    "須經事前審查核准後使用。", "本品不需事前審查。", "免經事前審查；惟專案申請者仍須事前審查。", "擇一使用，不得併用。", "每一療程以三個月為限，每年最多兩個療程。", "檢附病人同意書，無須同意書者除外。", "非經專案審查不得合併使用。", "不必另檢附同意書", "無需擇一　擇一使用",
    "半年內不得重複申請\t專案申請", "毋須經過長時間的事前審查", "毋須經過的事前審查", "不得合併使用：不得併用", "此條無任何規定。",
]
_QUOTED = ", ".join(f"'{r}'" for r in _RULES)
_RULED = "concat(substr(text, 1, 10 * (abs(doc_id) % 7)), {rules}, substr(text, 10 * (abs(doc_id) % 7) + 1))"
_FLAG_WORDS = [(f, i, w) for f, ws in clauses.FLAGS.items() for i, w in enumerate(ws)]


@query(
    rf"""WITH d AS (SELECT doc_id, {_RULED.format(rules=f'[{_QUOTED}][CAST(abs(doc_id) % {len(_RULES)} AS INTEGER) + 1]')} AS t FROM documents WHERE text IS NOT NULL),
g(flag, ord, kw) AS (VALUES {', '.join(f"('{f}', {i}, '{w}')" for f, i, w in _FLAG_WORDS)}),
s AS (SELECT doc_id, t, flag, ord, kw, string_split(t, kw) AS parts FROM d JOIN g ON contains(t, kw)),
o AS (SELECT doc_id, t, flag, ord, kw, CAST(list_sum([length(x) FOR x IN parts[1:k]]) + (k - 1) * length(kw) AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM s)),
n AS (SELECT * FROM o WHERE len(list_filter({clauses.NEGATIONS!r}, lambda x: contains(substr(t, greatest(pos - 6, 0) + 1, least(pos, 6)), x))) = 0)
SELECT doc_id, flag, kw, CAST(pos AS INTEGER) AS pos, regexp_replace(replace(substr(t, greatest(pos - 22, 0) + 1, least(pos, 22) + length(kw) + 22), chr(10), ' '), '^[\s　]+|[\s　]+$', '', 'g') AS quote FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, flag ORDER BY ord, pos) = 1"""
)
def keyword_scan(spark, sf_dir):
    """The six groups of keywords in texts that have a rule put in, with negators: all words in one scan of each text."""
    rules = f"element_at(array({_QUOTED}), CAST(abs(doc_id) % {len(_RULES)} AS INT) + 1)"
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", _RULED.format(rules=rules).replace("10 * (abs(doc_id) % 7)", "CAST(10 * (abs(doc_id) % 7) AS INT)") + " AS t")
    found = keywords.extract_flags_scan(d, "t")
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"{f}_ev").alias("ev")) for f in clauses.FLAGS))).alias("r")
    return found.select("doc_id", rows).where("r.ev IS NOT NULL").select("doc_id", "r.flag", "r.ev.kw", "r.ev.pos", "r.ev.quote")


_NAMES = "SELECT DISTINCT lower(x) AS name FROM (SELECT regexp_extract(text, '([A-Za-z]{3,9} [a-z]{3,9})', 1) AS x FROM benchmark UNION ALL SELECT regexp_extract(text, '([A-Za-z]{6,12})', 1) FROM benchmark UNION ALL SELECT regexp_extract(text, '([a-z]+, [a-z]+)', 1) FROM benchmark UNION ALL SELECT * FROM (VALUES ('co-trimoxa-zole (oral)'), ('甲氨蝶呤注射液'), ('short')) v(x)) WHERE x <> ''"
_MENTIONING = "SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'Cotrimoxazole, or CO-TRIMOXA-ZOLE'), (-2, 'xco-trimoxa-zole cotrimoxazoles'), (-3, '曾使用甲氨蝶呤注射液無效'), (-4, 'short')) v(doc_id, text)"


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS text FROM ({_MENTIONING})), n AS ({_NAMES}), b AS (SELECT name, split_part(name, ' (', 1) AS base FROM n),
v AS (SELECT name, base AS v FROM b UNION SELECT name, replace(base, '-', '') FROM b)
SELECT DISTINCT doc_id, name FROM t JOIN v ON length(v) >= 6 AND contains(text, v) AND regexp_matches(text, '(^|[^a-z])' || v || '([^a-z]|$)')"""
)
def mention_scan(spark, sf_dir):
    """Names of one word and of two, with hyphens and in Han, that texts mention, from one scan of each."""
    t = {k: table(spark, sf_dir, k) for k in ("documents", "benchmark")}
    docs = spark.sql(_MENTIONING.replace("FROM documents", "FROM {documents}"), documents=t["documents"])
    names = spark.sql(_NAMES.replace("{", "{{").replace("}", "}}").replace("FROM benchmark", "FROM {benchmark}"), benchmark=t["benchmark"])
    return keywords.mention_scan(docs, "doc_id", "text", names, "name")


@query()
def rejoin_lines(spark, sf_dir):
    """Texts broken after every 60 characters, put together by their own lines."""
    d = table(spark, sf_dir, "documents")
    broken = F.regexp_replace("text", "([^\\n]{60})", "$1\n")
    return d.select("doc_id", textnorm.strip(tables.rejoin(broken, F.split("text", "\n"))).alias("joined")).select("doc_id", F.size(F.split("joined", "\n")).alias("n_lines"))


@query()
def table_splice(spark, sf_dir):
    """The first four long words of a text's first line as a table of two rows; a text with fewer has no table."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.filter(F.split(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), " "), lambda x: F.length(x) > 3))
    grid = F.array(F.array(F.array(F.get("w", 0), F.get("w", 1)), F.array(F.get("w", 2), F.get("w", 3))))
    n = F.when(F.size("w") >= 4, 1).otherwise(0)
    out = d.select("doc_id", n.alias("n"), tables.splice_tables("text", F.when(n == 1, grid).otherwise(F.array().cast("array<array<array<string>>>"))).alias("s"))
    return out.select("doc_id", F.size("s.placed").alias("placed"), F.size(tables.marked_tables(F.col("s.text"))).alias("marked"), F.size(tables.unplaced_tables(F.col("s.text"), F.col("n"))).alias("left"))


@query("SELECT doc_id, contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(substr(text, 10, 30), '\\s+', '', 'g')) AS verbatim FROM documents")
def verbatim_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.verbatim(F.substring("text", 10, 30), F.col("text")).alias("verbatim"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT *, length(trim(line)) BETWEEN 1 AND 40 AS short FROM l), g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, short ORDER BY no) AS island FROM s),
r AS (SELECT doc_id, count(*) AS n FROM g WHERE short GROUP BY doc_id, island)
SELECT doc_id, coalesce(max(n), 0) >= 2 AS fragments FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id"""
)
def fragment_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.fragment_run(F.col("text"), 2, 40).alias("fragments"))


@query("SELECT conv_id, CAST(coalesce(max(CASE WHEN role = 'user' AND turn <= f THEN turn END), f, 0) AS BIGINT) AS start FROM (SELECT *, min(CASE WHEN contains(text, 'the') THEN turn END) OVER (PARTITION BY conv_id) AS f, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n > 3 GROUP BY conv_id, f UNION ALL SELECT conv_id, 0 FROM conversations GROUP BY conv_id HAVING count(*) <= 3")
def relevant_start(spark, sf_dir):
    """Turns as clauses; the user's are of level 1."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "user", 1).otherwise(2).alias("level"), "text")
    return clauses.relevant_start(c, "conv_id", F.contains("text", F.lit("the"))).select("conv_id", F.col("start").cast("bigint").alias("start"))


@query("SELECT conv_id, turn AS idx, CASE WHEN role = 'user' THEN turn ELSE max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) END AS block FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn)")
def dosage_blocks(spark, sf_dir):
    """A user's turn heads a block of the turns after it; of a turn's roles the first by name counts."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").cast("int").alias("idx")).agg(F.min("role").alias("role"))
    c = c.withColumn("level", F.when(F.col("role") == "user", 1).otherwise(2))
    return dosage.dosage_blocks(c, "conv_id", F.col("role") == "user").select("conv_id", F.col("idx").cast("bigint").alias("idx"), F.col("block").cast("bigint").alias("block"))


@query(
    """WITH l AS (SELECT conv_id, turn, min(rtrim(text)) AS text FROM conversations GROUP BY conv_id, turn), s AS (SELECT conv_id, sum(length(text)) AS size, count(*) AS n FROM l GROUP BY conv_id)
SELECT conv_id, size < 10 AS is_stub, FALSE AS has_children, size < 10 AS title_is_rule, conv_id % 2 = 1 AS is_future FROM s"""
)
def section_states(spark, sf_dir):
    """Conversations as sections, turns as their clauses."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.rtrim("text")).alias("text"))
    code = F.concat(F.col("conv_id").cast("string"), F.lit("."))
    sections = c.select("conv_id").distinct().select(code.alias("code"), F.when(F.col("conv_id") % 2 == 1, "2030-01-01").otherwise("2020-01-01").alias("effective"))
    out = clauses.section_states(sections, c.select(code.alias("code"), "text"), "2024-01-01")
    return out.select(F.rtrim(F.translate("code", ".", " ")).cast("bigint").alias("conv_id"), "is_stub", "has_children", "title_is_rule", "is_future")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents)
SELECT doc_id, count(*) AS n_clauses, CAST(max(idx) AS INTEGER) AS last_idx, CAST(sum(length(t)) AS BIGINT) AS visible, sum(length(t)) < 300 AS notice FROM (SELECT doc_id, idx, regexp_replace(line, '\s+$', '') AS t FROM l) WHERE t <> '' GROUP BY doc_id"""
)
def annex_paragraphs(spark, sf_dir):
    """Texts as annexes: a clause for each line, and whether they show so little that they must be drawings."""
    p = clauses.annex_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, grid array<array<string>>")
    notice = clauses.image_notice(p, none, "doc_id")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max("idx").alias("last_idx")).join(notice, "doc_id").select("doc_id", "n_clauses", "last_idx", "visible", "notice")


