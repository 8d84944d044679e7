"""Near names, ranked search of many terms, the keyword automaton and matching blocks, against plain Python."""

import difflib
import random
import re
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerglass.operators import batch_search, clauses, keywords, matching, mentions, near_names, search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# --- near names


def near_rows(spark, names, terms, **how):
    n = spark.createDataFrame(list(enumerate(names)), "key int, name string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    return sorted(tuple(r)[:2] for r in near_names.near_names(n, "key", "name", t, "term", **how).collect())


def test_near_names_against_edit_distance(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé中") for _ in range(n))
    names = [word(r.randint(3, 8)) for _ in range(150)] + ["", None, "aaaaa", "aaaaaa", "aaaaaaa", "aaaaa"]
    terms = sorted({word(r.randint(4, 7)) for _ in range(80)} | {"aaaaaa", "aaaaaaaa"}) + [None, "", "aaaa"]
    want = sorted((t, i) for t in terms if t and len(t) >= 5 for i, n in enumerate(names) if n and distance(n, t) <= 1)
    assert near_rows(spark, names, terms) == want
    ahead = lambda n, t: abs(len(n) - len(t)) <= 2 and distance(n[: len(t) + 1], t) <= 1
    assert near_rows(spark, names, terms, ahead=True) == sorted((t, i) for t in terms if t and len(t) >= 5 for i, n in enumerate(names) if n and ahead(n, t))


def test_near_names_rules(spark):
    """Case and spaces do not count, two characters changed over are two edits, four characters are too few, repeated rows stay."""
    names = ["Valaciclovir", "valaciclovir", "VALA  CICLOVIR", "Acic", "Tacrolimus"]
    got = near_rows(spark, names, ["VALACICLOVIR", "valacicloviir", "valaciclovri", "acic", " vala ciclovir", "tacrolimu"])
    assert got == sorted([("VALACICLOVIR", 0), ("VALACICLOVIR", 1), ("VALACICLOVIR", 2), ("valacicloviir", 0), ("valacicloviir", 1), (" vala ciclovir", 0), (" vala ciclovir", 1), (" vala ciclovir", 2), ("tacrolimu", 4)])


def test_near_names_are_met_by_equality(spark):
    """No pair of a name and a term is made but on a posting that they share."""
    n = spark.createDataFrame([(1, "abcdef")], "key int, name string")
    t = spark.createDataFrame([("abcdeg",)], "term string")
    plan = near_names.near_names(n, "key", "name", t, "term")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("=" in x for x in joins)


# --- ranked search


def plain_hits(entry, q, fields):
    """Scores of one entry as the rules state them, one value after another."""
    best = (0, None, None)
    for f in fields:
        for v in entry.get(f.column) or []:
            h = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v).lower()).strip(" ")
            if not h:
                continue
            score = f.exact if h == q else f.prefix if h.startswith(q) else f.inside if q in h else 0
            if f.label == "section" and h.rstrip(".") == q.rstrip("."):
                score = f.exact
            if f.label == "code" and h.startswith(q) and h != q and len(q) < 3:
                score = 0
            if score > best[0]:
                best = (score, f.label, v[:40] if f.label == "note" else v)
    return best


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 10), (3, 1)])
def test_batch_search_against_plain_scoring(spark, seed, k):
    r = random.Random(seed)
    fields = batch_search.ALL_FIELDS
    word = lambda: "".join(r.choice("ab12. 中") for _ in range(r.randint(1, 6)))
    entries = []
    for i in range(60):
        e = {"key": f"k{i:02d}", "primary": r.random() < 0.4}
        for f in fields:
            e[f.column] = [word() for _ in range(r.choice([0, 1, 2]) if f.many else 1)] if r.random() < 0.4 else None
        entries.append(e)
    entries[0]["procedure_name"] = ["Ａｂ１　２"]  # full width
    entries[1]["aliases"] = [None, "", " ab ", "ab"]
    terms = sorted({word() for _ in range(40)} | {"a", "AB", "12.", "12", "1", " a  b ", "ab1 2", "中", "nothing at all", ""}) + [None]
    schema = "key string, primary boolean, shown string, " + ", ".join(f"{f.column} {'array<string>' if f.many else 'string'}" for f in fields)
    shown = lambda e: (e["name"] or e["procedure_name"] or [None])[0]
    rows = [(e["key"], e["primary"], shown(e), *((e[f.column] if f.many or e[f.column] is None else e[f.column][0]) for f in fields)) for e in entries]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for x in batch_search.batch_search(df, "key", "shown", fields, spark.createDataFrame([(t,) for t in terms], "term string"), "term", k, "primary").collect():
        got.setdefault(x.term, []).append((x["rank"], x.key, x.score, x.field, x.matched))
    want = {}
    for t in terms:
        q = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()
        found = []
        for e in entries if q else []:
            score, field, matched = plain_hits({**e, "aliases": [v for v in e["aliases"] or [] if v is not None]}, q, fields)
            if score:
                found.append((-(score + e["primary"]), shown(e) or "", e["key"], field, matched))
        if found:
            want[t] = [(i + 1, x[2], -x[0], x[3], x[4]) for i, x in enumerate(sorted(found)[:k])]
    assert {t: sorted(v) for t, v in got.items()} == want


def test_batch_search_as_single_searches(spark):
    """One term at a time, `search.search` gives the same scores."""
    rows = [(f"k{i}", n, [b], [s]) for i, (n, b, s) in enumerate([("acyclovir", "Zovirax", "10.7.1.1."), ("valaciclovir", "Valtrex", "10.7.1.1."), ("isotretinoin", "Roaccutane", "13.4."), ("tretinoin", "Airol", "13.40."), ("ketoconazole", "Nizoral", "13.4.1.")])]
    df = spark.createDataFrame(rows, "key string, name string, brands_en array<string>, sections array<string>")
    fields = [f for f in search.DRUG_FIELDS if f.column in ("name", "brands_en", "sections")]
    terms = ["13.4", "13.4.", "tretinoin", "VAL", "clovir", "zovirax", "0"]
    got = {(r.term, r.key, r.score, r.field) for r in batch_search.batch_search(df, "key", "name", fields, spark.createDataFrame([(t,) for t in terms], "term string"), "term").collect()}
    assert got == {(t, r.key, r.score, r.field) for t in terms for r in search.search(df, t, fields).collect()}
    assert {(k, s) for t, k, s, _ in got if t == "13.4"} == {("k2", 60), ("k3", 60), ("k4", 60)}


# --- keywords


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab審查", min_size=1, max_size=4), min_size=1, max_size=10, unique=True), st.lists(st.one_of(st.none(), st.text("ab審查x", max_size=40)), min_size=1, max_size=5), st.integers(0, 2))
def test_automaton_finds_every_occurrence(words, texts, how):
    cells, block = keywords.CELLS, keywords.BLOCK
    try:
        keywords.CELLS, keywords.BLOCK = [(cells, block), (12, block), (cells, 30)][how]  # several automata, several blocks
        got = [(f.first + int(t), words[w], int(p - f.begin[t])) for f in keywords.Matcher(words).find(texts) for t, w, p in zip(f.text, f.word, f.place, strict=True)]
    finally:
        keywords.CELLS, keywords.BLOCK = cells, block
    want = [(i, w, m.start()) for i, x in enumerate(texts) for w in words for m in re.finditer(f"(?={re.escape(w)})", x or "")]
    assert sorted(got) == sorted(want)


def test_automaton_over_pieces_of_a_long_text():
    r = random.Random(4)
    words = ["ab" * 40, "ba", "a" * 300, "审查事前" * 3]
    text = "".join(r.choice([*words, "x", "b"]) for _ in range(3000))
    got = sorted((words[w], int(p - f.begin[t])) for f in keywords.Matcher(words).find([text]) for t, w, p in zip(f.text, f.word, f.place, strict=True))
    assert got == sorted((w, m.start()) for w in words for m in re.finditer(f"(?={re.escape(w)})", text))


FLAGGED = [
    "須經事前審查核准後使用", "不需事前審查", "免經事前審查；惟專案申請者仍須事前審查", "擇一使用，不得併用", "擇一；擇一使用", "無需擇一 擇一", "每一療程，每年", "檢附同意書", "不必另檢附同意書", "不必再另行檢附同意書", "非經專案審查", "專案申請不必專案審查", "半年內", "　\t療程\n療程　", "", None,
    "限皮膚科專科醫師及限風濕免疫科專科醫師使用，詳附表十、附表二十二之一", "療" * 30 + "療程" + "程" * 30,
]


def test_flags_as_one_word_at_a_time(spark):
    """The six groups of keywords, and words that overlap themselves, in either way of searching."""
    d = spark.createDataFrame(list(enumerate(FLAGGED)), "k int, t string")
    cases = [(clauses.FLAGS, clauses.NEGATIONS), ({"twice": ["aa", "aba"], "none": ["zz"]}, ["n", "no"])]
    more = spark.createDataFrame([(i, x) for i, x in enumerate(["aaa", "naaa", "nxxxxxxaaa", "ababa", "noababa", "x n aa aa aa aa", "a" * 50 + "n" + "a" * 9])], "k int, t string")
    for df, (flags, negations) in zip((d, more), cases, strict=True):
        columns = ["k", *flags, *(f"{f}_ev" for f in flags), "specialist_only", "attachments"]
        got, want = (sorted(map(tuple, x(df, "t", flags, negations).select(*columns).collect())) for x in (keywords.extract_flags_scan, clauses.extract_flags))
        assert got == want
    first = {r.k: r for r in keywords.extract_flags_scan(d, "t").collect()}
    assert first[1].prior_review is False and first[2].prior_review_ev.pos == 15 and first[2].special_case_ev.kw == "專案申請"
    assert first[4].no_combination_ev.kw == "擇一使用" and first[5].no_combination is False  # an earlier word of a group wins over an earlier place
    assert first[8].consent_form is False and first[9].consent_form is True  # a negator counts in the six characters before
    assert first[13].course_limited_ev.quote == "療程 療程"


def test_mentions_as_by_words(spark):
    docs = [(1, "Methotrexate and ISOTRETINOIN"), (2, "tretinoin, not isotretinoin"), (3, "co-trimoxazole; cotrimoxazole2"), (4, "xmethotrexate methotrexates"), (5, None), (6, "gold sodium thiomalate 甲氨蝶呤注射液"), (6, "methotrexate"), (7, "gold sodium thiomalateß")]
    names = ["methotrexate", "isotretinoin", "tretinoin", "co-trimoxazole (oral)", "gold sodium thiomalate", "urea", "甲氨蝶呤注射液", None, "Methotrexate"]
    d, n = spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(r) for r in keywords.mention_scan(d, "k", "t", n, "name").collect()}
    by_words = {tuple(r) for r in mentions.mention_matrix(d, "k", "t", n.where("name IS NOT NULL"), "name").collect()}
    assert got == by_words | {(6, "甲氨蝶呤注射液")}
    assert {k for k, x in got if x == "tretinoin"} == {2} and {k for k, x in got if x == "co-trimoxazole (oral)"} == {3}


def test_mentions_of_many_names(spark, monkeypatch):
    d = spark.createDataFrame([(1, "alphabet betamax"), (2, "gammaray")], "k int, t string")
    n = spark.createDataFrame([(x,) for x in ("alphabet", "betamax", "gammaray", "deltawing")], "name string")
    monkeypatch.setattr(keywords, "VOCABULARY", 9)
    assert {tuple(r) for r in keywords.mention_scan(d, "k", "t", n, "name").collect()} == {(1, "alphabet"), (1, "betamax"), (2, "gammaray")}
    assert keywords.mention_scan(d, "k", "t", n.limit(0), "name").count() == 0


# --- matching blocks


def joined(blocks):
    out = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def plain_blocks(a, b):
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
def test_blocks_of_short_texts(a, b):
    assert joined(matching.matching_blocks(a, b)) == plain_blocks(a, b)


def test_blocks_of_rearranged_texts():
    """By samples, by the automaton, and by both."""
    r = random.Random(7)
    sampled = 0
    for t in range(300):
        letters = "ab" if t % 4 == 0 else "abcdefghijklmnop療程審查"
        parts = ["".join(r.choice(letters) for _ in range(r.choice([4, 20, 60, 150]))) for _ in range(r.randint(1, 10))]
        a = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        b = "".join(x if r.random() < 0.8 else x[: len(x) // 2] + "Z" for x in r.choices(parts, k=r.randint(1, 12)))
        assert joined(matching.matching_blocks(a, b)) == plain_blocks(a, b)
        if (x := matching._longest_by_samples(a, b)) is not None:
            sampled += 1
            assert x == matching.SuffixAutomaton(b).longest(a)
    assert sampled > 100


def test_long_texts_without_line_breaks():
    """10^5 characters: rearranged, of few letters, unlike, and with a difference in every line."""
    r = random.Random(8)
    began = time.time()
    for letters in ([chr(0x4E00 + i) for i in range(900)], "ab", "etaoin shrdlu"):
        a = "".join(r.choice(letters) for _ in range(100_000))
        pieces = [a[i : i + 500] for i in range(0, len(a), 500)]
        r.shuffle(pieces)
        assert 0 < sum(n for *_, n in matching.matching_blocks(a, "".join(pieces))) < len(a)
    lines = "".join(f"{i:05d}-line-of-one-length-{i * 7:06d};" for i in range(3000))
    assert sum(n for *_, n in matching.matching_blocks(lines, lines.replace("-line", "_Line"))) == len(lines) - 2 * 3000
    assert matching.matching_blocks("a" * 100_000, "b" * 100_000) == []
    assert time.time() - began < 60


def test_share_is_of_the_whole_text(spark):
    """White space and dotted numbers go first, over line breaks too; a number at the very end stays."""
    def plain(source, parts):
        a, b = (re.sub(r"\d+(?:\.\d+)*\.?(?=[^\d])", "", re.sub(r"\s+", "", unicodedata.normalize("NFKC", x))) for x in (source, parts))
        return sum(m[2] for m in plain_blocks(a, b)) / len(a) if a else 1.0

    r = random.Random(9)
    rows = []
    for _ in range(60):
        lines = ["".join(r.choice("規定 使用療程1.2３．a") for _ in range(r.randint(0, 25))) for _ in range(r.randint(0, 6))]
        kept = r.sample(lines, k=r.randint(0, len(lines)))
        rows.append(("\n".join(lines), "\n".join(kept)))
    rows += [("13.4.\n1\n2 規定", "規定"), ("", "x"), ("12", "12")]
    got = [x.c for x in spark.createDataFrame(rows, "s string, p string").coalesce(1).select(matching.coverage("s", "p").alias("c")).collect()]
    assert got == [round(plain(*x), 4) for x in rows]


def test_coverage_query(spark, sf):
    """Documents with their halves changed over: as the plain comparison of characters, which takes too long for long ones."""
    from ledgerglass.plans import catalogue

    got = {r.doc_id: r.coverage for r in catalogue.QUERIES["coverage"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    some = 0
    for i, t in docs.items():
        if t is None or len(t) > 4000:
            continue
        lines = t.split("\n")
        h = len(lines) // 2
        p = "\n".join(lines[h:] + lines[: min(h, 1)] + lines[2:h]) if h else t[len(t) // 2 :] + t[: len(t) // 3]
        a, b = matching.bare(t), matching.bare(p)
        assert got[i] == (round(sum(m[2] for m in plain_blocks(a, b)) / len(a), 4) if a else 1.0)
        some += 1
    assert some > 100 and len({round(x, 2) for x in got.values()}) > 10


def test_native_evidence_trims_every_white_space(spark):
    ev = spark.createDataFrame([("　\t療程　",)], "t string").select(clauses.flag_evidence("t", ["療程"]).alias("e")).first().e
    assert ev.quote == "療程"
    assert spark.range(1).select(F.size(near_names.deletions(F.lit("aab"))).alias("n")).first().n == 3
