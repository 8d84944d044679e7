"""Literal inputs and what they have to give."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerglass.functions import codes, dates, names, routes, textnorm
from ledgerglass.operators import aggregates, clauses, diffing, dosage, licence, mentions, scans, search, tables
from ledgerglass.streaming import manifest


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, iso", [("115/6/1", "2026-06-01"), ("1150601", "2026-06-01"), ("20260601", "2026-06-01"), ("9991231", None), ("", None), ("29101231", None), (" 86/9/1 ", "1997-09-01"), ("115/13/1", None), ("115/2/31", "2026-02-31")])
def test_roc_dates(spark, text, iso):
    assert value(spark, dates.roc_to_iso("v"), v=text) == iso


def test_revision_dates(spark):
    assert value(spark, dates.revision_dates("v"), v="規定（86/9/1、87/4/1）及(100/1/1說明)（87/4/1）") == ["1997-09-01", "1998-04-01"]


def test_codes(spark):
    assert value(spark, codes.match_prefix("a", "b"), a="8.2.16.", b="8.2.1.") is False
    assert value(spark, codes.match_prefix("a", "b"), a="8.2.1.6", b="8.2.1") is True
    assert value(spark, codes.same_code("a", "b"), a="13.3.3", b="13.3.3.") is True
    assert value(spark, codes.code_tuple("a"), a="13.10.") == [13, 10]
    assert value(spark, codes.code_tuple("a"), a="13.x.") == [9999]
    assert value(spark, codes.ancestors("a"), a="1.2.3.") == ["1.", "1.2.", "1.2.3."]
    assert value(spark, codes.ancestors("a", proper=True), a="1.") == []
    assert tuple(value(spark, codes.parse_file_name("a"), a="13.17.1._20260601.pdf")) == ("13.17.1.", "2026-06-01", None)
    assert tuple(value(spark, codes.parse_file_name("a"), a="5.1_20200102_003.pdf")) == ("5.1.", "2020-01-02", 3)
    assert value(spark, codes.parse_file_name("a"), a="x.pdf") is None
    assert value(spark, codes.split_codes("a"), a="13.17.,13.17.1.,abc, 6.2.9") == ["13.17.", "13.17.1.", "6.2.9."]


@pytest.mark.parametrize("name, key", [("附表二十二之一", (22, 1, "")), ("附表二-A", (2, 0, "A")), ("附表十", (10, 0, "")), ("附表32", (32, 0, "")), ("說明", (999, 999, ""))])
def test_annex_order(spark, name, key):
    assert tuple(value(spark, codes.annex_key("a"), a=name))[:3] == key


VOCABULARY = names.Vocabulary(
    preserve=frozenset({"BETAMETHASONE", "MOMETASONE"}), salts=frozenset({"HCL", "SODIUM", "HYDROCHLORIDE"}), esters=frozenset({"VALERATE", "FUROATE", "PHOSPHATE"}),
    aliases={"ACICLOVIR": "ACYCLOVIR"}, base_atc_ester={"MOMETASONE|D07AC": "FUROATE"},
)


@pytest.mark.parametrize(
    "raw, atc, key",
    [
        ("AMOROLFINE HCL 55.74MG/ML 外用液劑 5.0ML", "", "AMOROLFINE"), ("LYSOZYME10MG", "", "LYSOZYME"), ("SALMETEROL 25 (50) MCG/DOSE", "", "SALMETEROL"),
        ("BETAMETHASONE (VALERATE)", "", "BETAMETHASONE (VALERATE)"), ("BETAMETHASONE VALERATE", "", "BETAMETHASONE (VALERATE)"), ("Betamethasone sodium phosphate 4mg", "", "BETAMETHASONE (PHOSPHATE)"),
        ("MOMETASONE", "D07AC", "MOMETASONE (FUROATE)"), ("ACICLOVIR", "", "ACYCLOVIR"), ("維生素 Vitamins", "", "維生素 VITAMINS"), ("SODIUM", "", "SODIUM"), ("", "", ""),
    ],
)
def test_canonical_names(spark, raw, atc, key):
    assert value(spark, names.canonicalize("r", VOCABULARY, "a"), r=raw, a=atc) == key


def test_components_and_products(spark):
    assert value(spark, names.split_components("a"), a="SENNOSIDE (A+B)") == ["SENNOSIDE (A+B)"]
    assert value(spark, names.split_components("a"), a="X + Y (B+C)+ Z") == ["X", "Y (B+C)", "Z"]
    assert value(spark, names.split_components("a"), a="ALUMINUM BIS (=ALUMINUM + ACETYL") == ["ALUMINUM BIS (=ALUMINUM", "ACETYL"]
    got = value(spark, names.normalize("g", "i", "m", VOCABULARY), g="RIVAROXABAN ，一般錠劑膠囊劑，10mg-20mg", i="", m="")
    assert (got.keys, got.is_combo, got.source, got.warnings) == (["RIVAROXABAN"], False, "group", [])
    got = value(spark, names.normalize("g", "i", "m", VOCABULARY), g="", i="B + A", m="")
    assert (got.combo_key, got.source, got.warnings) == ("A + B", "ingredient", ["fallback_ingredient_field", "mixture_flag_conflict"])
    assert value(spark, names.normalize("g", "i", "m", VOCABULARY), g="", i="", m="").source == "unknown"


def test_stems(spark):
    assert value(spark, names.stem_en("a"), a="VALTREX TABLETS 500MG") == "Valtrex"
    assert value(spark, names.stem_en("a"), a="CELESTODERM-V") == "Celestoderm-V"
    assert value(spark, names.stem_en("a"), a="TABLETS") == "Tablets"
    assert tuple(value(spark, names.stem_zh("a"), a="祛疹易錠５００毫克")) == ("祛疹易", False)
    assert value(spark, names.zh_alias("a"), a='"五洲"嘴?乳膏５０毫克/公克（艾賽可威）') == "艾賽可威"
    assert value(spark, names.zh_alias("a"), a="Ganciclovir（義大利廠）") is None


def test_routes(spark):
    assert tuple(value(spark, routes.derive("g", "d"), g="注射劑", d="")) == ("INJ", "group")
    assert tuple(value(spark, routes.derive("g", "d"), g="0.5MG", d="點眼乳劑")) == ("OPH", "keyword")
    assert tuple(value(spark, routes.derive("g", "d"), g="", d="乳劑")) == ("OTHER", "ambiguous")
    assert tuple(value(spark, routes.derive("g", "d"), g="", d="?")) == ("OTHER", "unknown")
    assert value(spark, routes.form_group("g"), g="A , 外用軟膏劑 , 5") == "外用軟膏劑"


def test_unicode(spark):
    assert tuple(value(spark, textnorm.repair("a", "b"), a="HALDOL?", b="")) == ("HALDOL", True)
    assert tuple(value(spark, textnorm.repair("a", "b"), a="A?", b="clean")) == ("clean", True)
    assert value(spark, textnorm.nfc("a"), a="樂") == "樂"
    assert value(spark, textnorm.title_case("a"), a="betamethasone (valerate)") == "Betamethasone (Valerate)"
    assert textnorm.query_term("  ＡＢ　c ") == "ab c"
    assert value(spark, textnorm.unescape("a"), a="a&amp;b&#233;") == "a&bé"
    assert value(spark, textnorm.display_width("a"), a="a錠") == 3


def test_licences(spark):
    assert tuple(value(spark, licence.id_to_key("a"), a="01000123")) == ("衛署藥製字", "123")
    assert value(spark, licence.id_to_key("a"), a="99000123") is None
    assert value(spark, licence.id_from_url("a"), a="http://x?licId=01000123&y=2") == "01000123"
    assert tuple(value(spark, licence.number_to_key("a"), a="衛署藥製字第000123號")) == ("衛署藥製字", "123")


def test_flags_and_negation(spark):
    ev = clauses.flag_evidence("t", ["事前審查"])
    assert value(spark, ev, t="無需事前審查") is None
    assert value(spark, ev, t="無需事前審查。但另案須經事前審查").pos == 12
    assert value(spark, ev, t="須經事前審查後使用").quote == "須經事前審查後使用"


def test_clauses(spark):
    body = "前言\n1.第一\n續行\n(1)子項\n附表十 同意書\n2.後"
    df = spark.createDataFrame([("a", body)], "code string, body string")
    got = [tuple(r)[1:] for r in clauses.split_clauses(df, "code", "body").orderBy("idx").collect()]
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [(None, 0, "前言", False), ("1", 1, "1.第一\n續行", False), ("1", 2, "(1)子項", False), (None, 1, "附表十 同意書", True), ("2", 1, "2.後", True)]


def test_titles_and_coverage(spark):
    t = value(spark, clauses.split_title("c", "t"), c="13.4.", t="\n13.4.Isotretinoin（如\nTest）（86/9/1）：\n1.規定")
    assert (t.title, t.body) == ("Isotretinoin（如Test）（86/9/1）：", "1.規定")
    assert value(spark, clauses.coverage("s", "p"), s="1.2. abcd", p="ab cd") == 1.0
    assert value(spark, clauses.coverage("s", "p"), s="abcdefghij", p="abcdefgh") == 0.8


def test_mentions(spark):
    m = mentions.mentions(F.col("t"), F.col("n"))
    assert value(spark, m, t="2.famciclovir；valaciclovir：", n="aciclovir") is False
    assert value(spark, m, t="1.isotretinoin：", n="tretinoin") is False
    assert value(spark, m, t="用tretinoin，", n="tretinoin") is True
    assert value(spark, m, t="zinc", n="zinc") is False


def test_dosage_sentences(spark):
    assert value(spark, dosage.is_substantive(F.col("t")), t="(詳細敘述請參見仿單擬稿)。") is False
    assert value(spark, dosage.adjust_quotes(F.col("t")), t="一天2次，塗於患部，兒童不宜使用。") == []
    assert value(spark, dosage.adjust_quotes(F.col("t")), t="一天2次。兒童不宜使用本藥。") == ["兒童不宜使用本藥。"]


def test_dosage_classes(spark):
    c = spark.createDataFrame([("s", 1, 1, "1.使用劑量："), ("s", 2, 2, "(1)druga 10mg 每日"), ("s", 3, 2, "(2)曾接受 drugbb 治療"), ("s", 4, 1, "2.其他 drugbb 先前 5mg"), ("t", 1, 1, "每週不超過 5 mg")], "code string, idx int, level int, text string")
    listed = spark.createDataFrame([("A", "s"), ("A", "t")], "inn string, code string")
    m = spark.createDataFrame([("s", 2, "A"), ("s", 3, "B"), ("s", 4, "B"), ("t", 1, "A")], "code string, idx int, inn string")
    got = {(r.code, r.idx, r["class"], tuple(r.for_drugs or ())) for r in dosage.collect_dosage(c, listed, m).collect()}
    assert got == {("s", 2, "direct", ()), ("s", 3, "prerequisite", ("B",)), ("s", 4, "prerequisite", ("B",)), ("t", 1, "section_sole", ())}


def test_sentence_diff(spark):
    assert diffing.compare("a。b。c。", "a。b。c。")["hunks"] == []
    d = value(spark, diffing.sentence_diff("a", "b"), a="一。二。三。", b="一。二改。三。四。")
    assert (d.sent_added, d.sent_removed, d.sent_equal, d.change_ratio) == (2, 1, 2, 0.375)
    assert d.hunks[0].ctx_before == ["一。"] and d.hunks[0].added == ["二改。"]


def test_tables(spark):
    text = "前文\n項目 劑量\n甲 1\n乙 2\n後文"
    grid = [["項目", "劑量"], ["甲", "1"], ["乙", "2"]]
    mark = f"{tables.MARK}TB0{tables.MARK}"
    out, placed = tables.splice([text], [grid, [["不", "在"]]])
    assert placed == [0] and out == [(0, f"前文\n{mark}\n後文")]
    # over three clauses: the emptied one goes
    out, placed = tables.splice(["前文\n項目 劑量", "甲 1", "乙＿2\n後文"], [grid])
    assert placed == [0] and out == [(0, f"前文\n{mark}"), (2, "\n後文")]
    # prose between the cells is never cut; a piece of a cell said twice is
    assert tables.splice(["項目 劑量 甲 散文在此 1 乙 2"], [grid])[1] == []
    assert tables.splice(["臨床特徵 床特徵 甲 循環不良 良"], [[["臨床特徵", "甲"], ["循環不良", "良"]]]) == ([(0, mark)], [0])
    # the heading before the table has its first cell too: fewest other characters win
    assert tables.splice(["甲乙嚴重度（S）： 嚴重度 輕 重"], [[["嚴重度", "輕", "重"]]])[0] == [(0, f"甲乙嚴重度（S）： {mark}")]
    # one cell that the text does not have
    assert tables.splice(["一 二 三 四"], [[["一", "二"], ["併格", "三"], ["四", ""]]])[1] == [0]
    assert tables.rejoin_lines("ab\ncd\nef\nx", {"abcdef"}) == "ab cd ef\nx"
    got = value(spark, tables.splice_tables(F.col("t"), F.array(F.array(F.array(F.lit("甲"), F.lit("1"))))), t="x 甲 1 y")
    assert (got.text, got.placed) == (f"x {mark} y", [0])


def test_coverage_by_lines_is_that_of_characters():
    import difflib
    import random
    import unicodedata

    def plain(source, parts):
        a, b = (re.sub(clauses.CODE_IN_TEXT, "", "".join(unicodedata.normalize("NFKC", s).split())) for s in (source, parts))
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)

    r = random.Random(3)
    for _ in range(50):
        lines = [f"{''.join(r.choice('abcdefghijklmnop') for _ in range(r.randint(20, 60)))}。" for _ in range(r.randint(1, 12))]
        kept = [x if r.random() < 0.8 else x[: len(x) // 2] for x in lines if r.random() < 0.9]
        assert abs(clauses.matched_share("\n".join(lines), "\n".join(kept)) - plain("\n".join(lines), "\n".join(kept))) < 0.02


def test_sections_and_annexes(spark):
    s = spark.createDataFrame([("1.", "2020-01-01"), ("1.2.", "2030-01-01"), ("3.", None), ("4.", "2020-01-01")], "code string, effective string")
    c = spark.createDataFrame([("1.", 1, "短", False), ("1.2.", 1, "這一條的文字超過十個字元", False), ("4.", 1, "附表十 " + "字" * 201, True), ("4.", 2, "◎附表十一：參照", True), ("1.2.", 2, "附表九 短", True)], "code string, idx int, text string, appendix boolean")
    got = {r.code: tuple(r)[1:] for r in clauses.section_states(s, c, "2024-01-01").collect()}
    assert got == {"1.": (True, True, False, False), "1.2.": (False, False, False, True), "3.": (True, False, True, False), "4.": (False, False, False, False)}
    none = spark.createDataFrame([], "code string")
    assert [tuple(r) for r in clauses.annex_hosts(c, none).collect()] == [("附表十", "4.")]
    assert {tuple(r) for r in clauses.annex_hosts(c, spark.createDataFrame([("1.2.",)], "code string")).collect()} == {("附表十", "4."), ("附表九", "1.2.")}
    a = spark.createDataFrame([("a", "□ 一 \n\n 二\t"), ("b", "字" * 300)], "name string, text string")
    p = clauses.annex_paragraphs(a, "name", "text")
    assert [(r.idx, r.text) for r in p.where("name = 'a'").orderBy("idx").collect()] == [(0, "□ 一"), (2, " 二")]
    g = spark.createDataFrame([("a", [["xy", None]])], "name string, grid array<array<string>>")
    assert {tuple(r) for r in clauses.image_notice(p, g, "name").collect()} == {("a", 7, True), ("b", 300, False)}


def test_brands_and_representatives(spark):
    rows = [
        ("T", ["T"], "OPH", "Timoptol", "青", None, 5.0, True, 1, False), ("T", ["T"], "OPH", "TIMOPTOL", None, None, 0.0, False, 2, True), ("T", ["T"], "OPH", "Zed", None, None, 0.0, False, 3, True),
        ("T", ["T", "DORZO"], "OPH", "Cosopt", None, None, 9.0, True, 4, True), ("T", ["T"], "OPH", None, None, "Plain", 1.0, False, 5, False),
    ]
    p = spark.createDataFrame(rows, "inn string, inn_keys array<string>, route string, brand_en string, brand_zh string, name_en string, price double, originator boolean, ordinal int, has_insert boolean")
    got = [(r.partners, r.name, r.originator, r.priced, r.n, r.zh) for r in aggregates.brand_overview(p).orderBy("place").collect()]
    assert got == [("", "TIMOPTOL", True, True, 2, ["青"]), ("", "Plain", False, True, 1, []), ("", "Zed", False, False, 1, []), ("+ Dorzo", "Cosopt", True, True, 1, [])]
    assert [r.ordinal for r in aggregates.representative(p, ["inn"], "has_insert", "originator", "ordinal", ["ordinal"]).collect()] == [4]
    n = {(r.kind, r.value): r.n for r in aggregates.counters(p, ["route"], ["inn_keys"]).collect()}
    assert n == {("route", "OPH"): 5, ("inn_keys", "T"): 5, ("inn_keys", "DORZO"): 1}


def test_personal_data_and_keys(spark):
    rows = [(1, "第0930060063號 0912-345-678"), (2, "文號0930060063號"), (3, "病歷號：A12345 出生日期：86/9"), (4, "github_pat_" + "a1" * 12), (5, "A123456789 x@y.org"), (6, "z" * (1 << 20) + " sk-" + "k" * 20)]
    d = spark.createDataFrame(rows, "id int, t string")
    assert {(r.id, r.kind, r.found[:14]) for r in scans.scan(d, "id", "t").collect()} == {(1, "mobile", "0912-345-678"), (3, "record_number", "病歷號：A12345"), (3, "birth_date", "出生日期：86/9"), (4, "api_key", "github_pat_a1a"), (5, "national_id", "A123456789"), (5, "email", "x@y.org"), (6, "api_key", "sk-kkkkkkkkkkk")}


def test_visual_lines(spark):
    rows = [("d", 1, 50.0, 10.4, "b"), ("d", 1, 5.0, 10.0, "a"), ("d", 1, 5.0, 20.0, "alone"), ("d", 2, 1.0, 9.0, "p"), ("d", 2, 2.0, 9.0, "q")]
    got = {(r.page, r.line) for r in tables.visual_lines(spark.createDataFrame(rows, "doc string, page int, x double, y double, text string")).collect()}
    assert got == {(1, "a b"), (2, "p q")}


def test_grids(spark):
    g = F.array(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b"), F.lit("c")))
    assert value(spark, tables.grid_problem(g)) is None
    assert value(spark, tables.grid_problem(g, F.lit("a b"))) == "foreign"
    assert value(spark, tables.grid_problem(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))) == "ragged"
    assert value(spark, tables.clean_cell(F.lit("涵蓋程\n度"))) == "涵蓋程度"
    assert value(spark, tables.clean_cell(F.lit("Region\nscore"))) == "Region score"


def test_fuzzy_search(spark):
    index = spark.createDataFrame([("ISOTRETINOIN", ["ACCUTANE"]), ("TRETINOIN", [])], "name string, aliases array<string>")
    hits, _ = search.search_with_fallback(index, "isotretinoim", [search.Field("name", "name", 100, 95, 50)], ["name", "aliases"])
    assert [(r.name, r.score) for r in hits.collect()] == [("ISOTRETINOIN", 10)]
    assert search.search(index, "tret", [search.Field("name", "name", 100, 95, 50)]).first().name == "TRETINOIN"
    assert search.lookup(index, "accutane").first().name == "ISOTRETINOIN"


def edit1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6)), min_size=20, max_size=60))
def test_edit_distance_model(spark, pairs):
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", F.col("b"), 1).between(0, 1).alias("near")).collect()
    assert all(r.near == edit1(r.a, r.b) for r in got)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789./x ", max_size=9), min_size=20, max_size=80))
def test_date_model(spark, texts):
    def model(v):
        v = v.strip(" ")
        if v in ("", "9991231"):
            return None
        for pattern, shift in ((r"(\d{2,3})/(\d{1,2})/(\d{1,2})", 1911), (r"(\d{4})(\d{2})(\d{2})", 0), (r"(\d{2,3})(\d{2})(\d{2})", 1911)):
            if m := re.fullmatch(pattern, v):
                y, mo, d = map(int, m.groups())
                if 1 <= mo <= 12 and 1 <= d <= 31 and (shift or 1900 <= y <= 2100):
                    return f"{y + shift:04d}-{mo:02d}-{d:02d}"
        return None

    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", dates.roc_to_iso("v").alias("d")).collect()
    assert [(r.v, r.d) for r in got] == [(t, model(t)) for t in texts]


def test_manifest_rules():
    old = ("f1", "2020-02-01", "a", "2020", None)
    assert manifest.transition(None, "f", "d", "s", "now", False) == ("new", ("f", "d", "s", "now", None))
    assert manifest.transition(old, "f1", "2020-02-01", "b", "now", False) == ("silent_edit", ("f1", "2020-02-01", "b", "2020", None))
    assert manifest.transition(old, "f2", "2020-03-01", "b", "now", False) == ("revised", ("f2", "2020-03-01", "b", "now", "f1"))
    assert manifest.transition(old, "f2", "2020-01-01", "b", "now", False) == ("unchanged", old)
    assert manifest.transition(old, "f2", "2020-03-01", None, "now", True) == ("fetch_stale", old)
    assert manifest.transition(None, "f2", "2020-03-01", None, "now", True) == ("fetch_failed", None)
