"""The 38 release rules: a release that passes them all, and one fault for each rule."""

import copy

import pytest

from ledgerglass.operators import release
from ledgerglass.operators.tables import MARK

SCHEMAS = {
    "products": "code string, atc string, route string, is_combo boolean, inn_keys array<string>, unresolved boolean, has_insert boolean",
    "ingredients": "inn string, subset boolean, sections array<string>, products array<string>",
    "sections": "code string, title string, text string, char_count int, no_file boolean, is_stub boolean, coverage double, tables array<struct<cols:int,lossless:boolean>>, annexes array<struct<name:string,missing:boolean>>, annex_from int, prior_review boolean, prior_review_evidence string, clauses array<string>, tables_spliced int",
    "previous_sections": "code string, is_stub boolean",
    "manifest": "code string, no_file boolean, char_count int, file string, sha256 string, effective string",
    "files": "file string, sha256 string",
    "events": "code string, kind string",
    "pending": "section string, effective string",
    "dosage": "inn string, kind string, section string, quote string",
    "labels": "id int, licences array<string>, text string, adjust array<string>",
    "licences": "licence string, dosage string",
    "procedures": "code string, subset boolean",
    "sources": "name string, sha256 string, fetched_at string",
    "header": "columns array<string>",
    "heads": "name string",
    "annexes": "name string, url string",
    "annex_manifest": "name string, url string",
    "annex_files": "name string",
    "index": "bytes long, entries long",
}
POLICY = release.Policy(
    columns=["a", "b"], canaries=["alphacort"], prefixes=["1"], preserve=["alphacort"], procedure_canaries=["P1"], blocked_procedures=["P9"], aliases={"cyclo": "ciclo", "same": "same base"},
    seeds=["1.1."], prose=["1.2."], annex_of={"1.1.": "附表一"}, columns_of={"1.1.": 3}, sources=["one"],
)
PREVIOUS = release.Previous(products=10, procedures=2, annexes=1)


def section(code, **more):
    row = dict(code=code, title="t", text="use betaderm 5 mg daily", char_count=30, no_file=False, is_stub=False, coverage=0.9, tables=[], annexes=[], annex_from=None, prior_review=False, prior_review_evidence=None, clauses=["a"], tables_spliced=0)
    return row | more


def good():
    t = {
        "products": [dict(code=f"c{i}", atc="D07A", route="SKIN", is_combo=False, inn_keys=["ALPHACORT (X)"], unresolved=False, has_insert=True) for i in range(10)],
        "ingredients": [dict(inn="ALPHACORT", subset=True, sections=["1.1."], products=["c0", "c1"]), dict(inn="BETADERM", subset=False, sections=[], products=["c2"])],
        "sections": [section(f"2.{i}.") for i in range(500)],
        "previous_sections": [dict(code="2.1.", is_stub=False), dict(code="2.2.", is_stub=True)],
        "manifest": [dict(code="1.1.", no_file=False, char_count=9, file="f1", sha256="aa", effective="2026-01-01"), dict(code="1.2.", no_file=True, char_count=None, file=None, sha256=None, effective=None)],
        "files": [dict(file="f1", sha256="aa")],
        "events": [dict(code="1.1.", kind="fetch_stale")],
        "pending": [dict(section="1.1.", effective="2026-02-01")],
        "dosage": [dict(inn="BETADERM", kind="direct", section="1.1.", quote="betaderm  5 mg"), dict(inn="GAMMACIN", kind="prior", section="1.1.", quote="5 mg daily")],
        "labels": [dict(id=1, licences=["L1", "L2"], text="once daily", adjust=["daily"])],
        "licences": [dict(licence="L2", dosage=" once daily\n")],
        "procedures": [dict(code="P1", subset=True), dict(code="P9", subset=False)],
        "sources": [dict(name="one", sha256="x", fetched_at="2026")],
        "header": [dict(columns=["a", "b"])],
        "heads": [dict(name="ciclo acid"), dict(name="CYCLO")],
        "annexes": [dict(name="附表一", url="u")],
        "annex_manifest": [dict(name="附表一", url="u")],
        "annex_files": [dict(name="附表一")],
        "index": [dict(bytes=1000, entries=201)],
    }
    t["sections"][0] = section("1.1.", tables=[dict(cols=3, lossless=True)], annexes=[dict(name="附表一", missing=False)], annex_from=4, clauses=[f"a {MARK}TB0{MARK}"], tables_spliced=1)
    t["sections"][1] = section("1.2.")
    return t


def changed(table, row, **values):
    def change(t):
        t[table][row].update(values)

    return change


FAULTS = {
    1: lambda t: t["products"].extend(copy.deepcopy(t["products"][:2])),
    2: changed("header", 0, columns=["b", "a"]),
    3: lambda t: t["sections"].pop(),
    4: changed("manifest", 0, char_count=0),
    5: changed("sections", 5, title="", char_count=19),
    7: changed("products", 9, unresolved=True),
    8: changed("products", 0, route="OTHER"),
    11: changed("index", 0, bytes=300 * 1024),
    13: lambda t: t["ingredients"].__setitem__(0, t["ingredients"][0] | {"inn": "ALPHACORT Y"}),
    14: changed("products", 3, inn_keys=["ALPHACORT", "ALPHACORT (Z)"]),
    15: lambda t: t["sections"][3].update(code="2.1.", is_stub=True),
    16: changed("ingredients", 0, sections=["1.10."]),
    17: changed("sections", 1, coverage=0.69),
    18: changed("sections", 7, text="x豈"),
    19: changed("ingredients", 1, inn="BETADERM 外"),
    20: changed("sections", 8, tables=[dict(cols=2, lossless=None)]),
    21: changed("sections", 1, tables=[dict(cols=2, lossless=True)]),
    22: changed("sections", 0, annexes=[dict(name="附表一", missing=None), dict(name="附表十", missing=False)][1:]),
    23: lambda t: [s.update(annex_from=1) for s in t["sections"][1:17]],
    24: changed("sections", 9, prior_review=True, prior_review_evidence=""),
    25: changed("sources", 0, fetched_at=None),
    26: changed("sections", 0, tables=[dict(cols=4, lossless=True)]),
    27: changed("dosage", 0, quote="betaderm 6 mg"),
    28: lambda t: (t["sections"][0].update(text="Gammacin 15 mg"), t["dosage"].__setitem__(0, t["dosage"][0] | {"quote": "Gammacin 15 mg"}), t["dosage"][1].update(quote="15 mg")),
    29: lambda t: t["procedures"].append(dict(code="P2", subset=False)),
    30: changed("procedures", 0, subset=None),
    31: changed("procedures", 1, subset=True),
    32: changed("sections", 0, clauses=[f"a {MARK}TB1{MARK}"]),
    33: changed("labels", 0, adjust=["twice"]),
    34: changed("sections", 4, clauses=["a\nb\nc\nd"]),
    35: lambda t: t["heads"].pop(0),
    36: changed("annex_manifest", 0, url="v"),
    37: changed("sections", 6, annexes=[dict(name="附表九之六", missing=True), dict(name="附表二", missing=True)]),
    38: lambda t: [t["products"][i].update(has_insert=None) for i in (0, 1)],
    39: changed("ingredients", 1, inn="BETADERM10MG"),
    40: changed("files", 0, sha256="bb"),
    41: changed("events", 0, kind="fetch_failed"),
    42: changed("pending", 0, effective="2026-01-01"),
}


def failed(spark, rows):
    tables = {name: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in split(SCHEMAS[name])) for r in rows[name]], SCHEMAS[name]).coalesce(1) for name in SCHEMAS}
    report = release.check(tables, POLICY, PREVIOUS, override=(1,)).collect()
    assert sorted(r.id for r in report) == sorted(FAULTS)
    assert [r.id for r in report if r.overridden] == [1]
    return {r.id for r in report if not r.passed}


def split(schema):
    """Top-level fields of a schema string."""
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def test_a_good_release_passes(spark):
    assert failed(spark, good()) == set()


def test_an_empty_release_fails_without_an_error(spark):
    got = failed(spark, {name: [] for name in SCHEMAS})
    assert {1, 2, 3, 11, 13, 16, 22, 25, 26, 30, 38} == got


@pytest.mark.parametrize("id", sorted(FAULTS))
def test_a_fault_fails_its_rule_alone(spark, id):
    rows = good()
    FAULTS[id](rows)
    assert failed(spark, rows) == {id}
