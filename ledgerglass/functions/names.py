"""Product and ingredient names: strength, salts and esters, components, brand stems."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .textnorm import nfkc, strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Units, dosage forms and endings as the catalogues write them.
STRENGTH = r"(?i)(?<![\d.])\d*[\d.,]*\d\s*(?:MG|MCG|UG|GM|G|ML|L|IU|U|MEQ|KIU|%|％)(?:\s*/\s*[\d.,]*\s*(?:MG|GM|G|ML|L|CM2|DOSE|PUFF|ACT)?)?"
FORM_WORDS = (
    "F.C. TABLETS|FILM COATED TABLETS|FILM-COATED TABLETS|SOFT GELATIN CAPSULES|PROLONGED-RELEASE HARD CAPSULES|EXTENDED-RELEASE TABLETS|CONCENTRATE FOR SOLUTION|POWDER FOR SOLUTION|SOLUTION FOR INJECTION|SOLUTION FOR INFUSION|FOR INJECTION|PREFILLED|TABLETS|TABLET|CAPSULES|CAPSULE|CREAM|OINTMENT|INJECTION|SOLUTION|SUSPENSION|GEL|LOTION|SYRUP|SPRAY|PATCH|POWDER|GRANULES|SUPPOSITORY|EMULSION|VANISHING CREAM|EYE DROPS|INFUSION"
)
NAME_STRENGTH = r"(?<![\p{L}\p{N}_])\d*[\d.]*\d\s*(?:MG|MCG|GM|G|ML|IU|%|％)"
ZH_DOSE_TAIL = r"[\d.．]+\s*(?:毫克|公克|毫升|微克|克|％|%|單位)(?:/\s*[\p{L}\p{N}_]+)?\s*$"
ZH_FORM_TAIL = (
    "(?:懸液用粉劑|懸液用粉|口服懸液劑|持續性藥效膠囊劑|持續性藥效錠|凍晶乾粉注射劑|預充填式注射劑|外用凝膠劑|眼用軟膏劑|點眼液劑|點眼膏劑|點眼劑|口腔吸入劑|鼻用噴液劑|膜衣錠|糖衣錠|口溶錠|咀嚼錠|腸溶錠|軟膠囊劑|軟膠囊|膠囊劑|膠囊|乳膏劑|乳膏|軟膏劑|軟膏|霜劑|霜|凝膠劑|凝膠|乾粉注射劑|凍晶注射劑|注射液劑|注射劑|注射液|針劑|內服液劑|外用液劑|懸液劑|懸浮液|液劑|溶液|糖漿劑|糖漿|散劑|顆粒劑|細粒劑|粉劑|貼片|栓劑|噴劑|噴液|洗劑|洗髮精|口內膏|眼藥水|眼藥膏|錠劑|錠)\\s*$"
)
QUOTED_MAKER = "[\"“”「」'][^\"“”「」']{1,12}[\"“”「」']"
PAREN = r"[（(]([^）)]{2,12})[）)]"
ALIAS_STOP = ("廠", "公司", "股份", "有限", "藥業", "製藥", "進口", "分裝", "國", "版", "型")


def strip_strength(x) -> Column:
    """Strengths become a space; spaces and edges are tidied."""
    s = F.regexp_replace(F.regexp_replace(_c(x), STRENGTH, " "), r"\s+", " ")
    return F.regexp_replace(s, r"^[ ,;.]+|[ ,;.]+$", "")


@dataclass(frozen=True)
class Vocabulary:
    """Curated words, as parameters: what salts are cut, what esters are kept for which bases, and what is called what."""

    preserve: frozenset[str] = frozenset()
    salts: frozenset[str] = frozenset()
    esters: frozenset[str] = frozenset()
    ester_alias: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    atc_ester: dict[str, str] = field(default_factory=dict)
    base_atc_ester: dict[str, str] = field(default_factory=dict)


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _among(words, x: Column) -> Column:
    return x.isin(*sorted(words)) if words else F.lit(False)


def canonicalize(raw, vocabulary: Vocabulary, atc=None) -> Column:
    """One ingredient's key: upper case, no strength, no salt; esters only for bases that keep them.

    A base that keeps esters and names none takes the one that its ATC code
    implies: by the whole code, else by base and the longest prefix of four or more.
    """
    v = vocabulary
    s = strip_strength(F.upper(F.coalesce(_c(raw), F.lit(""))))
    s = F.trim(F.regexp_replace(s, r"^[\s.,\d]+", ""))
    cut = F.regexp_replace(s, r"^([^㐀-鿿]+)[㐀-鿿].*$", "$1")
    return let(F.regexp_replace(cut, r"^[ ,;.\-]+|[ ,;.\-]+$", ""), lambda s: _key(s, v, atc))


def _key(s: Column, v: Vocabulary, atc) -> Column:
    """What `canonicalize` makes of a name in upper case without strengths."""
    named = F.transform(F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), 1), lambda p: F.trim(p))
    alias = lambda t: F.coalesce(_lookup(v.ester_alias, t), t)
    base = strip_strength(F.regexp_replace(s, r"\([^)]*\)", " "))
    base = F.regexp_replace(F.regexp_replace(base, r"\s+", " "), r"^[ ,;.\-]+|[ ,;.\-]+$", "")
    return let(F.split(base, " "), lambda words: let(_peeled(words, v, alias), lambda peeled: _spelt(F.array_join(peeled["base"], " "), peeled["esters"], named, v, alias, atc)))


def _peeled(words: Column, v: Vocabulary, alias) -> Column:
    """struct(base, esters, …): salts and esters taken from the end of the words."""
    none = F.array().cast("array<string>")

    def peel(state, word):
        t = alias(word)
        last = F.size(words) - F.size(state["base"]) - state["gone"] <= 1  # the first word always stays
        stop = state["done"] | last
        is_salt, is_ester = ~stop & _among(v.salts, t), ~stop & _among(v.esters, t)
        taken = is_salt | is_ester
        return F.struct(
            (state["done"] | ~taken).alias("done"),
            F.when(taken, state["base"]).otherwise(F.array_prepend(state["base"], word)).alias("base"),
            F.when(is_ester, F.array_prepend(state["esters"], t)).otherwise(state["esters"]).alias("esters"),
            (state["gone"] + taken.cast("int")).alias("gone"),
        )

    start = F.struct(F.lit(False).alias("done"), none.alias("base"), none.alias("esters"), F.lit(0).alias("gone"))
    return F.aggregate(F.reverse(words), start, peel)


def _spelt(base: Column, esters: Column, named: Column, v: Vocabulary, alias, atc) -> Column:
    """The key of a base with the esters that were at its end and those named in brackets."""
    kept = F.array_distinct(F.concat(F.filter(F.transform(named, alias), lambda t: _among(v.esters, t)), esters))
    code = F.upper(F.trim(F.coalesce(_c(atc) if atc is not None else F.lit(None).cast("string"), F.lit(""))))
    tries = [_lookup(v.atc_ester, code)] + [F.when(F.length(code) >= n, _lookup(v.base_atc_ester, F.concat(base, F.lit("|"), F.substring(code, 1, n)))) for n in (7, 6, 5, 4)]
    filled = lambda kept: let(F.coalesce(*tries), lambda fill: F.when((F.size(kept) == 0) & fill.isNotNull(), F.array(fill)).otherwise(kept))
    key = let(let(kept, filled), lambda k: F.when(_among(v.preserve, base) & (F.size(k) > 0), F.concat(base, F.lit(" ("), F.array_join(k, "/"), F.lit(")"))).otherwise(base))
    return F.when(base == "", "").otherwise(let(key, lambda key: F.trim(F.coalesce(_lookup(v.aliases, key), _lookup(v.aliases, base), key))))


def split_components(x) -> Column:
    """Parts at `+` outside brackets; with unbalanced brackets, at every `+`."""
    s = _c(x)
    opens, closes = F.length(F.regexp_replace(s, r"[^(]", "")), F.length(F.regexp_replace(s, r"[^)]", ""))

    def step(state, ch):
        depth = F.when(ch == "(", state["depth"] + 1).when(ch == ")", F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        return F.struct(depth.alias("depth"), F.concat(state["out"], F.when((ch == "+") & (depth == 0), F.lit("\u0000")).otherwise(ch)).alias("out"))

    outside = F.aggregate(F.split(s, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda st: st["out"])
    parts = F.when(opens != closes, F.split(s, r"\+")).otherwise(F.split(outside, "\u0000"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def normalize(group_name, ingredient, mixture, vocabulary: Vocabulary, atc=None) -> Column:
    """struct(keys, combo_key, is_combo, source, warnings) of a product."""
    first = strip(F.element_at(F.split(F.coalesce(_c(group_name), F.lit("")), "[,，、]"), 1))
    other = strip(F.coalesce(_c(ingredient), F.lit("")))
    texts = let(first, lambda first: F.struct(first.alias("first"), F.when(first != "", first).otherwise(other).alias("text")))

    def found(t):
        keys = F.filter(F.transform(split_components(t["text"]), lambda c: canonicalize(c, vocabulary, atc)), lambda k: k != "")
        return let(keys, lambda keys: _product(t["first"], t["text"], keys, mixture))

    return let(texts, found)


def _product(first: Column, text: Column, keys: Column, mixture) -> Column:
    many = F.size(keys) > 1
    source = F.when(F.size(keys) == 0, "unknown").when(first != "", "group").otherwise("ingredient")
    declared = strip(F.coalesce(_c(mixture), F.lit(""))) == "複方"
    warnings = F.when(text == "", F.array(F.lit("no_ingredient"))).when(F.size(keys) == 0, F.array(F.lit("canonicalize_empty"))).otherwise(
        F.array_compact(F.array(F.when(first == "", "fallback_ingredient_field"), F.when(declared != many, "mixture_flag_conflict")))
    )
    return F.struct(keys.alias("keys"), F.when(many, F.array_join(F.array_sort(keys), " + ")).alias("combo_key"), many.alias("is_combo"), source.alias("source"), warnings.alias("warnings"))


def title_words(x) -> Column:
    """Capitals at the start of words and of parts after a hyphen; short words in capitals stay."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))
    word = lambda w: F.when((F.length(w) <= 3) & (F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.array_join(F.transform(F.split(w, "-"), part), "-"))
    return F.array_join(F.transform(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""), word), " ")


def stem_en(name) -> Column:
    """The brand before the first dosage form or strength; the whole name if nothing is left."""
    s = F.trim(F.coalesce(_c(name), F.lit("")))
    cut = F.regexp_extract(s, rf"(?i)^(.*?)(?:(?<![\p{{L}}\p{{N}}_])(?:{FORM_WORDS})(?![\p{{L}}\p{{N}}_])|{NAME_STRENGTH})", 1)
    cut = F.regexp_replace(cut, r"^[ \-,()]+|[ \-,()]+$", "")
    return title_words(F.when(cut != "", cut).otherwise(s))


def stem_zh(name) -> Column:
    """struct(stem, mojibake): NFKC, without brackets, quoted makers, doses and forms at the end."""
    raw = strip(F.coalesce(_c(name), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(nfkc(raw), PAREN, ""), QUOTED_MAKER, "")
    for _ in range(3):
        s = strip(F.regexp_replace(strip(F.regexp_replace(s, ZH_DOSE_TAIL, "")), ZH_FORM_TAIL, ""))
    s = F.regexp_replace(s, r"^[ \-,()（）]+|[ \-,()（）]+$", "")
    return F.struct(F.when(s != "", s).otherwise(raw).alias("stem"), raw.rlike("[?？□]").alias("mojibake"))


def zh_alias(name) -> Column:
    """The first bracketed text that can be a common name: two to eight characters, no digit, no sign of a maker."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(name), F.lit("")), F.lit(PAREN), 1), strip)
    good = F.filter(found, lambda t: F.length(t).between(2, 8) & ~t.rlike(r"(?U)\d") & ~t.rlike("|".join(ALIAS_STOP)))
    return F.try_element_at(good, F.lit(1))


def shard_name(key) -> Column:
    """File name of an ingredient's shard."""
    return F.translate(_c(key), "/ ()", "__")
