"""Dotted codes such as `13.17.1.`: normal form, order, ancestors, and what is written with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_code(code) -> Column:
    """Trimmed, with exactly one dot at the end; empty stays empty."""
    bare = F.regexp_replace(F.trim(_c(code)), r"\.+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit(".")))


def match_prefix(code, prefix) -> Column:
    """Whether a code is the prefix or lies under it; `8.2.16.` is not under `8.2.1.`."""
    return F.startswith(normalize_code(code), normalize_code(prefix))


def same_code(a, b) -> Column:
    return normalize_code(a) == normalize_code(b)


def _parts(code) -> Column:
    return F.split(F.regexp_replace(F.trim(_c(code)), r"\.+$", ""), r"\.")


def code_tuple(code) -> Column:
    """Sort key: the parts as integers, or [9999] if one is no number."""
    numbers = F.transform(_parts(code), lambda p: p.try_cast("int"))
    return F.when(F.exists(numbers, lambda n: n.isNull()), F.array(F.lit(9999))).otherwise(numbers)


def parent_code(code) -> Column:
    """The code without its last part, null at the top."""
    p = _parts(code)
    return F.when(F.size(p) > 1, F.concat(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "."), F.lit(".")))


def ancestors(code, proper: bool = False) -> Column:
    """All codes above (and, unless `proper`, the code itself): turns a prefix join into an equi-join."""
    p = _parts(code)
    last = F.size(p) - (1 if proper else 0)
    make = lambda n: F.concat(F.array_join(F.slice(p, F.lit(1), n), "."), F.lit("."))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), make)).otherwise(F.array().cast("array<string>"))


def chapter_no(code) -> Column:
    return F.element_at(_parts(code), 1).try_cast("int")


def slug(code) -> Column:
    return F.replace(F.regexp_replace(F.trim(_c(code)), r"\.+$", ""), F.lit("."), F.lit("-"))


#: Names of section files: code, date, optional sequence number.
FILE_NAME = r"^([\d.]+?)_(\d{8})(?:_(\d{3}))?\.pdf$"


def parse_file_name(name) -> Column:
    """struct(code, effective as ISO date, seq), null if the name is none of a section file."""
    n = _c(name)
    iso = let(F.regexp_extract(n, FILE_NAME, 2), lambda day: F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    seq = F.nullif(F.regexp_extract(n, FILE_NAME, 3), F.lit(""))
    return F.when(n.rlike(FILE_NAME), F.struct(normalize_code(F.regexp_extract(n, FILE_NAME, 1)).alias("code"), iso.alias("effective"), seq.try_cast("int").alias("seq")))


def split_codes(text) -> Column:
    """Comma-separated codes, normalised, in their order; anything that is no code is left out."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+(\.\d+)*\.?$")), normalize_code)


#: Chinese digits and their values; ten is a multiplier.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def chinese_int(text) -> Column:
    """Value of a number up to 99 in Chinese or Arabic digits; null if it is neither."""
    t = _c(text)
    digit = F.create_map(*(x for k, v in DIGITS.items() for x in (F.lit(k), F.lit(v))))
    start = F.struct(F.lit(0).alias("tens"), F.lit(-1).alias("last"))

    def step(s, ch):
        ten = ch == "十"
        tens = F.when(ten, F.when(s["last"] < 0, 1).otherwise(s["last"])).otherwise(s["tens"])
        return F.struct(tens.alias("tens"), F.when(ten, -1).otherwise(F.coalesce(F.try_element_at(digit, ch), F.lit(0))).alias("last"))

    value = F.aggregate(F.split(t, ""), start, step, lambda s: s["tens"] * 10 + F.greatest(s["last"], F.lit(0)))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike("^[零〇一二三四五六七八九十]+$"), value)


#: Names of annexes: number, optional second number, optional letter.
ANNEX = r"^附表([一二三四五六七八九十百零〇\d]+)(?:之([一二三四五六七八九十\d]+))?(?:-([A-Z]))?"


def annex_key(name) -> Column:
    """Natural sort key struct(number, second, letter, name); what is no annex comes last."""
    n = _c(name)
    part = lambda i: F.regexp_extract(n, ANNEX, i)
    ok = n.rlike(ANNEX)
    return F.struct(
        F.when(ok, F.coalesce(chinese_int(part(1)), F.lit(999))).otherwise(999).alias("number"),
        F.when(ok, F.coalesce(chinese_int(F.nullif(part(2), F.lit(""))), F.lit(0))).otherwise(999).alias("second"),
        F.when(ok, part(3)).otherwise("").alias("letter"),
        n.alias("name"),
    )
