"""Dates as ISO text, read from the notations of the Republic of China calendar (year + 1911)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: End dates that mean "without end".
FOREVER = ("", "9991231")
_SLASH = r"^(\d{2,3})/(\d{1,2})/(\d{1,2})$"
_WESTERN = r"^(\d{4})(\d{2})(\d{2})$"
_PACKED = r"^(\d{2,3})(\d{2})(\d{2})$"
_BLOCK = r"[（(][\d/、，,\s]+[）)]"
_IN_TEXT = r"\d{2,3}/\d{1,2}/\d{1,2}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _iso(v: Column, pattern: str, shift: int) -> Column:
    y, m, d = (F.regexp_extract(v, pattern, i).try_cast("int") for i in (1, 2, 3))
    ok = v.rlike(pattern) & m.between(1, 12) & d.between(1, 31)
    if shift == 0:
        ok = ok & y.between(1900, 2100)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y + shift, m, d))


def roc_to_iso(value) -> Column:
    """ISO text of `115/6/1`, `20260601` or `1150601`; null for the end of time and for anything else.

    Only ranges are checked, so that a 31st of February passes. Eight digits are
    tried before the packed form, as the order decides what a text means.
    """
    v = F.trim(_c(value))
    return F.when(v.isin(*FOREVER), None).otherwise(F.coalesce(_iso(v, _SLASH, 1911), _iso(v, _WESTERN, 0), _iso(v, _PACKED, 1911)))


def revision_dates(text) -> Column:
    """Distinct ISO dates, in order, from brackets that hold nothing but dates."""
    brackets = F.regexp_extract_all(_c(text), F.lit(_BLOCK), 0)
    found = F.flatten(F.transform(brackets, lambda b: F.regexp_extract_all(b, F.lit(_IN_TEXT), 0)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, roc_to_iso), lambda d: d.isNotNull())))


def annotate_dates(text) -> Column:
    """The text in pieces, array of struct(text, iso): dates of the calendar's slash form with their ISO text, what is between them without."""
    marked = F.regexp_replace(_c(text), f"({_IN_TEXT})", "\u0001$1\u0001")
    shown = lambda p, i: F.regexp_extract(p, _SLASH, i)
    iso = lambda p: F.when(p.rlike(_SLASH), F.concat_ws("-", (shown(p, 1).try_cast("int") + 1911).cast("string"), F.lpad(shown(p, 2), 2, "0"), F.lpad(shown(p, 3), 2, "0")))
    return F.transform(F.split(marked, "\u0001"), lambda p: F.struct(p.alias("text"), iso(p).alias("iso")))


def days_between(later, earlier) -> Column:
    return F.datediff(F.try_to_date(_c(later)), F.try_to_date(_c(earlier)))


def is_stale(built, as_of, limit: int = 45) -> Column:
    """Whether something built is more than `limit` days old."""
    return days_between(as_of, built) > limit


def full_years(later, earlier) -> Column:
    return F.floor(days_between(later, earlier) / 365.25).cast("int")


def in_force(effective, as_of) -> Column:
    return _c(effective) <= _c(as_of)
