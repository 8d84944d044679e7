"""Scans for what must not be published: personal data, secrets, active content, paths outside the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of personal data and keys; the first group is what is reported.
# An address is looked for at the start of a run of its characters only, which keeps long runs linear.
# A number after 第 or before 號 is that of an official notice, no telephone number.
PATTERNS = {
    "national_id": r"(?<![A-Za-z0-9])([A-Z][12]\d{8})(?![0-9])",
    "mobile": r"(?<![第\d])(09\d{2}[- ]?\d{3}[- ]?\d{3})(?![\d號])",
    "record_number": r"(病歷號碼?\s*[：:]\s*[A-Za-z0-9]{4,})",
    "birth_date": r"(出生日期\s*[：:]\s*\d{2,4}[/年-]\d{1,2})",
    "api_key": r"(ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,})",
    "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "email": r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
}
PERSONAL = ("national_id", "mobile", "record_number", "birth_date", "email")
SECRET = ("api_key", "private_key")
DENIED = ["<script", "javascript:", "eval(", "document.cookie"]


def scan(docs: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """key, kind, found: the first match of each pattern in the whole text, cut to 40 characters."""
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), F.substring(F.regexp_extract(F.col(text), p, 1), 1, 40).alias("found")) for kind, p in patterns.items()))
    return docs.select(key, F.inline(rows)).where("found <> ''")


def allowed_path(path: Column, exact: list[str], prefixes: list[str]) -> Column:
    ok = path.isin(exact)
    for p in prefixes:
        ok = ok | F.startswith(path, F.lit(p))
    return ok


def escape_json(text: Column) -> Column:
    """JSON that may stand inside a script element: no `<`, `>`, `&` and no line separators."""
    for plain, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def denied_tokens(text: Column, tokens: list[str] = DENIED) -> Column:
    """The tokens that a text contains, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in tokens)))
