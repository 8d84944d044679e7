"""Unicode layer: normal forms, references, mojibake, query terms. UDFs are Arrow-batched."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that stand for something lost in conversion.
MOJIBAKE = "[?？□�]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.BooleanType())
def is_nfc(s: pd.Series) -> pd.Series:
    """Whether a text is as `nfc` would make it; the text itself does not come back."""
    return pd.Series([None if x is None else unicodedata.is_normalized("NFC", x) for x in s], dtype="boolean")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """A capital after every character that is no letter, as in `Betamethasone (Valerate)`."""
    return s.map(str.title, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """Terminal columns: wide and full-width characters take two."""
    wide = lambda x: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in x)
    return s.map(wide, na_action="ignore").astype("Int32")


def wrapped(text: str, width: int, indent: str = "") -> str:
    """Lines of at most `width` columns, cut at any character, as texts without spaces have to be; the lines after the first are indented."""
    lines, line, used = [], [], 0
    for c in text:
        columns = 2 if unicodedata.east_asian_width(c) in "WF" else 1
        if c == "\n" or used + columns > width:
            lines.append("".join(line))
            line, used = [], 0
        if c != "\n":
            line.append(c)
            used += columns
    return ("\n" + indent).join([*lines, "".join(line)] if line else lines)


def wrap(width: int, indent: str = ""):
    """A function of a text: `wrapped`; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: wrapped(x, width, indent), na_action="ignore")

    return run


def register(spark: SparkSession) -> None:
    """Make the UDFs known to SQL."""
    for f in (nfc, nfkc, unescape, title_case, display_width):
        spark.udf.register(f.__name__, f)


def strip(x) -> Column:
    """Trim every kind of white space, which plain trim does not."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def query_term(q: str) -> str:
    """A search term as it is compared: NFKC, trimmed, lower case, single spaces. For literals on the driver."""
    return " ".join(unicodedata.normalize("NFKC", q).lower().split())


def has_mojibake(x) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(MOJIBAKE)


def repair(name, alternative) -> Column:
    """struct(name, repaired): the clean alternative for a damaged name, else the name without stray question marks."""
    n, alt = _c(name), F.coalesce(_c(alternative), F.lit(""))
    dropped = F.regexp_replace(n, r"(?<=[\p{L}\p{N}])[?？](?=\s|$|[\p{L}\p{N}])", "")
    bad = has_mojibake(n)
    fixed = F.when(~bad, n).when((alt != "") & ~has_mojibake(alt), alt).otherwise(dropped)
    return F.struct(fixed.alias("name"), (bad & (fixed != n)).alias("repaired"))
