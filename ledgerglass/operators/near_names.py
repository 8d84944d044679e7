"""Names within one edit of many terms, by the neighbourhood of deletions.

Two strings are at most one edit apart only if they are equal, or one of them, or
both, become the same string when one character is left out. So each name is posted
under itself and under all it becomes by leaving one character out, terms are
posted in the same way, and an equi-join on the postings meets all candidates; one
exact check of each decides. Two neighbouring characters changed over are two edits.

Joins are by shuffle: postings are many times the file that their size is guessed from, and no side may go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import FUZZY_SCORE, norm

#: Terms below this many characters have no near names.
LEAST_TERM = 5


def deletions(x: Column) -> Column:
    """Hashes of a string and of all strings it becomes without one of its characters, each once."""
    # the array has one place more than the string, which leaves nothing out
    without = F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.xxhash64(F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
    return F.array_distinct(without)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1).between(0, 1)


def index_names(names: DataFrame, name: str) -> DataFrame:
    """posting, value: every different name (lower case, single spaces) under its deletions; names too short for any term are left out.

    A table that depends on the names alone; write it to search it again and again.
    """
    values = names.select(norm(F.col(name)).alias("value")).where(F.length("value") >= LEAST_TERM - 1).distinct()
    return values.select(F.explode(deletions(F.col("value"))).alias("posting"), "value")


def near_values(index: DataFrame, terms: DataFrame, term: str, ahead: bool = False) -> DataFrame:
    """term, value: each different term with the indexed values at most one edit away.

    With `ahead` a value of two characters more than the term also counts if it is
    within one edit without its last character, as a term does that is still being
    typed. Hashes only meet candidates, the check is exact; a pair that met on several
    postings is one row.
    """
    t = terms.select(F.col(term).alias("given"), norm(F.col(term)).alias("term")).where(F.length("term") >= LEAST_TERM).distinct()
    posted = t.select("term", F.explode(deletions(F.col("term"))).alias("posting")).distinct()
    met = index.join(posted.hint("merge"), "posting").where(F.abs(F.length("value") - F.length("term")) <= 1).where(within_one_edit(F.col("value"), F.col("term"))).select("term", "value")
    if ahead:
        # value without its last character is the term with one character more: the term is among its deletions
        cut = index.select("value").distinct().select("value", F.substring(F.col("value"), F.lit(1), F.length("value") - 1).alias("cut"))
        cut = cut.select("value", "cut", F.explode(deletions(F.col("cut"))).alias("posting"))
        whole = t.select("term", F.xxhash64("term").alias("posting")).distinct()
        met = met.union(cut.join(whole.hint("merge"), "posting").where((F.length("value") == F.length("term") + 2) & within_one_edit(F.col("cut"), F.col("term"))).select("term", "value"))
    return t.join(met.distinct().hint("merge"), "term").select(F.col("given").alias(term), "value")


def near_names(names: DataFrame, key: str, name: str, terms: DataFrame, term: str, ahead: bool = False) -> DataFrame:
    """term, key, name, score: every row of `names` within one edit of a term, in any case.

    Terms of fewer than five characters, null and empty names have none. Names and
    terms that repeat are compared once and then joined back by equality: a name that
    a third of all rows has is one posting. Repeated rows of `names` give repeated rows.
    """
    found = near_values(index_names(names, name), terms, term, ahead).withColumnRenamed("value", "__value")
    rows = names.select(F.col(key), F.col(name), norm(F.col(name)).alias("__value"))
    return found.join(rows.hint("merge"), "__value").select(term, key, name, F.lit(FUZZY_SCORE).alias("score"))
