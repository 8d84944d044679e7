"""Which names a text mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 6


def mentions(text: Column, name: Column) -> Column:
    """Whether a lower-case text has the name with no letter a-z next to it; names of fewer than six characters never count."""
    return (F.length(name) >= LEAST) & F.rlike(text, F.concat(F.lit(r"(?<![a-z])\Q"), name, F.lit(r"\E(?![a-z])")))


def variants(inn: Column) -> Column:
    """A key's base name in lower case, with and without hyphens."""
    base = F.lower(F.substring_index(inn, " (", 1))
    return F.array_distinct(F.array(base, F.replace(base, F.lit("-"), F.lit(""))))


def mention_matrix(docs: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key, name: distinct mentions of names made of one or more words a-z.

    Texts are cut into words once and names into their first word, so that the
    join is an equi-join on words; only keys and words are dealt. A name that is a
    word is decided by that. For the rest - names with a space, a digit or a hyphen -
    the texts of the keys that are left are fetched and the whole name is tested.
    """
    t = docs.select(F.col(key).alias("__k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    words = t.select("__k", F.explode(F.array_distinct(F.regexp_extract_all("__t", F.lit("[a-z]+"), 0))).alias("__w"))
    n = names.select(F.col(name), F.explode(variants(F.col(name))).alias("__v")).where(F.length("__v") >= LEAST)
    n = n.withColumn("__w", F.regexp_extract("__v", "[a-z]+", 0)).where("__w <> ''").distinct()
    met = words.join(n, "__w").select("__k", name, "__v", "__w")
    sure = met.where("__v = __w").select("__k", name)
    open_ = met.where("__v <> __w").select("__k", name, "__v").distinct()
    tested = open_.join(t, "__k").where(mentions(F.col("__t"), F.col("__v"))).select("__k", name)
    return sure.union(tested).distinct().withColumnRenamed("__k", key)


def listed_or_referenced(sections: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """sections (code, title, text) -> code, name, listed: whether the title has the name, or only the text."""
    title = mention_matrix(sections, "code", "title", names, name).withColumn("listed", F.lit(True))
    text = mention_matrix(sections, "code", "text", names, name)
    return text.join(title, ["code", name], "full_outer").withColumn("listed", F.coalesce("listed", F.lit(False)))


def mention_index(sections: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """sections (code, title, text) -> name, listed (codes whose title has it), referenced (codes with it in the text only)."""
    j = listed_or_referenced(sections, names, name)
    return j.groupBy(name).agg(F.array_sort(F.collect_set(F.when(F.col("listed"), F.col("code")))).alias("listed"), F.array_sort(F.collect_set(F.when(~F.col("listed"), F.col("code")))).alias("referenced"))


def others_mentioned(matrix: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, others: what else a text that mentions a name mentions."""
    sets = matrix.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("__all"))
    return matrix.join(sets, key).select(key, name, F.array_except("__all", F.array(name)).alias("others"))
