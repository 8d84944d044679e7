"""Ranked search over many fields, with an edit-distance fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.textnorm import query_term


def norm(x: Column) -> Column:
    """A field as it is compared: lower case, trimmed, single spaces. Fields are stored in NFKC."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def match_level(field: Column, q: str) -> Column:
    """3 exact, 2 prefix, 1 inside, 0 none."""
    return let(norm(field), lambda h: F.when(h == "", 0).when(h == q, 3).when(F.startswith(h, F.lit(q)), 2).when(F.contains(h, F.lit(q)), 1).otherwise(0))


@dataclass(frozen=True)
class Field:
    """A column (of strings, or of arrays of them), what a hit is called, and the scores of exact, prefix and inner matches."""

    column: str
    label: str
    exact: int
    prefix: int
    inside: int
    many: bool = False


# Weights of the fields, in the order that decides between equal scores.
DRUG_FIELDS = [
    Field("name", "name", 100, 95, 50),
    Field("aliases", "alias", 100, 90, 48, True),
    Field("zh_names", "zh_name", 88, 80, 42, True),
    Field("originators", "originator", 90, 85, 40, True),
    Field("brands_en", "brand", 80, 75, 40, True),
    Field("brands_zh", "brand_zh", 78, 70, 38, True),
    Field("sections", "section", 60, 60, 0, True),
    Field("atc", "atc", 55, 55, 0, True),
    Field("components", "component", 50, 45, 30, True),
]
PROCEDURE_FIELDS = [
    Field("code", "code", 100, 92, 0),
    Field("name", "name", 99, 95, 93),
    Field("name_en", "name_en", 94, 88, 52),
    Field("synonyms", "synonym", 92, 86, 50, True),
    Field("note", "note", 20, 20, 20),
]
FUZZY_SCORE = 10


def _hit(value: Column, f: Field, q: str) -> Column:
    level = match_level(value, q)
    if f.label == "section":  # a code counts with or without its last dot
        level = F.when(F.rtrim(F.translate(norm(value), ".", " ")) == F.rtrim(F.lit(q.replace(".", " "))), 3).otherwise(level)
    if f.label == "code" and len(q) < 3:
        level = F.when(level == 3, 3).otherwise(0)
    return let(level, lambda n: F.when(n == 3, f.exact).when(n == 2, f.prefix).when(n == 1, f.inside).otherwise(0))


def _entry(order: int, f: Field, q: str):
    return lambda v, i: F.struct(_hit(v, f, q).alias("score"), F.lit(-order).alias("order"), (-i).alias("place"), F.lit(f.label).alias("field"), v.cast("string").alias("matched"))


def best_match(fields: list[Field], q: str, bonus: Column | None = None) -> Column:
    """struct(score, field, matched): the highest score, the earlier field and value among equals, in one expression."""
    tried = []
    for order, f in enumerate(fields):
        make = _entry(order, f, q)
        values = F.coalesce(F.col(f.column), F.array().cast("array<string>")) if f.many else F.array(F.col(f.column))
        tried.append(F.transform(values, make))

    def shown(best):
        score = F.coalesce(best["score"], F.lit(0))
        if bonus is not None:
            score = F.when(score > 0, score + bonus).otherwise(score)
        return F.struct(score.alias("score"), F.when(score > 0, best["field"]).alias("field"), F.when(score > 0, best["matched"]).alias("matched"))

    return let(F.array_max(F.concat(*tried)), shown)


def search(index: DataFrame, q: str, fields: list[Field], name: str = "name", limit: int | None = 10, bonus: Column | None = None) -> DataFrame:
    """Rows with a hit, best first, then by name in code-point order; the top-k is Spark's, no full sort."""
    # exploded, as a filter on the match would work it out once more
    hits = index.select("*", F.explode(F.filter(F.array(best_match(fields, query_term(q), bonus)), lambda h: h["score"] > 0)).alias("hit")).select("*", "hit.*").drop("hit")
    return hits if limit is None else hits.orderBy(F.desc("score"), F.asc(name)).limit(limit)


def fuzzy(index: DataFrame, q: str, fields: list[str], name: str = "name", limit: int | None = 10) -> DataFrame:
    """Rows with a value at most one edit away, for terms of five characters or more; lengths are compared first."""
    term = query_term(q)
    if len(term) < 5:
        return index.limit(0).withColumn("score", F.lit(FUZZY_SCORE)).withColumn("matched", F.lit(""))
    values = F.flatten(F.array(*(F.col(c) if index.schema[c].dataType.typeName() == "array" else F.array(F.col(c)) for c in fields)))
    near = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.length(norm(v)).between(len(term) - 1, len(term) + 1) & F.levenshtein(norm(v), F.lit(term), 1).between(0, 1))
    hits = index.withColumn("matched", F.try_element_at(near, F.lit(1))).where("matched is not null").withColumn("score", F.lit(FUZZY_SCORE))
    return hits if limit is None else hits.orderBy(name).limit(limit)


def by_locale(name: str, *then: str, partition: str | None = None) -> WindowSpec:
    """A window in the order of a language's names (ICU's root collation): letters first, then accents, then case; columns `then` decide between equals."""
    w = Window.orderBy(F.collate(F.col(name), "UNICODE"), *then)
    return w.partitionBy(partition) if partition else w


def search_with_fallback(index: DataFrame, q: str, fields: list[Field], fuzzy_fields: list[str], name: str = "name", limit: int = 10, wider: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Hits, else near misses, and how many hits the wider index has if there are none at all."""
    hits = search(index, q, fields, name, limit)
    if not hits.isEmpty():
        return hits, 0
    near = fuzzy(index, q, fuzzy_fields, name, limit)
    if wider is None or not near.isEmpty():
        return near, 0
    return near, search(wider, q, fields, name, None).count()


def lookup(index: DataFrame, key: str) -> DataFrame:
    """The row with this key, else that with such an alias, in any case."""
    exact = index.where(F.col("name") == key)
    if not exact.isEmpty():
        return exact
    return index.where(F.exists("aliases", lambda a: F.lower(a) == key.lower()))
