"""Ranked search of many terms at once over an inverted index of the fields' values.

The index posts every different value of a field under its exact form, under its
beginnings and under its n-grams (the `kind` of a posting), so that a term meets only
values that may match it, by equi-joins. What a field's match can score is known
beforehand. Exact matches and beginnings come first; matches inside values are
only looked for where their bound could still change a term's best k (max-score
pruning): the bound is the best inner score of the fields that hold the term's rarest
n-gram at all. Every match is checked on the value itself, hashes only meet candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import nfkc, strip
from ..sources.scratch import written
from . import near_names
from .search import DRUG_FIELDS, FUZZY_SCORE, PROCEDURE_FIELDS, Field, norm

#: Characters of the n-grams that are posted; a term is looked up by the longest that it has. Of numbers that count upwards, short ones are in more values the more there are.
GRAMS = (1, 2, 3, 6, 12)
#: Characters of the longest beginnings that are posted; longer terms are checked on the value.
BEGIN = 24
#: A code counts from this many characters of its beginning on.
LEAST_CODE = 3
#: Characters of a note that are shown.
SHOWN = 40


def _stored(entries: DataFrame, fields: Sequence[Field], *columns: Column | str) -> DataFrame:
    """columns of the entry, family (place of the field), place (of the value in it), value as stored."""
    parts = []
    for i, f in enumerate(fields):
        values = F.coalesce(F.col(f.column), F.array().cast("array<string>")) if f.many else F.array(F.col(f.column).cast("string"))
        parts.append(entries.select(*columns, F.lit(i).alias("family"), F.posexplode(values).alias("place", "value")))
    return reduce(DataFrame.union, parts)


def _with_form(rows: DataFrame) -> DataFrame:
    return rows.withColumn("form", norm(nfkc("value"))).where("form <> ''")


def values_of(entries: DataFrame, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, family (place of the field), place (of the value in it), value as stored, form as it is compared; null and empty values are left out."""
    return _with_form(_stored(entries, fields, F.col(key)))


def _end_dots(x: Column) -> Column:
    return F.regexp_replace(x, r"\.+$", "")


def _grams(form: Column) -> Column:
    """All n-grams of GRAMS characters, each once."""
    # places from which a whole n-gram fits; a filter, as a sequence that counts down would begin before the string
    of = [F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(form) - n + 1, F.lit(1))), lambda i: i <= F.length(form) - n + 1), lambda i: F.substring(form, i, F.lit(n))) for n in GRAMS]  # noqa: B023
    return F.array_distinct(F.concat(*of))


#: Drugs and procedures in one index; procedures have their names in columns of their own.
ALL_FIELDS = [*DRUG_FIELDS, *(replace(f, column=f"procedure_{f.column}") if f.column.startswith("name") else f for f in PROCEDURE_FIELDS)]


def build_index(entries: DataFrame, key: str, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """(values, postings): values (key, family, place, value, form), and postings (kind, gram, family, form) of the different forms of each family.

    Kinds: exact, begin, inside. Section codes are also posted without their last dots.
    Both tables depend on the entries alone and are written, to be searched again and again.
    """
    values = written(values_of(entries, key, fields), "search-values")
    return values, _postings(values, fields)


def _postings(values: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """values (family, form) -> the postings of `build_index`."""
    # forms are small and what is made of them is not, so they are dealt to as many tasks as a shuffle has, which adaptive execution would join into few
    forms = values.select("family", "form").distinct().repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "form")
    sections = [i for i, f in enumerate(fields) if f.label == "section"]
    exact = F.when(F.col("family").isin(sections), _end_dots(F.col("form"))).otherwise(F.col("form")) if sections else F.col("form")
    begins = F.transform(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(BEGIN))), lambda n: F.substring(F.col("form"), F.lit(1), n))
    inner = [i for i, f in enumerate(fields) if f.inside]
    kinds = [
        forms.select(F.lit("exact").alias("kind"), exact.alias("gram"), "family", "form"),
        forms.where(F.col("family").isin([i for i, f in enumerate(fields) if f.prefix])).select(F.lit("begin").alias("kind"), F.explode(begins).alias("gram"), "family", "form"),
        forms.where(F.col("family").isin(inner)).select(F.lit("inside").alias("kind"), F.explode(_grams(F.col("form"))).alias("gram"), "family", "form"),
    ]
    return written(reduce(DataFrame.union, kinds), "search-postings")


def _by_family(fields: Sequence[Field], of) -> Column:
    return F.element_at(F.array(*(F.lit(of(f)) for f in fields)), F.col("family") + 1)


def _score(fields: Sequence[Field], level: Column) -> Column:
    return F.when(level == 3, _by_family(fields, lambda f: f.exact)).when(level == 2, _by_family(fields, lambda f: f.prefix)).otherwise(_by_family(fields, lambda f: f.inside))


def _matches(met: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """met (term, family, form): term, family, form, score of what really matches, as one value against one term."""
    code = [i for i, f in enumerate(fields) if f.label == "code"]
    section = [i for i, f in enumerate(fields) if f.label == "section"]
    q, h = F.col("term"), F.col("form")
    level = F.when(h == q, 3).when(F.startswith(h, q), 2).when(F.contains(h, q), 1).otherwise(0)
    if section:
        level = F.when(F.col("family").isin(section) & (_end_dots(h) == _end_dots(q)), 3).otherwise(level)
    if code:
        level = F.when(F.col("family").isin(code) & (level == 2) & (F.length(q) < LEAST_CODE), 0).otherwise(level)
    out = met.withColumn("level", level).where("level > 0").withColumn("score", _score(fields, F.col("level")))
    return out.where("score > 0").select("term", "family", "form", "score")


def _leaders(values: DataFrame, names: DataFrame, key: str, k: int) -> DataFrame:
    """family, form, key, place, value, name, primary: of every form of a family the k first entries that have it, primary ones before others, then by name and key.

    No other entry can be among a term's k best by this form: the k before it score as much at least.
    """
    return _first_entries(values.join(names.hint("merge"), key), "form", key, k)


def _first_entries(rows: DataFrame, of: str, key: str, k: int) -> DataFrame:
    """Of every family and `of` the rows of its k first entries."""
    w = Window.partitionBy("family", of).orderBy(F.desc("primary"), F.col("name").asc_nulls_first(), F.col(key).asc_nulls_first())
    return rows.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k).drop("r")


def _leading(entries: DataFrame, key: str, name: Column, primary: Column, fields: Sequence[Field], k: int) -> DataFrame:
    """What `_leaders` gives of the entries, written, with no join and no row for all that is in them.

    The k first entries of a form are among the k first of each value as stored that has it, so only those need a form.
    """
    rows = _stored(entries, fields, F.col(key), name.alias("name"), primary.alias("primary")).where("value is not null")
    # written, or Spark would look for empty forms before, in all rows
    rows = written(_first_entries(rows, "value", key, k), "search-first-values")
    return written(_first_entries(_with_form(rows), "form", key, k), "search-leaders")


def _entries_hit(hits: DataFrame, leaders: DataFrame, key: str) -> DataFrame:
    """term, key, name, score, family, matched: of each entry's matches the best, the earlier field and value among equals; where an entry is primary, one more."""
    rows = hits.join(leaders.hint("merge"), ["family", "form"]).withColumn("score", F.col("score") + F.col("primary").cast("int"))
    best = rows.groupBy("term", key, "name").agg(F.max(F.struct("score", (-F.col("family")).alias("f"), (-F.col("place")).alias("p"), F.col("value").alias("matched"))).alias("b"))
    return best.select("term", key, "name", "b.score", (-F.col("b.f")).alias("family"), "b.matched")


def batch_search(entries: DataFrame, key: str, name: str, fields: Sequence[Field], terms: DataFrame, term: str, k: int = 10, primary: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """term (as it was given), rank, key, name, score, field, matched: the k best entries of every different term.

    Terms and values are compared in NFKC, lower case and single spaces. An entry
    scores by its best field; where `primary` holds, one more. Terms that are null or
    blank have no hits. Equal scores are ranked by name and key; keys are one per entry.
    Pairs of a term and all entries are never made: candidates come from the postings, each
    form brings its k first entries only, and of a term's rows no task keeps more than k once
    they are ranked. Joins are by shuffle: what is written is packed, and what is exploded from
    it many times larger, so that a side's size as Spark guesses it says little.
    """
    first_of = F.coalesce(F.col(primary), F.lit(False)) if primary else F.lit(False)
    if index is None:
        leaders = _leading(entries, key, F.col(name), first_of, fields, k)
        postings = _postings(leaders, fields)
    else:
        values, postings = index
        leaders = written(_leaders(values, entries.select(key, F.col(name).alias("name"), first_of.alias("primary")), key, k), "search-leaders")
    # written, or Spark would look for blank terms before, and every repeated one would go to Python
    given = written(terms.select(F.col(term).alias("given")).distinct(), "search-given")
    given = written(given.withColumn("term", norm(strip(nfkc("given")))).where("term <> ''"), "search-terms")
    asked = given.select("term").distinct()

    exact = asked.select("term", F.explode(F.array_distinct(F.array("term", _end_dots(F.col("term"))))).alias("gram"))
    begin = asked.select("term", F.substring(F.col("term"), 1, BEGIN).alias("gram"))
    outer = exact.withColumn("kind", F.lit("exact")).union(begin.withColumn("kind", F.lit("begin")))
    met = postings.join(outer.hint("merge"), ["kind", "gram"]).select("term", "family", "form")
    first = written(_entries_hit(_matches(met, fields).distinct(), leaders, key), "search-first")

    # the rarest n-gram of each term, and which fields hold it at all
    size = F.greatest(*(F.when(F.length("term") >= n, n) for n in GRAMS))
    own = asked.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substring(F.col("term"), i, size)))).alias("gram"))
    inside = postings.where("kind = 'inside'").drop("kind")
    counts = inside.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max(_by_family(fields, lambda f: f.inside)).alias("bound"))
    known = own.join(counts.hint("merge"), "gram", "left")
    probe = known.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("p"), F.min(F.coalesce("bound", F.lit(0))).alias("bound"))
    probe = probe.where("p.n > 0").select("term", F.col("p.gram").alias("gram"), (F.col("bound") + (1 if primary else 0)).alias("bound"))

    # of a term that has k hits already, only fields that can beat the last of them are looked at; an equal score may still win by its name
    place = Window.partitionBy("term").orderBy(F.desc("score"))
    last = first.select("term", "score", F.row_number().over(place).alias("r")).where(F.col("r") <= k).groupBy("term").agg(F.max("r").alias("n"), F.min("score").alias("floor"))
    open_ = probe.join(last.hint("merge"), "term", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("floor")))
    open_ = open_.select("term", "gram", F.when(F.col("n") >= k, F.col("floor")).otherwise(0).alias("floor"))
    more = inside.join(open_.hint("merge"), "gram").where(_by_family(fields, lambda f: f.inside) + (1 if primary else 0) >= F.col("floor")).select("term", "family", "form")
    second = _entries_hit(_matches(more, fields), leaders, key)

    both = first.union(second).groupBy("term", key, "name").agg(F.max(F.struct("score", (-F.col("family")).alias("f"), "matched")).alias("b"))
    both = both.select("term", key, "name", "b.score", F.element_at(F.array(*(F.lit(f.label) for f in fields)), 1 - F.col("b.f")).alias("field"), "b.matched")
    w = Window.partitionBy("term").orderBy(F.desc("score"), F.col("name").asc_nulls_first(), F.col(key).asc_nulls_first())
    best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shown = F.when(F.col("field") == "note", F.substring("matched", 1, SHOWN)).otherwise(F.col("matched")).alias("matched")
    return given.join(best.hint("merge"), "term").select(F.col("given").alias(term), "rank", key, "name", "score", "field", shown)


def near_where_none(hits: DataFrame, entries: DataFrame, key: str, name: str, spelt: Sequence[Field], terms: DataFrame, term: str, k: int = 10) -> DataFrame:
    """The rows of `hits` (of `batch_search`), and for every term that has none the k first entries, by name, of which a value of the fields `spelt` is at most one edit away.

    Near misses score FUZZY_SCORE, their field is that of the first value that is near. Terms of fewer than five characters have none.
    """
    left = terms.select(F.col(term).alias("given")).distinct().join(hits.select(F.col(term).alias("given")).distinct().hint("merge"), "given", "left_anti")
    left = left.select("given", strip(nfkc("given")).alias("asked"))
    values = values_of(entries, key, spelt).select(key, "family", "place", "value", "form")
    near = near_names.near_values(near_names.index_names(values, "form"), left.select("asked"), "asked").withColumnRenamed("value", "form")
    leaders = _leaders(values, entries.select(key, F.col(name).alias("name"), F.lit(False).alias("primary")), key, k)
    met = left.join(near.hint("merge"), "asked").join(leaders.hint("merge"), "form")
    rows = met.groupBy("given", key, "name").agg(F.min(F.struct("family", "place", "value")).alias("b"))
    label = F.element_at(F.array(*(F.lit(f.label) for f in spelt)), F.col("b.family") + 1)
    w = Window.partitionBy("given").orderBy(F.col("name").asc_nulls_first(), F.col(key).asc_nulls_first())
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.unionByName(rows.select(F.col("given").alias(term), "rank", key, "name", F.lit(FUZZY_SCORE).alias("score"), label.alias("field"), F.col("b.value").alias("matched")))
