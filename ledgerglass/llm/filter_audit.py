"""How filters interact: every order of them replayed over the documents' flags.

Flags are computed once per document. Each document meets the orders of all
filters (a broadcast table of n! rows, 120 for five), its first failure in an
order is found from the flags, the order's steps are exploded, and counts are
aggregated per part, order and step. Partial aggregates keep at most
parts x orders x steps rows a task, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_size, written

FILTERS = "ABCDE"
#: Filter E needs the whole table; the others look at one text.
DUPLICATE = "E"


def text_failures(text: Column) -> list[Column]:
    """Failures of A (short), B (repetitive), C (capitals), D (signs) for one text that is not null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def mask(failures: Sequence[Column]) -> Column:
    """Bit i is set if filter i fails."""
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failures)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def flag_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, fails (bit mask over FILTERS) of every row; texts are read once.

    A null text is empty and equals other empty ones; a null part is the empty
    string. A row with a null id is nobody's copy and has no copies: ids decide which
    of equal texts came first. Rows with the same id and text are not copies of each other.
    Other columns of `docs` are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", mask(text_failures(F.col("text"))).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = written(rows, "text-flags")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    groups = written(groups.select("digest", "first"), "equal-texts")
    out = join_by_size(rows, groups, "digest", "left", 64 * groups.count())
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return out.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copy, 1 << FILTERS.index(DUPLICATE)).otherwise(0)).alias("fails"))


def with_labels(flags: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`flags` with good and toxic: whether any label of the id has quality 1, or toxic 1; False without one."""
    found = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    found = written(found, "label-flags")
    out = join_by_size(flags, found, "doc_id", "left", 24 * found.count())
    return out.select(*flags.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark, filters: Sequence[str] = FILTERS) -> DataFrame:
    """order_id, and m1, m2, ...: the bit of the filter applied at each step, for every permutation in lexicographic order."""
    found = list(permutations(range(len(filters))))
    return spark.createDataFrame([(i, *(1 << f for f in p)) for i, p in enumerate(found)], ", ".join(["order_id int", *(f"m{s + 1} int" for s in range(len(filters)))]))


def replay(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """flags (part, fails, good, toxic) -> one row per part, filter_order and step, zeros included.

    Counts of documents: kept after the step, removed at it, redundant (they fail
    its filter but went earlier), unique_fails (they fail this filter only),
    good_lost and toxic_lost (of those removed here), shapley (removed by this
    filter, summed over all orders and steps). No row of `flags`, no row of the result.
    """
    n = len(filters)
    if not 1 <= n <= 7:
        raise ValueError("orders of 1 to 7 filters can be replayed")
    spark = flags.sparkSession
    met = flags.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders(spark, filters)))
    first = F.coalesce(*(F.when(F.col("fails").bitwiseAND(F.col(f"m{s}")) != 0, s) for s in range(1, n + 1)), F.lit(n + 1))
    met = met.withColumn("first", first)
    steps = met.select("part", "order_id", "fails", "good", "toxic", "first", F.posexplode(F.array(*(F.col(f"m{s}") for s in range(1, n + 1)))).alias("pos", "bit"))
    here = F.col("first") == F.col("pos") + 1
    counted = steps.groupBy("part", "order_id", "pos", "bit").agg(
        F.count_if(F.col("first") > F.col("pos") + 1).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("pos") + 1)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    names = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # n! rows each
    return counted.select("part", F.element_at(names, F.col("order_id") + 1).alias("filter_order"), (F.col("pos") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of FILTERS over whole `documents`, by lang.

    Null texts are empty; a null lang counts as the empty string, and one with it.
    Repeated rows count as often as they stand there. Empty tables of documents
    give no row, empty labels no good_lost or toxic_lost. Very long texts are only
    ever handled one at a time; ties do not matter, nothing is ordered.
    """
    return replay(with_labels(flag_documents(docs), labels))


ORACLE = r"""
WITH f(x, i) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE)] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM d LEFT JOIN l USING (doc_id)),
n AS (SELECT part, fails, good, toxic, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT n.*, filter_order, step, fails[ascii(filter_order[step]) - 64] AS fail, coalesce(list_position([fails[ascii(filter_order[k]) - 64] FOR k IN [1, 2, 3, 4, 5]], TRUE), 6) AS died FROM n, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(n) FILTER (died > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (died = step) AS BIGINT) AS removed, CAST(sum(n) FILTER (fail AND died < step) AS BIGINT) AS redundant,
      CAST(sum(n) FILTER (fail AND len(list_filter(fails, lambda x: x)) = 1) AS BIGINT) AS unique_fails, CAST(sum(n) FILTER (died = step AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (died = step AND toxic) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r
"""
