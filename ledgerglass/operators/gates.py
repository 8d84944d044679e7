"""Data-quality gates: each is one aggregate that says whether a table may be published. All run, then the release fails or passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """An aggregate condition over a table; `detail` is what the message shows."""

    id: int
    name: str
    table: str
    passed: Column
    detail: Column


def drift(id: int, name: str, table: str, baseline: int | None, share: float = 0.10) -> Gate:
    """The row count within a share of the last run's; without one, it passes."""
    n = F.count(F.lit(1))
    ok = F.lit(True) if not baseline else F.abs(n - baseline) <= share * baseline
    return Gate(id, name, table, ok, F.concat(n.cast("string"), F.lit(f" rows, {baseline} before")))


def at_least(id: int, name: str, table: str, least: int) -> Gate:
    n = F.count(F.lit(1))
    return Gate(id, name, table, n >= least, F.concat(n.cast("string"), F.lit(f" of {least}")))


def none(id: int, name: str, table: str, bad: Column) -> Gate:
    """No row is bad."""
    n = F.count_if(F.coalesce(bad, F.lit(False)))
    return Gate(id, name, table, n == 0, F.concat(n.cast("string"), F.lit(" bad rows")))


def share_at_most(id: int, name: str, table: str, bad: Column, most: float) -> Gate:
    share = F.coalesce(F.avg(F.coalesce(bad, F.lit(False)).cast("double")), F.lit(0.0))
    return Gate(id, name, table, share <= most, F.format_string("%.2f %%", share * 100))


def share_at_least(id: int, name: str, table: str, good: Column, least: float) -> Gate:
    share = F.coalesce(F.avg(F.coalesce(good, F.lit(False)).cast("double")), F.lit(0.0))
    return Gate(id, name, table, share >= least, F.format_string("%.2f %%", share * 100))


def unique(id: int, name: str, table: str, key: str) -> Gate:
    """No key twice, counted by one distinct aggregate."""
    twice = F.count(key) - F.count_distinct(key)
    return Gate(id, name, table, twice == 0, F.concat(twice.cast("string"), F.lit(" repeated")))


def contains_all(id: int, name: str, table: str, column: str, canaries: list[str]) -> Gate:
    """Known values that have to be there."""
    found = F.count_distinct(F.when(F.col(column).isin(canaries), F.col(column)))
    return Gate(id, name, table, found == len(canaries), F.concat(found.cast("string"), F.lit(f" of {len(canaries)}")))


def verbatim(quote: Column, source: Column) -> Column:
    """Whether a quote occurs in its source, white space aside."""
    plain = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")
    return F.contains(plain(source), plain(quote))


def fragment_run(text: Column, run: int = 4, longest: int = 6) -> Column:
    """Whether at least `run` lines in a row have one to `longest` characters: what a table that fell apart looks like."""
    lengths = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.length(F.trim(s)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, n):
        now = F.when(n.between(1, longest), s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(lengths, start, step, lambda s: s["best"]) >= run


def run(gates: list[Gate], tables: dict[str, DataFrame], override: tuple[int, ...] = ()) -> DataFrame:
    """One row per gate: id, name, passed, message, overridden. Gates of one table share one scan of it."""
    out = None
    for name in dict.fromkeys(g.table for g in gates):
        mine = [g for g in gates if g.table == name]
        one = tables[name].agg(*(c for g in mine for c in (g.passed.alias(f"p{g.id}"), g.detail.alias(f"d{g.id}"))))
        rows = F.array(*(F.struct(F.lit(g.id).alias("id"), F.lit(g.name).alias("name"), F.coalesce(F.col(f"p{g.id}"), F.lit(False)).alias("passed"), F.coalesce(F.col(f"d{g.id}"), F.lit("")).alias("message"), F.lit(g.id in override).alias("overridden")) for g in mine))
        part = one.select(F.inline(rows))
        out = part if out is None else out.union(part)
    return out


def failures(report: DataFrame) -> list[str]:
    """Gates that failed and were not overridden; one row per gate at most."""
    return [f"{r.id} {r.name}: {r.message}" for r in report.where("not passed and not overridden").orderBy("id").collect()]
