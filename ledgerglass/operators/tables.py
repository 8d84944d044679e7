"""Tables inside rule texts: grids from cells, their tests, and putting them back where they belong."""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table's place in a text: private-use characters around its number.
MARK = "\ue000"
MARKER = f"{MARK}TB(\\d+){MARK}"
MAX_ANCHORS, WINDOW, MAX_SKIP = 60, 400, 0.10


def clean_cell(cell: Column) -> Column:
    """Line breaks between CJK characters vanish, others become one space; white space is tidied."""
    cjk = r"[　-鿿豈-﫿＀-￯]"
    joined = F.regexp_replace(F.coalesce(cell, F.lit("")), rf"(?<={cjk})\s*\n\s*(?={cjk})", "")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def _filled(grid: Column) -> Column:
    return F.transform(grid, lambda r: F.transform(r, lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def grid_score(grid: Column) -> Column:
    """struct to compare readings of one table: fewer empty columns, fewer empty rows, denser, wider."""
    full = _filled(grid)
    width = F.size(F.get(grid, 0))
    rows = F.transform(full, _sum)
    columns = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: _sum(F.transform(full, lambda r: F.coalesce(F.get(r, j), F.lit(0)))))
    cells = F.greatest(F.size(grid) * width, F.lit(1))
    return F.struct((-F.size(F.filter(columns, lambda n: n == 0))).alias("empty_columns"), (-F.size(F.filter(rows, lambda n: n == 0))).alias("empty_rows"), (_sum(rows) / cells).alias("density"), width.alias("width"))


def grid_problem(grid: Column, source: Column | None = None) -> Column:
    """Why a grid is no table: shape, ragged, sparse, long_cell, foreign characters; null if it is one."""
    width = F.size(F.get(grid, 0))
    flat = F.flatten(grid)
    plain = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")
    out = (
        F.when(~width.between(2, 32) | ~F.size(grid).between(1, 80), "shape")
        .when(F.exists(grid, lambda r: F.size(r) != width), "ragged")
        .when(grid_score(grid)["density"] < 0.10, "sparse")
        .when(F.exists(flat, lambda c: F.length(c) > 1500), "long_cell")
    )
    if source is not None:
        out = out.when(F.exists(F.split(plain(F.array_join(flat, "")), ""), lambda ch: ~F.contains(plain(source), ch)), "foreign")
    return out


def best_reading(readings: DataFrame) -> DataFrame:
    """readings (doc, page, x0, y0, x1, y1, strategy, grid) -> the best per rounded box, in reading order."""
    box = [F.round(c).cast("int").alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]
    g = readings.groupBy("doc", "page", *box).agg(F.max_by(F.struct("strategy", "grid", "x0", "y0"), F.struct(grid_score(F.col("grid")), "strategy")).alias("x"))
    return g.select("doc", "page", "x.*").orderBy("doc", "page", "y0", "x0")


def is_label_row(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) == 1


def visual_lines(pieces: DataFrame, tolerance: float = 1.5, most: int = 12) -> DataFrame:
    """pieces (doc, page, x, y, text) -> doc, page, y, line: pieces whose height is within the tolerance of a line's first, left to right.

    Groups are single pages, whose size does not grow with the corpus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[tuple[float, list[tuple[float, str]]]] = []
        for y, x, t in sorted(zip(pdf["y"], pdf["x"], pdf["text"], strict=True), key=lambda r: (r[0], r[1])):
            for key, held in lines:
                if abs(key - y) <= tolerance:
                    held.append((x, t))
                    break
            else:
                lines.append((y, [(x, t)]))
        out = [(pdf["doc"].iloc[0], pdf["page"].iloc[0], y, " ".join(t for _, t in sorted(held))) for y, held in lines if 2 <= len(held) <= most]
        return pd.DataFrame(out, columns=["doc", "page", "y", "line"])

    return pieces.groupBy("doc", "page").applyInPandas(run, "doc string, page int, y double, line string")


def rejoin_lines(text: str, known: set[str], most: int = 12) -> str:
    """Greedy: from every line on, the longest run of up to `most` lines whose text without white space is a known line becomes one line.

    White space is taken out once; a run whose length no known line has is not looked up.
    """
    lines, out, i = (text or "").split("\n"), [], 0
    bare = ["".join(line.split()) for line in lines]
    joined, ends, lengths = "".join(bare), [0, *itertools.accumulate(map(len, bare))], {len(k) for k in known}
    while i < len(lines):
        for j in range(min(len(lines), i + most), i + 1, -1):
            if ends[j] - ends[i] in lengths and joined[ends[i] : ends[j]] in known:
                out.append(" ".join(s.strip() for s in lines[i:j]))
                i = j
                break
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def rejoin(text: pd.Series, lines: pd.Series) -> pd.Series:
    """`lines`: a document's visual lines."""
    key = lambda s: "".join(s.split())
    return pd.Series([rejoin_lines(t, {key(x) for x in (ls if ls is not None else ())}) for t, ls in zip(text, lines, strict=True)], dtype=object)


#: What forms are filled in on, which texts have and cells do not.
FILLERS = frozenset("_＿﹏‥…．·・")


def squeeze(texts: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """All texts in NFC as one string without white space and fillers, and (text, offset) of every character of it."""
    kept = [(ch, (k, i)) for k, t in enumerate(texts) for i, ch in enumerate(t) if not ch.isspace() and ch not in FILLERS]
    return "".join(ch for ch, _ in kept), [place for _, place in kept]


def _anchors(flat: str, first: str, start: int):
    at = flat.find(first, start)
    while at >= 0:
        yield at
        at = flat.find(first, at + 1)


def find_span(flat: str, cells: list[str], start: int = 0, missing: int = 0) -> tuple[int, int] | None:
    """The span of a squeezed text that has the cells in order with the fewest other characters; the first such span.

    A cell has to begin within WINDOW characters of the one before; up to `missing`
    cells may be absent. The first cell's first MAX_ANCHORS places are tried.
    """
    best: tuple[int, int, int] | None = None
    for at in itertools.islice(_anchors(flat, cells[0], start), MAX_ANCHORS):
        end, own, absent = at, 0, 0
        for cell in cells:
            place = flat.find(cell, end, end + WINDOW + len(cell))
            if place < 0:
                absent += 1
                if absent > missing:
                    break
            else:
                end, own = place + len(cell), own + len(cell)
        if absent <= missing and (best is None or end - at - own < best[0]):
            best = (end - at - own, at, end)
            if best[0] == 0:
                break
    return None if best is None else best[1:]


def only_cells(flat: str, cells: list[str]) -> bool:
    """Whether what is left of a text, once every occurrence of every cell is taken out, are pieces of the joined cells.

    Such pieces are cells that the text layer said twice; anything else is prose, which may not be cut.
    """
    taken = np.zeros(len(flat) + 1, dtype=np.int64)
    for cell in set(cells):
        for at in _anchors(flat, cell, 0):
            taken[at] += 1
            taken[at + len(cell)] -= 1
    covered = np.cumsum(taken[:-1]) > 0
    together = "".join(cells)
    left = ("".join(ch for ch, _ in run) for inside, run in itertools.groupby(zip(flat, covered, strict=True), key=lambda x: x[1]) if not inside)
    return all(piece in together for piece in left)


def locate(flat: str, tables: list[list[list[str]]]) -> list[tuple[int, int, int]]:
    """(number, begin, end) of the tables that have a place, in the order of the text.

    A table is looked for after the last one, then from the start; with all its
    cells, then without a tenth of them. One that overlaps the last is given up.
    """
    found: list[tuple[int, int, int]] = []
    for number, grid in enumerate(tables):
        cells = [x for x in (squeeze([unicodedata.normalize("NFC", c or "")])[0] for row in grid for c in row) if x]
        if not cells:
            continue
        after = found[-1][2] if found else 0
        tries = ((start, missing) for missing in (0, max(1, int(len(cells) * MAX_SKIP))) for start in (after, 0))
        span = next((s for s in (find_span(flat, cells, *t) for t in tries) if s), None)
        if span and span[0] >= after and only_cells(flat[slice(*span)], cells):
            found.append((number, *span))
    return found


def splice(texts: list[str], tables: list[list[list[str]]]) -> tuple[list[tuple[int, str]], list[int]]:
    """Clauses with every table that has a place replaced by its marker, and the numbers of those tables.

    A table may span clauses: its marker stands in the first, and clauses of which
    nothing is left go; the others keep their index.
    """
    out = [unicodedata.normalize("NFC", t or "") for t in texts]
    flat, places = squeeze(out)
    spans = locate(flat, tables)
    for number, begin, end in reversed(spans):
        (a, i), (b, j) = places[begin], places[end - 1]
        rest = out[b][j + 1 :]
        out[a + 1 : b + 1] = [""] * (b - a)
        out[a] = out[a][:i] + f"{MARK}TB{number}{MARK}" + (rest if a == b else "")
        if a != b:
            out[b] = rest
    return [(k, t) for k, t in enumerate(out) if t.strip()] if spans else list(enumerate(out)), [n for n, *_ in spans]


_SPLICED = T.StructType([T.StructField("clauses", T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType())]))), T.StructField("placed", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_SPLICED)
def splice_clauses(texts: pd.Series, tables: pd.Series) -> pd.DataFrame:
    """struct(clauses (idx, text), placed) of a section's clause texts, an array, and its tables, an array of grids."""
    made = []
    for ts, gs in zip(texts, tables, strict=True):
        clauses, placed = splice(list(ts) if ts is not None else [], [[list(r) for r in g] for g in (gs if gs is not None else ())])
        made.append(([{"idx": i, "text": t} for i, t in clauses], placed))
    return pd.DataFrame(made, columns=["clauses", "placed"])


def splice_tables(text: Column, tables: Column) -> Column:
    """struct(text, placed) of one text."""
    made = splice_clauses(F.array(F.coalesce(text, F.lit(""))), tables)
    return F.struct(F.coalesce(F.try_element_at(made["clauses"], F.lit(1))["text"], F.lit("")).alias("text"), made["placed"].alias("placed"))


def marked_tables(text: Column) -> Column:
    """Numbers of the tables that a text has markers of."""
    return F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), lambda n: n.cast("int"))


def unplaced_tables(text: Column, count: Column) -> Column:
    """Numbers of tables without a marker; they are shown after the text."""
    return F.when(count > 0, F.array_except(F.sequence(F.lit(0), count - 1), marked_tables(text))).otherwise(F.array().cast("array<int>"))
