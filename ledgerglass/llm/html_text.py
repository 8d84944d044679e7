"""Main text of web pages.

A page is read into blocks. Landmarks decide most of them: inside `article` or
`main` everything is text except nested menus, forms, adverts, comments and the
like; on a page with such a landmark everything outside it is furniture. For
pages without one, a host-wide sampled suffix array decides: the token streams
outside of landmarks of all a host's pages are put side by side, every suffix cut to `RUN` tokens is
grouped with its equals, and tokens covered by a run that at least `MIN_PAGES`
distinct pages of the host share are furniture; what is unique stays. Inside a
landmark repeats are kept, as sites do publish one article under several
addresses and the article is to be whole on each of them.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import SpanHash, U, mix, row_grams, signed
from .common import join_by_size, small_batches, written

#: Tokens in a run that counts as repeated, and distinct pages that must share it.
RUN, MIN_PAGES = 8, 3

#: A tag, a comment or a declaration. A quote counts only where a value begins, so that an apostrophe in an unquoted one ends nothing.
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_RAW = frozenset("script style textarea title noscript template svg math iframe object select button canvas audio video".split())
_FURNITURE = frozenset("nav footer aside form menu dialog head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class names and ids. A name is a hint if it has one of these words and no others but the general ones: `ad-slot`, not `no-sidebar` or `article-header`.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments disqus respond footer header masthead pagination pager toolbar login response responses replies reply signup".split()
)
_GENERAL = frozenset(
    "area bar block bottom box button buttons col column container desktop element fixed form global group holder icons id inline inner item items layout left link links list main mobile outer page panel post posts right row section site slot sticky sub thread top unit widget widgets wrap wrapper".split()
)
#: Hints of what readers and others wrote, in which an article is none of the page's.
_FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus respond response responses replies reply related recommended recommendations newsletter".split())
#: Words that name what others wrote about, beside a foreign hint: `article-comments`, `related-posts`.
_ABOUT = frozenset("article articles blog content entry news page post posts reader readers stories story user users".split())
#: Hints that a heading inside the main text may have too.
_TOPS = frozenset("header masthead banner".split())
#: Names of what announces another page's article.
_TEASERS = frozenset("teaser teasers card cards snippet preview excerpt".split())
#: What may stand in `head`; any other element ends it, as its end tag may be left out.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title noframes".split())
#: Open elements that a new one of the same group ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _hints(value: str) -> set[str]:
    """Furniture words of a class attribute or id."""
    out: set[str] = set()
    for name in value.split():
        words = set(_WORDS.findall(name))
        found = words & _HINTS
        if found and words - _HINTS <= (_GENERAL | _ABOUT if found & _FOREIGN else _GENERAL):
            out |= found
    return out


def _kind(tag: str, attributes: str, in_main: bool) -> str:
    """What an element is: 'skip' (furniture), 'foreign' (what others wrote), 'soft' (furniture unless it holds the main text), 'main', 'article', 'teaser' or ''."""
    if tag in _FURNITURE and tag != "form":
        return "skip"
    kind = tag if tag in ("article", "main") else "soft" if tag == "form" else ""
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "skip"
            if name == "role":
                if value == "form":
                    kind = "soft"
                elif value in _ROLES:
                    return "skip"
                elif value in ("main", "article"):
                    kind = value
            elif name == "itemprop" and value == "articlebody":
                kind = "main"
            elif name in ("class", "id"):
                found = _hints(value)
                if found & _FOREIGN:
                    return "foreign"
                if kind in ("main", "article"):
                    if kind == "article" and any(set(_WORDS.findall(x)) & _TEASERS for x in value.split()):
                        kind = "teaser"
                elif found - _TOPS if in_main else found:
                    kind = "soft"
    if tag == "header" and not in_main and not kind:
        return "soft"
    return kind


def blocks_of(page: str | None) -> tuple[list[str], list[str]]:
    """Text blocks inside landmarks, and the undecided ones outside of any landmark and furniture.

    A main element is one wherever it stands but in furniture proper. An article inside
    what only looks like furniture - a form around the page, a class name - counts where
    the page has no other, as does one that looks like a teaser.
    """
    inside: list[str] = []
    second: list[str] = []
    outside: list[str] = []
    if not page:
        return inside, outside
    stack: list[tuple[str, str, int]] = []
    skip = main = soft = 0  # soft: open elements that look like furniture and in which no main text has begun
    second_rate = 0
    parts: list[str] = []
    at, n = 0, len(page)

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text and not soft:
                (second if second_rate else inside if main else outside).append(text)

    def pop_to(k: int):
        nonlocal skip, main, soft, second_rate
        while len(stack) > k:
            _, kind, lifted = stack.pop()
            skip -= kind in ("skip", "foreign")
            main -= kind in ("main", "article", "teaser")
            second_rate -= kind == "teaser"
            soft += lifted - (kind == "soft")

    def find(tags) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
        return -1

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not skip:
                parts.append(page[at:])
            break
        if m.start() > at and not skip:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1] and tag not in _IN_HEAD and (k := find(("head",))) >= 0:
            flush()
            pop_to(k)
        if m[1]:
            if tag in _INLINE and tag not in ("label",):
                k = find((tag,))
                if k >= 0 and stack[k][1] and k == len(stack) - 1:
                    flush()
                    pop_to(k)
                elif k == len(stack) - 1 >= 0:
                    stack.pop()
                continue
            flush()
            k = find((tag,))
            if k >= 0:
                pop_to(k)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            if end:
                at = end.end()
            elif not m[3].endswith("/") and tag in ("script", "style", "textarea", "title"):
                at = n
            if tag in ("textarea", "select", "iframe", "object", "video", "audio"):
                flush()
            continue
        if tag in _VOID:
            if tag == "br":
                parts.append(" ") if not skip else None
            elif tag == "hr":
                flush()
            continue
        kind = _kind(tag, m[3], main > 0)
        lifted = 0
        if kind == "article" and inside and any(k == "article" for _, k, _ in stack):
            kind = "foreign"  # an article in an article that has begun is a reader's
        if tag in _INLINE:
            if kind in ("skip", "foreign", "soft"):
                flush()
        else:
            flush()
            if (k := find(("p",))) >= 0 and all(t in _INLINE or t == "p" for t, *_ in stack[k:]):
                pop_to(k)
            if tag in _ENDS and (k := find(_ENDS[tag])) >= 0 and not any(t in ("ul", "ol", "dl", "table", "select") for t, *_ in stack[k:]):
                pop_to(k)
        if kind in ("main", "article", "teaser") and soft and not skip:
            # the main text has begun: what is around it only looked like furniture
            kind = "main" if kind == "main" else "teaser"
            lifted, soft = soft, 0
        stack.append((tag, kind, lifted))
        skip += kind in ("skip", "foreign")
        main += kind in ("main", "article", "teaser")
        second_rate += kind == "teaser"
        soft += kind == "soft"
    flush()
    return inside or second, outside


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the white-space separated tokens of a text's bytes, and their hashes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    solid = np.concatenate(([False], (data != 32) & (data != 10), [False]))
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    return starts, SpanHash(data)(starts, ends)


def host(url: str):
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def _suffixes(pages: DataFrame) -> DataFrame:
    """pages (host, k1, k2, html) -> host, k1, k2, page (hash of its text), bare (no text inside a landmark), at (token outside of landmarks), suffix (hash of RUN tokens)."""

    def scan(batches):
        for batch in batches:
            row, page, bare, at, suffix = [], [], [], [], []
            for i, doc in enumerate(batch.column("html").to_pylist()):
                inside, outside = blocks_of(doc)
                if not outside:
                    continue
                _, tokens = _tokens("\n".join(outside))
                grams = row_grams(tokens, RUN)
                with np.errstate(over="ignore"):
                    # the same menu around different articles is on different pages
                    every = _tokens("\n".join(outside + inside))[1]
                    whole = np.bitwise_xor.reduce(mix(every + np.arange(len(every), dtype=U)))
                row.append(np.full(len(grams), i))
                page.append(np.full(len(grams), whole, dtype=U))
                bare.append(np.full(len(grams), not inside))
                at.append(np.arange(len(grams), dtype=np.int32))
                suffix.append(grams)
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("host", "k1", "k2")), pa.array(signed(np.concatenate(page))), pa.array(np.concatenate(bare)), pa.array(np.concatenate(at)), pa.array(signed(np.concatenate(suffix)))],
                    names=["host", "k1", "k2", "page", "bare", "at", "suffix"],
                )

    return pages.mapInArrow(scan, "host string, k1 long, k2 long, page long, bare boolean, at int, suffix long")


def repeated_runs(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, k1, k2, starts: for pages (host, k1, k2, html) without text inside a landmark, where runs of RUN tokens start that other pages of the host share.

    Pages of the same text count as one. The hash of a run and of a page reduce
    to counts before anything is joined; a host of any size is dealt by suffix.
    """
    suffixes = written(_suffixes(pages).distinct(), "suffixes")
    shared = suffixes.select("host", "suffix", "page").distinct().groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.where(F.col("n") >= min_pages).select("host", "suffix")
    return suffixes.where("bare").join(shared, ["host", "suffix"], "left_semi").groupBy("host", "k1", "k2").agg(F.collect_list("at").alias("starts"))


def _unique(outside: list[str], starts) -> list[str]:
    """The blocks without the tokens that repeated runs cover."""
    if not starts:
        return outside
    words = [b.split(" ") for b in outside]
    covered = np.zeros(sum(map(len, words)) + RUN, dtype=bool)
    for s in starts:
        covered[s : s + RUN] = True
    out, at = [], 0
    for block in words:
        kept = " ".join(w for w, c in zip(block, covered[at : at + len(block)], strict=True) if not c)
        at += len(block)
        if kept:
            out.append(kept)
    return out


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Columns `keep` of every page and its `main_text`; a null, empty or textless page has an empty text.

    Columns may have any names but that of the result's own; repeated rows give repeated rows.
    """
    if "main_text" in keep:
        raise ValueError("main_text is the result's own column")
    small_batches(pages.sparkSession)
    k1, k2 = F.xxhash64(html), F.xxhash64(F.lit("second"), F.col(html))
    rows = pages.select(F.struct(*keep).alias("__kept"), host(url).alias("__host"), k1.alias("__k1"), k2.alias("__k2"), F.col(html).alias("__html"))
    every = pages.where(F.col(html).isNotNull()).select(host(url).alias("host"), k1.alias("k1"), k2.alias("k2"), F.col(html).alias("html"))
    runs = written(repeated_runs(every, min_pages), "runs").toDF("__h", "__a", "__b", "__starts")
    size = runs.agg(F.sum(96 + 4 * F.size("__starts"))).first()[0] or 0
    on = (F.col("__host") == F.col("__h")) & (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b"))
    rows = join_by_size(rows, runs, on, "left", size)
    kept = rows.schema["__kept"]

    def scan(batches):
        for batch in batches:
            texts = []
            for doc, starts in zip(batch.column("__html").to_pylist(), batch.column("__starts").to_pylist(), strict=True):
                inside, outside = blocks_of(doc)
                texts.append("\n".join(inside or _unique(outside, starts)))
            yield pa.RecordBatch.from_arrays([batch.column("__kept"), pa.array(texts, pa.string())], names=["__kept", "main_text"])

    out = rows.select("__kept", "__html", "__starts").mapInArrow(scan, T.StructType([kept, T.StructField("main_text", T.StringType())]))
    return out.select("__kept.*", "main_text")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; repeated rows are extracted again, null ids and addresses stay null."""
    return extract(pages, ["page_id", "url"]).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
