"""Main text of web pages by template deduction over the pages of a host.

Each page gives tokens: its element paths (tag, classes, id, role, with the path above) and its text blocks. A token's
occurrence vector says how often it occurs on each page of the host. Tokens with the same vector form an
equivalence class; a class that enough pages of the host share is valid. Valid classes nest by their paths and
make up the host's template: text blocks of a valid class belong to the template itself (menus, notices, captions); all other
text stands in slots of the elements around it. Elements that occur once on each of their pages are the template's frame,
elements that occur in varying numbers (paragraphs, list items) are sets that repeat inside a slot.

The article is a slot too: the innermost element of the frame below which most of the slots' text stands, in elements inside it
rather than in its own text. So it is found on pages whose tags and classes tell nothing, where links, adverts and the like that
change from page to page stand in other slots. Names are a check on it. Elements that are no article by name (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments) are left out of the slots. If the page has an article by name
(article, main, content classes) around or inside the deduced one, its extent counts; if both stand apart, the
deduced one counts. Headings beside the deduced article's elements belong to it. Hosts of few pages have no template: names decide.

Inside an article element a class of blocks is the template's if half of the pages with its path have it and most of their
article is left for the slots: pages that share most of their article are copies, which keep it. On pages without an article
element a class is judged by its own support, a fixed number of pages, so menus and articles of each of a host's layouts are
found; they reach the pages that have them by a join, as there may be many.

Vectors are compared through sums of keyed hashes over pages, a grouped sum per (host, token), so a host with a third
of all pages is combined before the shuffle and none of its pages meet in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import as_text, from_text, stored
from verdigris.llm.markup import INLINE, Element, Run, runs, spaced

#: A class is valid from so many pages on, and from this share of the host's pages.
LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: A class of blocks that makes up more than this of its pages' text leaves no slots; its pages are copies.
MOST_TEXT = 0.5
#: The same outside article elements, where menus may outweigh the text; and from how many pages on a class counts there.
MOST_AROUND = 0.8
LAYOUT_PAGES = 5
#: The article holds more than this of the slots' text, and no more than this of it outside elements of its own.
MAIN_SHARE = 0.5
#: In place of a block's hash: the path is an article's.
_REGION = -1
_HEADING = re.compile(r"h[1-6](?![a-z0-9])")
#: Pages of which this says no have no article element.
_MAY_HAVE_ARTICLE = r"(?i)<article|articlebody"
_HALF = (1 << 31) - 1

_TOKENS = (
    "host string, path string, block long, inside boolean, times int, low long, high long, own long, direct long, whole long"
)


def _blocks(source: str) -> tuple[list[Element], list[tuple[str, Element]]]:
    """The elements of a page, and its text blocks (spaces made one) with their element."""
    elements, blocks = [], []
    last: Run | None = None
    for item in runs(source):
        if isinstance(item, Element):
            elements.append(item)
        elif last is not None and item.block == last.block and item.element.aside == last.element.aside:
            last.text += item.text
        else:
            last = item
            blocks.append(item)
    return elements, [(text, run.element) for run in blocks if (text := spaced(run.text))]


def _inside(path: str, regions: set[str]) -> bool:
    """Whether a path is one of the regions or below one."""
    return path in regions or any(path.startswith(p + "/") for p in regions)


def _article(elements: list[Element]) -> set[str]:
    """The paths of a page's article elements."""
    return {e.path for e in elements if e.region == 1 and not e.aside}


def _block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def _sizes(paths: set[str], blocks: list[tuple[str, Element]]) -> tuple[Counter, Counter]:
    """The characters of open blocks by path: those below it, and those that stand in it and its inline elements."""
    direct: Counter = Counter()
    for text, e in blocks:
        if not e.aside:
            path = e.path
            while re.split(r"[.#@]", path.rpartition("/")[2], maxsplit=1)[0] in INLINE:
                path = path.rpartition("/")[0]
            direct[path] += len(text)
    below = Counter(direct)
    for path in sorted(paths | direct.keys(), key=len, reverse=True):
        if path:
            below[path.rpartition("/")[0]] += below[path]
    return below, direct


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per distinct token of every page; ``low`` and ``high`` are hashes of (page, occurrences).

    Elements say how many open characters stand below them (``own``), directly in them (``direct``) and on the page (``whole``);
    blocks whether they stand inside an article element, their characters (``own``) and those of all blocks there (``whole``).
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, source in zip(batch["host"], batch["page"], batch["html"]):
                elements, blocks = _blocks(source or "")
                article = _article(elements)
                seen = Counter((e.path, None, False) for e in elements)
                seen["", None, False] += 1
                below, direct = _sizes({e.path for e in elements}, blocks)
                whole: Counter = Counter()
                sizes = {}
                for text, e in blocks:
                    if not e.aside:
                        token = (e.path, _block_hash(text), _inside(e.path, article))
                        seen[token] += 1
                        sizes[token] = len(text)
                        whole[token[2]] += len(text)
                for token, n in seen.items():
                    path, block, inside = token
                    mark = xxhash.xxh3_64_intdigest(f"{page} {n}".encode())
                    if block is None:
                        counts = (below[path], direct[path], below[""])
                    else:
                        counts = (n * sizes[token], 0, whole[inside])
                    rows.append((host, *token, n, mark & _HALF, mark >> 33, *counts))
            names = ["host", "path", "block", "inside", "times", "low", "high", "own", "direct", "whole"]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.mapInPandas(tokens, _TOKENS)


def _article_template(summed: DataFrame) -> DataFrame:
    """``h``, ``p``, ``block``, ``inside``, ``own`` of template blocks inside article elements.

    Half of the pages that have the path have the block, so a path has few of them, and the blocks of its class leave most of
    their pages' article for the slots.
    """
    around = summed.filter("block is null").select(
        F.col("host").alias("h"), F.col("path").alias("p"), F.col("pages").alias("around")
    )
    blocks = summed.filter("inside")
    nested = blocks.join(around, blocks["host"].eqNullSafe(around["h"]) & (blocks["path"] == around["p"])).filter(
        F.col("pages") >= LEAST_SHARE * F.col("around")
    )
    classes = nested.groupBy("host", "low", "high").agg(
        F.sum("own").alias("own"),
        F.max("whole").alias("whole"),
        F.collect_list(F.struct("path", "block", "own")).alias("texts"),
    )
    found = classes.filter(F.col("own") <= MOST_TEXT * F.col("whole")).select(F.col("host").alias("h"), F.explode("texts").alias("t"))
    return found.select("h", F.col("t.path").alias("p"), "t.block", F.lit(True).alias("inside"), "t.own")


def _open_tokens(pages: DataFrame) -> DataFrame:
    """``h``, ``page``, ``p``, ``b``: the distinct open blocks and elements (``_REGION``) of pages without an article element."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, source in zip(batch["host"], batch["page"], batch["html"]):
                elements, blocks = _blocks(source or "")
                tokens = {(e.path, _block_hash(t)) for t, e in blocks if not e.aside}
                tokens |= {(e.path, _REGION) for e in elements if not e.aside}
                rows += [(host, page, *token) for token in tokens]
            yield pd.DataFrame(rows, columns=["h", "page", "p", "b"], dtype=object)

    return pages.mapInPandas(found, "h string, page long, p string, b long")


def _layout_template(summed: DataFrame) -> DataFrame:
    """``h``, ``p``, ``block``, ``inside``, ``own`` of template blocks outside article elements, by the support of their class."""
    blocks = summed.filter(F.col("block").isNotNull() & ~F.col("inside") & (F.col("pages") >= LAYOUT_PAGES))
    classes = (
        blocks.groupBy("host", "low", "high")
        .agg(F.sum("own").alias("own"), F.max("whole").alias("whole"))
        .filter(F.col("own") <= MOST_AROUND * F.col("whole"))
        .select(F.col("host").alias("of"), F.col("low").alias("l"), F.col("high").alias("g"))
    )
    same = blocks["host"].eqNullSafe(classes["of"]) & (blocks["low"] == classes["l"]) & (blocks["high"] == classes["g"])
    return blocks.join(classes, same, "left_semi").select(F.col("host").alias("h"), F.col("path").alias("p"), "block", "inside", "own")


def page_layouts(layout: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``page`` and ``layout`` (paths and hashes of its template blocks, paths of its articles) of pages that have any."""
    known = layout.select("h", "p", "block").unionByName(
        regions.select(F.col("host").alias("h"), F.col("path").alias("p"), F.lit(_REGION).cast("long").alias("block"))
    )
    known = known.select(F.col("h").alias("of"), F.col("p").alias("path"), "block")
    tokens = _open_tokens(pages)
    same = tokens["h"].eqNullSafe(known["of"]) & (tokens["p"] == known["path"]) & (tokens["b"] == known["block"])
    met = tokens.join(known, same, "left_semi").distinct().groupBy("page")
    return stored(met.agg(F.collect_list(F.struct(F.col("p").alias("path"), F.col("b").alias("block"))).alias("layout")), "page-layouts")


def summed_tokens(pages: DataFrame) -> DataFrame:
    """The support, vector and characters of every token of every host that can be part of its template."""
    summed = page_tokens(pages).groupBy("host", "path", "block", "inside").agg(
        F.count("*").alias("pages"),
        F.max("times").alias("times"),
        *[F.sum(c).alias(c) for c in ("low", "high", "own", "direct", "whole")],
    )
    return stored(summed.filter(F.col("block").isNull() | (F.col("pages") >= LEAST_PAGES)), "page-tokens")


def _of_most_pages(tokens: DataFrame, summed: DataFrame) -> DataFrame:
    """Those tokens that half of their host's pages have."""
    whole = summed.filter("path = '' and block is null").select(F.col("host").alias("of"), F.col("pages").alias("all"))
    valid = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all"))
    return tokens.join(whole, tokens["host"].eqNullSafe(whole["of"])).filter(valid).drop("of", "all")


def _host_template(summed: DataFrame) -> DataFrame:
    """``h``, ``p``, ``block``, ``inside``, ``own`` of template blocks that most pages of a host share, and of those in articles."""
    valid = _of_most_pages(summed, summed)
    # a block of a class of elements: the same occurrence vector
    texts = valid.filter("block is not null and not inside").select(
        F.col("host").alias("h"), F.col("path").alias("p"), "block", "inside", "own", F.col("low").alias("l"), F.col("high").alias("g")
    )
    classes = valid.filter("block is null").select("host", "low", "high").distinct()
    same = texts["h"].eqNullSafe(classes["host"]) & (texts["l"] == classes["low"]) & (texts["g"] == classes["high"])
    return texts.join(classes, same, "left_semi").select("h", "p", "block", "inside", "own").unionByName(_article_template(summed))


def _and_above(path: Column) -> Column:
    """A path and the paths of all elements around it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def article_regions(summed: DataFrame, template: DataFrame) -> DataFrame:
    """``host``, ``path``, ``pages`` of elements of the frame below which most text of the slots of their pages stands."""
    fixed = template.select("h", F.explode(_and_above(F.col("p"))).alias("a"), "own").groupBy("h", "a").agg(F.sum("own").alias("fixed"))
    frame = summed.filter((F.col("block").isNull()) & (F.col("path") != "") & (F.col("times") == 1) & (F.col("pages") >= LAYOUT_PAGES))
    joined = frame.join(fixed, frame["host"].eqNullSafe(fixed["h"]) & (frame["path"] == fixed["a"]), "left")
    text = F.coalesce("fixed", F.lit(0))
    slots = F.col("own") - text
    main = (slots > MAIN_SHARE * (F.col("whole") - text)) & (F.col("direct") <= MAIN_SHARE * F.col("own"))
    return joined.filter(main).select("host", "path", "pages")


def host_templates(summed: DataFrame, template: DataFrame, regions: DataFrame) -> DataFrame:
    """``host``, ``regions`` (paths of its articles) and ``texts`` (path, hash, ``inside`` of template blocks)."""
    fixed = template.groupBy("h").agg(F.collect_list(F.struct(F.col("p").alias("path"), "block", "inside")).alias("texts"))
    found = _of_most_pages(regions, summed).groupBy("host").agg(F.collect_list("path").alias("regions"))
    hosts = found.join(fixed, found["host"].eqNullSafe(fixed["h"]), "full")
    return stored(hosts.select(F.coalesce("host", "h").alias("host"), "regions", "texts"), "host-templates")


def _heads(path: str, region: str) -> bool:
    """Whether a path is a heading beside a region or an element around it."""
    above, _, label = path.rpartition("/")
    return bool(_HEADING.match(label)) and _inside(region, {above})


def main_text(
    source: str | None,
    regions: set[str] | None = None,
    texts: set[tuple[str, int, bool]] | None = None,
    layout: set[tuple[str, int]] | None = None,
) -> str:
    """The main text of one page, given its host's articles and template and what of the page belongs to its layout."""
    elements, blocks = _blocks(source or "")
    open_blocks = [(t, e) for t, e in blocks if not e.aside]
    ranks = [e.region for e in elements if e.region and not e.aside]
    named = {e.path for e in elements if ranks and e.region == min(ranks) and not e.aside}
    known = {p for p, b in layout or () if b == _REGION} | (regions or set())
    deduced = max((e.path for e in elements if e.path in known and not e.aside), key=len, default=None)
    kept = []
    if deduced is not None and not any(_inside(deduced, {n}) or _inside(n, {deduced}) for n in named):
        kept = [(t, e) for t, e in open_blocks if _inside(e.path, {deduced}) or _heads(e.path, deduced)]
    elif named:
        kept = [(t, e) for t, e in open_blocks if _inside(e.path, named)]
    if not kept:
        kept = open_blocks
    if texts:  # what all pages say is the template's
        article = _article(elements)
        kept = [(t, e) for t, e in kept if (e.path, _block_hash(t), _inside(e.path, article)) not in texts]
    if layout:  # a page of which nothing else is left is one of several copies
        kept = [(t, e) for t, e in kept if (e.path, _block_hash(t)) not in layout] or kept
    return " ".join(t for t, _ in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, the main text and its length for every page.

    The host is the part of the url between its scheme and path; pages without one are a host of their own. A null or
    empty html has an empty text. Repeated rows give equal results; an empty table gives no rows; other
    columns are not read.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    hashed = rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    summed = summed_tokens(hashed)
    template, layout = stored(_host_template(summed), "host-blocks"), stored(_layout_template(summed), "layout-blocks")
    regions = stored(article_regions(summed, template.unionByName(layout).distinct()), "host-articles")
    templates = host_templates(summed, template, regions)
    marked = F.col("html").rlike(_MAY_HAVE_ARTICLE)
    layouts = page_layouts(layout, regions, hashed.filter(~marked)).withColumnRenamed("page", "met")
    bare = rows.filter(~marked).withColumn("page", F.xxhash64("page_id", "url", "html"))
    bare = bare.join(layouts, F.col("page") == F.col("met"), "left").drop("page", "met")
    rest = rows.filter(marked | marked.isNull()).withColumn("layout", F.lit(None).cast(layouts.schema["layout"].dataType))
    rows = rest.unionByName(bare)
    joined = rows.join(templates.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed: dict = {}
        for batch in batches:
            out = []
            columns = [batch[c] for c in ("host", "html", "regions", "texts", "layout")]
            for name, source, regions, texts, layout in zip(*columns):
                if name not in fixed:
                    if len(fixed) >= 1000:
                        fixed.clear()
                    blocks = {(x["path"], x["block"], x["inside"]) for x in texts} if texts is not None else set()
                    fixed[name] = (set(regions) if regions is not None else set(), blocks)
                own = {(x["path"], x["block"]) for x in layout} if layout is not None else None
                out.append(main_text(source, *fixed[name], own))
            frame = batch[["page_id", "url"]].reset_index(drop=True)
            yield frame.assign(text=out, n_chars=[len(t) for t in out])

    wanted = joined.select(as_text("page_id"), "url", "host", "html", "regions", "texts", "layout")
    return from_text(wanted.mapInPandas(read, "page_id string, url string, text string, n_chars long"), "page_id")
