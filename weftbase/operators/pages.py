"""Web pages: parsing once into candidate texts and links, choosing, chunking, crawling stored pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftbase.functions.citation import website
from weftbase.functions.text import break_aware_chunks, html_title
from weftbase.operators.search import longest

PARSED = "page_id long, url string, title string, candidates array<struct<method:string,text:string>>, links array<struct<href:string,nav:boolean,ord:int,place:int>>"
#: Class or id words that mark the main content.
CONTAINERS = ("content", "main-content", "article-body", "post-content", "entry-content")
_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "ul", "ol", "body", "main"}
_VOID = {"br", "img", "hr", "input", "meta", "link"}
#: White space that is not one blank already.
_WIDE, _BLANKS = re.compile(r"[^\S ]\s*| \s+"), re.compile(" {2,}")


class _Page(HTMLParser):
    """Texts of an article, a content container, the body, paragraphs, headings; and links in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.texts: dict[str, list[str]] = {k: [] for k in ("article", "container", "body", "paragraphs", "headings", "nav", "header", "title")}
        self.links: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "a" and own.get("href") is not None:
            self.links.append((own["href"], any(t in ("nav", "header", "footer") for t, _ in self.stack)))
        marked = any(w in CONTAINERS for w in f"{own.get('class') or ''} {own.get('id') or ''}".split())
        if tag not in _VOID:
            self.stack.append((tag, marked))
        if tag in _BLOCK:
            self._break(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in _BLOCK:
                    self._break(tag)
                del self.stack[i:]
                break

    def _break(self, tag: str) -> None:
        for v in self.texts.values():
            if v and v[-1] != "\n":
                v.append("\n")
        if re.fullmatch("h[1-6]", tag) and self.texts["headings"][-1:] != ["#" * int(tag[1]) + " "]:
            self.texts["headings"].append("#" * int(tag[1]) + " " if any(t == tag for t, _ in self.stack[-1:]) else "")

    def handle_data(self, data: str) -> None:
        tags = {t for t, _ in self.stack}
        text = _WIDE.sub(" ", data)
        if tags & _SKIP or not text.strip():
            return
        put = lambda k: self.texts[k].append(text)
        if "title" in tags:
            return put("title")
        if "nav" in tags:
            put("nav")
        heading = any(re.fullmatch("h[1-6]", t) for t in tags)
        if heading:
            put("header")
        if "article" in tags:
            put("article")
        if any(m for _, m in self.stack):
            put("container")
        if "body" in tags or "html" not in tags:
            put("body")
        if "p" in tags:
            put("paragraphs")
        if "p" in tags or heading:
            put("headings")

    def text(self, kind: str) -> str:
        lines = (_BLANKS.sub(" ", x).strip() for x in "".join(self.texts[kind]).split("\n"))
        return "\n".join(x for x in lines if x.strip("# "))


def absolute(base: str, href: str) -> str | None:
    """A link of the same host without query and fragment; None for others."""
    if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
        return None
    try:
        full = urlsplit(urldefrag(urljoin(base, href)).url)
    except ValueError:
        return None
    if full.scheme not in ("http", "https") or full.netloc != urlsplit(base).netloc:
        return None
    return urlunsplit((full.scheme, full.netloc, full.path, "", ""))


def parse_page(html: str | None, url: str | None) -> tuple[str, list[dict], list[dict]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    found = [{"method": m, "text": page.text(m)} for m in ("article", "container", "body", "paragraphs", "headings")]
    nav = " | ".join(x for x in page.text("nav").split("\n"))
    head = "\n".join(f"Header: {x}" for x in page.text("header").split("\n") if x)
    title = page.text("title").replace("\n", " ")
    found.append({"method": "navigation", "text": "\n".join(x for x in (f"Title: {title}" if title else "", f"Menu/Navigation: {nav}" if nav else "", head) if x)})
    links: dict[str, dict] = {}
    for place, (href, is_nav) in enumerate(sorted(page.links, key=lambda x: not x[1])):
        full = absolute(url or "", href)
        if full and full not in links:
            links[full] = {"href": full, "nav": is_nav, "ord": len(links), "place": place}
    return title, found, list(links.values())


def parsed(pages: DataFrame) -> DataFrame:
    """Each page (page_id, url, html) parsed once: title, candidate texts, links to its own host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse_page(h, u) for h, u in zip(pdf["html"], pdf["url"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "title": [r[0] for r in rows], "candidates": [r[1] for r in rows], "links": [r[2] for r in rows]})

    return pages.select("page_id", "url", "html").mapInPandas(run, PARSED)


def main_content(rows: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, title, method, text): the longest candidate; navigation and headings only where it is
    shorter than ``least`` characters."""
    main = longest(F.filter("candidates", lambda c: c["method"] != "navigation"))
    nav = F.get(F.filter("candidates", lambda c: c["method"] == "navigation"), F.lit(0))
    best = F.when(F.length(main["text"]) >= least, main).when(F.length(nav["text"]) > F.length(main["text"]), nav).otherwise(main)
    return rows.withColumn("_b", best).select("page_id", "url", "title", F.col("_b.method").alias("method"), F.col("_b.text").alias("text"))


def passed(contents: DataFrame, topic: Column, least: int = 100) -> DataFrame:
    """Pages with enough text; short topic pages get a line that names their topic, other short ones go."""
    short = F.length("text") < least
    filled = F.when(short & topic, F.concat_ws("\n", F.concat(F.lit("Topic page: "), F.coalesce("title", "url")), "text")).otherwise(F.col("text"))
    return contents.filter(~short | topic).withColumn("is_minimal", short).withColumn("text", filled)


def page_chunks(contents: DataFrame, retrieved_on: str, size: int = 1000, overlap: int = 250, most: int = 1000) -> DataFrame:
    """Chunks of pages with title, URL, index, page number and citation."""
    rows = contents.select("page_id", "url", "title", "method", F.posexplode(F.slice(break_aware_chunks(F.col("text"), size, overlap), 1, most)).alias("chunk_index", "c"))
    return rows.select("page_id", "url", "title", "method", "chunk_index", F.col("c.text").alias("text"), (F.col("chunk_index") + 1).alias("page_number"), website(F.col("title"), F.col("url"), retrieved_on).alias("citation"))


def titled(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_title(F.col("html"), F.col("url")).alias("title"))


def links(rows: DataFrame) -> DataFrame:
    """(url, dst, nav, ord): links of parsed pages, navigation first."""
    return rows.select("url", F.explode("links").alias("l")).select("url", F.col("l.href").alias("dst"), F.col("l.nav").alias("nav"), F.col("l.ord").alias("ord"))


def links_of_urls(rows: DataFrame) -> DataFrame:
    """(url, dst, nav, ord): ``links`` of each URL, whatever number of pages is stored under it. A link has one row,
    at the first of its places among all links of a page; of links at the same place of two pages, navigation comes
    first, then the lesser ``dst``. The links of one URL are sorted in one task, which spills."""
    found = rows.select("url", F.explode("links").alias("l"))
    at = F.min(F.col("l.place") * 2 + F.when(F.col("l.nav"), 0).otherwise(1)).alias("at")
    merged = found.groupBy("url", F.col("l.href").alias("dst")).agg(at)
    ord_ = (F.row_number().over(Window.partitionBy("url").orderBy("at", "dst")) - 1).alias("ord")
    return merged.select("url", "dst", (F.col("at") % 2 == 0).alias("nav"), ord_)


def first_links(edges: DataFrame, most: int, keywords: tuple[str, ...] = ()) -> DataFrame:
    """(url, out): each page's first ``most`` distinct links (url, dst, nav, ord) in one array of (at, dst). Links
    with a keyword come first, then navigation links, then by place on the page. Spark cuts the groups before its
    shuffle, so a page with very many links sends ``most`` rows a task."""
    promoted = F.lit(1)
    for k in keywords:
        promoted = F.when(F.contains(F.lower("dst"), F.lit(k)), 0).otherwise(promoted)
    at = F.struct(promoted.alias("promoted"), (~F.coalesce("nav", F.lit(False))).cast("int").alias("not_nav"), "ord")
    distinct = edges.filter("url is not null and dst is not null").groupBy("url", "dst").agg(F.min(at).alias("at"))
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("at", "dst"))).filter(F.col("_r") <= most)
    return ranked.groupBy("url").agg(F.collect_list(F.struct("at", "dst")).alias("out"))


def crawl(edges: DataFrame, seeds: DataFrame, max_pages: int = 25, keywords: tuple[str, ...] = (), keep=None) -> DataFrame:
    """(seed, url, depth, ord): pages reached from each seed over stored links, breadth first, up to
    ``max_pages`` a seed, which ends the rounds at that depth; of the pages of one depth, those in the order of
    ``first_links``. ``keep`` writes rows where their lineage should end (a function of DataFrame).

    A seed with room for r pages has visited ``max_pages - r``, so of one page's links it takes none behind the
    first ``max_pages``: links are cut to those once, which loses nothing. A round writes its own pages only, and
    reads the visited pages of seeds that have room and came upon something new in the round before. There are at
    most ``max_pages`` rounds, and a round has at most ``max_pages`` squared rows a seed. A seed with a null URL is
    its own only page; links from or to null URLs are left out."""
    keep = keep or (lambda df: df.checkpoint())
    out = keep(first_links(edges, max_pages, keywords))
    start = seeds.select(F.col("url").alias("seed"), "url").distinct()
    rounds = [keep(start.withColumns({"depth": F.lit(0), "ord": F.lit(0), "held": F.lit(1)}))]
    of_seed = Window.partitionBy("seed")
    while True:
        frontier = rounds[-1].filter(F.col("held") < max_pages)
        if frontier.isEmpty():
            break
        seen = reduce(DataFrame.unionByName, rounds).select("seed", "url").join(frontier.select("seed").distinct(), "seed", "left_semi")
        step = frontier.select("seed", "url", "held").join(out, "url").select("seed", "held", F.explode("out").alias("o"))
        step = step.groupBy("seed", F.col("o.dst").alias("url")).agg(F.min("o.at").alias("at"), F.first("held").alias("before"))
        step = step.join(seen, ["seed", "url"], "left_anti").withColumn("_r", F.row_number().over(of_seed.orderBy("at", "url")))
        step = step.filter((F.col("_r") <= max_pages) & (F.col("before") + F.col("_r") <= max_pages))
        place = (F.col("before") + F.col("_r") - 1).cast("int").alias("ord")
        held = (F.col("before") + F.count(F.lit(1)).over(of_seed)).cast("int").alias("held")
        rounds.append(keep(step.select("seed", "url", F.lit(len(rounds)).alias("depth"), place, held)))
    return reduce(DataFrame.unionByName, rounds).drop("held")


def seed_urls(bases: DataFrame, terms: DataFrame, most: int = 100) -> DataFrame:
    """URLs from base and term, and the term without hyphens; the first ``most`` of each base. Both tables
    are short lists kept by hand."""
    pairs = bases.select("base").distinct().crossJoin(terms.select("term").distinct())
    slug = F.regexp_replace(F.lower("term"), r"\s+", "-")
    rows = pairs.select("base", F.explode(F.array_distinct(F.array(F.concat("base", slug), F.concat("base", F.regexp_replace(slug, "-", ""))))).alias("url"))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("base").orderBy("url"))).filter(F.col("at") <= most)


def pdf_chunks(pages: DataFrame, most_pages: int = 50, most_chars: int = 10_000, most_chunks: int = 200) -> DataFrame:
    """Chunks of page texts (document_id, page_number, text): the first pages, long ones cut, numbered through
    each document."""
    from weftbase.functions.text import fixed_chunks, truncated
    from weftbase.operators.queue import ordinals

    rows = pages.filter(F.col("page_number") <= most_pages).withColumn("text", truncated(F.col("text"), most_chars))
    rows = rows.select("document_id", "page_number", F.explode(fixed_chunks(F.col("text"))).alias("c")).select("document_id", "page_number", F.col("c.pos").alias("chunk_index"), F.col("c.text").alias("text_content"))
    return ordinals(rows).filter(F.col("ordinal") < most_chunks)
