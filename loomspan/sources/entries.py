"""Rows out of pages: events, figures, links to other hosts, outlines of what people use with their sections."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls, uses
from loomspan.sources import feeds
from loomspan.sources.html import AROUND, SILENT, attribute, decoded_all, json_ld, whole_references, without_scripts

_EVENT = r"""(?is)<(\w+)\b[^>]*class=["'][^"']*\bh-event\b[^"']*["'][^>]*>(.*?)</\1>"""


def _inner(name: str) -> str:
    return rf"""(?is)<[^>]+class=["'][^"']*\b{name}\b[^"']*["'][^>]*>(.*?)</\w+>"""


def marked_events(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, n, url, title, location, start, stop of events marked by class. Those without a title or start are left out; an address
    on another site gives way to the page's own."""
    rows, b = pages.select(key, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_EVENT), 2)).alias("n", "b")), F.col("b")
    plain = lambda c: tx.extracted(F.regexp_replace(c, r"<[^>]+>", " "))
    at = lambda name: feeds.iso(attribute(F.regexp_extract(b, rf"""(?is)<\w+\b([^>]*class=["'][^"']*\b{name}\b[^"']*["'][^>]*)>""", 1), "datetime"))
    href = urls.same_resource(F.col(url), attribute(F.regexp_extract(b, r"""(?is)<a\b([^>]*class=["'][^"']*\bu-url\b[^"']*["'][^>]*)>""", 1), "href"))
    own = F.when(urls.origin(href) == urls.origin(F.col(url)), href).otherwise(F.col(url))
    out = rows.select(key, "n", own.alias("url"), plain(F.regexp_extract(b, _inner("p-name"), 1)).alias("title"), plain(F.regexp_extract(b, _inner("p-location"), 1)).alias("location"), at("dt-start").alias("start"), at("dt-end").alias("stop"))
    return out.where("title <> '' AND start IS NOT NULL")


def declared_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, url, title, location, start, stop, cancelled of events in JSON-LD."""
    rows, o = pages.select(key, F.posexplode(json_ld(F.col(html))).alias("n", "o")), F.col("o")
    at = lambda p: feeds.iso(F.get_json_object(o, p))
    place = F.coalesce(F.get_json_object(o, "$.location.name"), F.get_json_object(o, "$.location"))
    out = rows.where(F.get_json_object(o, "$.@type").rlike("Event")).select(key, "n", F.get_json_object(o, "$.url").alias("url"), tx.extracted(F.get_json_object(o, "$.name")).alias("title"), place.alias("location"), at("$.startDate").alias("start"), at("$.endDate").alias("stop"), F.coalesce(F.get_json_object(o, "$.eventStatus").rlike("Cancelled"), F.lit(False)).alias("cancelled"))
    return out.where("title <> '' AND start IS NOT NULL")


def figures(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, n, url, title, image of figures with a caption or an alternative text that lead to a page of their own site; figures that
    only lead to their picture are left out. Pictures count over https only."""
    rows, b = pages.select(key, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<figure\b[^>]*>(.*?)</figure>"), 1)).alias("n", "b")), F.col("b")
    tag = lambda t: F.regexp_extract(b, rf"(?is)<{t}\b([^>]*)>", 1)
    caption = F.coalesce(F.nullif(F.regexp_extract(b, r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>", 1), F.lit("")), attribute(tag("img"), "alt"))
    src, href = urls.same_resource(F.col(url), F.nullif(attribute(tag("img"), "src"), F.lit(""))), urls.same_resource(F.col(url), F.nullif(attribute(tag("a"), "href"), F.lit("")))
    made = F.struct("n", F.coalesce(href, src).alias("u"), tx.extracted(F.regexp_replace(caption, r"<[^>]+>", " ")).alias("title"), F.when(src.startswith("https://"), src).alias("image"), urls.origin(F.col(url)).alias("o"))
    out = rows.select(key, F.explode(F.array(made)).alias("x")).select(key, "x.*")  # so that the filter reads what is made here
    return out.where((F.col("title") != "") & (urls.origin(F.col("u")) == F.col("o")) & ~F.col("u").rlike(r"(?i)\.(jpe?g|png|gif|webp|avif|svg|mp3|mp4|webm|ogg|wav|pdf)([?#]|$)")).select(key, "n", F.col("u").alias("url"), "title", "image")


def outbound(pages: DataFrame, key: str, html: str, url: str, hosts: tuple[str, ...] | None = None) -> DataFrame:
    """key, url, text of links to other sites, each address once with its first text; with hosts, to these and what lies below them only."""
    tags = F.regexp_extract_all(without_scripts(F.col(html)), F.lit(r"(?is)<a\b([^>]*)>(?:.*?)</a>"), 1)
    texts = F.regexp_extract_all(without_scripts(F.col(html)), F.lit(r"(?is)<a\b(?:[^>]*)>(.*?)</a>"), 1)
    both = F.arrays_zip(F.transform(tags, lambda a: attribute(a, "href")).alias("h"), decoded_all(F.transform(texts, lambda t: F.regexp_replace(t, r"<[^>]+>", " "))).alias("t"))
    rows = pages.select(key, url, F.posexplode(both).alias("n", "x")).select(key, url, "n", F.col("x.h").alias("h"), F.col("x.t").alias("t"))
    rows = rows.withColumn("u", urls.without_tracking(urls.same_resource(F.col(url), F.nullif(F.col("h"), F.lit(""))))).where(urls.origin(F.col("u")) != urls.origin(F.col(url)))
    if hosts:
        h = F.regexp_replace(urls.host(F.col("u")), r"^www\.", "")
        rows = rows.where(h.isin(*hosts) | F.exists(F.array(*map(F.lit, hosts)), lambda x: h.endswith(F.concat(F.lit("."), x))))
    return rows.groupBy(key, F.col("u").alias("url")).agg(tx.squeezed(F.min_by("t", "n")).alias("text"))


_BLOCK = "n:int,tag:string,section:string,text:string,href:string,depth:int,parent:int"


class _Outline(HTMLParser):
    """List items, terms and rows with the headings above them. A block's text is its own, without lists in it."""

    def __init__(self):
        super().__init__()
        self.headings, self.heading, self.blocks, self.open, self.lists, self.hidden = [], None, [], [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT or tag in AROUND:
            self.hidden.append(tag)
        elif self.hidden:
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and not self.open:
            self.heading = [int(tag[1]), []]
        elif tag in ("ul", "ol", "dl", "table"):
            self.lists += 1
        elif tag in ("li", "dt", "tr"):
            while self.open and self.open[-1]["depth"] >= self.lists:
                self.open.pop()
            parent = self.open[-1]["n"] if self.open else None
            self.blocks.append({"n": len(self.blocks), "tag": tag, "section": " / ".join(t for _, t in self.headings), "text": [], "href": None, "depth": self.lists, "parent": parent})
            self.open.append(self.blocks[-1])
        elif tag == "a" and self.open and self.open[-1]["href"] is None and self.open[-1]["depth"] == self.lists:
            self.open[-1]["href"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if self.heading and tag == f"h{self.heading[0]}":
            level, text = self.heading[0], " ".join("".join(self.heading[1]).split())
            self.headings = [h for h in self.headings if h[0] < level] + ([(level, text)] if text else [])
            self.heading = None
        elif tag in ("ul", "ol", "dl", "table"):
            while self.open and self.open[-1]["depth"] >= self.lists:
                self.open.pop()
            self.lists = max(0, self.lists - 1)
        elif tag in ("li", "dt", "tr") and self.open and self.open[-1]["depth"] == self.lists:
            self.open.pop()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.heading:
            self.heading[1].append(data)
        elif self.open and self.open[-1]["depth"] == self.lists:
            self.open[-1]["text"].append(data)


def outline_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, n, tag, section (headings above, joined by slashes), text, href (its first link), depth, parent (n) of each list item,
    term and table row outside navigation. Parsed in Arrow batches; a null page has none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"`{key}` {pages.schema[key].dataType.simpleString()}, blocks array<struct<{_BLOCK}>>"
    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source in b.column(1).to_pylist():
                p = _Outline()
                p.feed(whole_references(source))
                p.close()
                rows.append([{**x, "text": " ".join("".join(x["text"]).split())} for x in p.blocks])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, schema.field(1).type)], schema=schema)

    return pages.select(key, html).mapInArrow(run, ddl).select(key, F.explode("blocks").alias("x")).select(key, "x.*").where("text <> ''")


def use_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, n, label, context, section, status, href, purposes of what pages list as used: a block up to its first separator is the
    label, the rest its context. Denied uses, sentences, articles and labels that repeat their section are left out."""
    b = outline_blocks(pages, key, html)
    split = r"^(.*?)(?:\s[-–—]\s|:\s|\s\()(.*?)\)?$"
    label = F.when(F.col("text").rlike(split), F.regexp_extract("text", split, 1)).otherwise(F.col("text"))
    made = F.struct("n", tx.label(label).alias("label"), F.regexp_extract("text", split, 2).alias("context"), F.substring_index("section", " / ", -1).alias("section"), uses.status(F.concat_ws(" ", "section", "text")).alias("status"), "href")
    # Through explode(), so that the filter below reads the label instead of making it anew in each of its patterns.
    b = b.select(key, F.explode(F.array(made)).alias("x")).select(key, "x.*")
    good = (F.col("label") != "") & ~uses.is_sentence(F.col("label"), clean=True) & ~uses.is_article(F.col("label"), clean=True) & (F.col("status") != "unspecified") & ~((F.lower("label") == F.lower("section")) & (F.col("context") == ""))
    return b.where(good).select(key, "n", "label", "context", "section", "status", "href", uses.purposes(F.concat_ws(" ", "section", "context")).alias("purposes"))


def requests(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, n, description, title, categories, url of listings marked as wanted (h-listing with p-action); those without a description go."""
    block = r"""(?is)<(\w+)\b[^>]*class=["'][^"']*\bh-listing\b[^"']*["'][^>]*>(.*?)</\1>"""
    rows, b = pages.select(key, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(block), 2)).alias("n", "b")), F.col("b")
    plain = lambda name: tx.extracted(F.regexp_replace(F.regexp_extract(b, _inner(name), 1), r"<[^>]+>", " "))
    cats = F.transform(F.regexp_extract_all(b, F.lit(_inner("p-category")), 1), lambda c: tx.squeezed(F.regexp_replace(c, r"<[^>]+>", " ")))
    out = rows.where(F.lower(plain("p-action")) == "wanted").select(key, "n", F.substring(F.coalesce(F.nullif(plain("p-description"), F.lit("")), plain("e-description")), 1, tx.SUMMARY).alias("description"), plain("p-name").alias("title"), cats.alias("categories"), F.col(url).alias("url"))
    return out.where("description <> ''")


def albums(pages: DataFrame, key: str, html: str, url: str, mark: str = "album-in-list-link") -> DataFrame:
    """key, url, title of marked album links within the page's own site, each address once, titled by their first span, else by their picture."""
    both = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(rf"""(?is)<a\b([^>]*\bclass=["']?[^"'>]*{mark}[^>]*)>.*?</a>"""), 1).alias("a"), F.regexp_extract_all(F.col(html), F.lit(rf"""(?is)<a\b[^>]*\bclass=["']?[^"'>]*{mark}[^>]*>(.*?)</a>"""), 1).alias("i"))
    rows = pages.select(key, url, F.posexplode(both).alias("n", "x"))
    inner = F.col("x.i")
    title = F.coalesce(F.nullif(tx.extracted(F.regexp_replace(F.regexp_extract(inner, r"(?is)<span[^>]*>(.*?)</span>", 1), r"<[^>]+>", " ")), F.lit("")), tx.extracted(attribute(F.regexp_extract(inner, r"(?is)<img\b([^>]*)>", 1), "alt")))
    out = rows.select(key, "n", urls.same_resource(F.col(url), F.nullif(attribute(F.col("x.a"), "href"), F.lit(""))).alias("u"), title.alias("t"), F.col(url).alias("p"))
    return out.where((urls.origin(F.col("u")) == urls.origin(F.col("p"))) & (F.col("t") != "")).groupBy(key, F.col("u").alias("url")).agg(F.min_by("t", "n").alias("title"))


def children(links: DataFrame, key: str, page: str, href: str, most: int = 200) -> DataFrame:
    """key, url: the pages of its own site that an index page (page) links to (links: key, page, n, href), each once, the first `most`; not
    the index itself and no static files."""
    from loomspan.operators.ranking import capped

    rows = links.withColumn("url", urls.without_fragment(urls.same_resource(F.col(page), F.col(href))))
    good = (urls.origin(F.col("url")) == urls.origin(F.col(page))) & (urls.path(F.col("url")) != urls.path(F.col(page))) & ~urls.path(F.col("url")).rlike(r"(?i)\.(css|js|jpe?g|png|gif|webp|avif|svg|ico|pdf|zip|mp3|mp4|webm|woff2?)$")
    return capped(rows.where(good).groupBy(key, "url").agg(F.min("n").alias("n")), [key], [F.col("n")], most).select(key, "url")
