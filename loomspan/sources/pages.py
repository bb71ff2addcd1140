"""Rows out of raw web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.html import attribute, decoded_all, whole_references, without_scripts

#: Elements whose text isn't read, and those that aren't part of a page's main text.
SILENT, AROUND = frozenset({"script", "style", "noscript", "template"}), frozenset({"nav", "header", "footer", "aside"})


def links(pages: DataFrame) -> DataFrame:
    """page_id, href for each link, in the page's order, quoted in any way or not; links in scripts and comments aren't any."""
    bare = F.regexp_replace(without_scripts(F.col("html")), r"(?s)<!--.*?-->", " ")
    tags = F.filter(F.regexp_extract_all(bare, F.lit(r"(?is)<a\b([^>]*)>"), 1), lambda a: a.rlike(r"(?i)\bhref\s*="))
    return pages.select("page_id", F.explode(decoded_all(F.transform(tags, lambda a: attribute(a, "href")))).alias("href"))


class _Regions(HTMLParser):
    def __init__(self):
        super().__init__()
        self.lang, self.title, self.main, self.around, self.stack = None, [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        if tag in SILENT or tag in AROUND or tag == "title":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if any(t in SILENT for t in self.stack):
            return
        (self.title if "title" in self.stack else self.around if any(t in AROUND for t in self.stack) else self.main).append(data)


def regions(pages: DataFrame) -> DataFrame:
    """page_id, lang, title, main, around: a page parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for html in b["html"]:
                p = _Regions()
                p.feed(whole_references(html))
                p.close()
                out.append((p.lang, *(" ".join(" ".join(x).split()) for x in (p.title, p.main, p.around))))
            yield pd.DataFrame({"page_id": b["page_id"], **{k: [o[i] for o in out] for i, k in enumerate(("lang", "title", "main", "around"))}})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, lang string, title string, main string, around string")
