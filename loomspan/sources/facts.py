"""What parsed pages (sources.tree) say of themselves, as Column expressions over the tree: nothing is searched in the source again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.sources.html import PARAGRAPH, _strings


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def meta(t: Column, *keys: str) -> Column:
    """The first content that any of the keys has, in their order; null without one."""
    own = lambda k: first(F.transform(F.filter(t["metas"], lambda m: (m["key"] == k) & (m["content"] != "")), lambda m: m["content"]))
    return F.coalesce(*(own(k) for k in keys))


def poster(t: Column, page: Column) -> Column:
    """The image that a page shows where it is shared, over https only; null without one."""
    href = urls.same_resource(page, meta(t, "og:image", "twitter:image", "twitter:image:src"))
    return F.when(href.rlike("^https://[^/@]+(/|$)"), href)


def share_text(t: Column) -> Column:
    return tx.readable(F.coalesce(meta(t, "og:description", "description", "twitter:description"), F.lit("")))


def canonical(t: Column, page: Column) -> Column:
    """Where a page says that it belongs; empty without a link."""
    own = F.filter(t["heads"], lambda h: F.array_contains(F.split(h["rel"], r"\s+"), "canonical"))
    return F.coalesce(urls.same_resource(page, first(F.transform(own, lambda h: h["href"]))), F.lit(""))


def feeds(t: Column, page: Column, most: int = 2) -> Column:
    """The feeds that a page's links name, as (url, kind): alternates, and links that look like feeds; distinct, the first `most`."""
    every = F.concat(F.transform(t["heads"], lambda h: F.struct(h["rel"].alias("rel"), h["type"].alias("type"), h["href"].alias("href"))), F.transform(t["links"], lambda x: F.struct(x["rel"].alias("rel"), F.lit("").alias("type"), x["href"].alias("href"))))
    looks = lambda h: (F.array_contains(F.split(h["rel"], r"\s+"), "alternate") & h["type"].rlike("rss|atom|feed|xml|json")) | h["href"].rlike(r"(?i)/(?:feed|rss|atom)(?:[./]|$)|\.(?:rss|atom)$")
    hint = lambda h: F.lower(F.concat_ws(" ", h["type"], h["href"]))
    kind = lambda h: F.when(hint(h).contains("json"), "json").when(hint(h).contains("atom"), "atom").otherwise("rss")
    found = F.transform(F.filter(every, looks), lambda h: F.struct(urls.same_resource(page, h["href"]).alias("url"), kind(h).alias("kind")))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x["url"].isNotNull())), 1, most)


def _bare_types(o: Column) -> Column:
    return F.filter(F.transform(_strings(o, "$.@type"), lambda t: F.substring_index(t, "/", -1)), lambda t: t != "")


def schema_types(t: Column) -> Column:
    """The types that a page declares, without their vocabularies; Article too where it shares itself as one."""
    shared = F.when(F.lower(F.coalesce(meta(t, "og:type"), F.lit(""))) == "article", F.array(F.lit("Article"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.flatten(F.transform(t["objects"], _bare_types)), shared))


def knows_about(t: Column) -> Column:
    """What a page's persons and organisations say that they know."""
    who = F.filter(t["objects"], lambda o: F.exists(_bare_types(o), lambda x: F.lower(x).isin("person", "organization")))
    name = lambda x: F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    return F.filter(F.flatten(F.transform(who, lambda o: F.transform(_strings(o, "$.knowsAbout"), name))), lambda x: x.isNotNull() & (x != ""))


def first_paragraph(t: Column) -> Column:
    """The first paragraph outside navigation, header and footer with PARAGRAPH characters or more; empty without one."""
    own = F.filter(F.transform(F.filter(t["paragraphs"], lambda p: ~p["chrome"]), lambda p: F.substring(p["text"], 1, tx.SUMMARY)), lambda p: F.length(p) >= PARAGRAPH)
    return F.coalesce(first(own), F.lit(""))
