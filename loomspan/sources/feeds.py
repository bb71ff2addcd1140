"""Rows out of feeds, outlines, sitemaps and robots files: tables of bodies in, tables of items out, in DataFrame operations.

Bodies that aren't what they should be give no rows. Items keep the body's key, and n, their place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.sources.html import attribute

JSON_FEED = "struct<items:array<struct<id:string,url:string,external_url:string,title:string,summary:string,content_text:string,content_html:string,date_published:string,language:string,image:string,tags:array<string>>>>"
HUGO = "array<struct<title:string,permalink:string,url:string,summary:string,content:string,date:string,tags:array<string>>>"


def _first(*values: Column) -> Column:
    """The first value that isn't empty; empty without one."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values), F.lit(""))


def _tag(block: Column, *names: str) -> Column:
    return _first(*(F.regexp_extract(block, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1) for n in names))


def iso(c: Column) -> Column:
    """A time in ISO form or as in mails, as a UTC instant; null otherwise."""
    mail = F.regexp_replace(F.regexp_replace(c, r"(?i)^[a-z]{3},\s*", ""), r"(?i)\b(GMT|UTC|Z|UT)$", "+0000")
    return F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm Z")))


def xml_items(bodies: DataFrame, key: str, body: str, site: str | None = None) -> DataFrame:
    """key, n, id, url, title, summary, published_at, categories of RSS items and Atom entries. With site, a column of origins,
    items that lie elsewhere are left out."""
    blocks = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    rows = bodies.select(key, *([site] if site else []), F.posexplode(blocks).alias("n", "b"))
    b = F.col("b")
    # Atom: the first link without a rel or with rel=alternate.
    tags = F.regexp_extract_all(b, F.lit(r"(?i)<link\b([^>]*)/?>"), 1)
    href = F.get(F.transform(F.filter(tags, lambda a: attribute(a, "rel").isin("", "alternate")), lambda a: attribute(a, "href")), F.lit(0))
    plain = lambda c: tx.extracted(F.regexp_replace(tx.decoded(tx.without_cdata(c)), r"<[^>]+>", " "))
    terms = F.transform(F.regexp_extract_all(b, F.lit(r"(?i)<category\b([^>]*)/?>"), 1), lambda a: attribute(a, "term"))
    names = F.regexp_extract_all(b, F.lit(r"(?is)<category(?:\s[^>]*)?>(.*?)</category>"), 1)
    blank = F.lit("\x1f")
    rows = rows.select(
        key, *([site] if site else []), "n", tx.extracted(_tag(b, "guid", "id")).alias("id"), tx.extracted(_first(F.regexp_extract(b, r"(?is)<link(?:\s[^>]*)?>(.*?)</link>", 1), F.coalesce(href, F.lit("")))).alias("url"),
        plain(_tag(b, "title")).alias("title"), tx.summary(_tag(b, "description", "summary", "content:encoded", "content")).alias("summary"), iso(_tag(b, "pubDate", "published", "updated", "dc:date")).alias("published_at"),
        F.filter(F.array_distinct(F.transform(F.split(tx.decoded(tx.without_cdata(F.array_join(F.concat(names, terms), "\x1f"))), "\x1f"), tx.squeezed)), lambda x: (x != "") & (x != blank)).alias("categories"),
    )
    return rows.where(urls.of_site(F.col("url"), F.col(site))).drop(site) if site else rows


def json_items(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """key, n, id, url, title, summary, published_at, categories of JSON Feed items."""
    rows = bodies.select(key, F.posexplode(F.from_json(body, JSON_FEED)["items"]).alias("n", "i"))
    c = lambda k: F.coalesce(F.col(f"i.{k}"), F.lit(""))
    return rows.select(key, "n", F.trim(c("id")).alias("id"), _first(c("url"), c("external_url")).alias("url"), tx.extracted(c("title")).alias("title"), tx.summary(_first(c("summary"), c("content_text"), c("content_html"))).alias("summary"), iso(c("date_published")).alias("published_at"), F.filter(F.transform(F.coalesce("i.tags", F.array().cast("array<string>")), tx.squeezed), lambda x: x != "").alias("categories"))


def index_items(bodies: DataFrame, key: str, body: str, origin: str) -> DataFrame:
    """key, n, url, title, summary, published_at, categories of a static site's search index, an array of JSON objects; places
    are resolved against the column origin."""
    rows = bodies.select(key, origin, F.posexplode(F.from_json(body, HUGO)).alias("n", "i"))
    c = lambda k: F.coalesce(F.col(f"i.{k}"), F.lit(""))
    return rows.select(key, "n", urls.same_resource(F.col(origin), _first(c("permalink"), c("url"))).alias("url"), tx.extracted(c("title")).alias("title"), tx.summary(_first(c("summary"), c("content"))).alias("summary"), iso(c("date")).alias("published_at"), F.coalesce("i.tags", F.array().cast("array<string>")).alias("categories"))


def archive_items(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, n, url, title, published_at of lists of entries: list items with a date before or after their link."""
    items = F.filter(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1), lambda b: b.rlike(r"\d{4}-\d{2}-\d{2}") & b.rlike(r"(?i)<a\b[^>]*\bhref"))
    b = F.col("b")
    rows = pages.select(key, url, F.posexplode(items).alias("n", "b"))
    title = tx.extracted(F.regexp_replace(F.regexp_extract(b, r"(?is)<a\b[^>]*>(.*?)</a>", 1), r"<[^>]+>", " "))
    return rows.select(key, "n", urls.same_resource(F.col(url), attribute(F.regexp_extract(b, r"(?i)<a\b([^>]*)>", 1), "href")).alias("url"), title.alias("title"), iso(F.regexp_extract(b, r"(\d{4}-\d{2}-\d{2})", 1)).alias("published_at"))


def marked_entries(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, n, url, title, summary, published_at, categories of entries marked up by class (h-entry with p-name, u-url, dt-published, p-summary, p-category)."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<(article|li|div|section)\b[^>]*class=["'][^"']*\bh-entry\b[^"']*["'][^>]*>(.*?)</\1>"""), 2)
    rows, b = pages.select(key, url, F.posexplode(blocks).alias("n", "b")), F.col("b")
    inner = lambda c: rf"""(?is)<(\w+)\b[^>]*class=["'][^"']*\b{c}\b[^"']*["'][^>]*>(.*?)</\1>"""
    plain = lambda c: tx.extracted(F.regexp_replace(c, r"<[^>]+>", " "))
    opening = lambda c: F.regexp_extract(b, rf"""(?is)<\w+\b([^>]*class=["'][^"']*\b{c}\b[^"']*["'][^>]*)>""", 1)
    when = _first(attribute(opening("dt-published"), "datetime"), F.regexp_extract(b, inner("dt-published"), 2))
    return rows.select(key, "n", urls.same_resource(F.col(url), attribute(opening("u-url"), "href")).alias("url"), plain(F.regexp_extract(b, inner("p-name"), 2)).alias("title"), plain(F.regexp_extract(b, inner("p-summary"), 2)).alias("summary"), iso(when).alias("published_at"), F.transform(F.regexp_extract_all(b, F.lit(inner("p-category")), 2), tx.squeezed).alias("categories"))


def topics(items: DataFrame, key: str, source: str) -> DataFrame:
    """key, slug, label, source, items: what the categories of items declare, by folded slug; the first label by code point stays."""
    rows = items.select(key, "n", F.explode("categories").alias("label")).withColumn("slug", tx.singular_slug(tx.slug(F.col("label"))))
    return rows.where(~tx.is_no_subject(F.col("slug"))).groupBy(key, "slug").agg(F.min("label").alias("label"), F.lit(source).alias("source"), F.countDistinct("n").alias("items"))


def outline_urls(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """key, n, field, url of an outline's pages and feeds. Bodies with a document type or entities of their own are left out."""
    tags = F.when(~F.col(body).rlike(r"(?i)<!DOCTYPE|<!ENTITY"), F.regexp_extract_all(F.col(body), F.lit(r"(?i)<outline\b([^>]*?)/?>"), 1))
    rows = bodies.select(key, F.posexplode(tags).alias("n", "a"))
    both = F.array(*(F.struct(F.lit(f).alias("field"), tx.squeezed(attribute(F.col("a"), f)).alias("url")) for f in ("htmlUrl", "xmlUrl")))
    return rows.select(key, "n", F.explode(both).alias("x")).select(key, "n", "x.*").where("url <> ''")


def sitemap_urls(bodies: DataFrame, key: str, body: str, origin: str | None = None) -> DataFrame:
    """key, n, url of a sitemap's places, each once, in order; with origin, a column, those of that origin only."""
    locs = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.col(body), F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), 1), tx.squeezed), lambda x: x != ""))
    if origin:
        locs = F.filter(locs, lambda x: urls.origin(x) == urls.origin(F.col(origin)))
    return bodies.select(key, F.posexplode(locs).alias("n", "url"))


def _lines(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """key, n, field, value of the directives of robots files."""
    rows = bodies.select(key, F.posexplode(F.split(F.col(body), r"\r?\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    return rows.select(key, "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def robots_sitemaps(bodies: DataFrame, key: str, body: str) -> DataFrame:
    return _lines(bodies, key, body).where("field = 'sitemap' AND value <> ''").groupBy(key, F.col("value").alias("url")).agg(F.min("n").alias("n"))


def robots_groups(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """key, g, agents, rules (array of field, path): neighbouring agents share the rules that follow; rules before any agent are for all."""
    rows = _lines(bodies, key, body).where("field IN ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy(key).orderBy("n")  # the lines of one file
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("allow")) != "user-agent")
    rows = rows.withColumn("g", F.sum(opens.cast("int")).over(w))
    agents = F.collect_list(F.when(F.col("field") == "user-agent", F.struct("n", F.lower(F.when(F.col("value") == "", "*").otherwise(F.col("value"))).alias("v"))))
    rules = F.collect_list(F.when(F.col("field") != "user-agent", F.struct("n", "field", F.col("value").alias("path"))))
    out = rows.groupBy(key, "g").agg(F.array_sort(agents).alias("a"), F.array_sort(rules).alias("r"))
    return out.select(key, "g", F.when(F.size("a") == 0, F.array(F.lit("*"))).otherwise(F.transform("a", lambda x: x["v"])).alias("agents"), F.transform("r", lambda x: x.dropFields("n")).alias("rules"))


def robots_allowed(groups: DataFrame, paths: DataFrame, key: str, path: str, agent: str) -> DataFrame:
    """paths (key, path) with allowed: by the first group that names the agent, else the first for all; of the rules whose path
    is a prefix the longest decides, of equal ones the one that allows. Without a group or rule all is allowed."""
    own = groups.withColumn("rank", F.when(F.array_contains("agents", agent.lower()), 0).when(F.array_contains("agents", "*"), 1)).where("rank IS NOT NULL")
    own = own.groupBy(key).agg(F.min_by("rules", F.struct("rank", "g")).alias("rules"))
    full = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit("/"), F.col(path)))
    hit = F.filter(F.coalesce("rules", F.array().cast("array<struct<field:string,path:string>>")), lambda r: (r["path"] != "") & F.startswith(full, r["path"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(F.length(r["path"]).alias("n"), (r["field"] == "allow").alias("ok"))))
    return paths.join(own, key, "left").select(*paths.columns, F.coalesce(best["ok"], F.lit(True)).alias("allowed"))
