"""Passages, repeated blocks, works and portfolios out of parsed pages (sources.tree)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.sources.html import PARAGRAPH

#: Most characters of a passage, most works of a portfolio's page, fields of a portfolio's table, types of works.
PASSAGE, WORKS, FIELDS = 800, 400, ("year", "client", "project", "sector", "location")
TYPES = "CreativeWork|Book|Painting|Photograph|ImageObject|VisualArtwork|MusicAlbum|MusicRecording|Movie|VideoObject|VideoGame|Game|SoftwareApplication|WebApplication|Sculpture|Drawing|Collection"
#: What names a work, the most telling first.
SOURCES = ("schema", "figure", "list", "open-graph", "page")


def passages(trees: DataFrame, key: str) -> DataFrame:
    """key, n, kind, section, text, sentences: a page's articles or, without any, its paragraphs, outside navigation; the headings above;
    the first PASSAGE characters; how many sentences these are."""
    rows = trees.select(key, F.explode("tree.passages").alias("x")).select(key, "x.n", "x.kind", "x.section", F.rtrim(F.substring("x.text", 1, PASSAGE)).alias("text"))
    return rows.withColumn("sentences", F.size(sentences(F.col("text"))))


def sentences(text: Column) -> Column:
    """Sentences: they end after . ! or ? before white space; the last needs no mark."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def repeated(trees: DataFrame, key: str) -> DataFrame:
    """key, n, path, chrome, items (text, href) of each run of siblings of one kind."""
    return trees.select(key, F.explode("tree.repeated").alias("x")).select(key, "x.*")


def _own(page: Column, href: Column) -> Column:
    """href within the page's own site, without fragment and tracking; null elsewhere."""
    u = urls.without_tracking(urls.without_fragment(urls.same_resource(page, href)))
    return F.when(urls.origin(u) == urls.origin(page), u)


def portfolio(trees: DataFrame, key: str, url: str, lists: bool = False) -> DataFrame:
    """key, n, source, year, client, project, sector, location, url of a page's works: the rows of its first table that has columns for a
    sector and for a client or project; without any, its links to works (/work/..., /portfolio/..., /projects/...); without any, if lists
    is asked for, the items of its repeated blocks that lead to a page of the site. The first WORKS of a page. A table's work is at
    the link whose slug is its own; works without one get the page's address with their slug, numbered where it repeats."""
    page, t = F.col(url), F.col("tree")
    good = lambda x: F.array_contains(x["names"], "sector") & (F.array_contains(x["names"], "client") | F.array_contains(x["names"], "project"))
    cell = lambda x, r, f: F.coalesce(F.get(r, F.array_position(x["names"], f).cast("int") - 1), F.lit(""))
    made = lambda x: F.filter(F.transform(x["rows"], lambda r: F.struct(*(cell(x, r, f).alias(f) for f in FIELDS))), lambda w: (w["sector"] != "") | (w["project"] != "") | (w["client"] != ""))
    none = F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in FIELDS)}>>")
    tables = F.coalesce(F.get(F.filter(F.transform(F.filter(t["tables"], good), made), lambda w: F.size(w) > 0), F.lit(0)), none)
    slug = lambda u: F.lower(F.regexp_extract(urls.path(u), "(?i)^/(?:portfolio|work|projects?)/([^/]+)$", 1))
    links = F.filter(F.transform(t["links"], lambda x: F.struct(_own(page, x["href"]).alias("url"), x["text"].alias("text"))), lambda x: x["url"].isNotNull())
    cases = F.filter(F.transform(links, lambda x: F.struct(x["url"], slug(x["url"]).alias("slug"), x["text"])), lambda x: x["slug"] != "")
    rows = trees.select(key, url, tables.alias("tables"), cases.alias("cases"), F.col("tree.repeated").alias("blocks"))
    work = lambda source, project, at, w=None: F.struct(F.lit(source).alias("source"), *((project if f == "project" else F.lit("") if w is None else w[f]).alias(f) for f in FIELDS), at.alias("url"))
    slugs = lambda w: F.array(*(tx.slug(F.concat_ws(" ", *(w[f] for f in fs))) for fs in (("client", "project"), ("project",), ("client",))))
    at = lambda w: F.get(F.transform(F.filter(F.col("cases"), lambda c: F.array_contains(slugs(w), c["slug"])), lambda c: c["url"]), F.lit(0))
    by_table = F.transform("tables", lambda w: work("table", w["project"], at(w), w))
    once = F.filter("cases", lambda c: ~F.exists(F.col("cases"), lambda d: (d["url"] == c["url"]) & F.lit(False)))
    by_link = F.transform(once, lambda c: work("link", F.coalesce(F.nullif(c["text"], F.lit("")), F.replace(c["slug"], F.lit("-"), F.lit(" "))), c["url"]))
    items = F.flatten(F.transform("blocks", lambda b: F.filter(F.transform(b["items"], lambda i: F.struct(i["text"], _own(F.col(url), i["href"]).alias("u"))), lambda i: i["u"].isNotNull())))
    by_list = F.transform(items, lambda i: work("list", i["text"], i["u"]))
    every = F.when(F.size("tables") > 0, by_table).when(F.size("cases") > 0, by_link)
    rows = rows.select(key, F.col(url).alias("_page"), F.posexplode(F.slice(every.otherwise(by_list) if lists else F.coalesce(every, F.slice(by_link, 1, 0)), 1, WORKS)).alias("n", "w")).select(key, "_page", "n", "w.*")
    # Links and items name an address once, with the last text; slugs of works without a link are numbered in order.
    rows = rows.withColumn("_slug", F.when(F.col("url").isNull(), F.coalesce(F.nullif(tx.slug(F.concat_ws(" ", "client", "project", "year")), F.lit("")), F.lit("work"))))
    k = F.row_number().over(Window.partitionBy(key, "_page", "_slug").orderBy("n"))
    last = F.row_number().over(Window.partitionBy(key, "_page", "source", "url").orderBy(F.desc("n")))
    rows = rows.withColumn("_k", k).withColumn("_last", last).where("source = 'table' OR _last = 1")
    query = F.concat(F.regexp_replace(urls.without_fragment(F.col("_page")), r"[?&]work=[^&]*", ""), F.when(F.col("_page").contains("?"), "&work=").otherwise("?work="), F.col("_slug"), F.repeat(F.lit("-2"), (F.col("_k") - 1).cast("int")))
    return rows.select(key, "n", "source", *FIELDS, F.coalesce("url", query).alias("url"))


def candidates(trees: DataFrame, key: str, url: str) -> DataFrame:
    """key, rank, n, url, title, summary, image, at: all that pages say of works of their own site, from one parse, by SOURCES."""
    page, t, o = F.col(url), F.col("tree"), F.get_json_object
    none = F.lit(None).cast("string")
    item = lambda source, n, u, title, summary=none, image=none, at=none: F.struct(F.lit(SOURCES.index(source)).alias("rank"), n.cast("int").alias("n"), u.alias("url"), title.alias("title"), summary.alias("summary"), image.alias("image"), at.alias("at"))
    text = lambda x, *ks: F.coalesce(*(F.nullif(F.trim(o(x, f"$.{k}")), F.lit("")) for k in ks))
    schema = F.filter(t["objects"], lambda x: F.coalesce(o(x, "$.@type").rlike(rf"(?i)\b({TYPES})\b"), F.lit(False)))
    schema = F.transform(schema, lambda x, n: item("schema", n, F.coalesce(_own(page, text(x, "url", "@id")), F.when(text(x, "url").isNull(), _own(page, F.lit("")))), text(x, "name", "headline", "title"), text(x, "description", "caption", "abstract"), urls.same_resource(page, text(x, "image.url", "image", "thumbnailUrl")), text(x, "datePublished")))
    figures = F.transform(t["figures"], lambda x: item("figure", x["n"], _own(page, x["href"]), F.nullif(x["caption"], F.lit("")), none, urls.same_resource(page, x["image"])))
    lists = F.flatten(F.transform(t["repeated"], lambda b: F.transform(b["items"], lambda i, k: item("list", b["n"] + k, _own(page, i["href"]), i["text"]))))
    meta = lambda k: F.get(F.transform(F.filter(t["metas"], lambda m: (m["key"] == k) & (m["content"] != "")), lambda m: m["content"]), F.lit(0))
    graph = F.array(item("open-graph", F.lit(0), F.coalesce(_own(page, meta("og:url")), _own(page, F.lit(""))), meta("og:title"), meta("og:description"), urls.same_resource(page, meta("og:image"))))
    first = F.get(F.filter(F.transform(F.filter(t["paragraphs"], lambda p: ~p["chrome"]), lambda p: p["text"]), lambda p: F.length(p) >= PARAGRAPH), F.lit(0))
    own = F.array(item("page", F.lit(0), _own(page, F.lit("")), F.nullif(t["title"], F.lit("")), F.substring(first, 1, tx.SUMMARY)))
    rows = trees.select(key, F.explode(F.concat(schema, figures, lists, graph, own)).alias("x")).select(key, "x.*")
    pictures = r"(?i)\.(jpe?g|png|gif|webp|avif|svg)([?#]|$)"
    return rows.where(F.col("url").isNotNull() & F.col("title").isNotNull() & ~((F.col("rank") == 1) & F.col("url").rlike(pictures)))


def collected(found: DataFrame, key: str) -> DataFrame:
    """candidates merged by address: url, title, summary, image, at, source (of the title), sources, mentions. Each field is that of
    the first source, by SOURCES, that fills it; of one source, the first page's. One grouping, whose parts merge before the shuffle."""
    order = F.struct("rank", key, "n")
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    name = lambda r: F.element_at(F.array(*map(F.lit, SOURCES)), (r + 1).cast("int"))
    g = found.groupBy("url").agg(*(best(c) for c in ("title", "summary", "image", "at")), F.min("rank").alias("_r"), F.array_sort(F.collect_set("rank")).alias("_s"), F.count("*").alias("mentions"))
    return g.select("url", "title", "summary", "image", "at", name(F.col("_r")).alias("source"), F.array_join(F.transform("_s", name), ",").alias("sources"), "mentions")
