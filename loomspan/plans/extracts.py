"""Queries over sinks and sources: bodies made from tables (feeds, outlines, sitemaps, robots files, pages) and read back into rows.

Bodies are made by the package's own sinks or by concatenation, so each query runs a writer and a reader over whole tables; its
SQL takes the rows from the tables directly. A feed's document holds the latest 50 rows of its key: that is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans.registry import query
from loomspan.sinks import documents as sink
from loomspan.sources import facts, feeds, html, tree
from loomspan.sources.tables import spread, table

_PART = """p AS (SELECT p_brand AS brand, p_partkey, p_name, p_type, 'https://example.org/p/' || p_partkey || '?a=1&b=2' AS url, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(p_partkey * 60) AS ts FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ts DESC, url) - 1 AS n FROM p)"""


def _part(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, root, "part").select(
        F.col("p_brand").alias("brand"), "p_partkey", "p_name", "p_type", F.concat(F.lit("https://example.org/p/"), key.cast("string"), F.lit("?a=1&b=2")).alias("url"), F.timestamp_seconds(1700000000 + key * 60).alias("at"),
        F.concat("p_name", F.lit(" <b>bold</b> & more")).alias("summary"), F.array("p_type", F.lit("a & b")).alias("topics"),
    )


@query(f"""
WITH {_PART} SELECT brand, CAST(n AS INT) AS n, url AS id, url, p_name AS title, p_name || ' bold & more' AS summary, epoch(ts) AS "at", p_type || ',a & b' AS categories FROM t WHERE n < 50
""")
def atom_feed(spark: SparkSession, root: str) -> DataFrame:
    """Atom feeds of parts by brand, written and read back."""
    bodies = sink.atom(_part(spark, root), "brand", "url", "p_name", "summary", "at", "topics")
    return feeds.xml_items(bodies, "brand", "body").select("brand", "n", "id", "url", "title", "summary", F.unix_timestamp("published_at").cast("double").alias("at"), F.array_join("categories", ",").alias("categories"))


@query(f"""
WITH {_PART} SELECT brand, CAST(n AS INT) AS n, url, p_name AS title, p_name || ' bold & more' AS summary, epoch(ts) AS "at" FROM t WHERE n < 50
""")
def json_feed(spark: SparkSession, root: str) -> DataFrame:
    """JSON Feeds of parts by brand, written and read back."""
    bodies = sink.json_feed(_part(spark, root), "brand", "url", "p_name", "summary", "at")
    return feeds.json_items(bodies, "brand", "body").select("brand", "n", "url", "title", "summary", F.unix_timestamp("published_at").cast("double").alias("at"))


@query(f"""
WITH {_PART}, r AS (SELECT *, 'https://' || CASE WHEN p_partkey % 3 = 0 THEN 'other.net' ELSE 'www.example.org' END || '/r/' || p_partkey AS link FROM p)
SELECT p_partkey, CAST(1 AS INT) AS n, link AS url, p_name || ' & Söhne' AS title, epoch(date_trunc('minute', ts)) AS "at", p_type AS categories FROM r WHERE p_partkey % 3 <> 0
""")
def rss_items(spark: SparkSession, root: str) -> DataFrame:
    """RSS items with CDATA, references and mail dates; items that lie on another host are left out."""
    p = _part(spark, root).withColumn("link", F.concat(F.lit("https://"), F.when(F.col("p_partkey") % 3 == 0, "other.net").otherwise("www.example.org"), F.lit("/r/"), F.col("p_partkey").cast("string")))
    item = F.concat(F.lit("<item><title><![CDATA["), "p_name", F.lit(" &amp; S&ouml;hne]]></title><link>"), "link", F.lit("</link><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm"), F.lit(":00 GMT</pubDate><category><![CDATA["), "p_type", F.lit("]]></category></item>"))
    bodies = p.select("p_partkey", F.lit("https://example.org").alias("site"), F.concat(F.lit("<rss><channel><title>x</title><item><title>no link</title></item>"), item, F.lit("</channel></rss>")).alias("body"))
    rows = feeds.xml_items(bodies, "p_partkey", "body", "site")
    return rows.select("p_partkey", "n", "url", "title", F.unix_timestamp("published_at").cast("double").alias("at"), F.array_join("categories", ",").alias("categories"))


@query("""
SELECT p_partkey, CAST(0 AS INT) AS n, 'https://site.example/posts/' || p_partkey AS url, p_name AS title, epoch(TIMESTAMP '2023-11-14 00:00:00' + to_days(p_partkey % 1000)) AS "at", p_type AS categories FROM part
""")
def index_items(spark: SparkSession, root: str) -> DataFrame:
    """Items of a static site's search index, with places below the site's origin."""
    item = F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/posts/"), F.col("p_partkey").cast("string")).alias("url"), F.date_format(F.date_add(F.lit("2023-11-14").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyy-MM-dd").alias("date"), F.array("p_type").alias("tags"))))
    bodies = table(spark, root, "part").select("p_partkey", F.lit("https://site.example").alias("origin"), item.alias("body"))
    return feeds.index_items(bodies, "p_partkey", "body", "origin").select("p_partkey", "n", "url", "title", F.unix_timestamp("published_at").cast("double").alias("at"), F.array_join("categories", ",").alias("categories"))


@query("""
SELECT p_partkey, CAST(0 AS INT) AS n, 'https://site.example/log/e' || p_partkey AS url, p_name AS title, epoch(TIMESTAMP '2023-11-14 00:00:00' + to_days(p_partkey % 1000)) AS "at" FROM part
""")
def archive_items(spark: SparkSession, root: str) -> DataFrame:
    """Dated links of archive lists; items without a date or a link give nothing."""
    day = F.date_format(F.date_add(F.lit("2023-11-14").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyy-MM-dd")
    body = F.concat(F.lit("<ul><li><a href='/about'>About</a></li><li><time>"), day, F.lit("</time> <a class=x href=e"), F.col("p_partkey").cast("string"), F.lit("><b>"), "p_name", F.lit("</b></a></li><li>2020-01-01</li></ul>"))
    pages = table(spark, root, "part").select("p_partkey", F.lit("https://site.example/log/").alias("url"), body.alias("html"))
    return feeds.archive_items(pages, "p_partkey", "html", "url").select("p_partkey", "n", "url", "title", F.unix_timestamp("published_at").cast("double").alias("at"))


@query("""
SELECT p_partkey, CAST(0 AS INT) AS n, 'https://site.example/n/' || p_partkey AS url, p_name AS title, p_type || ' & co' AS summary, epoch(TIMESTAMP '2023-11-14 00:00:00' + to_days(p_partkey % 1000)) AS "at", 'x,' || p_brand AS categories FROM part
""")
def marked_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries that pages mark up by class."""
    day = F.date_format(F.date_add(F.lit("2023-11-14").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyy-MM-dd")
    body = F.concat(F.lit('<main><article class="post h-entry"><h2 class="p-name">'), "p_name", F.lit('</h2><a class="u-url" href="/n/'), F.col("p_partkey").cast("string"), F.lit('">#</a><time class="dt-published" datetime="'), day, F.lit('">then</time><p class="p-summary"><i>'), "p_type", F.lit('</i> &amp; co</p><span class="p-category">x</span><span class="p-category">'), "p_brand", F.lit("</span></article></main>"))
    pages = table(spark, root, "part").select("p_partkey", F.lit("https://site.example/").alias("url"), body.alias("html"))
    return feeds.marked_entries(pages, "p_partkey", "html", "url").select("p_partkey", "n", "url", "title", "summary", F.unix_timestamp("published_at").cast("double").alias("at"), F.array_join("categories", ",").alias("categories"))


@query(f"""
WITH {_PART}, x AS (SELECT brand, n, unnest([p_type, 'Rivers', 'river', 'The']) AS label FROM t WHERE n < 50), s AS (SELECT brand, n, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM x),
f AS (SELECT brand, n, label, CASE WHEN slug = 'rivers' THEN 'river' ELSE slug END AS slug FROM s WHERE slug <> 'the')
SELECT brand, slug, min(label) AS label, 'rss:category' AS source, count(DISTINCT n) AS items FROM f GROUP BY brand, slug
""")
def feed_topics(spark: SparkSession, root: str) -> DataFrame:
    """Topics that feeds' categories declare, plurals folded, stopwords out."""
    bodies = sink.atom(_part(spark, root).withColumn("topics", F.array("p_type", F.lit("Rivers"), F.lit("river"), F.lit("The"))), "brand", "url", "p_name", "summary", "at", "topics")
    return feeds.topics(feeds.xml_items(bodies, "brand", "body"), "brand", "rss:category")


@query("""
WITH s AS (SELECT s_nationkey AS nation, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS n FROM supplier)
SELECT nation, CAST(n AS INT) AS n, 'htmlUrl' AS field, 'https://s' || s_suppkey || '.example' AS url FROM s WHERE n < 1000 UNION ALL SELECT nation, CAST(n AS INT), 'xmlUrl', 'https://s' || s_suppkey || '.example/feed?x=1&y=2' FROM s WHERE n < 1000
""")
def outline_urls(spark: SparkSession, root: str) -> DataFrame:
    """Outlines of suppliers by nation, written and read back."""
    s = table(spark, root, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name", F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("page"))
    bodies = sink.outline(s.withColumn("feed", F.concat("page", F.lit("/feed?x=1&y=2"))), "nation", "s_name", "page", "feed")
    rows = feeds.outline_urls(bodies, "nation", "body")
    return rows.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))


@query("""
SELECT c_custkey, CAST(0 AS INT) AS n, 'https://site.example/c/' || c_custkey AS url FROM customer UNION ALL SELECT c_custkey, 1, 'https://site.example/d' FROM customer
""")
def sitemap_urls(spark: SparkSession, root: str) -> DataFrame:
    """Places of sitemaps, each once, of their own origin."""
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit("<urlset><url><loc> https://site.example/c/"), k, F.lit("\n</loc></url><url><LOC>https://site.example/d</LOC></url><url><loc>https://site.example/c/"), k, F.lit("</loc></url><url><loc>https://else.example/x</loc></url></urlset>"))
    return feeds.sitemap_urls(table(spark, root, "customer").select("c_custkey", F.lit("https://site.example").alias("origin"), body.alias("body")), "c_custkey", "body", "origin")


def _robots(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.concat(
        F.lit("Sitemap: https://e.example/s.xml # main\nUser-agent: Good\nUser-agent: other\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /n"), k.cast("string"), F.lit("\nAllow: /n"), k.cast("string"), F.lit("\nDisallow: /private\n"),
        F.when(k % 2 == 0, "Disallow: /\r\nSitemap: https://e.example/t.xml").otherwise("nonsense"),
    )
    return table(spark, root, "nation").select("n_nationkey", body.alias("body"))


@query("""
SELECT n_nationkey, CAST(1 AS BIGINT) AS g, 'good,other' AS agents, 'allow /a/b,disallow /a' AS rules FROM nation
UNION ALL SELECT n_nationkey, 2, '*', 'disallow /n' || n_nationkey || ',allow /n' || n_nationkey || ',disallow /private' || CASE WHEN n_nationkey % 2 = 0 THEN ',disallow /' ELSE '' END FROM nation
""")
def robots_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups of agents and rules in robots files."""
    g = feeds.robots_groups(_robots(spark, root), "n_nationkey", "body")
    return g.select("n_nationkey", "g", F.array_join("agents", ",").alias("agents"), F.array_join(F.transform("rules", lambda r: F.concat_ws(" ", r["field"], r["path"])), ",").alias("rules"))


@query("""
WITH p AS (SELECT n_nationkey, unnest(['/', '/n' || n_nationkey || '/x', 'private/1', '/a']) AS path FROM nation)
SELECT n_nationkey, path, CASE WHEN path LIKE '/n%' THEN true WHEN path LIKE 'private%' THEN false ELSE n_nationkey % 2 = 1 END AS allowed FROM p
""")
def robots_allowed(spark: SparkSession, root: str) -> DataFrame:
    """What robots files allow an agent that they don't name."""
    r = _robots(spark, root)
    paths = r.select("n_nationkey", F.explode(F.array(F.lit("/"), F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/x")), F.lit("private/1"), F.lit("/a"))).alias("path"))
    return feeds.robots_allowed(feeds.robots_groups(r, "n_nationkey", "body"), paths, "n_nationkey", "path", "Loom")


@query("""
SELECT n_nationkey, 'https://e.example/s.xml' AS url, CAST(0 AS INT) AS n FROM nation UNION ALL SELECT n_nationkey, 'https://e.example/t.xml', 11 FROM nation WHERE n_nationkey % 2 = 0
""")
def robots_sitemaps(spark: SparkSession, root: str) -> DataFrame:
    """Sitemaps that robots files name."""
    return feeds.robots_sitemaps(_robots(spark, root), "n_nationkey", "body")


@query("""
SELECT p_partkey, p_name || ' & "Co"' AS title, 'https://site.example/img/' || p_partkey || '.png' AS poster, p_type || ' <one>' AS description, 'https://site.example/p/' || p_partkey AS canonical,
 'Product,Brand,Person,Article' AS types, p_brand || ',maps' AS knows, 'https://site.example/f.json json,https://site.example/rss rss' AS feeds, p_name || ' says enough here for a paragraph.' AS paragraph FROM part
""")
def page_meta(spark: SparkSession, root: str) -> DataFrame:
    """What pages say of themselves: titles, images, canonical places, declared types, knowledge, feeds, first paragraphs."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit("<html><head><META PROPERTY='og:title' content='"), "p_name", F.lit(" &amp; &quot;Co&quot;'><meta name=twitter:image content=/img/"), k, F.lit('.png><meta content="'), "p_type", F.lit(' &lt;one&gt;" name="description"><meta property="og:type" content="Article">'),
        F.lit("<link href='/p/"), k, F.lit("' rel=\"alternate canonical\"><link rel=alternate type=application/feed+json href=/f.json>"),
        F.lit('<script type="application/ld+json">{"@type":"Product","@graph":[{"@type":["http://schema.org/Brand"]},{"@type":"Person","knowsAbout":["'), "p_brand", F.lit('",{"name":"maps"}]}]}</script><script type="application/ld+json">not json</script></head>'),
        F.lit("<body><nav><p>a paragraph of the navigation that is long</p></nav><p>short</p><p class=x>"), "p_name", F.lit(" says <b>enough</b> here for a paragraph.</p><a href='/rss'>feed</a></body></html>"),
    )
    t, page = F.col("tree"), F.lit("https://site.example/x/y")
    rows = tree.trees(spread(table(spark, root, "part")).select("p_partkey", body.alias("html")), "p_partkey")
    return rows.select(
        "p_partkey", facts.meta(t, "og:title").alias("title"), facts.poster(t, page).alias("poster"), facts.share_text(t).alias("description"), facts.canonical(t, page).alias("canonical"), F.array_join(facts.schema_types(t), ",").alias("types"),
        F.array_join(facts.knows_about(t), ",").alias("knows"), F.array_join(F.transform(facts.feeds(t, page), lambda f: F.concat_ws(" ", f["url"], f["kind"])), ",").alias("feeds"), facts.first_paragraph(t).alias("paragraph"),
    )


@query(r"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+', ' ', 'g')), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '\s+', ' ', 'g')), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS heading,
 CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS links, false AS noindex FROM pages
""")
def page_outline(spark: SparkSession, root: str) -> DataFrame:
    """Language, title, first heading and number of links of pages, from the parser."""
    p = html.parsed(table(spark, root, "pages"))
    return p.select("page_id", "page.lang", "page.title", F.get("page.headings", F.lit(0))["text"].alias("heading"), F.size("page.links").alias("links"), "page.noindex")


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages)
SELECT page_id, href, text, 'nav' AS place, count(*) AS n FROM l GROUP BY ALL
""")
def page_links(spark: SparkSession, root: str) -> DataFrame:
    """Links of pages with their text and where they stand, from the parser."""
    p = html.parsed(table(spark, root, "pages")).select("page_id", F.explode("page.links").alias("l"))
    return p.groupBy("page_id", "l.href", "l.text", "l.place").agg(F.count("*").alias("n"))


@query(r"""
WITH o AS (SELECT o_orderpriority AS k, o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders)
SELECT k, md5('BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg('BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d') || chr(13) || chr(10)
 || 'DTEND;VALUE=DATE:' || strftime(d + INTERVAL 2 DAY, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:Order\, no ' || o_orderkey || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10), '' ORDER BY n) || 'END:VCALENDAR' || chr(13) || chr(10)) AS digest FROM o WHERE n <= 50 GROUP BY k
""")
def event_calendar(spark: SparkSession, root: str) -> DataFrame:
    """Calendars of orders by priority: the first 50 days."""
    o = table(spark, root, "orders").select(F.col("o_orderpriority").alias("k"), "o_orderkey", F.to_date("o_orderdate").alias("d"), F.concat(F.lit("Order, no "), F.col("o_orderkey").cast("string")).alias("title"))
    return sink.calendar(o, "k", "o_orderkey", "title", "d", 2).select("k", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("""
WITH s AS (SELECT s_nationkey AS k, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, 'https://s' || s_suppkey || '.example') AS n FROM supplier)
SELECT k, '# ' || k || chr(10) || chr(10) || string_agg('- [' || s_name || '](https://s' || s_suppkey || '.example)' || chr(10), '' ORDER BY n) AS body FROM s WHERE n <= 50 GROUP BY k
""")
def topic_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of links to suppliers by nation."""
    s = table(spark, root, "supplier").select(F.col("s_nationkey").alias("k"), "s_name", F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("url"))
    return sink.markdown(s, "k", "s_name", "url")


@query("""
WITH c AS (SELECT n_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900)
SELECT k, '{"schema_version":1' || coalesce(',"members":[' || string_agg('{"id":' || c_custkey || '}', ',' ORDER BY n) || ']', '') || '}' AS body FROM c WHERE n <= 1000 GROUP BY k
""")
def sparse_documents(spark: SparkSession, root: str) -> DataFrame:
    """A JSON document for each nation with its richest customers; nations without any leave the list out."""
    c = table(spark, root, "customer").where("c_acctbal > 9900").select("c_nationkey", "c_custkey")
    rows = table(spark, root, "nation").select(F.col("n_nationkey").alias("k")).join(c, F.col("k") == F.col("c_nationkey"), "left")
    return sink.collection(rows, "k", "members", F.when(F.col("c_custkey").isNotNull(), F.struct(F.col("c_custkey").alias("id"))), [F.col("c_custkey")])
