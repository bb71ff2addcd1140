"""Queries over link graphs, items and topics of sites: nations, customers, parts and lines stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import edges, graph, items, topics
from loomspan.plans.registry import query
from loomspan.sources.tables import table


def _links(spark: SparkSession, root: str) -> DataFrame:
    """Links from customers' pages to those of other customers, some of them marked, tracked, to the hub or to nobody."""
    k = F.col("c_custkey")
    to = (k * 7 + 3) % 50
    href = F.concat(F.lit("https://c"), to.cast("string"), F.when(k % 11 == 0, ".nowhere").otherwise(".example"), F.lit("/p"), (k % 3).cast("string"), F.when(k % 4 == 0, "?utm_source=x&q=1").otherwise(""))
    classes = F.when(k % 6 == 1, F.array(F.lit("u-in-reply-to"))).when(k % 6 == 2, F.array(F.lit("x"), F.lit("u-repost-of"))).otherwise(F.array().cast("array<string>"))
    page = F.concat(F.lit("https://c"), (k % 50).cast("string"), F.lit(".example"), F.when(k % 5 == 0, "/").otherwise(F.concat(F.lit("/post/"), k.cast("string"))))
    rel = F.when(k % 6 == 3, F.array(F.lit("syndication"))).otherwise(F.array().cast("array<string>"))
    return table(spark, root, "customer").select(page.alias("page"), href.alias("href"), rel.alias("rel"), classes.alias("classes"), F.lit("t").alias("text"))


_LINKS = """k AS (SELECT c_custkey AS k, 'https://c' || c_custkey % 50 || '.example' AS source, 'https://c' || (c_custkey * 7 + 3) % 50 || CASE WHEN c_custkey % 11 = 0 THEN '.nowhere' ELSE '.example' END AS target FROM customer),
l AS (SELECT *, source || CASE WHEN k % 5 = 0 THEN '/' ELSE '/post/' || k END AS page, target || '/p' || k % 3 || CASE WHEN k % 4 = 0 THEN '?q=1' ELSE '' END AS href,
  CASE k % 6 WHEN 1 THEN 'reply-to' WHEN 2 THEN 'repost-of' WHEN 3 THEN 'syndication' ELSE CASE WHEN k % 5 = 0 THEN 'homepage-link' ELSE 'content-link' END END AS relation FROM k WHERE source <> target AND target NOT LIKE '%.nowhere' AND source <> 'https://c0.example' AND target <> 'https://c0.example'),
e AS (SELECT source, target, page, href, arg_min(relation, CASE relation WHEN 'content-link' THEN 0 WHEN 'homepage-link' THEN 0 WHEN 'syndication' THEN 0 WHEN 'reply-to' THEN 1 ELSE 2 END) AS relation FROM l GROUP BY ALL)"""


def _observed(spark: SparkSession, root: str) -> DataFrame:
    members = spark.range(50).select(F.concat(F.lit("https://c"), F.col("id").cast("string"), F.lit(".example")).alias("origin"))
    # A link that stands twice is looked at by its least marks; links of one page differ in their address here.
    rows = edges.observed(_links(spark, root), members, "origin", "https://c0.example")
    return rows.withColumn("relation", edges.relation(F.col("rel"), F.col("classes"), F.col("page"), F.col("source"), F.lit(False)))


@query("""
WITH k AS (SELECT c_custkey AS k, 'https://c' || c_custkey % 50 || '.example' AS source, 'https://c' || (c_custkey * 7 + 3) % 50 || '.example' AS target FROM customer WHERE c_custkey % 11 <> 0)
SELECT DISTINCT source, target, source || CASE WHEN k % 5 = 0 THEN '/' ELSE '/post/' || k END AS page, target || '/p' || k % 3 || CASE WHEN k % 4 = 0 THEN '?q=1' ELSE '' END AS href FROM k WHERE source <> target AND source <> 'https://c0.example' AND target <> 'https://c0.example'
""")
def observed_links(spark: SparkSession, root: str) -> DataFrame:
    """Links between two different members, resolved, without tracking, none of the hub's."""
    return _observed(spark, root).select("source", "target", "page", "href")


@query("""
WITH k AS (SELECT c_custkey AS k, c_custkey % 50 AS s FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 50 <> (c_custkey * 7 + 3) % 50 AND c_custkey % 50 <> 0 AND (c_custkey * 7 + 3) % 50 <> 0)
SELECT 'https://c' || s || '.example/post/' || k AS page, CASE k % 6 WHEN 1 THEN 'reply-to' WHEN 2 THEN 'repost-of' WHEN 3 THEN 'syndication' ELSE 'content-link' END AS relation FROM k
""")
def typed_edges(spark: SparkSession, root: str) -> DataFrame:
    """Relations of links of posts: what the link marks, else a content link."""
    return _observed(spark, root).where(F.col("page").contains("/post/")).select("page", "relation")


@query("""
WITH o AS (SELECT s_nationkey AS s, s_suppkey, 'https://n' || s_suppkey % 30 || '.example/feed' AS url FROM supplier)
SELECT DISTINCT 'https://n' || s || '.example' AS source, 'https://n' || s_suppkey % 30 || '.example' AS target, 'https://n' || s || '.example/roll' AS blogroll FROM o WHERE s_suppkey % 30 < 25 AND s_suppkey % 30 <> s
""")
def blogroll_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of blogrolls between two different members."""
    site = lambda c: F.concat(F.lit("https://n"), c.cast("string"), F.lit(".example"))
    o = table(spark, root, "supplier").select(site(F.col("s_nationkey")).alias("source"), F.concat(site(F.col("s_suppkey") % 30), F.lit("/feed")).alias("url"), F.concat(site(F.col("s_nationkey")), F.lit("/roll")).alias("blogroll"))
    return edges.blogroll(o, table(spark, root, "nation").select(site(F.col("n_nationkey")).alias("origin")), "origin")


@query("""
WITH c AS (SELECT c_custkey AS k, 'https://s' || c_nationkey || '.example' AS source, 'https://t' || c_custkey % 9 || '.example' AS target, ['content-link', 'friend', 'link', 'blogroll', 'credit'][c_custkey % 5 + 1] AS relation FROM customer)
SELECT source, target, CASE WHEN relation = 'blogroll' THEN 'blogroll' ELSE 'content-link' END AS relation, CASE WHEN k % 4 = 0 THEN target || '/' ELSE target || '/a' END AS href, CASE WHEN k % 3 = 0 THEN source || '/' ELSE source || '/p' END AS page, count(*) AS n FROM c
WHERE relation <> 'friend' AND source IN (SELECT 'https://s' || n_nationkey || '.example' FROM nation WHERE n_regionkey = 1) GROUP BY ALL
""")
def carried_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of sites that weren't read again, as they are carried on."""
    k = F.col("c_custkey")
    site = lambda p, c: F.concat(F.lit(f"https://{p}"), c.cast("string"), F.lit(".example"))
    rel = F.element_at(F.array(*map(F.lit, ("content-link", "friend", "link", "blogroll", "credit"))), (k % 5 + 1).cast("int"))
    c = table(spark, root, "customer").select(site("s", F.col("c_nationkey")).alias("source"), site("t", k % 9).alias("target"), rel.alias("relation"), F.when(k % 4 == 0, "").otherwise(F.concat(site("t", k % 9), F.lit("/a?fbclid=1"))).alias("href"), F.when(k % 3 != 0, F.concat(site("s", F.col("c_nationkey")), F.lit("/p"))).alias("page"))
    read = table(spark, root, "nation").where("n_regionkey = 1").select(site("s", F.col("n_nationkey")).alias("source"))
    return edges.carried(c, read, "source").groupBy("source", "target", "relation", "href", "page").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT s_nationkey AS source, n_regionkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'credit' ELSE 'link' END AS relation, 'p' || s_suppkey % 7 AS page, 'h' || s_suppkey % 5 AS href, s_suppkey % 2 AS old FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT DISTINCT source, target, relation, page, href FROM l WHERE old = 0 OR relation <> 'credit')
SELECT source, target, relation, arg_min(page, page || href) AS first_page, arg_min(href, page || href) AS first_href, count(*) AS evidence_count FROM u GROUP BY ALL
""")
def united_edges(spark: SparkSession, root: str) -> DataFrame:
    """New edges and those known before as one, with their evidence; old credits go."""
    k = F.col("s_suppkey")
    l_ = table(spark, root, "supplier").join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.when(k % 3 == 0, "credit").otherwise("link").alias("relation"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("page"), F.concat(F.lit("h"), (k % 5).cast("string")).alias("href"), (k % 2).alias("old"))
    return edges.united(l_.where("old = 0"), l_.where("old = 1"))


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS source, (c_nationkey + c_custkey) % 25 AS target FROM customer), p AS (SELECT CASE WHEN source % 5 = 1 THEN source - 1 ELSE source END AS source, CASE WHEN target % 5 = 1 THEN target - 1 ELSE target END AS target FROM e)
SELECT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, count(*) AS n FROM p GROUP BY ALL
""")
def promoted_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges with their ends replaced by the primaries of their families."""
    e = table(spark, root, "customer").select(F.col("c_nationkey").cast("bigint").alias("source"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).cast("bigint").alias("target")).distinct()
    families = spark.range(25).where("id % 5 = 1").select(F.col("id").alias("secondary"), (F.col("id") - 1).alias("primary"))
    return edges.promoted(e, families, ["source", "target"]).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT DISTINCT n_nationkey AS secondary, n_regionkey AS prim FROM nation UNION SELECT 7, 4 UNION SELECT 30, 2), m AS (SELECT n_nationkey AS o FROM nation)
SELECT 'several-families' AS code, secondary AS origin FROM f GROUP BY secondary HAVING count(DISTINCT prim) > 1 UNION ALL SELECT 'primary-too', secondary FROM (SELECT DISTINCT secondary FROM f) WHERE secondary IN (SELECT prim FROM f)
UNION ALL SELECT 'no-member', x FROM (SELECT secondary AS x FROM f UNION SELECT prim FROM f) WHERE x NOT IN (SELECT o FROM m)
""")
def family_errors(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with families of sites."""
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"))
    f = n.select(F.col("n").alias("secondary"), F.col("r").alias("primary")).union(spark.createDataFrame([(7, 4), (30, 2)], "secondary long, primary long")).distinct()
    return edges.family_errors(f, n, "n")


@query("""
WITH p AS (SELECT p_brand AS k, p_partkey AS o, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN '' END AS title, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind, ['t' || p_size % 4, 'all'] AS tags FROM part),
g AS (SELECT k, arg_min(title, o) FILTER (WHERE title <> '') AS title, arg_min(kind, o) FILTER (WHERE kind IS NOT NULL) AS kind, count(*) AS drafts FROM p GROUP BY k), t AS (SELECT k, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT k, unnest(tags) AS t FROM p) GROUP BY k)
SELECT g.k AS brand, title, kind, drafts, tags FROM g JOIN t USING (k)
""")
def merged_items(spark: SparkSession, root: str) -> DataFrame:
    """Drafts of one brand merged: first values that aren't empty, all tags."""
    k = F.col("p_size")
    d = table(spark, root, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "").alias("title"), F.when(k % 2 == 0, F.col("p_type")).alias("kind"), F.array(F.concat(F.lit("t"), (k % 4).cast("string")), F.lit("all")).alias("tags"))
    return items.merged(d, "brand", ["p_partkey"], ["title", "kind"], ["tags"]).withColumn("tags", F.array_join("tags", ","))


@query("""
WITH p AS (SELECT l_partkey AS k, arg_max(l_shipmode2, (l_orderkey, l_linenumber)) AS mode FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode2 FROM lineitem) GROUP BY l_partkey)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE mode END AS mode FROM part LEFT JOIN p ON k = p_partkey
""")
def items_with_pages(spark: SparkSession, root: str) -> DataFrame:
    """Items with what the last page of their address says, where they say nothing."""
    i = table(spark, root, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("mode"))
    p = table(spark, root, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("mode"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return items.with_pages(i, p, "p_partkey", ["mode"], "o")


_EVIDENCE = "e AS (SELECT l_partkey % 97 AS slug, CASE l_returnflag WHEN 'A' THEN 'declared' WHEN 'R' THEN 'heuristic' ELSE 'observed' END AS class, 'L' || l_suppkey % 5 AS label, l_suppkey AS page, l_orderkey * 10 + l_linenumber AS at_ FROM lineitem WHERE l_partkey % 97 > 3 OR l_returnflag <> 'A')"


def _evidence(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "declared").when(F.col("l_returnflag") == "R", "heuristic").otherwise("observed")
    rows = table(spark, root, "lineitem").where("l_partkey % 97 > 3 OR l_returnflag <> 'A'")
    return rows.select((F.col("l_partkey") % 97).alias("slug"), kind.alias("class"), F.concat(F.lit("L"), (F.col("l_suppkey") % 5).cast("string")).alias("label"), F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))


@query(f"""
WITH {_EVIDENCE} SELECT slug, CASE min(CASE class WHEN 'declared' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END) WHEN 0 THEN 'declared' WHEN 1 THEN 'heuristic' ELSE 'observed' END AS class, arg_max(label, (at_, label)) AS label, count(DISTINCT page) AS pages, count(*) AS pieces FROM e GROUP BY slug
""")
def evidence_by_slug(spark: SparkSession, root: str) -> DataFrame:
    """Evidence of a topic as one: the strongest class, the latest label, pages once."""
    return items.by_slug(_evidence(spark, root), ["slug"])


@query(f"""
WITH {_EVIDENCE}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY slug, class, page ORDER BY at_ DESC) = 1) SELECT slug, class, page, at_ AS "at" FROM l QUALIFY row_number() OVER (PARTITION BY slug ORDER BY class, page) <= 8
""")
def shown_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The latest of equal pieces of evidence, eight of a topic."""
    return items.shown_evidence(_evidence(spark, root), ["slug"], ["class", "page"], "at").select("slug", "class", "page", "at")


@query(f"""
WITH {_EVIDENCE} SELECT CASE WHEN class = 'declared' THEN 'declared' ELSE 'signal' END AS side, class, count(*) AS n FROM e GROUP BY ALL
""")
def split_topics(spark: SparkSession, root: str) -> DataFrame:
    """Declared topics and signals, apart."""
    declared, signals = items.split_topics(_evidence(spark, root))
    count = lambda df, side: df.groupBy("class").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "class", "n")
    return count(declared, "declared").unionByName(count(signals, "signal"))


@query(f"""
WITH {_EVIDENCE}, d AS (SELECT DISTINCT slug, class AS site, lpad(CAST(page AS VARCHAR), 9, '0') AS page FROM e), n AS (SELECT slug, site, count(*) AS n FROM d GROUP BY ALL), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY slug, site ORDER BY page) <= 8)
SELECT slug, site, n."n" AS "all", p.pages FROM n JOIN (SELECT slug, site, string_agg(page, ',' ORDER BY page) AS pages FROM f GROUP BY ALL) p USING (slug, site)
""")
def topics_hub(spark: SparkSession, root: str) -> DataFrame:
    """Topics by site with their first eight pages."""
    rows = _evidence(spark, root).select("slug", F.col("class").alias("site"), F.lpad(F.col("page").cast("string"), 9, "0").alias("page"))
    return items.hub(rows, "slug", "site", "page")


@query("""
WITH c AS (SELECT p_type AS slug, min(p_brand || chr(31) || p_name) AS m FROM part GROUP BY p_type), b AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 1)
SELECT slug, split_part(m, chr(31), 2) AS label, (SELECT p_brand FROM b) AS richest FROM c
""")
def network_catalog(spark: SparkSession, root: str) -> DataFrame:
    """All topics with the label of their first origin, and the origin that has most topics."""
    p = table(spark, root, "part").select(F.col("p_brand").alias("origin"), F.col("p_type").alias("slug"), F.col("p_name").alias("label"))
    best = items.catalog_origin(p, "origin", "slug").select(F.col("origin").alias("richest"))
    return items.catalog(p, "origin", "slug", "label").crossJoin(F.broadcast(best))  # one row


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS s, (c_nationkey + c_custkey) % 20 AS t FROM customer), o AS (SELECT s, count(*) AS n FROM e GROUP BY s), i AS (SELECT t, count(*) AS n FROM e GROUP BY t), m AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey % 9) AS n FROM supplier GROUP BY 1),
l AS (SELECT c_nationkey AS k, arg_max(c_custkey, (c_acctbal, c_custkey)) AS r FROM customer GROUP BY 1)
SELECT n_nationkey, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(m.n, 0) AS topics, r AS recent FROM nation LEFT JOIN o ON o.s = n_nationkey LEFT JOIN i ON i.t = n_nationkey LEFT JOIN m ON m.k = n_nationkey LEFT JOIN l ON l.k = n_nationkey
""")
def site_view(spark: SparkSession, root: str) -> DataFrame:
    """Sites with their edges, topics and latest item."""
    c = table(spark, root, "customer")
    e = c.select(F.col("c_nationkey").alias("source"), ((F.col("c_nationkey") + F.col("c_custkey")) % 20).alias("target")).distinct()
    t = table(spark, root, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 9).alias("slug"))
    i = c.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("at"), F.col("c_custkey").alias("item"))
    return items.site_view(table(spark, root, "nation").select("n_nationkey"), e, t, i, "n_nationkey")


@query("""
WITH u AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT a.p_brand AS x, b.p_brand AS y, count(*) AS n FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT x AS a, y AS b, n FROM c UNION ALL SELECT y, x, n FROM c), r AS (SELECT DISTINCT a.p_brand AS a, b.p_brand AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand)
SELECT a, b, n FROM w UNION ALL SELECT a, b, 0 FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = r.a AND w.b = r.b)
""")
def related_topics(spark: SparkSession, root: str) -> DataFrame:
    """Brands by how often they are ordered together, from either side, and those that are only related by type, counted 0."""
    part = table(spark, root, "part")
    rows = table(spark, root, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    both = edges.both_ways(topics.cooccurrence(rows, "l_orderkey", "p_brand", 2).select(F.col("left_slug").alias("a"), F.col("right_slug").alias("b"), F.col("shared").alias("n")), "a", "b")
    kinds = part.select("p_brand", "p_type").distinct()  # brands and types: two short lists
    related = kinds.withColumnRenamed("p_brand", "a").join(kinds.withColumnRenamed("p_brand", "b"), "p_type").where("a <> b").select("a", "b")
    return items.with_related(both, related, ["a", "b"], "n")


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS source, c_custkey % 30 AS target FROM customer)
SELECT 'target' AS "end", target AS id FROM (SELECT DISTINCT target FROM e) WHERE target NOT IN (SELECT n_nationkey FROM nation)
""")
def phantom_links(spark: SparkSession, root: str) -> DataFrame:
    """Ends of links that are no sites."""
    e = table(spark, root, "customer").select(F.col("c_nationkey").cast("bigint").alias("source"), (F.col("c_custkey") % 30).cast("bigint").alias("target"))
    return graph.orphans(e, table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("n")), ["source", "target"], "n")
