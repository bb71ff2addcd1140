"""Queries over what people say of themselves: names, quantities, requests, albums, what may be removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import labels as lb
from loomspan.functions import text as tx
from loomspan.functions import uses
from loomspan.operators import history
from loomspan.plans.registry import query
from loomspan.sources import entries
from loomspan.sources.tables import spread, table


@query("""
WITH s AS (SELECT p_partkey, unnest(['Neovim - my editor', 'Dell U2720Q: a screen', 'Aeron. It''s comfortable', 'iTerm2 on my Mac', 'plain words', 'Vim and Emacs', 'Zsh, Tmux, Git', 'Mouse with a wheel', 'two Macs', '3 Macs', 'Macs']) AS t FROM part)
SELECT p_partkey, t, CASE t WHEN 'Neovim - my editor' THEN 'Neovim' WHEN 'Dell U2720Q: a screen' THEN 'Dell U2720Q' WHEN 'Aeron. It''s comfortable' THEN 'Aeron' WHEN 'iTerm2 on my Mac' THEN 'iTerm2' ELSE t END AS name,
 CASE t WHEN 'Neovim - my editor' THEN 'my editor' WHEN 'Dell U2720Q: a screen' THEN 'a screen' WHEN 'Aeron. It''s comfortable' THEN 'It''s comfortable' WHEN 'iTerm2 on my Mac' THEN 'on my Mac' ELSE '' END AS context,
 CASE t WHEN 'Vim and Emacs' THEN 'Vim|Emacs' WHEN 'Zsh, Tmux, Git' THEN 'Zsh|Tmux|Git' ELSE t END AS parts, CAST(CASE t WHEN 'two Macs' THEN 2 WHEN '3 Macs' THEN 3 ELSE 1 END AS INT) AS quantity FROM s
""")
def named_things(spark: SparkSession, root: str) -> DataFrame:
    """Names and contexts of labels, names that one label joins, and how many there are."""
    texts = ("Neovim - my editor", "Dell U2720Q: a screen", "Aeron. It's comfortable", "iTerm2 on my Mac", "plain words", "Vim and Emacs", "Zsh, Tmux, Git", "Mouse with a wheel", "two Macs", "3 Macs", "Macs")
    rows = spread(table(spark, root, "part")).select("p_partkey", F.explode(F.array(*map(F.lit, texts))).alias("t"))
    label = F.col("label")  # made once; so is what is told by it
    rows = rows.withColumn("label", tx.label(F.col("t"))).withColumn("both", uses.name_and_context(label, clean=True))
    return rows.select("p_partkey", "t", "both.name", "both.context", F.array_join(uses.names_of(label, clean=True), "|").alias("parts"), uses.quantity(label, F.lit("Macs"), clean=True).alias("quantity"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ada Byron' WHEN c_custkey % 3 = 1 THEN 'Ada King Byron' END AS person FROM customer
""")
def introduced_names(spark: SparkSession, root: str) -> DataFrame:
    """Names by which people introduce themselves, where their host is that name."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "Hi. I'm Ada Byron. I've written programs.").when(k == 1, "My name is Ada King Byron, hello").otherwise("I am Grace Hopper.")
    domain = F.when(k == 0, "www.ada-byron.example").when(k == 1, "adakingbyron.example").otherwise("navy.example")
    return table(spark, root, "customer").select("c_custkey", lb.person_of_intro(text, domain).alias("person"))


@query("""
SELECT p_partkey, CAST(0 AS INT) AS n, 'I look for ' || p_name AS description, p_type AS title, p_brand || ',rare' AS categories FROM part
""")
def marked_requests(spark: SparkSession, root: str) -> DataFrame:
    """Listings of pages that are marked as wanted; offers and empty ones are left out."""
    body = F.concat(F.lit("<article class='h-listing'><b class=\"p-action\">Wanted</b><h2 class='p-name'>"), "p_type", F.lit("</h2><p class='p-description'>I look for <i>"), "p_name", F.lit("</i></p><span class='p-category'>"), "p_brand", F.lit("</span><span class='p-category'>rare</span></article><div class='h-listing'><b class='p-action'>offer</b><p class='p-description'>x</p></div><section class='h-listing'><b class='p-action'>wanted</b></section>"))
    pages = spread(table(spark, root, "part")).select("p_partkey", F.lit("https://x.example/seeking").alias("url"), body.alias("html"))
    return entries.requests(pages, "p_partkey", "html", "url").select("p_partkey", "n", "description", "title", F.array_join("categories", ",").alias("categories"))


@query("""
SELECT p_partkey, 'https://x.example/albums/' || p_partkey AS url, p_name AS title FROM part UNION ALL SELECT p_partkey, 'https://x.example/albums/z', p_type FROM part
""")
def page_albums(spark: SparkSession, root: str) -> DataFrame:
    """Albums that pages list, by their span or picture, each once and only of the own site."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("<a class='album-in-list-link' href='/albums/"), k, F.lit("'><span>"), "p_name", F.lit("</span></a><a href=/albums/z class=album-in-list-link><img alt='"), "p_type", F.lit("'></a><a class='album-in-list-link' href='/albums/z'><span>again</span></a><a class='album-in-list-link' href='https://else.example/'><span>x</span></a>"))
    pages = spread(table(spark, root, "part")).select("p_partkey", F.lit("https://x.example/photos").alias("url"), body.alias("html"))
    return entries.albums(pages, "p_partkey", "html", "url")


@query("""
WITH l AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, o || href AS url FROM l WHERE href LIKE '/%' AND href <> path
""")
def index_children(spark: SparkSession, root: str) -> DataFrame:
    """Pages of their own site that pages link to."""
    from loomspan.functions import urls
    from loomspan.sources.pages import links

    p = table(spark, root, "pages")
    rows = links(p).withColumn("n", F.monotonically_increasing_id()).join(p.select("page_id", F.concat(urls.origin(F.col("url")), urls.path(F.col("url"))).alias("page")), "page_id")
    return entries.children(rows, "page_id", "page", "href", 10_000)


@query("""
WITH o AS (SELECT c_custkey AS k, c_custkey % 7 AS m FROM customer)
SELECT k, m = 0 AS may_remove, CASE m WHEN 0 THEN 'disappearance-removal' WHEN 1 THEN 'failed-or-incomplete-fetch' WHEN 2 THEN 'incomplete-coverage' WHEN 3 THEN 'policy-rejects-absence' WHEN 4 THEN 'policy-rejects-absence' WHEN 5 THEN 'disappearance-means-none' ELSE 'disappearance-hidden' END AS reason FROM o
""")
def removal_policies(spark: SparkSession, root: str) -> DataFrame:
    """What looks at sources may remove, by the policies of their families."""
    m = F.col("c_custkey") % 7
    policies = spark.createDataFrame([("uses", "removal", True), ("articles", "none", False), ("works", "hidden", True)], "family string, meaning string, feeds boolean")
    looks = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.when(m.isin(4, 5), "articles").when(m == 6, "works").otherwise("uses").alias("family"), F.when(m == 1, "timeout").when(m == 3, "unchanged").otherwise("success").alias("outcome"), F.when(m == 2, "partial").otherwise("complete").alias("coverage"), F.when(m == 4, "rss feed").otherwise("page").alias("found"))
    return history.removals(looks.union(looks.where("k % 7 <> 1")), policies, "k", "family")


@query("""
WITH s AS (SELECT CASE WHEN c_nationkey % 5 = 1 THEN c_nationkey - 1 ELSE c_nationkey END AS site, c_custkey, c_mktsegment FROM customer) SELECT CAST(site AS BIGINT) AS site, count(DISTINCT c_custkey) AS requests, count(DISTINCT c_mktsegment) AS categories FROM s GROUP BY site
""")
def request_view(spark: SparkSession, root: str) -> DataFrame:
    """Open requests by the primary of their site's family."""
    s = table(spark, root, "customer").select(F.col("c_nationkey").cast("bigint").alias("site"), F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("category"))
    return history.request_view(s, spark.range(25).where("id % 5 = 1").select(F.col("id").alias("secondary"), (F.col("id") - 1).alias("primary")), "site")


@query("""
WITH c AS (SELECT p_size % 4 AS m, p_size % 2 = 0 AS o, p_size % 3 = 0 AS j FROM part)
SELECT CASE m WHEN 0 THEN 'slots' WHEN 1 THEN 'details' WHEN 2 THEN 'rejected' ELSE 'unsorted' END AS part, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'merged', count(*) FROM c WHERE m = 0 AND o UNION ALL SELECT 'compounds', count(*) FROM c WHERE j
""")
def migration_report(spark: SparkSession, root: str) -> DataFrame:
    """How claims would move to a catalog: merged, joined names, and what each role holds."""
    k = F.col("p_size")
    claims = table(spark, root, "part").select(F.lit("o").alias("origin"), F.when(k % 3 == 0, "Vim and Git").otherwise("Vim").alias("name"), F.when(k % 2 == 0, "observed:vim").otherwise("vim").alias("stored"), F.lit("vim").alias("tool"), F.when(k % 4 == 0, "ranked").when(k % 4 == 1, "detail").when(k % 4 == 2, "rejected").alias("role"))
    return history.migration_report(claims)
