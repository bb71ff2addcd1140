"""Queries over pages parsed as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import works
from loomspan.plans.registry import query
from loomspan.sources import tree
from loomspan.sources.tables import table

_PLAIN = r"""regexp_replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"""


def _plain(c: str) -> str:
    """SQL: text without tags, entities and runs of white space; pages have four entities."""
    return rf"trim(regexp_replace({_PLAIN.format(c)}, '\s+', ' ', 'g'))"


def _trees(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed pages; titles may be cut short within a reference, and &amp counts without its semicolon, as in the SQL."""
    return tree.trees(table(spark, root, "pages"), keep=keep, loose=True)


_TITLE, _FIRST = _plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"), _plain("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")


@query(rf"""
WITH a AS (SELECT page_id, {_plain("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")} AS t FROM pages), p AS (SELECT page_id, rtrim(substr(t, 1, 800)) AS text FROM a WHERE t <> '')
SELECT page_id, 'article' AS kind, '' AS section, text, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS INT) AS sentences FROM p
""")
def topic_passages(spark: SparkSession, root: str) -> DataFrame:
    """The passages of pages that tell their topics, with the headings above them and their sentences."""
    return works.passages(_trees(spark, root), "page_id").drop("n")


@query(rf"""
WITH a AS (SELECT page_id, rtrim(rtrim({_TITLE}, '#')) AS section, unnest(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')[2:]) AS p FROM pages), t AS (SELECT page_id, section, {_plain("p")} AS text FROM a)
SELECT page_id, section, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))) AS BIGINT) AS sentences FROM t WHERE text <> '' GROUP BY ALL
""")
def section_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs and sentences of pages by section."""
    rows = _trees(spark, root).select("page_id", F.explode("tree.paragraphs").alias("x")).where("NOT x.chrome")
    return rows.groupBy("page_id", "x.section").agg(F.count("*").alias("paragraphs"), F.sum(F.length("x.text")).alias("characters"), F.sum(F.size(works.sentences(F.col("x.text")))).alias("sentences"))


@query(rf"""
WITH n AS (SELECT page_id, 'ul/li' AS path, true AS chrome, list_filter(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's'), lambda x: {_plain("x")}), lambda x: x <> '') AS items FROM pages),
p AS (SELECT page_id, 'article/p' AS path, false AS chrome, list_filter(list_transform(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')[2:], lambda x: {_plain("x")}), lambda x: x <> '') AS items FROM pages)
SELECT page_id, path, chrome, CAST(len(items) AS INT) AS size, items[1] AS first_item, items[-1] AS last_item FROM (SELECT * FROM n UNION ALL SELECT * FROM p) WHERE len(items) >= 3
""")
def repeated_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Runs of sibling elements of one kind: where they stand, how many, the first and last."""
    b = works.repeated(_trees(spark, root), "page_id")
    return b.select("page_id", "path", "chrome", F.size("items").alias("size"), F.col("items")[0]["text"].alias("first_item"), F.element_at("items", -1)["text"].alias("last_item"))


_ITEMS = rf"""
o AS (SELECT page_id, html, regexp_extract(url, '^(https?://[^/]+)', 1) AS o, regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=[^&]*$', '') AS own FROM pages),
li AS (SELECT page_id, o, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's')) AS x, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's'), 1) AS i FROM o),
items AS (SELECT page_id, i, o || regexp_extract(x, 'href="([^"]*)"', 1) AS url, {_plain("x")} AS text FROM li)"""


@query(rf"""
WITH {_ITEMS}
SELECT page_id, 'list' AS source, '' AS year, '' AS client, arg_max(text, i) AS project, '' AS sector, '' AS location, url FROM items WHERE text <> '' GROUP BY page_id, url
""")
def portfolio_works(spark: SparkSession, root: str) -> DataFrame:
    """What pages list as works: by table, by links to works, by repeated blocks."""
    return works.portfolio(_trees(spark, root, keep=("url",)), "page_id", "url", lists=True).drop("n")


@query(rf"""
WITH {_ITEMS},
own AS (SELECT page_id, own AS url, {_FIRST} AS title, substr(list_filter(list_transform(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')[2:], lambda x: {_plain("x")}), lambda x: length(x) >= 24)[1], 1, 400) AS summary FROM o),
c AS (SELECT url, 2 AS rank, page_id, i, text AS title, NULL AS summary FROM items WHERE text <> '' UNION ALL SELECT url, 4, page_id, 0, title, summary FROM own WHERE title <> '')
SELECT url, arg_min(title, (rank, page_id, i)) AS title, arg_min(summary, (rank, page_id, i)) FILTER (WHERE summary IS NOT NULL) AS summary, CASE min(rank) WHEN 2 THEN 'list' ELSE 'page' END AS source,
 CASE WHEN min(rank) = max(rank) THEN CASE min(rank) WHEN 2 THEN 'list' ELSE 'page' END ELSE 'list,page' END AS sources, count(*) AS mentions FROM c GROUP BY url
""")
def collected_works(spark: SparkSession, root: str) -> DataFrame:
    """Works of all sites, each address once, with fields from the most telling source that fills them, and where they are from."""
    t = _trees(spark, root, keep=("url",))
    return works.collected(works.candidates(t, "page_id", "url"), "page_id").drop("image", "at")
