"""Queries over graphs, joins to catalogs, and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.operators import graph, quality, topics
from loomspan.plans.registry import query
from loomspan.sources.pages import links
from loomspan.sources.tables import table


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS k, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.b AS left_slug, c.b AS right_slug, count(*) AS shared FROM o a JOIN o c ON a.k = c.k AND a.b < c.b GROUP BY ALL
""")
def cooccurrence(spark: SparkSession, root: str) -> DataFrame:
    """Brands that are ordered together: an order has seven lines at most."""
    rows = table(spark, root, "lineitem").join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return topics.cooccurrence(rows, "l_orderkey", "p_brand")


@query("""
WITH u AS (SELECT user_id, string_agg(event_type, ' ' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id), s AS (SELECT types, count(*) AS n FROM u GROUP BY types)
SELECT a.types AS left_types, b.types AS right_types, CAST(len(list_intersect(string_split(a.types, ' '), string_split(b.types, ' '))) AS INT) AS shared, CAST(CASE WHEN a.types = b.types THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS pairs
FROM s a JOIN s b ON a.types <= b.types WHERE NOT (a.types = b.types AND a.n = 1)
""")
def overlap_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of users by the event types that they share: users stand together by their set of types, and pairs are counted, not
    listed. There are as many sets as combinations of types in use, whatever the users."""
    u = table(spark, root, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("types"))
    s = u.groupBy("types").agg(F.count("*").alias("n")).withColumn("name", F.array_join("types", " "))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{x}") for c in s.columns)) for x in "ab")
    both = a.join(b, F.col("name_a") <= F.col("name_b"))
    pairs = F.when(F.col("name_a") == F.col("name_b"), (F.col("n_a") * (F.col("n_a") - 1) / 2).cast("bigint")).otherwise(F.col("n_a") * F.col("n_b"))
    return both.select(F.col("name_a").alias("left_types"), F.col("name_b").alias("right_types"), F.size(F.array_intersect("types_a", "types_b")).alias("shared"), pairs.alias("pairs")).where("pairs > 0")


_USES = "u AS (SELECT DISTINCT user_id, event_type FROM events), m AS (SELECT c_custkey, c_mktsegment FROM customer)"


@query(f"""
WITH {_USES}, c AS (SELECT a.event_type AS s, b.event_type AS t, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 2)
SELECT 'tool:' || event_type AS source, 'kind:event' AS target, 'is_a' AS relation, count(*) AS members FROM u GROUP BY event_type
UNION ALL SELECT 'tool:' || s, 'tool:' || t, 'co_used_with', n FROM c UNION ALL SELECT 'member:' || user_id, 'tool:' || event_type, 'uses', 1 FROM u
UNION ALL SELECT 'tool:' || event_type, 'case:' || c_mktsegment, 'used_for', count(*) FROM u JOIN m ON c_custkey = user_id GROUP BY ALL
""")
def usage_graph(spark: SparkSession, root: str) -> DataFrame:
    """Edges of the usage graph: tools and their kind, tools used by the same two members or more, members and tools, tools and purposes."""
    u = table(spark, root, "events").select("user_id", "event_type").distinct()
    tool, cases = F.concat(F.lit("tool:"), "event_type"), table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    kinds = u.groupBy("event_type").agg(F.count("*").alias("members")).select(tool.alias("source"), F.lit("kind:event").alias("target"), F.lit("is_a").alias("relation"), "members")
    # Pairs come from a member's set of tools, which is as short as tools have kinds.
    pairs = topics.cooccurrence(u, "user_id", "event_type", 2)
    used = pairs.select(F.concat(F.lit("tool:"), "left_slug").alias("source"), F.concat(F.lit("tool:"), "right_slug").alias("target"), F.lit("co_used_with").alias("relation"), F.col("shared").alias("members"))
    own = u.select(F.concat(F.lit("member:"), F.col("user_id").cast("string")).alias("source"), tool.alias("target"), F.lit("uses").alias("relation"), F.lit(1).cast("long").alias("members"))
    purpose = u.join(cases, "user_id").groupBy(tool.alias("source"), F.concat(F.lit("case:"), "c_mktsegment").alias("target")).agg(F.count("*").alias("members")).select("source", "target", F.lit("used_for").alias("relation"), "members")
    return kinds.unionByName(used).unionByName(own).unionByName(purpose)


@query(f"""
WITH {_USES} SELECT 'tool:' || event_type AS id, 'tool' AS kind FROM u UNION SELECT 'kind:event', 'category' UNION SELECT 'member:' || user_id, 'member' FROM u UNION SELECT 'case:' || c_mktsegment, 'case' FROM m
""")
def usage_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of the usage graph, each once: tools, their kind, members, purposes."""
    u = table(spark, root, "events").select("user_id", "event_type")
    node = lambda df, prefix, c, kind: df.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("kind"))
    every = node(u, "tool:", "event_type", "tool").union(node(u, "member:", "user_id", "member")).union(node(table(spark, root, "customer"), "case:", "c_mktsegment", "case"))
    return every.union(spark.range(1).select(F.lit("kind:event"), F.lit("category"))).dropDuplicates(["id"])


@query("""
WITH a AS (SELECT p_type AS tool, substr(p_name, 1, 5) AS alias FROM part), g AS (SELECT alias, count(DISTINCT tool) AS n, min(tool) AS tool FROM a GROUP BY alias),
c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'none' || p_size ELSE substr(p_name, 1, 5) END AS alias FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN tool END AS tool FROM c LEFT JOIN g USING (alias)
""")
def catalog_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Labels looked up in a catalog of aliases: unique, ambiguous or none."""
    p, alias = table(spark, root, "part"), F.substring("p_name", 1, 5)
    g = p.groupBy(alias.alias("alias")).agg(F.countDistinct("p_type").alias("n"), F.min("p_type").alias("t"))
    claims = p.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("none"), F.col("p_size").cast("string"))).otherwise(alias).alias("alias"))
    verdict = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return claims.join(g, "alias", "left").select("p_partkey", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("t")).alias("tool"))


@query("""
WITH RECURSIVE p AS (SELECT n_nationkey AS alias, n_nationkey // 2 AS target FROM nation WHERE n_nationkey > 0),
c AS (SELECT alias, target, 1 AS d FROM p UNION ALL SELECT c.alias, p.target, d + 1 FROM c JOIN p ON c.target = p.alias WHERE d < 10)
SELECT alias, CAST(arg_max(target, d) AS BIGINT) AS target FROM c GROUP BY alias
""")
def alias_closure(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of nations followed to their end."""
    p = table(spark, root, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("alias"), F.expr("n_nationkey div 2").alias("target"))
    return graph.closure(p.select("alias", F.col("target").cast("int").alias("target")), "alias", "target").select("alias", F.col("target").cast("bigint").alias("target"))


@query("""
WITH f AS (SELECT s_suppkey, n_regionkey AS primary_key FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT primary_key, count(DISTINCT s_suppkey) AS members, min(s_suppkey) AS first FROM f GROUP BY primary_key
""")
def site_families(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers contracted to their nations' regions."""
    f = table(spark, root, "supplier").join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return f.groupBy(F.col("n_regionkey").alias("primary_key")).agg(F.countDistinct("s_suppkey").alias("members"), F.min("s_suppkey").alias("first"))


@query(r"""
WITH l AS (SELECT regexp_replace(regexp_extract(lower(url), '^(https?://[^/?#@]+)([/?#]|$)', 1), '^https?://', '') AS source, page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS target FROM pages)
SELECT source, target, min(page_id) AS first_page_id, count(DISTINCT page_id) AS evidence_count FROM l GROUP BY ALL
""")
def edge_aggregate(spark: SparkSession, root: str) -> DataFrame:
    """Links of pages as edges from hosts, with their evidence."""
    p = table(spark, root, "pages")
    own = links(p).join(p.select("page_id", urls.host(F.col("url")).alias("source")), "page_id").withColumnRenamed("href", "target")
    return graph.aggregate_edges(own, ["source", "target"], ["page_id"])


@query("""
SELECT code, CAST(violations AS BIGINT) AS violations FROM (SELECT 'negative_quantity' AS code, count_if(NOT l_quantity > 0) AS violations FROM lineitem UNION ALL SELECT 'discount_range', count_if(NOT (l_discount >= 0 AND l_discount <= 0.1)) FROM lineitem
UNION ALL SELECT 'flag_known', count_if(l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'tax_range', count_if(NOT l_tax < 0.05) FROM lineitem)
""")
def quality_gates(spark: SparkSession, root: str) -> DataFrame:
    """How many lines break each rule."""
    rules = {"negative_quantity": F.col("l_quantity") > 0, "discount_range": F.col("l_discount").between(0, 0.1), "flag_known": F.col("l_returnflag").isin("A", "N"), "tax_range": F.col("l_tax") < 0.05}
    return quality.violations(table(spark, root, "lineitem"), rules)


@query("""
SELECT DISTINCT 'o_custkey' AS "end", o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
""")
def integrity(spark: SparkSession, root: str) -> DataFrame:
    """Orders' customers that a list of nodes lacks."""
    return graph.orphans(table(spark, root, "orders"), table(spark, root, "customer").where("c_custkey % 10 <> 0"), ["o_custkey"], "c_custkey")


@query("""
WITH c AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT coalesce(c.m, n.m) AS member, CASE WHEN c.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'removed' ELSE 'retained' END AS state FROM c FULL JOIN n ON c.m = n.m
""")
def membership_transitions(spark: SparkSession, root: str) -> DataFrame:
    """Customers before and after a day: added, removed or retained. One pass, no join."""
    o = table(spark, root, "orders").select("o_custkey", (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).alias("early"))
    per = o.groupBy(F.col("o_custkey").alias("member")).agg(F.bool_or("early").alias("was"), F.bool_or(~F.col("early")).alias("is"))
    return per.select("member", F.when(~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("retained").alias("state"))
