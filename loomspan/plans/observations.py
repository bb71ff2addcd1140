"""Queries over observation runs, snapshots, catalogs and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import observation, quality, ranking
from loomspan.plans.registry import query
from loomspan.sources.tables import table


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def published_observations(spark: SparkSession, root: str) -> DataFrame:
    """Events of committed runs: customers of one segment stand for the runs."""
    runs = table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "committed").otherwise("validated").alias("status"))
    return observation.published(table(spark, root, "events"), runs, "user_id", "status").select("event_id", "user_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'supersede' WHEN o_custkey % 5 < 3 AND o_orderkey % 20 <= 7 THEN 'retry' ELSE 'abort' END AS fate FROM orders
""")
def generation_fate(spark: SparkSession, root: str) -> DataFrame:
    """What becomes of runs that were never committed."""
    return table(spark, root, "orders").select("o_orderkey", observation.fate(F.col("o_orderkey") % 20, F.col("o_custkey") % 5, F.col("o_orderstatus") == "O").alias("fate"))


@query("""
WITH a AS (SELECT doc_id, lang, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT lang, md5(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, lang, h AS digest FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.lang = a.lang AND b.h = a.h)
""")
def short_circuit(spark: SparkSession, root: str) -> DataFrame:
    """Documents that their language's other half has too, by digest."""
    d = table(spark, root, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))
    return observation.unchanged(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["lang"], "digest").select("doc_id", "lang", "digest")


@query("""
WITH b AS (SELECT user_id, max(event_type) AS v FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1), g AS (SELECT user_id, max(event_type) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT coalesce(b.user_id, g.user_id) AS user_id, coalesce(g.v, b.v) AS v, CASE WHEN b.user_id IS NULL THEN 'added' WHEN g.user_id IS NULL THEN 'kept' WHEN b.v = g.v THEN 'same' ELSE 'updated' END AS outcome FROM b FULL JOIN g ON b.user_id = g.user_id
""")
def merge_gathered(spark: SparkSession, root: str) -> DataFrame:
    """A retained base merged with what a new run gathered."""
    e = table(spark, root, "events")
    base = e.where("ts < TIMESTAMP_NTZ '2024-01-05 00:00:00'").groupBy("user_id").agg(F.max("event_type").alias("v"))
    new = e.where("ts >= TIMESTAMP_NTZ '2024-01-28 00:00:00'").groupBy("user_id").agg(F.max("event_type").alias("v"))
    return observation.merged(base, new, "user_id", "v")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_type = 'purchase'")
def prune_cache(spark: SparkSession, root: str) -> DataFrame:
    """Rows that a cache of eleven days keeps; one type is pinned."""
    return table(spark, root, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' OR event_type = 'purchase'").select("event_id")


@query("""
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) AND p_size > 40 THEN 'brand_key' WHEN p_type = 'PROMO' THEN 'type_key' ELSE 'none' END AS stage,
 CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) AND p_size > 40 THEN 'b:' || p_brand WHEN p_type = 'PROMO' THEN 't:PROMO' END AS target FROM part
""")
def classify_claim(spark: SparkSession, root: str) -> DataFrame:
    """Parts looked up in stages; the first that knows a part decides."""
    p = table(spark, root, "part")
    claims = p.select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_brand")).alias("brand_key"), F.col("p_type").alias("type_key"))
    brands = p.where("p_size > 49").select(F.col("p_brand").alias("brand_key")).distinct().withColumn("target", F.concat(F.lit("b:"), "brand_key"))
    types = p.where("p_type = 'PROMO'").select(F.col("p_type").alias("type_key")).distinct().withColumn("target", F.concat(F.lit("t:"), "type_key"))
    return observation.first_match(claims, [("brand_key", brands), ("type_key", types)], "p_partkey")


_EDGES = "SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """Links from customers' to suppliers' nations."""
    li = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, root, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target")), F.col("l_suppkey") == F.col("s_suppkey"))
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey").join(table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").alias("source")), F.col("o_custkey") == F.col("c_custkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("source", "target").distinct()


@query(f"WITH e AS ({_EDGES}) SELECT source, target FROM e WHERE source <> target AND source IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) AND target IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def connection_observations(spark: SparkSession, root: str) -> DataFrame:
    """Links between two different members: nations of two regions."""
    return observation.connections(_edges(spark, root), table(spark, root, "nation").where("n_regionkey < 2"), "source", "target", "n_nationkey")


@query(f"""
WITH e AS ({_EDGES}), o AS (SELECT source AS n, count(*) AS c FROM e GROUP BY 1), i AS (SELECT target AS n, count(*) AS c FROM e GROUP BY 1)
SELECT n_nationkey, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM nation LEFT JOIN o ON o.n = n_nationkey LEFT JOIN i ON i.n = n_nationkey
""")
def participant_index(spark: SparkSession, root: str) -> DataFrame:
    """Outgoing and incoming links of every nation; unlinked ones stay."""
    return observation.neighbours(_edges(spark, root), table(spark, root, "nation"), "source", "target", "n_nationkey")


@query("""
WITH p AS (SELECT * FROM (VALUES ('%', 'all'), ('PROMO%', 'promo'), ('%STEEL', 'steel')) v(pattern, owner)), t AS (SELECT DISTINCT p_type FROM part)
SELECT p_type, max_by(owner, printf('%05d', length(pattern)) || pattern) AS owner FROM t JOIN p ON p_type LIKE pattern GROUP BY p_type
""")
def ownership(spark: SparkSession, root: str) -> DataFrame:
    """The owner of each part type by the longest pattern."""
    patterns = spark.createDataFrame([("%", "all"), ("PROMO%", "promo"), ("%STEEL", "steel")], "pattern string, owner string")
    return observation.longest_pattern(table(spark, root, "part").select("p_type").distinct(), patterns, "p_type", "pattern", "owner")


@query("""
WITH c AS (SELECT l_orderkey, l_partkey, l_linenumber, round(least(1.0, 0.4 + CASE WHEN l_partkey % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.1 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 0.1 ELSE 0 END + CASE WHEN l_tax > 0.05 THEN 0.05 ELSE 0 END), 2) AS confidence FROM lineitem)
SELECT l_partkey, l_orderkey, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY confidence DESC, l_orderkey, l_linenumber) AS n FROM c) WHERE n = 1
""")
def evidence_confidence(spark: SparkSession, root: str) -> DataFrame:
    """The surest line of each part."""
    c = observation.confidence(F.col("l_partkey") % 2 == 0, F.col("l_linestatus") == "O", F.col("l_returnflag") == "A", F.col("l_tax") > 0.05)
    rows = table(spark, root, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", c.alias("confidence"))
    return ranking.first_per(rows, ["l_partkey"], [F.desc("confidence"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "confidence")


@query(f"""
WITH e AS (SELECT CAST(source AS VARCHAR) AS s, CAST(target AS VARCHAR) AS t FROM ({_EDGES})), w0 AS (SELECT DISTINCT s AS start, s AS "at", CAST([] AS VARCHAR[]) AS used FROM e),
j0 AS (SELECT w.start, w."at", w.used, e.s, e.t, e.s || '>' || e.t AS edge, e.t IS NOT NULL AND NOT list_contains(w.used, e.s || '>' || e.t) AS free FROM w0 w LEFT JOIN e ON e.s = w."at"),
w1 AS (SELECT start, CASE WHEN free THEN t ELSE "at" END AS "at", CASE WHEN free THEN list_append(used, edge) ELSE used END AS used FROM j0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY free DESC, md5('5:' || edge), edge) = 1),
j1 AS (SELECT w.start, w."at", w.used, e.s, e.t, e.s || '>' || e.t AS edge, e.t IS NOT NULL AND NOT list_contains(w.used, e.s || '>' || e.t) AS free FROM w1 w LEFT JOIN e ON e.s = w."at"),
w2 AS (SELECT start, CASE WHEN free THEN t ELSE "at" END AS "at", CASE WHEN free THEN list_append(used, edge) ELSE used END AS used FROM j1 QUALIFY row_number() OVER (PARTITION BY start ORDER BY free DESC, md5('6:' || edge), edge) = 1),
j2 AS (SELECT w.start, w."at", w.used, e.s, e.t, e.s || '>' || e.t AS edge, e.t IS NOT NULL AND NOT list_contains(w.used, e.s || '>' || e.t) AS free FROM w2 w LEFT JOIN e ON e.s = w."at"),
w3 AS (SELECT start, CASE WHEN free THEN t ELSE "at" END AS "at", CASE WHEN free THEN list_append(used, edge) ELSE used END AS used FROM j2 QUALIFY row_number() OVER (PARTITION BY start ORDER BY free DESC, md5('7:' || edge), edge) = 1)
SELECT start, "at" AS "end", array_to_string(used, ' ') AS path FROM w3
""")
def link_trail(spark: SparkSession, root: str) -> DataFrame:
    """A walk of three links from each nation, no link twice."""
    e = _edges(spark, root).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return observation.trail(e, e.select("source").distinct(), "source", "target", 5)


@query("""
WITH h AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}') AS h FROM customer),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 25, 12) AS HUGEINT)) AS c FROM h)
SELECT n, substr(sha256(n || '-' || a || '-' || b || '-' || c), 1, 16) AS digest FROM s
""")
def freeze_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The digest of the customers' snapshot."""
    return observation.snapshot_hash(table(spark, root, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("""
SELECT 'site' AS type, CAST(n_nationkey AS VARCHAR) AS id, n_name AS title FROM nation UNION ALL SELECT 'topic', CAST(r_regionkey AS VARCHAR), r_name FROM region
UNION ALL SELECT 'content', CAST(p_partkey AS VARCHAR), p_name FROM part
""")
def search_documents(spark: SparkSession, root: str) -> DataFrame:
    """Three kinds of search documents in one table."""
    kind = lambda df, k, i, t: df.select(F.lit(k).alias("type"), F.col(i).cast("string").alias("id"), F.col(t).alias("title"))
    return kind(table(spark, root, "nation"), "site", "n_nationkey", "n_name").unionByName(kind(table(spark, root, "region"), "topic", "r_regionkey", "r_name")).unionByName(kind(table(spark, root, "part"), "content", "p_partkey", "p_name"))


@query("""
WITH m AS (SELECT o_orderstatus AS status, count_if(o_orderdate < TIMESTAMP '1998-01-01') AS b, count_if(o_orderdate >= TIMESTAMP '1998-01-01') AS a FROM orders GROUP BY 1)
SELECT status, CAST(b AS BIGINT) AS before, CAST(a AS BIGINT) AS after, b > 0 AND (b - a) / b > 0.35 AS drop_gate, coalesce(abs(a / (SELECT sum(a) FROM m) - b / (SELECT sum(b) FROM m)) > 0.02, false) AS share_gate FROM m
""")
def drift_gates(spark: SparkSession, root: str) -> DataFrame:
    """Counts of two periods held against each other: a fall of over 35 %, a share that moved."""
    early = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    m = table(spark, root, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))
    whole = m.agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    out = m.crossJoin(F.broadcast(whole))  # one row
    return out.select("status", "before", "after", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before") > 0.35).otherwise(False).alias("drop_gate"), F.coalesce(F.abs(F.try_divide("after", "_a") - F.try_divide("before", "_b")) > 0.02, F.lit(False)).alias("share_gate"))


@query("""
WITH t AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m') AS month, strftime(min(date_trunc('month', d)), '%Y-%m-%d') AS first, strftime(min(date_trunc('month', d)) + INTERVAL 1 MONTH, '%Y-%m-%d') AS stop, strftime(min(date_trunc('month', d)) - INTERVAL 1 MONTH, '%Y-%m') AS previous,
 strftime(min(d), '%Y') || '-Q' || min(quarter(d)) AS quarter, count(*) AS n FROM t GROUP BY 1
""")
def period_keys(spark: SparkSession, root: str) -> DataFrame:
    """Bounds and neighbours of the months of orders."""
    start = F.trunc("d", "MM")
    d = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("d")).withColumn("m", start)
    g = d.groupBy("m").agg(F.count("*").alias("n"))
    return g.select(F.date_format("m", "yyyy-MM").alias("month"), F.date_format("m", "yyyy-MM-dd").alias("first"), F.date_format(F.add_months("m", 1), "yyyy-MM-dd").alias("stop"), F.date_format(F.add_months("m", -1), "yyyy-MM").alias("previous"), F.concat(F.date_format("m", "yyyy"), F.lit("-Q"), F.quarter("m").cast("string")).alias("quarter"), "n")


@query("""
WITH a AS (SELECT count(*) AS now, count_if(c_name IS NULL OR c_custkey IS NULL) AS bad FROM customer), b AS (SELECT count(*) AS before FROM customer WHERE c_custkey % 3 <> 0)
SELECT now, before, CAST(bad AS BIGINT) AS bad, bad = 0 AND now >= 1 AND now / before >= 0.5 AS valid FROM a, b
""")
def registry_guard(spark: SparkSession, root: str) -> DataFrame:
    """Whether a registry may replace the one before: no bad rows, some rows, not half gone."""
    c = table(spark, root, "customer")
    g = c.agg(F.count("*").alias("now"), F.count_if(F.col("c_custkey") % 3 != 0).alias("before"), F.count_if(F.col("c_name").isNull() | F.col("c_custkey").isNull()).alias("bad"))
    return g.withColumn("valid", (F.col("bad") == 0) & (F.col("now") >= 1) & (F.col("now") / F.col("before") >= 0.5))


@query("""
WITH r AS (SELECT o_orderpriority AS tool, count(DISTINCT o_custkey) AS active FROM orders GROUP BY 1), d AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
SELECT 'unique_tool' AS code, CAST((SELECT count(*) - count(DISTINCT tool) FROM r) AS BIGINT) AS violations UNION ALL SELECT 'within_bounds', CAST((SELECT count(*) FROM r, d WHERE active > n OR active < 0) AS BIGINT)
""")
def rollup_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of a rollup, as counts of what breaks it."""
    o = table(spark, root, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("tool")).agg(F.countDistinct("o_custkey").alias("active"), F.count("*").alias("rows"))
    again = r.groupBy("tool").agg(F.count("*").alias("n"), F.max("active").alias("active"))
    whole = o.agg(F.countDistinct("o_custkey").alias("denominator"))
    return quality.violations(again.crossJoin(F.broadcast(whole)), {"unique_tool": F.col("n") == 1, "within_bounds": F.col("active").between(0, F.col("denominator"))})
