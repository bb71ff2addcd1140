"""Queries over what is shown and checked, registries, aliases, stores and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import content, times
from loomspan.functions import text as tx
from loomspan.operators import topics, views
from loomspan.plans.registry import query
from loomspan.sources import stores
from loomspan.sources.tables import table
from loomspan.streaming.ledger import base_folder


def _site(c):
    return F.concat(F.lit("https://n"), c.cast("string"), F.lit(".example"))


@query("""
WITH i AS (SELECT s_suppkey, s_nationkey, s_name FROM supplier)
SELECT s_suppkey AS item, CASE WHEN s_nationkey % 3 = 0 THEN 'The ' || n_name WHEN s_nationkey % 3 = 1 THEN n_name ELSE 'n' || s_nationkey || '.example' END AS publisher, 't' || s_suppkey % 5 || ',t' || s_suppkey % 7 AS tags,
 array_to_string(list_sort(list_distinct(list_filter(['t' || s_suppkey % 5, 't' || s_suppkey % 7], lambda x: x IN ('t1', 't2', 't6')))), ',') AS neighbourhoods FROM i JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> s_suppkey % 7
UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'The ' || n_name WHEN s_nationkey % 3 = 1 THEN n_name ELSE 'n' || s_nationkey || '.example' END, 't' || s_suppkey % 5, CASE WHEN s_suppkey % 5 IN (1, 2) THEN 't' || s_suppkey % 5 ELSE '' END FROM i JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = s_suppkey % 7
""")
def display_rows(spark: SparkSession, root: str) -> DataFrame:
    """Items with the titles of their sites, their topics once, and which of these are public."""
    k = F.col("s_suppkey")
    t = lambda n: F.concat(F.lit("t"), (k % n).cast("string"))
    items = table(spark, root, "supplier").select(k.alias("item"), _site(F.col("s_nationkey")).alias("site"), F.lit("u").alias("url"), F.col("s_name").alias("title"), F.array(t(5), t(7)).alias("topics"))
    sites = table(spark, root, "nation").select(_site(F.col("n_nationkey")).alias("site"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("The "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise(" ").alias("title"), F.lit("").alias("domain"))
    out = views.display(items, sites, spark.createDataFrame([("t1",), ("t2",), ("t6",), ("none",)], "slug string"), "site")
    return out.select("item", "publisher", F.array_join("tags", ",").alias("tags"), F.array_join("neighbourhoods", ",").alias("neighbourhoods"))


@query("""
SELECT p_partkey FROM part WHERE p_size % 4 IN (0, 1)
""")
def publishable_items(spark: SparkSession, root: str) -> DataFrame:
    """Items on their own site's or their feed's host; others and those without an address go."""
    u = F.element_at(F.array(F.lit("https://www.own.example/x"), F.lit("https://feeds.example/y"), F.lit("https://else.example/z"), F.lit("mailto:x")), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, root, "part").select("p_partkey", u.alias("url"), F.lit("https://own.example").alias("site"), F.lit("https://feeds.example/rss").alias("feed"))
    return views.publishable(rows, "site", "feed").select("p_partkey")


@query("""
SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n = 1
""")
def unique_by_url(spark: SparkSession, root: str) -> DataFrame:
    """One page of each address, the longest."""
    return views.first_by_url(table(spark, root, "pages"), "url", [F.desc(F.length("html")), F.col("page_id")]).select("page_id")


@query("""
SELECT DISTINCT c_nationkey AS site FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 30 <= 14
""")
def watch_origins(spark: SparkSession, root: str) -> DataFrame:
    """Sites with videos of the last two weeks."""
    k, now = F.col("c_custkey"), F.lit("2024-03-01").cast("timestamp")
    rows = table(spark, root, "customer").select(F.col("c_nationkey").alias("site"), F.when(k % 3 == 0, "video").otherwise("article").alias("type"), (now - F.make_dt_interval((k % 30).cast("int"))).alias("at"))
    return rows.where((F.col("type") == "video") & times.within_days(F.col("at"), now, content.ACTIVITY_DAYS)).select("site").distinct()


@query("""
SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'https://c' || CASE WHEN c_custkey % 20 = 1 THEN 1 ELSE c_custkey END || '.example' END AS origin, min(c_name) AS name, count(*) AS count FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1
""")
def registry_rows(spark: SparkSession, root: str) -> DataFrame:
    """Members out of registry documents, with origins that several nodes name or that aren't canonical."""
    k = F.col("c_custkey")
    origin = F.concat(F.lit("https://c"), F.when(k % 20 == 1, 1).otherwise(k).cast("string"), F.lit(".example"), F.when(k % 50 == 0, "/").otherwise(""))
    node = F.struct(origin.alias("origin"), F.col("c_name").alias("name"), F.when(k % 4 != 3, "valid").otherwise("lost").alias("latest_declaration_check_outcome"))
    docs = table(spark, root, "customer").select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(node).alias("nodes"))).alias("body"))
    return views.registry(docs, "body")


@query("SELECT n_nationkey, CAST(n AS INT) AS n, n_name || n AS name FROM nation, (SELECT unnest([0, 1]) AS n) WHERE n_nationkey % 3 <> 2")
def collection_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of documents that are lists or hold one under a name."""
    items = F.to_json(F.array(*(F.struct(F.concat("n_name", F.lit(str(n))).alias("name")) for n in (0, 1))))
    body = F.when(F.col("n_nationkey") % 3 == 0, items).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('{"v":1,"rows":'), items, F.lit("}"))).otherwise('{"v":1}')
    return views.collection(table(spark, root, "nation").select("n_nationkey", body.alias("body")), "n_nationkey", "body", "rows", "struct<name:string>").select("n_nationkey", "n", "item.name")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'user-' || a.user_id AS f, 'user-' || b.user_id AS t, CASE a.event_type WHEN 'signup' THEN 'broader' WHEN 'error' THEN 'kind-of' ELSE 'equivalent' END AS kind FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id),
g AS (SELECT f, min(t) AS t, count(*) AS n FROM e WHERE kind = 'equivalent' GROUP BY f), w AS (SELECT f AS s, t AS reached FROM g UNION SELECT w.s, g.t FROM w JOIN g ON g.f = w.reached),
c AS (SELECT s FROM w GROUP BY s HAVING bool_or(s = reached) AND min(reached) = s)
SELECT 'alias' AS kind, f AS a, t AS b FROM g UNION ALL SELECT 'broader', f, t FROM e WHERE kind = 'broader' UNION ALL SELECT 'alias-not-equivalent', f, t FROM e WHERE kind = 'kind-of'
UNION ALL SELECT 'alias-conflict', f, t FROM g WHERE n > 1 UNION ALL SELECT 'alias-cycle', f, t FROM g JOIN c ON c.s = g.f
""")
def alias_rows(spark: SparkSession, root: str) -> DataFrame:
    """Who acts after whom as aliases and relations by folded slug, and what is wrong with them: other kinds, two targets, circles."""
    e = table(spark, root, "events").select("event_id", "event_type", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("who"))
    kind = F.when(F.col("event_type") == "signup", "broader").when(F.col("event_type") == "error", "kind-of").when(F.col("event_type") == "view", "equivalent")
    a = e.select(F.col("event_id") + 1, F.col("who").alias("from"), kind.alias("kind")).toDF("event_id", "from", "kind").join(e.select("event_id", F.col("who").alias("to")), "event_id").drop("event_id")
    good, relations, errors = views.alias_rows(a)
    return good.select(F.lit("alias").alias("kind"), F.col("from").alias("a"), F.col("to").alias("b")).union(relations.select("kind", "from", "to")).union(errors.select("code", "from", "to"))


@query(r"""
WITH d AS (SELECT doc_id, source, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS line FROM documents), t AS (SELECT unnest(['the', 'of the', 'und', 'zzzz']) AS slug),
f AS (SELECT source, slug, doc_id FROM d, t WHERE contains(line, ' ' || slug || ' '))
SELECT source, slug, count(DISTINCT doc_id) AS hits FROM f WHERE NOT (slug = 'the' AND source = 'src1') GROUP BY ALL
""")
def catalog_matches(spark: SparkSession, root: str) -> DataFrame:
    """Topics of a catalog that sources mention without declaring them, and in how many documents."""
    t = spark.createDataFrame([("the",), ("of the",), ("und",), ("zzzz",)], "slug string").withColumn("phrase", F.col("slug"))
    d = table(spark, root, "documents")
    found = topics.mentions(d.where("source IS NOT NULL"), "doc_id", "text", t, "slug", "phrase", keep=("source",))
    own = views.catalog_matches(found, spark.createDataFrame([("src1", "the")], "source string, slug string"), ["source", "slug"], "doc_id")
    return own


@query("""
SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'https://n.example/uses/' WHEN 1 THEN 'https://n.example/uses.html' WHEN 2 THEN 'https://n.example/odd' END AS url, CASE n_nationkey % 4 WHEN 0 THEN 'assessed' WHEN 1 THEN 'out_of_scope' WHEN 2 THEN 'out_of_scope' ELSE 'not_found' END AS state FROM nation
""")
def assessed_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of sites that list uses: assessed, out of scope, or not found."""
    k = F.col("n_nationkey")
    row = lambda n, u, d, o: F.struct(F.lit(n).alias("n"), u.alias("url"), d.alias("digest"), o.alias("outcome"))
    u = F.when(k % 4 == 0, "https://n.example/uses/").when(k % 4 == 1, "https://n.example/uses.html").when(k % 4 == 2, "https://n.example/odd").otherwise("https://n.example/about")
    pages = F.array(row(0, F.lit("https://n.example/"), F.lit("h"), F.lit("ok")), row(1, u, F.when(k % 4 == 1, "h").otherwise("x"), F.when(k % 4 == 2, "out_of_scope").otherwise("ok")), row(2, F.lit("https://n.example/x"), F.lit("x"), F.lit("ok")))
    rows = table(spark, root, "nation").select(k.alias("k"), F.explode(pages).alias("p")).select("k", "p.*")
    return views.assessed(rows, "k", "n")


@query("""
SELECT p_partkey, p_size % 5 IN (0, 1) AS repeats FROM part
""")
def home_repeats(spark: SparkSession, root: str) -> DataFrame:
    """Pages that are the homepage served again."""
    k = F.col("p_size") % 5
    site = F.concat(F.lit("https://p"), F.col("p_partkey").cast("string"), F.lit(".example"))
    page = F.struct(F.concat(site, F.lit("/x")).alias("url"), F.when(k == 4, "Other").otherwise("Home").alias("title"), F.when(k == 0, F.concat(site, F.lit("/"))).when(k == 2, F.concat(site, F.lit("/x"))).otherwise(F.lit("")).alias("canonical"), F.when(k == 3, "y").otherwise("h").alias("digest"))
    home = F.struct(F.concat(site, F.lit("/")).alias("url"), F.lit("Home").alias("title"), F.lit("").alias("canonical"), F.lit("h").alias("digest"))
    rows = table(spark, root, "part").select("p_partkey", site.alias("site"), F.explode(F.array(home, page)).alias("x")).select("p_partkey", "site", "x.*")
    return views.repeats_home(rows, "site").where("url LIKE '%/x'").select("p_partkey", "repeats")


@query("""
WITH e AS (SELECT o_custkey % 40 AS k, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT')
SELECT CAST(count_if(k < 20 AND k % 2 = 0) AS BIGINT) AS collapses, CAST(count_if(NOT (k < 20 AND k % 2 = 0)) AS BIGINT) AS corrections FROM e
""")
def identity_corrections(spark: SparkSession, root: str) -> DataFrame:
    """Removals by correction: collapses into a canonical id that stays, and true corrections."""
    k = F.col("o_custkey") % 40
    e = table(spark, root, "orders").where("o_orderstatus <> 'P'").select(F.when(F.col("o_orderpriority") == "1-URGENT", "correction").otherwise("usage_added").alias("event_type"), F.lit("removed").alias("status"), F.concat(F.when(k < 20, "observed:").otherwise(""), k.cast("string")).alias("tool_id"))
    pairs = spark.range(40).select(F.concat(F.lit("observed:"), F.col("id").cast("string")).alias("observed"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("canonical"))
    return views.corrections(e, pairs, spark.range(40).where("id % 2 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("tool_id")))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no durable record' WHEN 1 THEN 'not committed' WHEN 2 THEN 'no sha' WHEN 3 THEN 'not validated,sha in manifest' ELSE '' END AS errors FROM orders
""")
def provenance_errors(spark: SparkSession, root: str) -> DataFrame:
    """What differs between manifests and durable records."""
    k = F.col("o_orderkey") % 5
    o = table(spark, root, "orders")
    m = o.select("o_orderkey", F.when(k == 3, "committed").otherwise("validated").alias("status"), F.when(k == 3, "abc").alias("sha"))
    return views.provenance(m, o.where(k != 0).select("o_orderkey", F.when(k == 1, "validated").otherwise("committed").alias("status"), F.when(k == 2, "").otherwise("abc").alias("sha")), "o_orderkey")


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'new' WHEN c_custkey % 7 = 1 THEN 'gone' WHEN c_custkey % 7 = 2 THEN 'changed' ELSE 'stale' END AS reason FROM customer WHERE c_custkey % 7 IN (0, 1, 2) OR c_custkey % 2 = 0
""")
def sync_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Members that a synchronisation has to look at, and why."""
    c, k, now = table(spark, root, "customer"), F.col("c_custkey"), F.lit("2024-03-01").cast("timestamp")
    members = c.where("c_custkey % 7 <> 1").select(k.alias("k"), F.col("c_name").alias("v"))
    known = c.where("c_custkey % 7 <> 0").select(k.alias("k"), F.when(k % 7 == 2, "old").otherwise(F.col("c_name")).alias("v"), (now - F.make_dt_interval((k % 2 + 1).cast("int") - F.lit(1) + F.when(k % 2 == 0, 1).otherwise(-1))).alias("at"))
    return views.sync_reasons(members, known, "k", "v", "at", now)


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '/blog' WHEN 1 THEN '/www' END AS path, CASE n_nationkey % 3 WHEN 0 THEN 'https://n.example/blog/a' WHEN 1 THEN 'https://n.example/www/a' ELSE 'https://n.example/a' END AS below FROM nation
""")
def crawl_roots(spark: SparkSession, root: str) -> DataFrame:
    """Paths that are set for sites under their own name or the other form, and addresses below them."""
    k = F.col("n_nationkey")
    o = table(spark, root, "nation").select("n_nationkey", F.concat(F.lit("https://"), F.when(k % 3 == 1, "www.").otherwise(""), F.lit("n"), k.cast("string"), F.lit(".example")).alias("origin"))
    roots = table(spark, root, "nation").where("n_nationkey % 3 < 2").select(F.concat(F.lit("https://n"), k.cast("string"), F.lit(".example")).alias("origin"), F.when(k % 3 == 0, "/blog").otherwise("/www").alias("path"))
    rows = views.rooted(o, roots, "origin")
    return rows.select("n_nationkey", "path", views.under_root(F.concat(F.lit("https://n.example"), F.coalesce("path", F.lit(""))), F.lit("/a")).alias("below"))


@query("""
SELECT event_id, 'sha256:' || sha256('event:v2:{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS id FROM events
""")
def event_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids of events by what they say."""
    return table(spark, root, "events").select("event_id", views.event_id(2, "user_id", "event_type").alias("id"))


@query("""
SELECT event_id, 'sha256:' || sha256('{"a":{"b":[1,{"c":"é"}]},"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS hash FROM events
""")
def semantic_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Digests of JSON that neither the order of keys nor times change."""
    body = F.concat(F.lit('{"generated_at": "now", "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": {"observed_at": 1, "b": [1, {"checked_at": 2, "c": "\\u00e9"}]}}'))
    return table(spark, root, "events").select("event_id", views.semantic_hash(body).alias("hash"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'long' WHEN p_size % 3 = 1 THEN NULL ELSE 'kept' END AS slot, p_size % 3 = 2 AS cached FROM part
""")
def model_proposals(spark: SparkSession, root: str) -> DataFrame:
    """Slots that a model proposes, each distinct prompt asked once and known ones not at all; unsure ones are left open."""

    def classify(prompts):
        return [[("long", 0.9), ("short", 0.1)] if p.endswith("0") else [("a", 0.72), ("b", 0.7)] for p in prompts]

    prompt = F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string"))
    return views.proposals(table(spark, root, "part"), "p_partkey", prompt, classify, 0.7, 0.15, spark.createDataFrame([("size 2", "kept")], "prompt string, slot string"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'outcome' WHEN 2 THEN 'completeness,url' ELSE 'time' END AS errors FROM orders
""")
def observation_errors(spark: SparkSession, root: str) -> DataFrame:
    """Observations whose fields lack or aren't of their kind."""
    k = F.col("o_orderkey") % 4
    rows = table(spark, root, "orders").select("o_orderkey", F.when(k == 1, "odd").otherwise("changed").alias("outcome"), F.when(k != 2, "complete").alias("completeness"), F.when(k == 2, "x").otherwise("https://x.example/").alias("url"), F.when(k != 3, F.col("o_orderdate")).alias("observed_at"))
    return views.observation_errors(rows, "o_orderkey")


@query("""
SELECT CASE p_size % 4 WHEN 0 THEN 'weak-title' WHEN 1 THEN 'fragment-double' ELSE 'elsewhere' END AS code, p_partkey FROM part WHERE p_size % 4 <> 3
""")
def attribution_errors(spark: SparkSession, root: str) -> DataFrame:
    """Shown items with weak titles, doubles by fragment, and those that lie elsewhere."""
    k = F.col("p_size") % 4
    own = F.concat(F.lit("https://s.example/"), F.col("p_partkey").cast("string"))
    rows = table(spark, root, "part").select("p_partkey", F.when(k == 0, "Home").otherwise(F.col("p_name")).alias("title"), F.when(k == 1, "https://s.example/shared#x").when(k == 2, "https://else.example/").otherwise(own).alias("url"), F.lit("https://s.example").alias("site"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "Shared", "https://s.example/shared", "https://s.example")], "p_partkey long, title string, url string, site string").select(F.col("p_partkey").cast(rows.schema["p_partkey"].dataType).alias("p_partkey"), "title", "url", "site"))
    return views.attribution_errors(rows, "p_partkey", "site")


@query("""
SELECT 'no-evidence' AS code, count(*) AS n FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'no-subject', 2 UNION ALL SELECT 'artifact', 1 UNION ALL SELECT 'no-members', 3
""")
def topic_report(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with public topics, counted by kind."""
    members = table(spark, root, "part").select(F.lower("p_type").alias("slug"), F.when(F.col("p_size") % 2 == 0, "heuristic").otherwise("declared").alias("membership"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(3).alias("pages"))
    t = members.select("slug").distinct().union(spark.createDataFrame([("quot",), ("the-of",), ("maps",)], "slug string"))
    return views.topic_report(t, members)


@query("SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY 1")
def stored_log(spark: SparkSession, root: str) -> DataFrame:
    """Periods of a log of events to which all events were added twice."""
    at = f"{base_folder(spark)}/log-{uuid.uuid4().hex[:12]}"
    e = table(spark, root, "events").select("event_id", "ts", "event_type")
    stores.append_events(spark, e.where("event_id % 3 = 0"), at, "event_id", "ts")
    stores.append_events(spark, e, at, "event_id", "ts")
    stores.append_events(spark, e, at, "event_id", "ts")
    return stores.stored_periods(spark, at)


@query("SELECT sha256(coalesce(p_name, '')) AS sha, count(*) AS n FROM part GROUP BY 1")
def stored_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Bodies by their digest, added twice and kept once, with the rows that name them."""
    at = f"{base_folder(spark)}/bodies-{uuid.uuid4().hex[:12]}"
    p = table(spark, root, "part").select("p_partkey", "p_name")
    stores.add_bodies(spark, p.where("p_partkey % 2 = 0"), at, "p_name")
    named = stores.add_bodies(spark, p, at, "p_name")
    return named.join(spark.read.parquet(at).select("sha"), "sha").groupBy("sha").agg(F.count("*").alias("n"))


@query("""
SELECT 'view' AS what, CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s, CAST(2 AS INT) AS writes FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey
UNION ALL SELECT 'record', c_mktsegment, count(*), CAST(sum(c_nationkey) AS BIGINT), CAST(1 AS INT) FROM customer GROUP BY c_mktsegment
""")
def stored_views(spark: SparkSession, root: str) -> DataFrame:
    """A view of customers by nation, offered three times (as it is, in another order, changed) and written twice, as it stands in the
    end; and customers as JSON records in folders by segment, read back."""
    at = f"{base_folder(spark)}/views-{uuid.uuid4().hex[:12]}"
    c = table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    view = lambda rows: rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))
    writes = sum(stores.write_if_changed(v, f"{at}/v", ["c_nationkey", "n", "s"]) for v in (view(c), view(c).orderBy(F.desc("n")), view(c.where("c_acctbal > 0"))))
    stores.write_records(c, f"{at}/r", "c_mktsegment", F.struct("c_custkey", "c_nationkey"))
    stands = spark.read.parquet(f"{at}/v/rows").select(F.lit("view").alias("what"), F.col("c_nationkey").cast("string").alias("k"), "n", "s", F.lit(writes).alias("writes"))
    back = spark.read.text(f"{at}/r").select("c_mktsegment", F.from_json("value", "c_custkey long, c_nationkey long").alias("x")).groupBy("c_mktsegment").agg(F.count("x.c_custkey").alias("n"), F.sum("x.c_nationkey").alias("s"))
    return stands.union(back.select(F.lit("record"), "c_mktsegment", "n", "s", F.lit(1)))


@query(r"""
SELECT doc_id, md5(CASE WHEN text IS NULL THEN '' ELSE text END) AS digest, contains(lower(coalesce(text, '')), 'no longer') OR regexp_matches(lower(coalesce(text, '')), '\b(not|never|formerly|considering|replaced by)\b') AS denied FROM documents
""")
def publish_guards(spark: SparkSession, root: str) -> DataFrame:
    """Which whole texts take a claim back."""
    d = table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (~content.may_publish(F.lit(True), F.lit(""), F.col("t"))).alias("denied"))


@query("""
SELECT s_suppkey, trim(regexp_replace(s_name, '\\s+', ' ', 'g')) AS text, CASE WHEN length(trim(s_name)) = 0 THEN 0 WHEN length(s_name) < 40 THEN 1 ELSE 2 END AS worth FROM supplier
""".replace("\\\\s", "\\s"))
def described_sites(spark: SparkSession, root: str) -> DataFrame:
    """Descriptions as they are shown and what they are worth."""
    s = table(spark, root, "supplier").select("s_suppkey", views.described(F.col("s_name")).alias("d"))
    return s.select("s_suppkey", "d.text", "d.worth")


@query("""
SELECT page_id, 'https://' || regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS origin FROM pages UNION SELECT page_id, 'https://new.example' FROM pages
""")
def listed_origins(spark: SparkSession, root: str) -> DataFrame:
    """Origins that directory pages list, each once, with those known before."""
    from loomspan.sources.entries import outbound

    body = F.concat(F.lit("<a href='https://"), F.regexp_extract(F.lower("url"), r"^https?://([^/?#]+)", 1), F.lit("/x'>a</a><a href='https://new.example/a'>b</a><a href='https://new.example/b'>c</a><a href='/own'>d</a>"))
    pages = table(spark, root, "pages").select("page_id", F.lit("https://directory.example/list").alias("url"), body.alias("html"))
    from loomspan.functions import urls

    return outbound(pages, "page_id", "html", "url").select("page_id", urls.origin(F.col("url")).alias("origin")).distinct()


@query("SELECT p_partkey, p_size % 4 < 2 AS slug_ok, CASE p_size % 4 WHEN 0 THEN 'web-map' WHEN 1 THEN 'lake' END AS slug FROM part")
def declared_topics(spark: SparkSession, root: str) -> DataFrame:
    """Topics that items declare, by folded slug; null where a label names no subject."""
    raw = F.element_at(F.array(F.lit("Web-Map"), F.lit("Lakes"), F.lit("the"), F.lit("2024")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, root, "part").select("p_partkey", content.topic_slug(raw).alias("slug")).withColumn("slug_ok", F.col("slug").isNotNull()).withColumn("slug", tx.singular_slug(F.col("slug")))
