"""Queries over pages' events, figures, links and lists, over labels and catalogs, and the whole rollup of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import uses
from loomspan.operators import catalog, rollup
from loomspan.plans.registry import query
from loomspan.sources import entries
from loomspan.sources.tables import dealt, spread, table


def _day(c: str):
    return F.date_format(F.date_add(F.lit("2023-11-14").cast("date"), (F.col(c) % 1000).cast("int")), "yyyy-MM-dd")


@query("""
WITH p AS (SELECT *, epoch(TIMESTAMP '2023-11-14 00:00:00' + to_days(p_partkey % 1000)) AS s FROM part)
SELECT p_partkey, 'marked' AS kind, CASE WHEN p_size % 2 = 0 THEN 'https://site.example/e/' || p_partkey ELSE 'https://site.example/events' END AS url, p_name AS title, p_type || ' & hall' AS location, s AS start, false AS cancelled FROM p
UNION ALL SELECT p_partkey, 'declared', 'https://site.example/d/' || p_partkey, p_type, p_brand, s, p_size % 3 = 0 FROM p
""")
def page_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of pages, marked by class and declared in JSON-LD; those without a start or a title are left out."""
    k = F.col("p_partkey").cast("string")
    marked = F.concat(F.lit("<section class='h-event'><h2 class='p-name'><i>"), "p_name", F.lit("</i></h2><a class='u-url' href='"), F.when(F.col("p_size") % 2 == 0, "/e/").otherwise("https://else.example/"), k, F.lit("'>#</a><span class=\"x p-location\">"), "p_type", F.lit(" &amp; hall</span><time class='dt-start' datetime='"), _day("p_partkey"), F.lit("'>soon</time></section><div class='h-event'><b class='p-name'>no date</b></div>"))
    declared = F.concat(F.lit('<script type="application/ld+json">[{"@type":"MusicEvent","name":"'), "p_type", F.lit('","url":"https://site.example/d/'), k, F.lit('","startDate":"'), _day("p_partkey"), F.lit('","location":{"name":"'), "p_brand", F.lit('"},"eventStatus":"https://schema.org/'), F.when(F.col("p_size") % 3 == 0, "EventCancelled").otherwise("EventScheduled"), F.lit('"},{"@type":"Event","name":"undated"},{"@type":"Person"}]</script>'))
    pages = spread(table(spark, root, "part")).select("p_partkey", F.lit("https://site.example/events").alias("url"), F.concat(declared, marked).alias("html"))
    a = entries.marked_events(pages, "p_partkey", "html", "url").select("p_partkey", F.lit("marked").alias("kind"), "url", "title", "location", F.unix_timestamp("start").cast("double").alias("start"), F.lit(False).alias("cancelled"))
    return a.unionByName(entries.declared_events(pages, "p_partkey", "html").select("p_partkey", F.lit("declared").alias("kind"), "url", "title", "location", F.unix_timestamp("start").cast("double").alias("start"), "cancelled"))


@query("""
SELECT p_partkey, CAST(0 AS INT) AS n, 'https://site.example/w/' || p_partkey AS url, p_name || ' & co' AS title, 'https://site.example/i/' || p_partkey || '.jpg' AS image FROM part
""")
def page_figures(spark: SparkSession, root: str) -> DataFrame:
    """Figures that lead to a page; those that lead to a picture or to another site are left out."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("<figure><a href=/w/"), k, F.lit("><img src='/i/"), k, F.lit(".jpg' alt='x'></a><figcaption>"), "p_name", F.lit(" <b>&amp;</b> co</figcaption></figure><figure><img src=/a.png alt='a picture'></figure><figure><a href='https://else.example/'><img alt='b' src=b></a></figure>"))
    pages = spread(table(spark, root, "part")).select("p_partkey", F.lit("https://site.example/works").alias("url"), body.alias("html"))
    return entries.figures(pages, "p_partkey", "html", "url")


@query("""
SELECT p_partkey, 'https://band.music.example/t/' || p_partkey AS url, p_name AS text FROM part UNION ALL SELECT p_partkey, 'https://music.example/', 'All & more' FROM part
""")
def outbound_links(spark: SparkSession, root: str) -> DataFrame:
    """Links to a host and what lies below it, each address once."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("<a href='https://band.music.example/t/"), k, F.lit("?utm_source=x'><b>"), "p_name", F.lit("</b></a><a href='https://band.music.example/t/"), k, F.lit("'>again</a><a href=https://www.music.example/>x</a><a href=\"https://music.example/\">All &amp; more</a><a href='/own'>own</a><a href='https://notmusic.example/'>no</a><script>'<a href=https://music.example/js>'</script>"))
    pages = spread(table(spark, root, "part")).select("p_partkey", F.lit("https://site.example/sounds").alias("url"), body.alias("html"))
    return entries.outbound(pages, "p_partkey", "html", "url", ("music.example",)).where("url <> 'https://www.music.example/'")


@query("""
WITH x AS (SELECT p_partkey, unnest([{'n': 0, 'l': p_name, 'c': 'for writing notes', 's': 'Hardware', 't': 'current', 'h': '/x', 'p': 'writing'}, {'n': 1, 'l': 'Old ' || p_brand, 'c': 'no longer using it', 's': 'Hardware', 't': 'former', 'h': NULL, 'p': ''},
 {'n': 2, 'l': p_type, 'c': '', 's': 'Editor', 't': 'current', 'h': NULL, 'p': 'programming'}, {'n': 3, 'l': 'Part of it', 'c': '', 's': 'Editor', 't': 'current', 'h': NULL, 'p': 'programming'}]) AS r FROM part)
SELECT p_partkey, CAST(r.n AS INT) AS n, r.l AS label, r.c AS context, r.s AS section, r.t AS status, r.h AS href, r.p AS purposes FROM x
""")
def use_items(spark: SparkSession, root: str) -> DataFrame:
    """What pages list as used, with sections, states and purposes; denials, sentences and navigation are left out."""
    body = F.concat(
        F.lit("<nav><ul><li>Home</li></ul></nav><h1>Uses</h1><h2>Hardware</h2><ul><li><a href=/x>"), "p_name", F.lit("</a> - for writing notes</li><li>Old "), "p_brand", F.lit(" (no longer using it)</li></ul><h2>Software</h2><h3>Editor</h3><ul><li>"), "p_type",
        F.lit("<ul><li>Part of it</li></ul></li><li>I have a long story</li><li>I don't use this</li><li>Editor</li><li>Why it is good</li></ul>"),
    )
    rows = entries.use_items(spread(table(spark, root, "part")).select("p_partkey", body.alias("html")), "p_partkey", "html")
    return rows.withColumn("purposes", F.array_join("purposes", ","))


@query("""
WITH s AS (SELECT p_partkey, p_name, unnest(['I used to use ' || p_name, 'might try ' || p_name, 'on my list', p_name, 'I don''t use it', 'and then ' || p_name, 'Why ' || p_name || ' matters', 'My ' || p_type || ' is old', 'Dell S3425DW 34"', 'monitor', 'LG 27 in', ', 2026', '5 min read', 'iPhone 12']) AS t FROM part)
SELECT p_partkey, t, CASE WHEN t LIKE 'I used to use %' THEN 'former' WHEN t LIKE 'might try %' THEN 'considering' WHEN t = 'on my list' THEN 'wishlist' WHEN t LIKE 'I don%' THEN 'unspecified' ELSE 'current' END AS status,
 t LIKE 'and then %' OR t LIKE 'My %' OR t LIKE 'I used to use %' OR t LIKE 'I don%' AS sentence, t LIKE 'Why %' AS article, CASE WHEN t = 'monitor' OR t LIKE 'Dell %' THEN 'display' WHEN t = 'iPhone 12' THEN 'phone' END AS slot, t IN (', 2026', '5 min read') AS empty_title FROM s
""")
def label_shapes(spark: SparkSession, root: str) -> DataFrame:
    """States that texts tell, labels that are sentences or articles, slots by shape, titles that say nothing."""
    n, t = F.col("p_name"), F.col("p_type")
    texts = F.array(F.concat(F.lit("I used to use "), n), F.concat(F.lit("might try "), n), F.lit("on my list"), n, F.lit("I don't use it"), F.concat(F.lit("and then "), n), F.concat(F.lit("Why "), n, F.lit(" matters")), F.concat(F.lit("My "), t, F.lit(" is old")), F.lit('Dell S3425DW 34"'), F.lit("monitor"), F.lit("LG 27 in"), F.lit(", 2026"), F.lit("5 min read"), F.lit("iPhone 12"))
    c = F.col("t")
    return spread(table(spark, root, "part")).select("p_partkey", F.explode(texts).alias("t")).withColumn("label", tx.label(c)).select("p_partkey", "t", uses.status(c).alias("status"), uses.is_sentence(F.col("label"), clean=True).alias("sentence"), uses.is_article(F.col("label"), clean=True).alias("article"), uses.shape_slot(c).alias("slot"), uses.is_empty_title(c).alias("empty_title"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, k AS form, CASE WHEN k = 'none' OR (k = 'bare' AND o_orderkey % 2 = 0) OR k = 'wrong' THEN NULL ELSE CAST(d AS VARCHAR) END AS day FROM o, (SELECT unnest(['iso', 'instant', 'first', 'second', 'bare', 'none', 'wrong']) AS k)
""")
def appearance_dates(spark: SparkSession, root: str) -> DataFrame:
    """Days that free texts name, in all their forms."""
    d = F.to_date("o_orderdate")
    f = lambda p: F.date_format(d, p)
    forms = {"iso": f("yyyy-MM-dd"), "instant": F.concat(f("yyyy-MM-dd"), F.lit("T10:30:00Z")), "first": F.concat(F.lit("on "), f("MMMM d, yyyy"), F.lit(" in town")), "second": f("d MMM yyyy"), "bare": F.concat(F.lit("Conf 40"), f("MMM d")), "none": F.lit("some day"), "wrong": F.lit("February 30, 2020")}
    rows = table(spark, root, "orders").select("o_orderkey", f("yyyy").alias("y"), F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("t")) for k, v in forms.items()))).alias("x"))
    return rows.select("o_orderkey", "x.form", uses.appearance_date(F.col("x.t"), F.when(F.col("o_orderkey") % 2 == 1, F.col("y"))).cast("string").alias("day"))


@query("""
WITH c AS (SELECT p_partkey, p_size % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'unique' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unique' WHEN 3 THEN 'abstain' WHEN 4 THEN 'none' ELSE 'unique' END AS verdict, CASE k WHEN 0 THEN 'plain' WHEN 2 THEN 'scoped' WHEN 5 THEN 'here' END AS tool FROM c
""")
def resolved_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels against aliases with conditions on their context and section."""
    rules = spark.createDataFrame(
        [("a", "plain", None, None, None), ("b", "one", None, None, None), ("b", "two", None, [], None), ("c", "open", None, None, None), ("c", "scoped", ["desk"], None, None), ("d", "never", ["moon"], None, None), ("d", "open", None, None, None), ("f", "here", None, ["car"], ["office"])],
        "alias string, tool string, require_context array<string>, forbid_context array<string>, require_section array<string>",
    )
    label = F.element_at(F.array(*map(F.lit, "abcdef")), (F.col("p_size") % 6 + 1).cast("int"))
    claims = table(spark, root, "part").select("p_partkey", label.alias("comparison"), F.lit("home office").alias("section"), F.lit("on my desk").alias("context"))
    return catalog.resolved(claims, rules, "p_partkey")


@query("""
WITH t AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), b AS (SELECT o_custkey FROM t WHERE o_orderpriority = '1-URGENT')
SELECT t.o_custkey, 'observed:' || o_orderpriority AS observed, '1-URGENT' AS canonical FROM t WHERE o_orderpriority = '2-HIGH' AND o_custkey IN (SELECT o_custkey FROM b)
""")
def superseded_ids(spark: SparkSession, root: str) -> DataFrame:
    """Observed ids of customers that a catalog's id replaces, where they have both."""
    t = table(spark, root, "orders").select("o_custkey", "o_orderpriority").distinct().withColumn("k", F.xxhash64("o_custkey", "o_orderpriority"))
    tools = t.withColumn("tool_id", F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("observed:"), "o_orderpriority")).otherwise(F.col("o_orderpriority")))
    found = t.select("k", F.when(F.col("o_orderpriority") == "2-HIGH", "unique").otherwise("none").alias("verdict"), F.lit("1-URGENT").alias("tool"))
    return catalog.superseded(tools, found, "o_custkey", "k")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'editor' WHEN 1 THEN 'desk' WHEN 2 THEN 'desk' END AS slot FROM part
""")
def section_slots(spark: SparkSession, root: str) -> DataFrame:
    """Slots by the deepest part of a section's path that names one."""
    slots = spark.createDataFrame([("code editors", "editor"), ("editor", "editor"), ("office", "desk"), ("desk", "desk"), ("misc", "a"), ("misc", "b")], "name string, slot string")
    path = F.element_at(F.array(F.lit("Office / Code editors"), F.lit("Office / Misc"), F.lit("Things / Desk / Rest"), F.lit("Misc")), (F.col("p_size") % 4 + 1).cast("int"))
    return catalog.section_slots(table(spark, root, "part").select("p_partkey", path.alias("section")), slots, "p_partkey", "section")


@query("""
SELECT p_partkey, t AS tool FROM part, (SELECT unnest(['vscode', 'vim']) AS t) WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'code' FROM part WHERE p_size % 3 = 1
""")
def umbrella_names(spark: SparkSession, root: str) -> DataFrame:
    """Names of a catalog within contexts; a name inside a longer one isn't counted."""
    names = spark.createDataFrame([("visual studio code", "vscode"), ("code", "code"), ("vim", "vim"), ("studio", "studio")], "name string, tool string")
    text = F.when(F.col("p_size") % 3 == 0, "Visual Studio Code, and Vim!").when(F.col("p_size") % 3 == 1, "I code with vims").otherwise("nothing")
    return catalog.named_within(table(spark, root, "part").select("p_partkey", text.alias("context")), names, "p_partkey", "context")


_CLAIMS = """c AS (SELECT l_returnflag AS slot, p_brand AS tool, o_custkey AS origin, CAST(l_linenumber AS BIGINT) AS units, CASE WHEN l_returnflag = 'A' THEN 'units' ELSE 'publishers' END AS basis, p_type AS name, p_size % 7 AS purpose, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _claims(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem")
    n = lines.count()
    rows = dealt(lines, "l_orderkey", of=n).join(dealt(table(spark, root, "orders"), "o_orderkey", of=n), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = dealt(rows, "l_partkey", of=n).join(dealt(table(spark, root, "part"), "p_partkey", of=n), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_returnflag").alias("slot"), F.col("p_brand").alias("tool"), F.col("o_custkey").alias("origin"), F.col("l_linenumber").cast("bigint").alias("units"), F.when(F.col("l_returnflag") == "A", "units").otherwise("publishers").alias("basis"), F.col("p_type").alias("name"), (F.col("p_size") % 7).alias("purpose"), "o_orderdate")


@query(f"""
WITH {_CLAIMS}, p AS (SELECT slot, tool, basis, origin, max(units) AS u FROM c GROUP BY ALL), r AS (SELECT slot, tool, basis, count(*) AS active, sum(u) AS units FROM p GROUP BY ALL), w AS (SELECT slot, count(DISTINCT origin) AS o, sum(units) AS a FROM c GROUP BY slot),
v AS (SELECT slot, tool, name FROM (SELECT slot, tool, name, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY slot, tool ORDER BY n DESC, name) = 1), u AS (SELECT slot, tool, count(DISTINCT purpose) AS purposes FROM c GROUP BY ALL),
e AS (SELECT tool, count(DISTINCT origin) AS ever FROM c WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' GROUP BY tool)
SELECT slot, tool, active, CAST(r.units AS BIGINT) AS units, CAST(CASE WHEN basis = 'units' THEN a ELSE o END AS BIGINT) AS denominator, CAST(round(100.0 * CASE WHEN basis = 'units' THEN r.units ELSE active END / CASE WHEN basis = 'units' THEN a ELSE o END) AS BIGINT) AS score, name, purposes, coalesce(ever, 0) AS ever
FROM r JOIN w USING (slot) JOIN v USING (slot, tool) JOIN u USING (slot, tool) LEFT JOIN e USING (tool)
""")
def whole_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The whole rollup of claims by slot and tool: origins, units, denominators, votes, purposes, changes of a month."""
    c = _claims(spark, root)
    month = c.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-02-01 00:00:00'").select("tool", "origin")
    return rollup.full(dealt(c, "origin", of=table(spark, root, "lineitem").count()), month)


@query(f"""
WITH {_CLAIMS}, r AS (SELECT slot, tool, count(DISTINCT origin) AS active FROM c GROUP BY ALL) SELECT tool, slot, active FROM r QUALIFY row_number() OVER (PARTITION BY tool ORDER BY active DESC, slot = 'R' DESC, slot) = 1
""")
def one_row_per_tool(spark: SparkSession, root: str) -> DataFrame:
    """Of a tool's rows the one that counts most."""
    c = dealt(_claims(spark, root), "origin", of=table(spark, root, "lineitem").count())
    r = c.select("slot", "tool", "origin").distinct().groupBy("slot", "tool").agg(F.count("origin").alias("active"))
    return rollup.one_per_tool(r, r.select("tool", F.lit("R").alias("slot")).distinct())
