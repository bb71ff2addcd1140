"""Queries over hosts, over sites and vectors that are near each other, and over records that are damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.operators import hosts, prototypes, similar
from loomspan.plans.registry import query
from loomspan.sources import quarantine, tree
from loomspan.sources.tables import spread, table
from loomspan.streaming.ledger import new_folder


@query(r"""
WITH o AS (SELECT page_id, url, html, regexp_extract(url, '^(https?://[^/]+)', 1) AS o FROM pages), h AS (SELECT regexp_extract(o, '//(.*)', 1) AS host, count(*) AS n FROM o GROUP BY 1),
r AS (SELECT host AS pattern, true AS exact, 'own ' || host AS network FROM h WHERE n >= 5 UNION ALL SELECT DISTINCT regexp_extract(host, '^[^.]+\.(.*)', 1), false, 'below ' || regexp_extract(host, '^[^.]+\.(.*)', 1) FROM h WHERE n < 5),
links AS (SELECT url AS link FROM pages UNION ALL SELECT o || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) FROM o),
l AS (SELECT link, regexp_extract(link, '^https?://([^/]+)', 1) AS host, len(list_filter(string_split(regexp_replace(regexp_extract(link, '^https?://[^/]+([^?#]*)', 1), '', ''), '/'), lambda s: s <> '')) AS k, lower(regexp_extract(link, '^https?://[^/]+/([^/?#]*)', 1)) AS first FROM links),
c AS (SELECT l.*, coalesce((SELECT arg_max(r.network, (r.exact, length(r.pattern))) FROM r WHERE CASE WHEN r.exact THEN l.host = r.pattern ELSE l.host LIKE '%.' || r.pattern END), 'web') AS network FROM (SELECT DISTINCT host FROM l) l),
n AS (SELECT l.k, l.first, c.network FROM l JOIN c USING (host))
SELECT network, count(*) AS links, count(*) FILTER (WHERE network LIKE 'own %' AND (k = 1 AND first NOT IN ('the', 'of', 'and') OR k >= 2 AND first = 'en')) AS profiles FROM n GROUP BY network
""")
def link_networks(spark: SparkSession, root: str) -> DataFrame:
    """All pages and their links by network: hosts with five pages are networks of their own, others lie below the host after their first
    label. Which of a network's addresses look like profiles."""
    pages = table(spark, root, "pages")  # parsed for their links only
    links = pages.select(F.col("url").alias("link")).union(tree.trees(pages, keep=("url",)).select(F.explode("tree.links").alias("x"), "url").select(urls.same_resource(F.col("url"), F.col("x.href"))))
    per = pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    below = F.regexp_extract("host", r"^[^.]+\.(.*)", 1)
    own = per.where("n >= 5").select("host", F.lit(True).alias("exact"), F.concat(F.lit("own "), "host").alias("network"))
    rules = hosts.rules_of(own.union(per.where("n < 5").select(below, F.lit(False), F.concat(F.lit("below "), below)).distinct()), "host", "exact", "network")
    found = hosts.classified(links.withColumn("host", urls.host(F.col("link"))), "host", rules)
    refused = F.array(*map(F.lit, ("the", "of", "and")))
    none = F.array().cast("array<string>")
    paths = rules.where("exact").select("network", F.explode(F.array(F.struct(F.lit(1).alias("least"), F.lit(1).alias("most"), none.alias("first"), refused.alias("refused")), F.struct(F.lit(2).alias("least"), F.lit(99).alias("most"), F.array(F.lit("en")).alias("first"), none.alias("refused")))).alias("x")).select("network", "x.*")
    return hosts.profiles(found, "link", paths).groupBy("network").agg(F.count("*").alias("links"), F.count_if("profile").alias("profiles"))


@query("""
WITH s AS (SELECT DISTINCT user_id, strftime(ts, '%d') || event_type AS topic FROM events), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.user_id AS u, b.user_id AS other, count(*) AS shared FROM s a JOIN s b ON a.topic = b.topic AND a.user_id <> b.user_id GROUP BY ALL),
j AS (SELECT u AS user_id, other, shared, shared / (x.n + y.n - shared) AS similarity FROM p JOIN n x ON x.user_id = u JOIN n y ON y.user_id = other)
SELECT user_id, other, shared, similarity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, other) AS INT) AS rank FROM j WHERE similarity >= 0.25 QUALIFY rank <= 3
""")
def nearest_users(spark: SparkSession, root: str) -> DataFrame:
    """For each user the three others who are most alike in what they did on which day, from a quarter in common on."""
    e = table(spark, root, "events").select("user_id", F.concat(F.date_format("ts", "dd"), "event_type").alias("topic"))
    return similar.nearest(e, "user_id", "topic", 0.25, 3)


@query("""
WITH c AS (SELECT *, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) AS INT) AS h FROM orders),
f AS (SELECT unnest(['json', 'csv']) AS format), x AS (SELECT *, CASE h WHEN 0 THEN 'not a record' WHEN 1 THEN 'wrong type: o_totalprice' WHEN 2 THEN 'missing: o_custkey' WHEN 3 THEN CASE format WHEN 'csv' THEN 'wrong columns' END END AS reason FROM c, f)
SELECT format, coalesce(reason, 'good') AS fate, count(*) AS records, CAST(sum(CASE WHEN reason IS NULL THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM x GROUP BY ALL
""")
def damaged_records(spark: SparkSession, root: str) -> DataFrame:
    """Orders as JSON and CSV lines of which a sixteenth each is cut short, has a word for a number, lacks its customer, or (CSV) has a
    field too many: what a tolerant read takes and what it sets aside. None is lost."""
    at, schema, keys = new_folder(spark, "damaged"), "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", ["o_orderkey", "o_custkey"]
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1), 16, 10).cast("int")
    o = spread(table(spark, root, "orders")).select("o_orderkey", F.when(h != 2, F.col("o_custkey")).alias("o_custkey"), F.concat("o_orderpriority", F.lit(', "urgent"')).alias("o_orderpriority"), F.when(h == 1, "much").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"), h.alias("h"))
    fields = [c for c in o.columns if c != "h"]
    cut = lambda line: F.when(F.col("h") == 0, F.expr("left(line, length(line) - 12)")).otherwise(line)
    quoted = F.concat(F.lit('"'), F.replace("o_orderpriority", F.lit('"'), F.lit('""')), F.lit('"'))
    o.withColumn("line", F.to_json(F.struct(*fields))).select(cut(F.col("line")).alias("value")).write.text(f"{at}/json")
    wide = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.coalesce(F.col("o_custkey").cast("string"), F.lit("")), "o_totalprice", quoted)
    o.withColumn("line", F.when(F.col("h") == 3, F.concat(wide, F.lit(",more"))).otherwise(wide)).select(cut(F.col("line")).alias("value")).write.text(f"{at}/csv")
    out = None
    for kind, found in (("json", quarantine.json_lines(spark, f"{at}/json", schema, keys)), ("csv", quarantine.csv_lines(spark, f"{at}/csv", "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", keys))):
        good, bad = quarantine.split(found, f"{at}/bad-{kind}")
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        own = good.groupBy(F.lit(kind).alias("format"), F.lit("good").alias("fate")).agg(F.count("*").alias("records"), total.alias("total"))
        own = own.union(bad.groupBy(F.lit(kind), F.col("reason")).agg(F.count("*"), F.lit(None).cast("double")))
        out = own if out is None else out.union(own)
    return out


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), p AS (SELECT label, d, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY 1), w AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS w FROM x GROUP BY 1),
s AS (SELECT x.vec_id, p.label, round(sum(CAST(x.v AS DOUBLE) * p.m) / (any_value(n.n) * any_value(w.w)), 9) AS s FROM x JOIN p USING (d) JOIN n ON n.label = p.label JOIN w ON w.vec_id = x.vec_id GROUP BY x.vec_id, p.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s), t AS (SELECT vec_id, max(CASE WHEN k = 1 THEN s END) AS a, max(CASE WHEN k = 2 THEN s END) AS b, max(CASE WHEN k = 1 THEN label END) AS label FROM r GROUP BY 1)
SELECT vec_id, CASE WHEN a >= 0.3 AND (b IS NULL OR a - b >= 0.05) THEN label END AS slot FROM t
""")
def prototype_slots(spark: SparkSession, root: str) -> DataFrame:
    """The label whose prototype a vector is clearly most like, over all dimensions; null where none is."""
    e = table(spark, root, "embeddings")
    return prototypes.proposed(e, "vec_id", "embedding", prototypes.fitted(e, "embedding", "label"), "label", 0.3, 0.05)
