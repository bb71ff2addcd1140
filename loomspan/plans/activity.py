"""Queries over activity: rollups, rankings, listings, the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.operators import ledger, ranking, rollup, summaries
from loomspan.plans.registry import query
from loomspan.sources.tables import table
from loomspan.streaming.ledger import daily_active


@query("""
WITH m AS (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY ALL)
SELECT event_type, count(*) AS origins, round(sum(v), 4) AS units FROM m GROUP BY event_type
""")
def adoption_units(spark: SparkSession, root: str) -> DataFrame:
    """Units of each type: a user counts with its largest value, once."""
    per = table(spark, root, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    return per.groupBy("event_type").agg(F.count("*").alias("origins"), F.round(F.sum("v"), 4).alias("units"))


@query("""
WITH k AS (SELECT DISTINCT unnest([{'g': 'month', 'p': strftime(o_orderdate, '%Y-%m')}, {'g': 'quarter', 'p': strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)},
  {'g': 'year', 'p': strftime(o_orderdate, '%Y')}, {'g': 'all-time', 'p': 'all'}]) AS x, o_orderpriority AS tool, o_custkey AS origin FROM orders),
r AS (SELECT x.g AS granularity, x.p AS period, tool, origin FROM k),
d AS (SELECT granularity, period, count(DISTINCT origin) AS denominator FROM r GROUP BY ALL),
n AS (SELECT granularity, period, tool, count(*) AS active FROM r GROUP BY ALL)
SELECT granularity, period, tool, active, denominator, CAST(round(100.0 * active / denominator) AS BIGINT) AS score FROM n JOIN d USING (granularity, period)
""")
def period_rollup_all(spark: SparkSession, root: str) -> DataFrame:
    """Customers by order priority for every month, quarter, year and all time."""
    return rollup.rollup(table(spark, root, "orders"), "o_orderdate", "o_orderpriority", "o_custkey")


@query("""
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS tool, count(DISTINCT o_custkey) AS active FROM orders WHERE month(o_orderdate) <> 6 GROUP BY ALL),
d AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT o_custkey) AS denominator FROM orders WHERE month(o_orderdate) <> 6 GROUP BY ALL), x AS (SELECT * FROM r JOIN d USING (period))
SELECT x.period, x.tool, x.active, x.denominator, y.active AS previous, x.active - y.active AS change, CAST(round(100.0 * x.active / x.denominator) - round(100.0 * y.active / y.denominator) AS BIGINT) AS points
FROM x LEFT JOIN x y ON y.tool = x.tool AND y.period = strftime(CAST(x.period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
""")
def period_momentum(spark: SparkSession, root: str) -> DataFrame:
    """Customers of each priority by month, with the calendar month before; June is left out, so July has none before it."""
    o = table(spark, root, "orders").where(F.month("o_orderdate") != 6).select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("tool"), "o_custkey")
    whole = o.groupBy("period").agg(F.countDistinct("o_custkey").alias("denominator"))
    r = o.groupBy("period", "tool").agg(F.countDistinct("o_custkey").alias("active")).join(whole, "period")
    return rollup.momentum(r, ["tool"], "period", "active", "denominator", rollup.previous_month(F.col("period")))


@query("""
WITH y AS (SELECT year(o_orderdate) AS y, o_orderpriority AS tool, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL),
a AS (SELECT tool, n FROM y WHERE y = 1996), b AS (SELECT tool, n FROM y WHERE y = 1995)
SELECT coalesce(a.tool, b.tool) AS tool, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b ON a.tool = b.tool
""")
def adoption_change(spark: SparkSession, root: str) -> DataFrame:
    """Two years' customers by priority, side by side."""
    y = table(spark, root, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("tool")).agg(F.countDistinct("o_custkey").alias("n"))
    return rollup.change(y.where("y = 1996"), y.where("y = 1995"), ["tool"], "n")


@query("""
WITH r AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL),
l AS (SELECT *, lag(n) OVER (PARTITION BY tool ORDER BY period) AS p FROM r)
SELECT tool, count(*) AS periods, coalesce(bool_or(n <> p), false) AS ready FROM l GROUP BY tool
""")
def trend_ready(spark: SparkSession, root: str) -> DataFrame:
    """Whether a priority's monthly count ever changed."""
    r = table(spark, root, "orders").groupBy(F.col("o_orderpriority").alias("tool"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.countDistinct("o_custkey").alias("n"))
    r = r.withColumn("p", F.lag("n").over(Window.partitionBy("tool").orderBy("period")))
    return r.groupBy("tool").agg(F.count("*").alias("periods"), F.coalesce(F.bool_or(F.col("n") != F.col("p")), F.lit(False)).alias("ready"))


@query("""
SELECT event_type, count(DISTINCT user_id) AS ever FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type
""")
def period_ever(spark: SparkSession, root: str) -> DataFrame:
    """Users of each type at any time of a half-open week."""
    e = table(spark, root, "events").where("ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("ever"))


@query("""
WITH e AS (SELECT *, CAST(event_type = 'error' AS INT) AS gone FROM events WHERE ts < TIMESTAMP '2024-01-25'),
l AS (SELECT *, sum(gone) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e),
c AS (SELECT *, last_value(CASE WHEN gone = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM l)
SELECT user_id, event_id, event_type, round(carried, 4) AS carried FROM c WHERE n = 1 AND gone = 0
""")
def replay_state(spark: SparkSession, root: str) -> DataFrame:
    """Each user's state before 25 January: the last event, unless an error ended it."""
    s = ledger.replay(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "value", F.expr("ts < TIMESTAMP_NTZ '2024-01-25 00:00:00'"))
    return s.select("user_id", "event_id", "event_type", F.round("carried", 4).alias("carried"))


@query("""
WITH s AS (SELECT ts < TIMESTAMP '2024-01-11' AS early, ts >= TIMESTAMP '2024-01-20' AS late, user_id, event_type FROM events),
b AS (SELECT user_id, max(event_type) AS v FROM s WHERE early GROUP BY 1), a AS (SELECT user_id, max(event_type) AS v FROM s WHERE late AND event_type <> 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, b.v AS was, a.v AS is,
  CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' ELSE 'changed' END AS event
FROM b FULL JOIN a ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.v <> b.v
""")
def reconcile_diff(spark: SparkSession, root: str) -> DataFrame:
    """Change events between two snapshots of users' types."""
    e = table(spark, root, "events")
    before = e.where("ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'").groupBy("user_id").agg(F.max("event_type").alias("v"))
    after = e.where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' AND event_type <> 'view'").groupBy("user_id").agg(F.max("event_type").alias("v"))
    return ledger.difference(before, after, ["user_id"], "v")


@query("SELECT event_id, user_id, event_type FROM events")
def append_idempotent(spark: SparkSession, root: str) -> DataFrame:
    """A log that got its own second half twice more is the same log."""
    e = table(spark, root, "events").select("event_id", "user_id", "event_type")
    log = e.where("event_id % 2 = 0")
    return ledger.append(ledger.append(log, e, "event_id"), e.union(e), "event_id")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def compact_unchanged(spark: SparkSession, root: str) -> DataFrame:
    """The latest observation of each (user, type); older ones are dropped."""
    e = table(spark, root, "events")
    return ranking.first_per(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("""
WITH g AS (SELECT user_id, bool_and(value > 1) AS all_complete, bool_and(event_type <> 'error') AS all_succeeded, count(*) AS observations FROM events GROUP BY 1)
SELECT *, CASE WHEN NOT all_succeeded THEN 'failed' WHEN NOT all_complete THEN 'incomplete' ELSE 'verified' END AS absence FROM g
""")
def absence_policy(spark: SparkSession, root: str) -> DataFrame:
    """Whether a user's observations prove an absence."""
    return ledger.absences(table(spark, root, "events"), "user_id", F.col("value") > 1, F.col("event_type") != "error")


@query("""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2
""")
def activity_fair_cap(spark: SparkSession, root: str) -> DataFrame:
    """Two documents of each source, the longest first."""
    return ranking.capped(table(spark, root, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2).select("doc_id", "source")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1
""")
def latest_per_origin(spark: SparkSession, root: str) -> DataFrame:
    """Each user's latest event."""
    return ranking.first_per(table(spark, root, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""
SELECT doc_id, source, n AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) ORDER BY n, source LIMIT 50
""")
def round_robin(spark: SparkSession, root: str) -> DataFrame:
    """Fifty documents, one of each source in turn."""
    return ranking.round_robin(table(spark, root, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 50).select("doc_id", "source", F.col("turn"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS bare,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
k AS (SELECT page_id, CASE WHEN t <> '' THEN host || chr(31) || t END AS a, host || chr(31) || bare AS b FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY page_id) AS na, row_number() OVER (PARTITION BY b ORDER BY page_id) AS nb FROM k)
SELECT page_id FROM r WHERE (a IS NULL OR na = 1) AND nb = 1
""")
def dedupe_crosspost(spark: SparkSession, root: str) -> DataFrame:
    """Pages that come first on their host for their whole title, as titles are compared, and for their address without query and fragment."""
    p = table(spark, root, "pages")
    host, title = urls.host(F.col("url")), tx.title_key(tx.decoded(F.regexp_extract("html", "<title>([^<]*)", 1)))
    a = F.when(title != "", F.concat_ws("\x1f", host, title))
    b = F.concat_ws("\x1f", host, F.regexp_replace("url", r"[?#].*$", ""))
    return ranking.winners(p.select("page_id", a.alias("a"), b.alias("b")), ["a", "b"], [F.col("page_id")]).select("page_id")


@query("""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM f)
SELECT p_partkey, p_type, CAST(CASE WHEN k <= 3 THEN 0 ELSE 1 END AS INT) AS refill FROM k ORDER BY refill, p_type, k LIMIT 40
""")
def showcase_quota(spark: SparkSession, root: str) -> DataFrame:
    """Forty parts: two of each (type, brand), three of each type first, then refill."""
    return ranking.quota_then_refill(table(spark, root, "part"), "p_type", "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 2, 3, 40).select("p_partkey", "p_type", "refill")


@query("""
WITH s AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT p_brand, i AS place, n AS brands FROM r WHERE i = (DATE '2024-01-31' - DATE '1970-01-01') % n
""")
def featured_rotation(spark: SparkSession, root: str) -> DataFrame:
    """The brand of the day: the day's number modulo the number of brands."""
    w = Window.orderBy("p_brand")  # over distinct brands only
    s = table(spark, root, "part").select("p_brand").distinct()
    r = s.select("p_brand", (F.row_number().over(w) - 1).cast("bigint").alias("place"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("brands"))
    return r.where(F.col("place") == F.unix_date(F.lit("2024-01-31").cast("date")) % F.col("brands"))


@query("""
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS stop FROM orders),
t AS (SELECT CASE WHEN start > DATE '1995-06-17' THEN 'upcoming' WHEN start = DATE '1995-06-17' OR stop >= DATE '1995-06-17' THEN 'ongoing' ELSE 'past' END AS state, start FROM s)
SELECT state, count(*) AS n, CAST(min(start) AS VARCHAR) AS first, CAST(max(start) AS VARCHAR) AS last FROM t GROUP BY state
""")
def event_schedule(spark: SparkSession, root: str) -> DataFrame:
    """Orders as events of four days: upcoming, ongoing or past on a fixed day."""
    day = F.lit("1995-06-17").cast("date")
    s = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("start"))
    state = F.when(F.col("start") > day, "upcoming").when((F.col("start") == day) | (F.date_add("start", 3) >= day), "ongoing").otherwise("past")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("start").cast("string").alias("first"), F.max("start").cast("string").alias("last"))


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type
""")
def props_json(spark: SparkSession, root: str) -> DataFrame:
    """A number out of the events' JSON, summed by type."""
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("""
WITH k AS (SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'vip:' || c_custkey WHEN c_nationkey < 5 THEN 'nation:' || c_nationkey ELSE 'segment:' || c_mktsegment END AS identity FROM customer)
SELECT identity, count(*) AS members, min(c_custkey) AS first FROM k GROUP BY identity
""")
def identity_ladder(spark: SparkSession, root: str) -> DataFrame:
    """Customers grouped by the strongest identity that they have."""
    c = table(spark, root, "customer")
    k = F.coalesce(F.when(F.col("c_acctbal") >= 9000, F.concat(F.lit("vip:"), "c_custkey")), F.when(F.col("c_nationkey") < 5, F.concat(F.lit("nation:"), "c_nationkey")), F.concat(F.lit("segment:"), "c_mktsegment"))
    return c.groupBy(k.alias("identity")).agg(F.count("*").alias("members"), F.min("c_custkey").alias("first"))


@query("""
WITH u AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM u
""")
def share_of_total(spark: SparkSession, root: str) -> DataFrame:
    """Each type's share of all (user, type) pairs."""
    u = table(spark, root, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return u.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority AS name, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM v) WHERE r = 1
""")
def name_vote(spark: SparkSession, root: str) -> DataFrame:
    """The priority that each customer uses most."""
    v = table(spark, root, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return ranking.first_per(v, ["o_custkey"], [F.desc("n"), F.col("o_orderpriority")]).select("o_custkey", F.col("o_orderpriority").alias("name"), "n")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY ALL")
def streaming_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Events of each type by day, from a stream of files with repeated events dropped within a watermark."""
    return daily_active(spark, root)


def _claims(spark: SparkSession, root: str) -> DataFrame:
    """Events as claims of a tool (their type) for a use (a quarter of k), by weeks of their month; errors are claims of nothing."""
    e = table(spark, root, "events")
    tool = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select(F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-w"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")).alias("period"), "user_id", tool.alias("tool"), F.floor(F.get_json_object("props", "$.k").cast("int") / 25).alias("use"))


_CLAIMS = """c AS (SELECT strftime(ts, '%Y-%m') || '-w' || ((day(ts) - 1) // 7) AS period, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS tool, CAST(props->>'$.k' AS INT) // 25 AS use FROM events),
n AS (SELECT count(DISTINCT user_id) AS eligible FROM events), w AS (SELECT period, count(DISTINCT user_id) AS verified FROM c GROUP BY 1),
t AS (SELECT period, tool, count(DISTINCT user_id) AS n FROM c WHERE tool IS NOT NULL GROUP BY ALL), tt AS (SELECT period, count(*) AS tools, string_agg(tool || ':' || n, ',' ORDER BY n DESC, tool) AS top_tools FROM t GROUP BY 1),
u AS (SELECT period, tool, use, count(DISTINCT user_id) AS n FROM c WHERE tool IS NOT NULL AND use IS NOT NULL GROUP BY ALL), uu AS (SELECT period, use, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL), us AS (SELECT period, string_agg(use || ':' || n, ',' ORDER BY n DESC, use) AS uses FROM uu GROUP BY 1)"""


@query(f"""
WITH {_CLAIMS}
SELECT period, eligible, verified, coalesce(tools, 0) AS tools, verified < 5 OR verified < 0.3 * eligible OR eligible = 0 AS early, coalesce(top_tools, '') AS top_tools, coalesce(uses, '') AS uses FROM w CROSS JOIN n LEFT JOIN tt USING (period) LEFT JOIN us USING (period)
""")
def period_summaries(spark: SparkSession, root: str) -> DataFrame:
    """What each week's events say of the use of tools, for the public."""
    c = _claims(spark, root)
    return summaries.summaries(c, "period", "user_id", "tool", "use", c.agg(F.countDistinct("user_id")).first()[0])


@query(f"""
WITH {_CLAIMS}
SELECT string_agg(period, ',' ORDER BY period DESC) AS periods, arg_max(verified < 5 OR verified < 0.3 * eligible OR eligible = 0, period) AS early, CAST(sum(verified) AS BIGINT) AS claims FROM w, n
""")
def summary_index(spark: SparkSession, root: str) -> DataFrame:
    """The index over all weeks' summaries."""
    return summaries.index(period_summaries(spark, root), "snapshot").drop("snapshot")


@query("""
WITH s AS (SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value >= 50) THEN 'verified' WHEN bool_or(event_type = 'purchase') THEN 'uncertain' WHEN bool_or(event_type = 'error') THEN 'blocked' ELSE 'unreachable' END AS state FROM events GROUP BY 1),
b AS (SELECT DISTINCT user_id || ':' || event_type AS k FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT DISTINCT user_id || ':' || event_type AS k FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT count(*) AS eligible, count(*) FILTER (WHERE state = 'verified') AS verified, count(*) FILTER (WHERE state = 'uncertain') AS uncertain, count(*) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state = 'unreachable') AS unreachable,
 (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS added, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS removed FROM s
""")
def run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The counts of a run over users by what they did, and which habits came and went between the halves of the month."""
    e = table(spark, root, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k"))
    bought, failed = F.col("event_type") == "purchase", F.col("event_type") == "error"
    state = F.when(F.bool_or(bought & (F.col("value") >= 50)), "verified").when(F.bool_or(bought), "uncertain").when(F.bool_or(failed), "blocked").otherwise("unreachable")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return summaries.metrics(e.groupBy("user_id").agg(state.alias("state")), "state", e.where(~late), e.where(late), "k")
