"""Queries over history: periods that close, checks, absences, requests, runs, drift, manifests, orders of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import history
from loomspan.plans.registry import query
from loomspan.sources.tables import table


@query("""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS tool, o_custkey AS origin FROM orders),
k AS (SELECT 'month' AS granularity, strftime(d, '%Y-%m') AS period, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS stop, tool, origin FROM o UNION ALL SELECT 'quarter', strftime(d, '%Y') || '-Q' || quarter(d), CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH AS DATE), tool, origin FROM o
  UNION ALL SELECT 'year', strftime(d, '%Y'), CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS DATE), tool, origin FROM o),
w AS (SELECT granularity, period, count(DISTINCT origin) AS denominator FROM k WHERE stop <= DATE '1997-08-15' GROUP BY ALL), n AS (SELECT granularity, period, tool, count(DISTINCT origin) AS active FROM k WHERE stop <= DATE '1997-08-15' GROUP BY ALL)
SELECT granularity, period, tool, active, denominator, CAST(round(100.0 * active / denominator) AS BIGINT) AS score, 'closed' AS fate FROM n JOIN w USING (granularity, period) WHERE NOT (granularity = 'year' AND period IN ('1992', '1993'))
UNION ALL SELECT 'year', '1992', '1-URGENT', 7, 9, 78, 'kept'
""")
def closed_periods(spark: SparkSession, root: str) -> DataFrame:
    """Rollups of all periods that have ended; one that was complete before stays, one of an older version is made anew... and 1993
    was complete without any tool."""
    stored = spark.createDataFrame([("year", "1992", "1-URGENT", 7, 9, 78, True, 2), ("year", "1994", "1-URGENT", 1, 1, 100, True, 1), ("year", "1995", "1-URGENT", 1, 1, 100, False, 2), ("year", "1993", None, 0, 0, None, True, 2)], "granularity string, period string, tool string, active long, denominator long, score long, complete boolean, version int")
    out = history.closed(table(spark, root, "orders"), stored, "o_orderdate", "o_orderpriority", "o_custkey", F.lit("1997-08-15").cast("date"), 2)
    return out.where("tool IS NOT NULL")


@query("""
WITH RECURSIVE c AS (SELECT o_custkey AS k, o_orderkey AS o, o_shippriority2 AS items, outcome, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT *, o_orderkey % 7 AS o_shippriority2, CASE WHEN o_orderkey % 5 = 0 THEN 'verified' ELSE 'uncertain' END AS outcome FROM orders)),
f AS (SELECT k, o, items, n FROM c WHERE n = 1 UNION ALL SELECT c.k, CASE WHEN c.items >= f.items OR c.outcome = 'verified' THEN c.o ELSE f.o END, CASE WHEN c.items >= f.items OR c.outcome = 'verified' THEN c.items ELSE f.items END, c.n FROM f JOIN c ON c.k = f.k AND c.n = f.n + 1)
SELECT k AS o_custkey, arg_max(o, n) AS o_orderkey, arg_max(items, n) AS items FROM f GROUP BY k
""")
def daily_checks(spark: SparkSession, root: str) -> DataFrame:
    """The check of each customer that stands when checks replace each other in order, without a fold."""
    k = F.col("o_orderkey")
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", (k % 7).alias("items"), F.when(k % 5 == 0, "verified").otherwise("uncertain").alias("outcome"))
    return history.checks(o, ["o_custkey"], ["o_orderkey"], "items", "outcome").select("o_custkey", "o_orderkey", "items")


@query("""
WITH e AS (SELECT user_id, ts, event_type <> 'error' AS present FROM events), p AS (SELECT user_id, max(ts) AS p FROM e WHERE present GROUP BY 1),
a AS (SELECT e.user_id, min(ts) AS since, max(ts) AS until FROM e JOIN p USING (user_id) WHERE NOT present AND ts > p GROUP BY 1)
SELECT p.user_id, CASE WHEN since IS NULL THEN 'current' WHEN until - since >= INTERVAL 24 HOUR THEN 'removed' ELSE 'pending' END AS state FROM p LEFT JOIN a USING (user_id)
""")
def pending_absences(spark: SparkSession, root: str) -> DataFrame:
    """What looks at pages prove: absent for a day from look to look means removed."""
    e = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("present"))
    return history.pending(e, ["user_id"], "ts", "present").select("user_id", "state")


@query("""
WITH p AS (SELECT c_custkey AS k, c_mktsegment AS v, DATE '2024-01-01' - CAST(c_custkey % 60 AS INT) AS d FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT c_custkey AS k, c_name AS v, DATE '2024-01-01' AS d FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0)
SELECT coalesce(p.k, n.k) AS k, coalesce(n.v, p.v) AS v FROM p FULL JOIN n ON p.k = n.k WHERE coalesce(n.d, p.d) >= DATE '2024-01-01' - 30
""")
def request_states(spark: SparkSession, root: str) -> DataFrame:
    """Requests by site: complete readings replace, others keep, 30 days without any expire."""
    c = table(spark, root, "customer")
    day, k = F.lit("2024-01-01").cast("date"), F.col("c_custkey")
    prior = c.where("c_custkey % 4 <> 0").select(k.alias("k"), F.col("c_mktsegment").alias("v"), F.date_sub(day, (k % 60).cast("int")).cast("timestamp").alias("d"))
    new = c.where("c_custkey % 3 = 0").select(k.alias("k"), F.col("c_name").alias("v"), day.cast("timestamp").alias("d"), (k % 5 != 0).alias("complete"))
    return history.requests(prior, new, "k", "v", "d", day.cast("timestamp"), 30).select("k", "v")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'page' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'ok' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def durable_overlay(spark: SparkSession, root: str) -> DataFrame:
    """Rows with the fields that a durable state fills; empty ones don't count."""
    c = table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment")
    d = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("page"), F.col("c_custkey").cast("string")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "ok").otherwise("").alias("c_mktsegment"))
    return history.overlay(c, d, "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR user_id = 4")
def candidate_observations(spark: SparkSession, root: str) -> DataFrame:
    """Events of committed runs and of the current one."""
    runs = table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "committed").otherwise("validated").alias("status"))
    runs = runs.unionByName(spark.createDataFrame([(4, "running")], "user_id long, status string").select(F.col("user_id").cast(runs.schema["user_id"].dataType).alias("user_id"), "status"))
    return history.candidates(table(spark, root, "events"), runs, "user_id", "status", 4).select("event_id", "user_id")


@query("""
WITH n AS (SELECT user_id, max(event_id) AS e FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS e FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1)
SELECT user_id, e, false AS carried FROM n UNION ALL SELECT user_id, e, true FROM b WHERE user_id NOT IN (SELECT user_id FROM n)
""")
def carried_signals(spark: SparkSession, root: str) -> DataFrame:
    """Users' latest signals; those that were quiet keep what they had."""
    e = table(spark, root, "events")
    late = F.expr("ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    last = lambda cond: e.where(cond).groupBy("user_id").agg(F.max("event_id").alias("e"))
    return history.carried(last(late), last(~late), "user_id")


@query("""
WITH e AS (SELECT event_id % 100000 // 2 AS id, CASE WHEN event_id % 50 <> 0 THEN ts END AS t FROM events), g AS (SELECT id, count(*) AS n FROM e GROUP BY id)
SELECT 'repeated_id' AS code, CAST((SELECT count(*) FROM g WHERE n > 1) AS BIGINT) AS violations UNION ALL SELECT 'no_time', (SELECT count(*) FROM e WHERE t IS NULL) UNION ALL SELECT 'future_time', (SELECT count(*) FROM e WHERE t > TIMESTAMP '2024-01-20')
""")
def history_errors(spark: SparkSession, root: str) -> DataFrame:
    """Ids of events that aren't unique, times that lack or lie ahead."""
    e = table(spark, root, "events").select(F.expr("event_id % 100000 div 2").alias("id"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("t"))
    return history.history_errors(e, "id", "t", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@query("""
WITH m AS (SELECT o_custkey AS k, count(*) AS n, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT k, array_to_string(list_filter([CASE WHEN f >= 3 AND o = 0 THEN 'verified_uses_collapsed_to_zero' END, CASE WHEN n % 13 >= 10 AND n % 3 = 0 AND o > 0 THEN 'extraction_items_collapsed_to_zero' END, CASE WHEN f > 0 AND f / n > 0.35 THEN 'removal_spike' END,
 CASE WHEN n % 13 >= 10 AND o >= f AND n % 3 * 2 < n % 13 THEN 'extraction_drop' END, CASE WHEN f >= 5 AND o >= 10 AND o > f * 2 THEN 'unresolved_spike' END, CASE WHEN o > 0 AND o / n > 0.35 THEN 'identity_shift' END,
 CASE WHEN n >= 20 AND o / n - f / n > 0.25 THEN 'abstention_spike' END, CASE WHEN n >= 20 AND abs(o - f) / n > 0.25 THEN 'category_distribution_shift' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m
""")
def drift_reasons(spark: SparkSession, root: str) -> DataFrame:
    """All eight reasons to hold a release back, over customers' counts as metrics."""
    m = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    n, f, o = F.col("n"), F.col("f"), F.col("o")
    side = lambda v, i, u, a: F.struct(v.alias("verified"), n.alias("eligible"), i.alias("items"), u.alias("unresolved"), n.alias("ranked"), n.alias("decisions"), a.alias("abstentions"))
    rows = m.select("k", side(o, n % 3 - F.when(n % 3 == 0, 0).otherwise(0), o, o).alias("now"), side(f, n % 13, f, f).alias("before"), f.alias("events_removed"), o.alias("corrections"), n.alias("edges"), (F.abs(o - f) / n).alias("shift"))
    return history.drift(rows).select("k", F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT 'customer' AS dataset, count(*) AS n, false AS publish FROM customer UNION ALL SELECT 'nation', count(*), true FROM nation UNION ALL SELECT 'region', count(*), true FROM region
""")
def data_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Digests of datasets against those before: one is equal in another order, one changed, one is new."""
    c, n, r = (table(spark, root, t) for t in ("customer", "nation", "region"))
    now = history.manifest({"customer": (c, ["c_custkey", "c_name"]), "nation": (n, ["n_nationkey", "n_name"]), "region": (r, ["r_regionkey"])})
    before = history.manifest({"customer": (c.repartition(3, "c_name"), ["c_custkey", "c_name"]), "nation": (n.where("n_nationkey > 0"), ["n_nationkey", "n_name"])})
    return now.join(history.to_publish(now, before), "dataset").select("dataset", "n", "publish")


@query("SELECT p_partkey, 3 AS version, CASE WHEN p_size % 3 = 0 THEN p_name || '!' ELSE upper(p_name) END AS label FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT p_partkey, 3, p_name FROM part WHERE p_size % 3 = 2")
def migrated_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of three versions brought to the last: directly, by two steps, not at all."""
    p = table(spark, root, "part").select("p_partkey", (F.col("p_size") % 3 + 1).cast("int").alias("version"), F.col("p_name").alias("label"))
    steps = {(1, 2): lambda d: d.withColumn("label", F.lit("never")), (1, 3): lambda d: d.withColumn("label", F.concat("label", F.lit("!"))), (2, 3): lambda d: d.withColumn("label", F.upper("label"))}
    return history.migrated(p, "version", steps, 3)


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END DESC NULLS LAST, o_custkey DESC, o_orderkey DESC) AS place FROM orders ORDER BY place LIMIT 100
""")
def recent_works(spark: SparkSession, root: str) -> DataFrame:
    """The hundred works that a listing shows first: published ones, the latest first, then by when they were seen, then by address."""
    o = table(spark, root, "orders").withColumn("published", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
    top = o.orderBy(F.desc_nulls_last("published"), F.desc("o_custkey"), F.desc("o_orderkey")).limit(100)
    w = Window.orderBy(F.desc_nulls_last("published"), F.desc("o_custkey"), F.desc("o_orderkey"))  # a hundred rows
    return top.select("o_orderkey", F.row_number().over(w).alias("place"))


@query("""
WITH s AS (SELECT p_type AS slot, count(DISTINCT p_brand) AS denominator, count(*) AS products FROM part GROUP BY 1) SELECT slot, denominator, products, row_number() OVER (ORDER BY denominator DESC, products DESC, slot) AS place FROM s
""")
def slots_by_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Slots in the order of their coverage: distinct publishers, products, name."""
    s = table(spark, root, "part").groupBy(F.col("p_type").alias("slot")).agg(F.countDistinct("p_brand").alias("denominator"), F.count("*").alias("products"))
    w = Window.orderBy(F.desc("denominator"), F.desc("products"), F.col("slot"))  # over slots only
    return s.withColumn("place", F.row_number().over(w))


@query("""
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'P')
(SELECT 'upcoming' AS list, o_orderkey, CAST(d AS VARCHAR) AS d FROM s WHERE d >= DATE '1995-06-17' ORDER BY s.d, o_orderkey LIMIT 50) UNION ALL (SELECT 'past', o_orderkey, CAST(d AS VARCHAR) FROM s WHERE d < DATE '1995-06-17' ORDER BY s.d DESC, o_orderkey LIMIT 50)
""")
def event_listings(spark: SparkSession, root: str) -> DataFrame:
    """The next fifty events, the soonest first, and the last fifty, the latest first; cancelled ones are left out."""
    s = table(spark, root, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    day = F.lit("1995-06-17").cast("date")
    up = s.where(F.col("d") >= day).orderBy("d", "o_orderkey").limit(50).select(F.lit("upcoming").alias("list"), "o_orderkey", F.col("d").cast("string").alias("d"))
    past = s.where(F.col("d") < day).orderBy(F.desc("d"), "o_orderkey").limit(50).select(F.lit("past").alias("list"), "o_orderkey", F.col("d").cast("string").alias("d"))
    return up.unionByName(past)
