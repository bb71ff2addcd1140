"""Queries of the general kinds: time joins and windows, rankings, frames, pivots, sets, sketches, functions of one's own, state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import timed
from loomspan.plans.registry import query
from loomspan.sources.tables import table
from loomspan.streaming import ledger as stream

_SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"


def _events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").withColumn("t", F.col("ts").cast("timestamp"))


@query("""
WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'),
j AS (SELECT c.event_id, arg_max(struct_pack(e := p.event_id, v := p.value), (p.ts, p.event_id)) AS x FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts <= c.ts GROUP BY c.event_id)
SELECT event_id, x.e AS purchase_id, round(x.v, 4) AS value FROM j
""")
def as_of_join(spark: SparkSession, root: str) -> DataFrame:
    """Each click with its user's latest purchase until then."""
    e = table(spark, root, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("purchase_id"), "value")
    return timed.as_of(clicks, buys, ["user_id"], "ts", "since", ["purchase_id", "value"]).select("event_id", "purchase_id", F.round("value", 4).alias("value"))


@query("""
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS a, CAST(o_orderdate AS DATE) - DATE '1990-01-01' + 1 + o_orderkey % 40 AS z FROM orders WHERE o_orderpriority = '1-URGENT'),
p AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS t FROM lineitem WHERE l_quantity > 49)
SELECT o_orderkey, count(*) AS n FROM s JOIN p ON t >= a AND t < z GROUP BY o_orderkey
""")
def interval_join(spark: SparkSession, root: str) -> DataFrame:
    """For urgent orders, as spans of up to 40 days, how many large lines were shipped in them."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("bigint")
    s = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", day("o_orderdate").alias("a")).withColumn("z", F.col("a") + 1 + F.col("o_orderkey") % 40)
    p = table(spark, root, "lineitem").where("l_quantity > 49").select(day("l_shipdate").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return timed.within(p, s, "t", "a", "z", 20, ["o_orderkey"]).groupBy("o_orderkey").agg(F.sum("n").alias("n"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch(min(ts)) AS start, epoch(max(ts)) AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, root: str) -> DataFrame:
    """Users' runs of events with gaps below six hours."""
    s = timed.sessions(_events(spark, root), "user_id", "t", "6 hours")
    return s.select("user_id", F.unix_micros("start").cast("double").alias("a"), F.unix_micros("stop").cast("double").alias("z"), "n").select("user_id", (F.col("a") / 1e6).alias("start"), (F.col("z") / 1e6).alias("stop"), "n")


@query(f"""
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2020-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2020-01-01') - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2020-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2020-01-01') - INTERVAL 18 HOUR]) AS s FROM events)
SELECT event_type, {_SECONDS.format('s')} AS start, count(*) AS n FROM w GROUP BY ALL
""")
def sliding_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by type in days that start every six hours."""
    return timed.sliding(_events(spark, root), ["event_type"], "t", "1 day", "6 hours").select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query(f"SELECT event_type, {_SECONDS.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by type and hour."""
    return timed.sliding(_events(spark, root), ["event_type"], "t", "1 hour", "1 hour").select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query("""
SELECT p_brand, p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER v AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, lead(p_partkey, 2) OVER v AS later, first_value(p_partkey) OVER v AS top
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), v AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)
""")
def rank_functions(spark: SparkSession, root: str) -> DataFrame:
    """Parts ranked in their brand by size, by all kinds of rank."""
    w, v = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return table(spark, root, "part").select("p_brand", "p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(v).alias("q"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("c"), F.lead("p_partkey", 2).over(v).alias("later"), F.first("p_partkey").over(v).alias("top"))


@query("""
SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) - DATE '1990-01-01' RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS recent,
 max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM orders
""")
def window_frames(spark: SparkSession, root: str) -> DataFrame:
    """Customers' orders of the last 90 days, and the greatest key around each order."""
    o = table(spark, root, "orders").withColumn("d", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")))
    days, rows = Window.partitionBy("o_custkey").orderBy("d").rangeBetween(-90, 0), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return o.select("o_custkey", "o_orderkey", F.count("*").over(days).alias("recent"), F.max("o_orderkey").over(rows).alias("near"))


@query("""
SELECT o_orderstatus, count_if(o_orderpriority = '1-URGENT') AS urgent, count_if(o_orderpriority = '2-HIGH') AS high, count_if(o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus
""")
def pivot_counts(spark: SparkSession, root: str) -> DataFrame:
    """Orders by status, with named priorities as columns."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    p = table(spark, root, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", list(names)).count()
    return p.select("o_orderstatus", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in names.items()))


@query("""
SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def cube_counts(spark: SparkSession, root: str) -> DataFrame:
    """Orders by status and priority, with all totals."""
    c = table(spark, root, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return c.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "level")


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0)
SELECT 'both' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def set_operations(spark: SparkSession, root: str) -> DataFrame:
    """Nations of customers that have suppliers in credit too, and those that have not."""
    a = table(spark, root, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, root, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").union(a.distinct().subtract(b).select(F.lit("first"), "k"))


@query("""
SELECT event_type, true AS users_near, true AS median_near, count(*) AS n FROM events GROUP BY event_type
""")
def approximate_counts(spark: SparkSession, root: str) -> DataFrame:
    """Whether sketches of distinct users and of the median value lie within 5 % and 2 ranks in 100 of the true ones."""
    e = table(spark, root, "events")
    # True counts by themselves: beside a distinct count, sketches would be kept for each user.
    users = e.where("user_id IS NOT NULL").groupBy("event_type", "user_id").agg(F.count("*").alias("c")).groupBy(F.col("event_type").alias("_of")).agg(F.count("*").alias("d"))
    g = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("a"), F.approx_percentile("value", 0.5, 1000).alias("m"), F.expr("percentile(value, array(0.48, 0.52))").alias("range"), F.count("*").alias("n"))
    g = g.join(users, F.col("event_type").eqNullSafe(F.col("_of")), "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return g.select("event_type", (F.abs(F.col("a") - F.col("d")) <= 0.05 * F.col("d")).alias("users_near"), F.col("m").between(F.col("range")[0], F.col("range")[1]).alias("median_near"), "n")


@query("""
SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS geometric FROM part GROUP BY p_brand
""")
def own_aggregate(spark: SparkSession, root: str) -> DataFrame:
    """An aggregate of one's own, the geometric mean, from sums that combine before the shuffle."""
    parts = table(spark, root, "part").groupBy("p_brand").agg(F.sum(F.log("p_retailprice")).alias("s"), F.count("p_retailprice").alias("n"))
    return parts.select("p_brand", F.round(F.exp(F.col("s") / F.col("n")), 4).alias("geometric"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, CAST(unnest(range(0, len(w))) AS INT) AS n, unnest(w) AS word FROM w
""")
def own_rows(spark: SparkSession, root: str) -> DataFrame:
    """A table function of one's own, in Arrow batches: the words of names with their places."""
    import pyarrow as pa

    def words(batches):
        for b in batches:
            lists = [(t or "").split(" ") if t else [] for t in b.column(1).to_pylist()]
            keys = [k for k, x in zip(b.column(0).to_pylist(), lists) for _ in x]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array([n for x in lists for n in range(len(x))], pa.int32()), pa.array([w for x in lists for w in x], pa.string())], names=["p_partkey", "n", "word"])

    p = table(spark, root, "part").select("p_partkey", "p_name")
    return p.mapInArrow(words, f"p_partkey {p.schema['p_partkey'].dataType.simpleString()}, n int, word string")


@query("SELECT user_id, count(*) AS events, round(sum(value), 3) AS total, false AS expired FROM events GROUP BY user_id")
def user_states(spark: SparkSession, root: str) -> DataFrame:
    """Users' running numbers as a stream keeps them, with state that expires after 30 idle days."""
    folder = f"{stream.base_folder(spark)}/states-{uuid.uuid4().hex[:12]}"
    stream.run(stream.user_states(stream.source(spark, root, "events")), folder, "update")
    return stream.latest(spark, folder, ["user_id"]).withColumn("total", F.round("total", 3))


@query("""
SELECT l_shipmode, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM (SELECT *, CASE WHEN l_tax > 0.04 THEN 'AIR' ELSE 'SHIP' END AS l_shipmode FROM lineitem) GROUP BY l_shipmode
""")
def grouped_pandas(spark: SparkSession, root: str) -> DataFrame:
    """Means by group from a pandas function over scalars of batches, added up by Spark."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def mode(tax: pd.Series) -> pd.Series:
        return tax.gt(0.04).map({True: "AIR", False: "SHIP"})

    rows = table(spark, root, "lineitem").select(mode("l_tax").alias("l_shipmode"), "l_quantity")
    return rows.groupBy("l_shipmode").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))
