"""Queries over what runs publish, and over periods that are computed anew where they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import projections, reconcile
from loomspan.plans.registry import query
from loomspan.sources.generations import Generations
from loomspan.sources.tables import table
from loomspan.streaming.ledger import new_folder

_AMOUNT = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"


@query("""
WITH g AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1)
SELECT 'pinned' AS reader, * FROM g WHERE event_type IN ('view', 'click') UNION ALL SELECT 'published', * FROM g WHERE event_type IN ('view', 'click', 'purchase')
UNION ALL SELECT 'candidate', * FROM g WHERE event_type IN ('view', 'click', 'purchase', 'signup')
""")
def generation_reads(spark: SparkSession, root: str) -> DataFrame:
    """Events gathered by five runs, one for each type. Three are committed (the third after a reader has pinned), one stays validated,
    one is aborted: what each reader sees."""
    events, gens = table(spark, root, "events"), Generations(spark, new_folder(spark, "generations"))
    for kind in ("view", "click", "signup", "error", "purchase"):
        gens.start(kind, base="1")
        gens.write(kind, "events", events.where(F.col("event_type") == kind).select("event_id", "event_type", "value"))
        gens.validate(kind)
        if kind in ("view", "click"):
            gens.commit(kind, "1")
    gens.abort("error")
    pinned = gens.pin()
    gens.commit("purchase", "2")
    schema, out = "event_id long, event_type string, value double", None
    for reader, rows in (("pinned", gens.published("events", schema, pinned)), ("published", gens.published("events", schema)), ("candidate", gens.candidate("events", schema, "signup"))):
        own = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.expr(_AMOUNT)).select(F.lit(reader).alias("reader"), "event_type", "n", "total")
        out = own if out is None else out.union(own)
    return out


_VIEWS = {"by_type": (["event_type"], None), "by_day": (["day"], None), "by_user": (["user_id"], None), "by_day_type": (["day", "event_type"], None), "purchases": (["day", "event_type"], "event_type = 'purchase'")}


@query("""
WITH p AS (SELECT 1 AS publication, * FROM events WHERE ts < TIMESTAMP '2024-01-16' UNION ALL SELECT 2, * FROM events WHERE ts < TIMESTAMP '2024-01-16' OR event_type <> 'purchase'
           UNION ALL SELECT 3, * FROM events WHERE ts < TIMESTAMP '2024-01-16' OR event_type <> 'purchase'),
e AS (SELECT publication, strftime(ts, '%Y-%m-%d') AS day, event_type, user_id, CAST(value AS DECIMAL(18,2)) AS v FROM p),
g AS (SELECT publication, 'by_type' AS name, event_type AS k, count(*) AS n, sum(v) AS total FROM e GROUP BY ALL UNION ALL SELECT publication, 'by_day', day, count(*), sum(v) FROM e GROUP BY ALL
      UNION ALL SELECT publication, 'by_user', CAST(user_id AS VARCHAR), count(*), sum(v) FROM e GROUP BY ALL UNION ALL SELECT publication, 'by_day_type', day || event_type, count(*), sum(v) FROM e GROUP BY ALL
      UNION ALL SELECT publication, 'purchases', day || event_type, count(*), sum(v) FROM e WHERE event_type = 'purchase' GROUP BY ALL),
d AS (SELECT publication, name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, md5(string_agg(k || ':' || n || ':' || total, ',' ORDER BY k)) AS digest FROM g GROUP BY ALL)
SELECT publication, name, groups, n, total, max(publication) FILTER (WHERE changed) OVER (PARTITION BY name ORDER BY publication) AS files_of
FROM (SELECT *, lag(digest) OVER (PARTITION BY name ORDER BY publication) IS DISTINCT FROM digest AS changed FROM d)
""")
def published_views(spark: SparkSession, root: str) -> DataFrame:
    """Five views of events, published three times, each time from one pass: their sums as published, and the publication whose files
    hold them. What didn't change isn't written again; each publication stays readable."""
    gens = Generations(spark, new_folder(spark, "views"))
    events = table(spark, root, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_type", "user_id", "value")
    early = F.col("ts") < F.lit("2024-01-16").cast(events.schema["ts"].dataType)
    out = None
    for n, rows in enumerate((events.where(early), events.where(early | (F.col("event_type") != "purchase")), events.where(early | (F.col("event_type") != "purchase"))), 1):
        gens.start(f"r{n}")
        gens.write_views(f"r{n}", projections.projections(rows, _VIEWS, [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")]))
        gens.validate(f"r{n}")
        gens.commit(f"r{n}", str(n))
    for n in (1, 2, 3):
        of = gens.views(n)
        for v in _VIEWS:
            own = gens.view(v, n).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
            own = own.select(F.lit(n).alias("publication"), F.lit(v).alias("name"), "*", F.lit(int(of[v]["run"][1:])).alias("files_of"))
            out = own if out is None else out.union(own)
    return out


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS priority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_orderkey) AS through FROM orders GROUP BY ALL
""")
def reconciled_periods(spark: SparkSession, root: str) -> DataFrame:
    """The state of orders by month, reconciled twice: orders up to the middle of a month, then all. The second pass computes and
    replaces that month and those after it; the files of others stay."""
    at = new_folder(spark, "reconciled")
    orders = table(spark, root, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), "o_orderdate", F.col("o_orderpriority").alias("priority"), "o_totalprice")
    step = lambda rows: rows.groupBy("period", "priority").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max("o_orderkey").alias("through"))
    for rows in (orders.where("o_orderdate < DATE '1996-05-17'"), orders):
        reconcile.reconcile(rows, at, "period", ["o_orderkey", "priority", "o_totalprice"], step)
    return reconcile.state(spark, at).select("period", "priority", "orders", "total", "through")
