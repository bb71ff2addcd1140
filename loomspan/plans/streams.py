"""Queries over streams of several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans.registry import query
from loomspan.sources.tables import table
from loomspan.streaming import absences, late
from loomspan.streaming.ledger import new_folder


@query("""
WITH a AS (SELECT ts, value, (day(ts) + CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 1) AS INT)) // 8 AS batch FROM events),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 DAY AS mark FROM a GROUP BY batch)
SELECT CAST(batch AS INT) AS batch, CASE WHEN ts < mark THEN 'late' ELSE 'kept' END AS fate, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM a JOIN m USING (batch) GROUP BY ALL
""")
def late_events(spark: SparkSession, root: str) -> DataFrame:
    """Events that arrive up to fifteen days after they happened, in six batches, with five days' grace: what each batch keeps and
    what goes to the side. Together they are all events."""
    folder = new_folder(spark, "late")
    events = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    waited = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 1), 16, 10).cast("int")
    dated = events.withColumn("arrival", F.floor((F.dayofmonth("ts") + waited) / 8))
    for n in range(6):
        dated.where(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(f"{folder}/input")
        late.route(late.arrivals(events, f"{folder}/input"), folder, "ts", "5 DAYS")
    return late.routed(spark, folder).groupBy("batch", "fate").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, event_type <> 'error' AS present FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 36 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM g), p AS (SELECT *, max(ts) FILTER (WHERE present) OVER (PARTITION BY user_id, spell) AS shown FROM s),
r AS (SELECT user_id, spell, min(ts) AS start, max(ts) AS last, count(*) AS looks, max(shown) AS shown, min(ts) FILTER (WHERE NOT present AND (shown IS NULL OR ts > shown)) AS since, max(ts) FILTER (WHERE NOT present AND (shown IS NULL OR ts > shown)) AS until FROM p GROUP BY ALL)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, looks,
       CASE WHEN shown IS NULL THEN 'unseen' WHEN since IS NULL THEN 'current' WHEN until - since >= INTERVAL 24 HOUR THEN 'removed' ELSE 'pending' END AS state,
       lead(start) OVER (PARTITION BY user_id ORDER BY start) IS NOT NULL OR last + INTERVAL 36 HOUR < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS expired FROM r
""")
def absence_spells(spark: SparkSession, root: str) -> DataFrame:
    """Looks at users in five batches of six days: spells of looks with what they prove; a user without a look for 36 hours is
    forgotten by a timer and begins anew when seen again."""
    folder = new_folder(spark, "spells")
    looks = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("present"))
    span = looks.agg(F.min(F.unix_date(F.to_date("ts"))).alias("a"), F.max(F.unix_date(F.to_date("ts"))).alias("z")).first()
    for day in range(span["a"] or 0, (span["z"] or -1) + 1, 6):
        looks.where(F.unix_date(F.to_date("ts")).between(day, day + 5)).write.mode("append").parquet(f"{folder}/input")
        absences.run(absences.spells(late.arrivals(looks, f"{folder}/input"), "36 hours", "6 hours"), folder)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return absences.results(spark, folder).select("user_id", text("start"), text("last"), "looks", "state", "expired")
