"""Every query by name, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH e AS (SELECT date_trunc('day', ts) AS day, event_type, user_id FROM events),
n AS (SELECT day, event_type, count(DISTINCT user_id) AS active FROM e GROUP BY ALL),
d AS (SELECT day, count(DISTINCT user_id) AS denominator FROM e GROUP BY ALL)
SELECT strftime(n.day, '%Y-%m-%d') AS day, event_type, active, denominator,
       CAST(round(100.0 * active / denominator) AS BIGINT) AS score
FROM n JOIN d USING (day)
""")
def adoption_daily(spark: SparkSession, root: str) -> DataFrame:
    """Share of a day's users that used each event type, as a score of 0 to 100."""
    e = table(spark, root, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id")
    active = e.groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("active"))
    base = e.groupBy("day").agg(F.countDistinct("user_id").alias("denominator"))
    return active.join(base, "day").withColumn("score", F.round(100.0 * F.col("active") / F.col("denominator")).cast("bigint"))


def load() -> None:
    """Register all queries of the package."""
    from loomspan.plans import activity, catalogs, extracts, general, generations, graphs, history, labels, network, observations, people, rules, sites, streams, texts, trees, views  # noqa: F401
