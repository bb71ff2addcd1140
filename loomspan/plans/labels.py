"""Queries over labels and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import labels, times
from loomspan.plans.registry import query
from loomspan.sources.tables import table


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) || '_' || upper(lang) WHEN 1 THEN ' ' || lang WHEN 2 THEN lang || '--x' ELSE 'he-IL' END AS raw FROM documents),
n AS (SELECT doc_id, raw, CASE WHEN length(trim(raw)) <= 35 AND regexp_matches(replace(lower(trim(raw)), '_', '-'), '^[a-z]{2,8}(-[a-z0-9]{1,8})*$') THEN replace(lower(trim(raw)), '_', '-') ELSE '' END AS tag FROM t)
SELECT doc_id, tag, split_part(tag, '-', 1) = 'en' AS english, regexp_split_to_array(lower(raw), '[-_]')[1] IN ('ar', 'he', 'fa', 'ur', 'yi', 'dv') AS rtl FROM n
""")
def language_tags(spark: SparkSession, root: str) -> DataFrame:
    """Language tags in several spellings, made regular."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.upper("lang"), F.lit("_"), F.upper("lang"))).when(k == 1, F.concat(F.lit(" "), "lang")).when(k == 2, F.concat("lang", F.lit("--x"))).otherwise("he-IL")
    return table(spark, root, "documents").select("doc_id", raw.alias("raw")).select("doc_id", labels.language_tag(F.col("raw")).alias("tag"), labels.is_english(F.col("raw")).alias("english"), labels.is_right_to_left(F.col("raw")).alias("rtl"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 261) AS h FROM t),
l AS (SELECT *, length(regexp_extract(h, '(?s)^(.*[.!?]) ', 1)) AS s, length(regexp_extract(h, '(?s)^(.*) ', 1)) AS p FROM h)
SELECT doc_id, CASE WHEN length(t) <= 260 THEN t WHEN s - 1 >= 117 THEN trim(substr(t, 1, s)) WHEN p >= 130 THEN trim(substr(t, 1, p)) || '…' ELSE rtrim(substr(t, 1, 260)) || '…' END AS description FROM l
""")
def descriptions(spark: SparkSession, root: str) -> DataFrame:
    """Descriptions of documents, cut at a sentence's end where one is near."""
    return table(spark, root, "documents").select("doc_id", labels.description(F.col("text")).alias("description"))


@query("""
SELECT event_type, CAST(count_if(ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY) AS BIGINT) AS fresh, CAST(count_if(ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY) AS BIGINT) AS recent, count(*) AS n FROM events GROUP BY event_type
""")
def freshness(spark: SparkSession, root: str) -> DataFrame:
    """Events by type: fresh on a day, and recent on it, which leaves later ones out."""
    now = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    ts = F.col("ts")
    return table(spark, root, "events").groupBy("event_type").agg(F.count_if(times.fresh(ts, now, 5)).alias("fresh"), F.count_if(times.within_days(ts, now, 5)).alias("recent"), F.count("*").alias("n"))
