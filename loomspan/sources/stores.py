"""Stores of files: a log of events by period, bodies by their digest, documents that may lack, views that are written if they changed.

Every writer gives its rows by Spark's own writers; a second run of the same rows changes nothing. Paths are any that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.observation import snapshot_hash


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with file, the name each came from; none where the path lacks."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, file string")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def append_events(spark: SparkSession, events: DataFrame, path: str, key: str, at: str) -> None:
    """Add events to a log by period, each id once; those without a time have a period of their own. Only periods that get rows are read."""
    rows = events.withColumn("period", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))).dropDuplicates([key])
    if exists(spark, path):
        periods = rows.select("period").distinct()
        known = spark.read.schema(rows.schema).parquet(path).join(periods, "period", "left_semi")
        rows = rows.join(known.select(key), key, "left_anti")
        mode = "append"
    else:
        mode = "errorifexists"
    rows.write.mode(mode).partitionBy("period").parquet(path)


def stored_periods(spark: SparkSession, path: str) -> DataFrame:
    """period, n of a log's periods."""
    return spark.read.parquet(path).groupBy(F.col("period").cast("string").alias("period")).agg(F.count("*").alias("n"))


def add_bodies(spark: SparkSession, bodies: DataFrame, path: str, body: str) -> DataFrame:
    """bodies with sha, the name of theirs; bodies that the store lacks are added, each once, by the first digits of their name."""
    named = bodies.withColumn("sha", F.sha2(body, 256))
    new = named.select("sha", body, F.substring("sha", 1, 2).alias("shard")).dropDuplicates(["sha"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(path)
    return named


def write_if_changed(view: DataFrame, path: str, columns: list[str]) -> bool:
    """Write a view unless what stands there says the same, whatever its order; whether it was written."""
    spark = view.sparkSession
    digest = snapshot_hash(view, columns).first()["digest"]
    if exists(spark, f"{path}/digest") and spark.read.text(f"{path}/digest").first()[0] == digest:
        return False
    # The old digest goes first: rows that a run left half-written are under none.
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digest")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    view.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/digest")
    return True


def write_records(rows: DataFrame, path: str, key: str, item: Column) -> None:
    """JSON records, in folders by key."""
    rows.select(key, F.to_json(item).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
