"""Connected components of a graph of links, by alternating large and small stars.

Each step is a groupBy with a minimum and a join; no node's neighbours are ever gathered. Every round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import drop_folder, stored, work_folder


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.col("m").alias("v")).union(down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v): for each node of a link that isn't its component's least node, a row (u, v) with v that least node."""
    spark, folder = links.sparkSession, work_folder(links.sparkSession, "components")
    e = stored(links.select("u", "v").where("u <> v").distinct(), f"{folder}/0")
    mark, k = None, 0
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            return e
        mark, k = now, k + 1
        e = stored(_small(_large(e)), f"{folder}/{k}")
        drop_folder(spark, f"{folder}/{k - 1}")
