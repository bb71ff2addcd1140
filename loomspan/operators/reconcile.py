"""State by period, computed anew only for the periods whose rows changed.

A period's state carries the count and digest of the rows it was made of. So what has changed is known from the state itself: a run that
died after some periods were replaced leaves the others with the digest of before, and the next one takes them up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.generations import digests
from loomspan.sources.stores import exists


def state(spark: SparkSession, path: str) -> DataFrame:
    """The state as it stands, with of_n and of_digest, what it was made of."""
    return spark.read.option("partitionColumnTypeInference", False).parquet(path).withColumn("period", F.col("period").cast("string"))


def changed(rows: DataFrame, path: str, period: str, columns: list[str]) -> DataFrame:
    """period, n, digest of the periods of rows that the state lacks or that were made of other rows; a period that has lost all its
    rows has n 0. `columns` are those that the state depends on: no others are read."""
    now = digests(rows.select(F.col(period).alias("period"), *columns), ["period"])
    if not exists(rows.sparkSession, path):
        return now
    before = state(rows.sparkSession, path).groupBy("period").agg(F.first("of_n").alias("of_n"), F.first("of_digest").alias("of_digest"))
    both = now.join(before, "period", "full_outer")
    same = (F.col("n") == F.col("of_n")) & (F.col("digest") == F.col("of_digest"))
    return both.where(~F.coalesce(same, F.lit(False))).select("period", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"))


def reconcile(rows: DataFrame, path: str, period: str, columns: list[str], step: Callable[[DataFrame], DataFrame]) -> int:
    """Bring the state at path up to rows: step makes the state of whole periods, and only changed ones are computed and replaced
    (dynamic partition overwrite). The number of periods that changed. Rows without a period have a period of their own."""
    spark = rows.sparkSession
    rows = rows.withColumn(period, F.coalesce(F.col(period).cast("string"), F.lit("none")))
    found = [(r["period"], r["n"], r["digest"]) for r in changed(rows, path, period, columns).collect()]  # one row for each period
    if not found:
        return 0
    of = F.broadcast(spark.createDataFrame(found, "period string, of_n long, of_digest string"))
    some = rows.where(F.col(period).isin([p for p, n, _ in found if n]))  # a filter on the period: prunes where rows are stored by it
    made = step(some).withColumnRenamed(period, "period").join(of, "period")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    for p, n, _ in found:
        if not n:  # nothing is written for a period without rows: its folder goes
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/period={p}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return len(found)
