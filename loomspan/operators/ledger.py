"""The usage ledger: differences between snapshots as events, replay of events to a state, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key that was added, removed or changed."""
    both = before.select(*keys, F.col(value).alias("was"), F.lit(1).alias("_b")).join(after.select(*keys, F.col(value).alias("is"), F.lit(1).alias("_a")), keys, "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.withColumn("event", kind).where("event IS NOT NULL").drop("_a", "_b")


def replay(events: DataFrame, keys: list[str], order: list[str], removes: Column, value: str, until: Column | None = None) -> DataFrame:
    """The state after all events (before `until`, exclusive): the latest event of each key and the last non-null value since
    its last removal. A key whose latest event removes it has no state."""
    rows = events if until is None else events.where(until)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_removes", removes.cast("int")).withColumn("_life", F.sum("_removes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy(*keys, "_life").orderBy(*order)
    rows = rows.withColumn("carried", F.last(F.when(F.col("_removes") == 0, F.col(value)), ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))))
    return rows.where("_n = 1 AND _removes = 0").drop("_n", "_removes", "_life")


def append(log: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """log with those rows of batch whose key it lacks, each once."""
    return log.unionByName(batch.dropDuplicates([key]).join(log.select(key), key, "left_anti"))


def absences(observations: DataFrame, source: str, complete: Column, success: Column) -> DataFrame:
    """Whether a source's observations together prove an absence: all complete, all successful, at least one."""
    rows = observations.groupBy(source).agg(F.bool_and(complete).alias("all_complete"), F.bool_and(success).alias("all_succeeded"), F.count("*").alias("observations"))
    verdict = F.when(~F.col("all_succeeded"), "failed").when(~F.col("all_complete"), "incomplete").otherwise("verified")
    return rows.withColumn("absence", verdict)
