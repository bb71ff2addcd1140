"""Joins and windows over time: as-of joins, intervals, sessions, sliding and tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each row of left with `values` of the latest row of right with its keys and right.since <= left.at; null without one. Of
    equal times the greatest values stand. Both sides are put in one order per key; nothing is paired."""
    named = F.struct(*values)
    a = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(named).schema[0].dataType)).withColumn("_row", F.struct(*left.columns))
    b = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), named.alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.select(*keys, "_t", "_side", "_v", "_row").unionByName(b).withColumn("_seen", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", "_seen.*")


def within(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, step: int, keep: list[str]) -> DataFrame:
    """Points joined with the spans [start, stop) that hold them (whole numbers). Spans are cut at multiples of `step`, so that
    the join is one of equal cells, and its cost follows spans' lengths over the step."""
    cells = spans.select(*keep, start, stop, F.explode(F.sequence(F.floor(F.col(start) / step), F.floor((F.col(stop) - 1) / step))).alias("_cell"))
    return points.withColumn("_cell", F.floor(F.col(at) / step)).join(cells, "_cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_cell")


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, start, stop, n of runs of rows whose gaps are below `gap`."""
    g = rows.groupBy(key, F.session_window(F.col(at), gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("stop"))
    return g.select(key, F.col("w.start").alias("start"), "stop", "n")


def sliding(rows: DataFrame, by: list[str], at: str, length: str, slide: str) -> DataFrame:
    """by, start, n for windows of `length` that start each `slide`; with slide = length they tumble."""
    return rows.groupBy(*by, F.window(F.col(at), length, slide).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")
