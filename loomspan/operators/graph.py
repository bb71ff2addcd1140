"""Graphs of links and use: edges, invariants, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.streaming.ledger import new_folder


def aggregate_edges(links: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """One edge for each key: its first evidence and the number of distinct pieces of evidence."""
    distinct = links.select(*keys, *evidence).distinct()
    first = F.min(F.struct(*evidence))
    return distinct.groupBy(*keys).agg(first.alias("_f"), F.count("*").alias("evidence_count")).select(*keys, *(F.col(f"_f.{c}").alias(f"first_{c}") for c in evidence), "evidence_count")


def closure(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Where each source ends when its pairs are followed, however long the chain: steps double until nothing moves. A source that
    runs into a cycle ends at the cycle's least node; of several targets the least is followed."""
    step = pairs.groupBy(F.col(source).alias("s")).agg(F.min(target).alias("t"))
    # low: the least node passed so far; a cycle never stops moving, so its sources end when `low` and the length say so.
    step = step.select("s", "t", F.col("t").alias("low"))
    n, covered, folder = None, 1, new_folder(pairs.sparkSession, "closure")
    while True:
        far = step.select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("low").alias("low2"))
        joined = step.join(far, "t", "left").select("s", F.coalesce("t2", "t").alias("t"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("t2").isNotNull().alias("moves"))
        joined.write.parquet(f"{folder}/{covered}")  # survives its executors
        joined = pairs.sparkSession.read.schema(joined.schema).parquet(f"{folder}/{covered}")
        n, covered = n or joined.count(), covered * 2
        moving = joined.where("moves").limit(1).count()
        step = joined.drop("moves")
        if not moving or covered > n:
            break
    # What still moves after more steps than there are sources runs in a cycle.
    looped = step.select("s", "t").join(step.select(F.col("s").alias("t"), F.col("low").alias("least")), "t", "left")
    return looped.select(F.col("s").alias(source), F.coalesce("least", "t").alias(target))


def orphans(edges: DataFrame, nodes: DataFrame, ends: list[str], node: str) -> DataFrame:
    """(end, id) of the ends of edges that are no nodes."""
    every = None
    for e in ends:
        own = edges.select(F.lit(e).alias("end"), F.col(e).alias("id")).join(nodes.select(F.col(node).alias("id")), "id", "left_anti").select("end", "id")
        every = own if every is None else every.union(own)
    return every.distinct()
