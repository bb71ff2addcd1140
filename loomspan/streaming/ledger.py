"""The ledger as a stream: files of events in, counts of distinct events by day and type out; and users' states that expire.

Counts come in update mode: a batch writes only the days that changed, in a folder of its own number, so that a batch that runs
again replaces itself; the latest batch of a day holds. A day's state is dropped when the watermark has passed it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{base_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def source(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]")  # as a pattern: the table may be one file


def counted(events: DataFrame, late: str = "40 days") -> DataFrame:
    """Streaming: day, event_type, events; a repeated event_id counts once within the watermark."""
    e = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def run(rows: DataFrame, folder: str, mode: str) -> None:
    """Write each batch of a stream to a folder of its number, until all files are read."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={n}")

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of each key what the latest batch says."""
    rows = spark.read.parquet(f"{folder}/result")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def daily_active(spark: SparkSession, root: str) -> DataFrame:
    """What the stream has counted once it has read all files of events."""
    folder = new_folder(spark, "stream")
    run(counted(source(spark, root, "events")), folder, "update")
    return latest(spark, folder, ["day", "event_type"])


def user_states(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """Streaming: user_id, events, total, expired: each user's running numbers; a user idle for longer than `idle` of event time is
    emitted once more as expired and forgotten. Rows of one user come in blocks and are only added up."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, blocks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "expired": [True]})
            return
        for b in blocks:
            n, total = n + len(b), total + float(b["value"].sum())
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "expired": [False]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select("user_id", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "40 days")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, events long, total double, expired boolean", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)
