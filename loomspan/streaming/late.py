"""Rows that come too late: a side output of a stream, instead of a silent loss.

Spark's own watermark drops late rows inside stateful operators, where nobody sees them. Here each batch is split before: rows
older than the watermark go to a table of their own, with those that have no time; the rest is kept. The watermark of a batch is
that of the batches before it (the latest kept time, less the delay), and is stored with each batch; so a batch that runs again
after a failure is split as before and replaces its own folder, and kept and late rows are always the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(rows: DataFrame, folder: str, schema: str | None = None) -> DataFrame:
    """A stream of the files in folder; rows (which may be empty) give the schema."""
    return rows.sparkSession.readStream.schema(schema or rows.schema).parquet(folder)


def route(stream: DataFrame, folder: str, at: str, delay: str) -> None:
    """Split what has newly arrived into folder/routed/batch=N/fate=kept, late or untimed."""

    def keep(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.schema("batch long, seen timestamp").json(f"{folder}/marks/*") if n else None
        latest = mark.where(F.col("batch") < n).agg(F.max("seen")).first()[0] if mark is not None else None
        ts = F.col(at).cast("timestamp")
        late = F.lit(False) if latest is None else ts < F.lit(latest) - F.expr(f"INTERVAL {delay}")
        fate = F.when(ts.isNull(), "untimed").when(late, "late").otherwise("kept")
        batch.withColumn("fate", fate).write.mode("overwrite").partitionBy("fate").parquet(f"{folder}/routed/batch={n}")
        seen = spark.read.schema(batch.schema.add("fate", "string")).parquet(f"{folder}/routed/batch={n}").where("fate = 'kept'").agg(F.lit(n).cast("long").alias("batch"), F.max(ts).alias("seen"))
        seen.coalesce(1).write.mode("overwrite").json(f"{folder}/marks/batch-{n}")

    q = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()


def routed(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with batch and fate."""
    return spark.read.parquet(f"{folder}/routed")
