"""Readers for the Parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root`` (any path or store that Spark reads)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, four tasks for each. For steps that work long on every row: a table of narrow rows is a small file, and is
    read by few tasks however many rows it has. Deal rows before they grow wide."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


#: Rows that a task of a join or count over a large table gets at most, on average.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, *by: str, of: int) -> DataFrame:
    """rows dealt by the columns `by` over as many tasks as a table of `of` rows needs, so that a task's memory doesn't grow with the table;
    as they are, where the session's own number of shuffle partitions is enough."""
    parts = -(-of // TASK_ROWS)
    return rows.repartition(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
