"""Tolerant reads: what can't be taken goes to a table of its own, with its file and the reason, and nothing is lost.

JSON lines and CSV lines are read as lines, so that a damaged one harms itself only. A line is taken if it parses, if its fields have their
types and if the required ones are there; else its reason is the first of: `not a record`, `wrong columns` (CSV), `wrong type: FIELD`,
`missing: FIELD`. Blank lines are no records. A byte order mark and a carriage return at a line's end don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file of all lines that aren't blank."""
    rows = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "^﻿|\r$", "").alias("line"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"))
    return rows.where(F.trim("line") != "")


def _checked(rows: DataFrame, raw: Column, schema: StructType, required: list[str], broken: Column) -> DataFrame:
    """rows with reason and record; raw is a struct of all fields as strings."""
    given = [(f, raw[f.name]) for f in schema]
    value = lambda f, c: c if isinstance(f.dataType, StringType) else c.try_cast(f.dataType)
    reason = F.when(broken, "not a record")
    for f, c in given:
        if not isinstance(f.dataType, StringType):
            reason = reason.when(c.isNotNull() & value(f, c).isNull(), f"wrong type: {f.name}")
    for name in required:
        reason = reason.when(raw[name].isNull(), f"missing: {name}")
    return rows.select("line", "file", reason.alias("reason"), F.struct(*(value(f, c).alias(f.name) for f, c in given)).alias("record"))


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """line, file, reason (null for a good one), record of JSON lines. A field that is null lacks."""
    want = StructType.fromDDL(schema)
    rows = lines(spark, path)
    broken = F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{")
    raw = F.from_json("line", ", ".join(f"`{f.name}` string" for f in want))
    return _checked(rows.withColumn("_raw", raw), F.col("_raw"), want, required, broken)


def csv_lines(spark: SparkSession, path: str, schema: str, required: list[str], sep: str = ",") -> DataFrame:
    """line, file, reason, record of CSV lines without a header, fields quoted by double quotes. An empty field lacks."""
    want = StructType.fromDDL(schema)
    names = [f.name for f in want]
    one = lines(spark, path).withColumn("_raw", F.from_csv("line", ", ".join(f"`{n}` string" for n in [*names, "_more"]), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}))
    rows = _checked(one, F.col("_raw"), want, required, (F.length(F.regexp_replace("line", '[^"]', "")) % 2) == 1)
    wide = F.length(F.regexp_replace(F.regexp_replace("line", '"(?:[^"]|"")*"', ""), f"[^{sep}]", "")) + 1 != len(names)
    return rows.withColumn("reason", F.when(F.col("reason") == "not a record", F.col("reason")).when(wide, "wrong columns").otherwise(F.col("reason")))


def split(found: DataFrame, to: str) -> tuple[DataFrame, DataFrame]:
    """The good records of found, and the quarantine: line, file, reason, written to a folder by reason and read back. Found is read once
    for each."""
    found.where("reason IS NOT NULL").select("line", "file", F.substring_index("reason", ":", 1).alias("kind"), "reason").write.mode("overwrite").partitionBy("kind").parquet(to)
    return found.where("reason IS NULL").select("record.*", "file"), found.sparkSession.read.parquet(to).select("line", "file", "reason")
