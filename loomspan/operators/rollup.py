"""Adoption rollups over calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(part: Column, whole: Column) -> Column:
    """A share as a whole number of 0 to 100; null without a whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole).cast("bigint"))


def periods(ts: Column) -> Column:
    """The month, quarter, year and all-time keys of a time, as an array of (granularity, period)."""
    year = F.date_format(ts, "yyyy")
    keys = (("month", F.date_format(ts, "yyyy-MM")), ("quarter", F.concat(year, F.lit("-Q"), F.quarter(ts).cast("string"))), ("year", year), ("all-time", F.lit("all")))
    return F.array(*(F.struct(F.lit(g).alias("granularity"), k.alias("period")) for g, k in keys))


def rollup(rows: DataFrame, ts: str, tool: str, origin: str) -> DataFrame:
    """granularity, period, tool: distinct origins, those of the period, and the score; all granularities in one pass."""
    keyed = rows.select(F.explode(periods(F.col(ts))).alias("p"), F.col(tool).alias("tool"), F.col(origin).alias("origin")).select("p.*", "tool", "origin").distinct()
    whole = keyed.groupBy("granularity", "period").agg(F.countDistinct("origin").alias("denominator"))
    return keyed.groupBy("granularity", "period", "tool").agg(F.count("*").alias("active")).join(whole, ["granularity", "period"]).withColumn("score", score(F.col("active"), F.col("denominator")))


def change(now: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both sides' values, 0 where one lacks the key, and their difference."""
    both = now.select(*keys, F.col(value).alias("now")).join(before.select(*keys, F.col(value).alias("before")), keys, "full_outer")
    both = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("now", "before")})
    return both.withColumn("change", F.col("now") - F.col("before"))


def previous_month(period: Column) -> Column:
    """The yyyy-MM before a yyyy-MM."""
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), -1), "yyyy-MM")


def momentum(rows: DataFrame, by: list[str], period: str, value: str, whole: str, before: Column) -> DataFrame:
    """rows (by, period, value, whole) with the value of their key in the calendar period `before` theirs, the change, and the
    change of the score in points; null where that period has no row."""
    was = rows.select(*by, F.col(period).alias("_p"), F.col(value).alias("previous"), F.col(whole).alias("_w"))
    both = rows.withColumn("_p", before).join(was, [*by, "_p"], "left")
    points = score(F.col(value), F.col(whole)) - score(F.col("previous"), F.col("_w"))
    return both.withColumn("change", F.col(value) - F.col("previous")).withColumn("points", points).drop("_p", "_w")


def full(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """The rollup of one period: slot, tool, active (distinct origins), units (the most of each origin, summed), denominator of the
    slot (distinct origins, or the units of all its claims where its basis is units), score, name (the one most claims use, the least of
    equals), purposes (the number of distinct ones), ever (distinct origins of changes in the period). claims: slot, tool, origin,
    units, basis, name, purpose; changes: tool, origin."""
    per = claims.groupBy("slot", "tool", "origin", "basis").agg(F.max("units").alias("u"), F.sum("units").alias("s"))
    rows = per.groupBy("slot", "tool", "basis").agg(F.count("*").alias("active"), F.sum("u").alias("units"))
    whole = per.groupBy("slot", "basis", "origin").agg(F.sum("s").alias("s")).groupBy("slot", "basis").agg(F.count("origin").alias("o"), F.sum("s").alias("all_units"))
    votes = claims.groupBy("slot", "tool", "name").agg(F.count("*").alias("n")).groupBy("slot", "tool").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    purposes = claims.groupBy("slot", "tool").agg(F.countDistinct("purpose").alias("purposes"))
    ever = changes.groupBy("tool").agg(F.countDistinct("origin").alias("ever"))
    out = rows.join(whole, ["slot", "basis"]).join(votes, ["slot", "tool"]).join(purposes, ["slot", "tool"]).join(ever, "tool", "left")
    base = F.when(F.col("basis") == "units", F.col("all_units")).otherwise(F.col("o"))
    part = F.when(F.col("basis") == "units", F.col("units")).otherwise(F.col("active"))
    return out.select("slot", "tool", "active", "units", base.alias("denominator"), score(part, base).alias("score"), "name", "purposes", F.coalesce("ever", F.lit(0)).alias("ever"))


def one_per_tool(rows: DataFrame, home: DataFrame) -> DataFrame:
    """Of several rows of a tool (slot, tool, active) the one with the larger count, then that of its home slot, then of the lesser slot."""
    both = rows.join(home.select("tool", F.col("slot").alias("_home")), "tool", "left")
    return both.groupBy("tool").agg(F.max_by(F.struct("slot", "active"), F.struct("active", F.coalesce(F.col("slot") == F.col("_home"), F.lit(False)), F.transform(F.split("slot", ""), lambda c: -F.ascii(c)))).alias("x")).select("tool", "x.*")
