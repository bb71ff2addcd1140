"""Summaries of use for the public: one row for each period, an index over them, and the counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import content

#: The states that a run's members are counted by.
STATES = ("verified", "uncertain", "blocked", "unreachable")


def _ranked(name: str, count: str):
    """The most counted first, then by name: `name:count`, comma-joined."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("k"), F.col(name).alias("name"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["name"].cast("string"), (-x["k"]).cast("string"))), ",")


def summaries(claims: DataFrame, period: str, member: str, tool: str, use: str, eligible: int) -> DataFrame:
    """period, eligible, verified (members with a claim in it), tools (how many), early (a small sample), top_tools and uses (by how many
    members, the most first). Members are counted once for each tool and use; a period's tools and uses are as many as its rows say."""
    rows = claims.select(F.col(period).alias("period"), F.col(member).alias("member"), F.col(tool).alias("tool"), F.col(use).alias("use"))
    by_tool = rows.where("tool IS NOT NULL").groupBy("period", "tool").agg(F.countDistinct("member").alias("n")).groupBy("period").agg(F.count("*").alias("tools"), _ranked("tool", "n").alias("top_tools"))
    by_use = rows.where("use IS NOT NULL AND tool IS NOT NULL").groupBy("period", "tool", "use").agg(F.countDistinct("member").alias("n")).groupBy("period", "use").agg(F.sum("n").alias("n")).groupBy("period").agg(_ranked("use", "n").alias("uses"))
    whole = rows.groupBy("period").agg(F.countDistinct("member").alias("verified"))
    out = whole.join(by_tool, "period", "left").join(by_use, "period", "left")
    return out.select(
        "period", F.lit(eligible).cast("long").alias("eligible"), "verified", F.coalesce("tools", F.lit(0)).cast("long").alias("tools"), content.is_early(F.col("verified"), F.lit(eligible)).alias("early"),
        F.coalesce("top_tools", F.lit("")).alias("top_tools"), F.coalesce("uses", F.lit("")).alias("uses"),
    )


def index(found: DataFrame, snapshot: str) -> DataFrame:
    """One row over summaries: the periods, the latest first, whether the latest is an early sample, and a digest of all of them."""
    own = F.xxhash64(*(F.col(c) for c in sorted(found.columns))).cast("decimal(38,0)")
    return found.agg(F.array_join(F.sort_array(F.collect_list("period"), asc=False), ",").alias("periods"), F.max_by("early", "period").alias("early"), F.sum("verified").alias("claims"), F.sum(own).cast("string").alias(snapshot))


def metrics(members: DataFrame, state: str, before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One row of a run's counts: members, members by state, and the rows (by key) that came and went since the run before."""
    counts = members.agg(F.count("*").alias("eligible"), *(F.count_if(F.col(state) == s).alias(s) for s in STATES))
    both = before.select(key, F.lit(1).alias("_b")).distinct().join(now.select(key, F.lit(1).alias("_n")).distinct(), key, "full_outer")
    moved = both.agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_n").isNull()).alias("removed"))
    return counts.crossJoin(moved)  # one row each
