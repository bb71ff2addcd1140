"""Labels against a catalog: aliases with conditions, ids that a better one replaces, slots by section, names within contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of names that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def _bounded(names: DataFrame) -> DataFrame:
    """names, all of texts, to be broadcast if the sum of their bytes is small enough, else shuffled. Left alone, Spark would broadcast what is
    joined with them, whose rows it sizes as before they were taken apart."""
    size = names.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names.columns), F.lit(64)))).first()[0] or 0
    return F.broadcast(names) if size <= BROADCAST_BYTES else names.hint("merge")


def _some(needles, hay):
    return F.exists(F.coalesce(needles, F.array().cast("array<string>")), lambda x: F.contains(hay, x))


def resolved(claims: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, verdict, tool of claims (key, comparison, section, context) by rules (alias, tool, require_context, forbid_context,
    require_section: arrays of comparison labels). Rules with conditions outrank those without. One tool: unique; several: ambiguous;
    conditions that all fail: abstain; no alias: none."""
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    r = rules.withColumn("scoped", has(F.col("require_context")) | has(F.col("forbid_context")) | has(F.col("require_section"))).withColumnRenamed("alias", "comparison")
    both = claims.join(r, "comparison", "left")
    hay = F.concat_ws(" ", "section", "context")
    ok = (~has(F.col("require_context")) | _some(F.col("require_context"), hay)) & ~_some(F.col("forbid_context"), hay) & (~has(F.col("require_section")) | _some(F.col("require_section"), F.col("section")))
    w = Window.partitionBy(key)
    both = both.withColumn("_any", F.max(F.col("scoped").cast("int")).over(w)).withColumn("_ok", ok & (F.col("scoped").cast("int") == F.col("_any")))
    g = both.groupBy(key).agg(F.count("tool").alias("rules"), F.countDistinct(F.when(F.col("_ok"), F.col("tool"))).alias("n"), F.min(F.when(F.col("_ok"), F.col("tool"))).alias("t"))
    verdict = F.when(F.col("rules") == 0, "none").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("abstain")
    return g.select(key, verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("t")).alias("tool"))


def superseded(tools: DataFrame, found: DataFrame, origin: str, key: str) -> DataFrame:
    """origin, observed, canonical: current observed ids (tools: key, origin, tool_id) whose label resolves (found: key, verdict, tool)
    to a tool that the origin has too."""
    seen = tools.where(F.col("tool_id").startswith("observed:")).join(found.where("verdict = 'unique'").select(key, F.col("tool").alias("canonical")), key)
    return seen.select(origin, F.col("tool_id").alias("observed"), "canonical").join(tools.select(origin, F.col("tool_id").alias("canonical")).distinct(), [origin, "canonical"], "left_semi").select(origin, "observed", "canonical").distinct()


def section_slots(claims: DataFrame, slots: DataFrame, key: str, section: str) -> DataFrame:
    """key, slot: the deepest part of a section's path that is one slot's name, id or synonym (slots: name, slot); null without one.
    A name of several slots is none."""
    one = slots.groupBy("name").agg(F.countDistinct("slot").alias("n"), F.min("slot").alias("slot")).where("n = 1").select("name", "slot")
    parts = claims.select(key, F.posexplode(F.split(F.lower(section), r"\s*/\s*")).alias("at", "name"))
    best = parts.join(_bounded(one), "name").groupBy(key).agg(F.max_by("slot", "at").alias("slot"))
    return claims.select(key).join(best, key, "left")


def named_within(claims: DataFrame, names: DataFrame, key: str, context: str, most_words: int = 4) -> DataFrame:
    """key, tool: names (name, tool) that stand within a context as whole words, the longest first: a name inside a longer one that
    was found is not counted. Contexts give their runs of up to `most_words` words, so the join is one of equal names."""
    words = claims.select(key, F.split(F.lower(context), r"[^a-z0-9+#.]+").alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), _run(n))).otherwise(F.array().cast("array<struct<a:int,n:int,name:string>>"))
    every = words.select(key, F.explode(F.concat(*(runs(n) for n in range(1, most_words + 1)))).alias("x")).select(key, "x.*")
    # What is found is gathered by context, no more than the runs of one context, and held against itself there.
    hits = every.join(_bounded(names.select("name", "tool")), "name").groupBy(key).agg(F.collect_list(F.struct("a", "n", "tool")).alias("h"))
    inside = lambda x: F.exists("h", lambda y: (y["n"] > x["n"]) & (y["a"] <= x["a"]) & (y["a"] + y["n"] >= x["a"] + x["n"]))
    return hits.select(key, F.explode(F.array_distinct(F.transform(F.filter("h", lambda x: ~inside(x)), lambda x: x["tool"]))).alias("tool"))


def _run(n: int):
    return lambda i: F.struct(i.cast("int").alias("a"), F.lit(n).alias("n"), F.array_join(F.slice(F.col("w"), i, n), " ").alias("name"))
