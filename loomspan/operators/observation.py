"""Observation runs, snapshots and catalogs: what is published, what is kept, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_PATTERNS = 10_000


def published(observations: DataFrame, runs: DataFrame, run: str, status: str) -> DataFrame:
    """Observations of committed runs only."""
    return observations.join(runs.where(F.col(status) == "committed").select(run), run, "left_semi")


def fate(age_days: Column, attempts: Column, newer: Column) -> Column:
    """What becomes of a run that was validated and never committed."""
    return F.when(newer, "supersede").when((attempts < 3) & (age_days <= 7), "retry").otherwise("abort")


def unchanged(now: DataFrame, before: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Rows whose digest the snapshot before has too: they need no work."""
    return now.join(before.select(*keys, digest), [*keys, digest], "left_semi")


def merged(base: DataFrame, gathered: DataFrame, key: str, value: str) -> DataFrame:
    """base and gathered by key; a gathered value wins. outcome: added, updated, kept or same."""
    both = base.select(key, F.col(value).alias("was"), F.lit(True).alias("_b")).join(gathered.select(key, F.col(value).alias("is"), F.lit(True).alias("_g")), key, "full_outer")
    outcome = F.when(F.col("_b").isNull(), "added").when(F.col("_g").isNull(), "kept").when(F.col("was").eqNullSafe(F.col("is")), "same").otherwise("updated")
    return both.select(key, F.coalesce("is", "was").alias(value), outcome.alias("outcome"))


def first_match(claims: DataFrame, stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Each claim with the first stage whose lookup (key column of the stage's name, target) knows it."""
    for name, lookup in stages:
        claims = claims.join(lookup.select(F.col(name), F.col("target").alias(f"_{name}")), name, "left")
    stage = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in stages), F.lit("none"))
    return claims.select(key, stage.alias("stage"), F.coalesce(*(F.col(f"_{n}") for n, _ in stages)).alias("target"))


def connections(links: DataFrame, members: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """Distinct links between two different members."""
    m = members.select(F.col(member).alias("_m"))
    near = links.where(F.col(source) != F.col(target)).join(m, F.col(source) == F.col("_m"), "left_semi").join(m, F.col(target) == F.col("_m"), "left_semi")
    return near.select(source, target).distinct()


def neighbours(edges: DataFrame, members: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """For every member how many others it links to and how many link to it."""
    out = edges.groupBy(F.col(source).alias(member)).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col(target).alias(member)).agg(F.count("*").alias("incoming"))
    return members.select(member).join(out, member, "left").join(into, member, "left").na.fill(0, ["outgoing", "incoming"])


def longest_pattern(paths: DataFrame, patterns: DataFrame, path: str, pattern: str, owner: str) -> DataFrame:
    """The owner of each path by the longest matching LIKE pattern, or null. Patterns are a
    short list that somebody wrote; more than MOST_PATTERNS are refused."""
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    hit = paths.join(F.broadcast(patterns), F.expr(f"{path} LIKE {pattern}"), "left")
    return hit.groupBy(path).agg(F.max_by(owner, F.struct(F.length(pattern), pattern)).alias(owner))


def confidence(resolved: Column, current: Column, section: Column, use_case: Column) -> Column:
    """How sure a piece of evidence is: 0.4 and what it has besides, 1 at most."""
    worth = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.4 + worth(resolved, 0.35) + worth(current, 0.1) + worth(section, 0.1) + worth(use_case, 0.05)), 2)


def trail(edges: DataFrame, starts: DataFrame, source: str, target: str, seed: int, hops: int = 3) -> DataFrame:
    """A walk of up to `hops` edges from each start, at each step the unused edge of the least hash. A walk has used k edges before
    step k, so only the first k + 1 edges of a node can be next: no hub's whole list is joined."""
    walk = starts.select(F.col(source).alias("start"), F.col(source).alias("at"), F.array().cast("array<string>").alias("used"))
    for k in range(hops):
        out = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t"), F.concat_ws(">", source, target).alias("edge")).distinct()
        by_hash = Window.partitionBy("_s").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed + k)), "edge").cast("binary")), "edge")
        out = out.withColumn("_k", F.row_number().over(by_hash)).where(F.col("_k") <= k + 1).drop("_k")
        step = walk.join(out, F.col("at") == F.col("_s"), "left").withColumn("free", F.col("_t").isNotNull() & ~F.exists("used", lambda u: u == F.col("edge")))
        order = Window.partitionBy("start").orderBy(F.desc("free"), F.md5(F.concat_ws(":", F.lit(str(seed + k)), "edge").cast("binary")), "edge")
        step = step.withColumn("n", F.row_number().over(order)).where("n = 1")
        walk = step.select("start", F.when(F.col("free"), F.col("_t")).otherwise(F.col("at")).alias("at"), F.when(F.col("free"), F.array_append("used", F.col("edge"))).otherwise(F.col("used")).alias("used"))
    return walk.select("start", F.col("at").alias("end"), F.array_join("used", " ").alias("path"))


def snapshot_hash(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: the hash of all rows' hashes, which neither order nor partitioning changes, and their number. Sums are taken
    by the hash's parts, so that no list of rows is ever built."""
    h = F.sha2(F.to_json(F.struct(*order)), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), *(part(k).alias(f"p{k}") for k in range(3))).select("n", F.substring(F.sha2(F.concat_ws("-", F.col("n").cast("string"), "p0", "p1", "p2"), 256), 1, 16).alias("digest"))
