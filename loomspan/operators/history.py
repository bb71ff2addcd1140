"""History: periods that close, daily checks, absences that wait for proof, requests that expire, runs and their fate, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import rollup

#: Hours until an absence counts as removal; shares and factors past which metrics are blocked.
REMOVAL_HOURS, REMOVAL_SHARE, ABSTENTION_GAIN, SHARE_SHIFT = 24, 0.35, 0.25, 0.25


def closed(events: DataFrame, stored: DataFrame, at: str, tool: str, origin: str, as_of: Column, version: int) -> DataFrame:
    """Rollups of all periods of `events` whose end as_of has passed: granularity, period, tool, active, denominator, score, fate. A
    period that `stored` (granularity, period, tool, active, denominator, score, complete, version) holds as complete at this version
    stays as it is, whatever came late."""
    keyed = events.select(F.explode(rollup.periods(F.col(at))).alias("p"), F.col(tool).alias("tool"), F.col(origin).alias("origin")).select("p.*", "tool", "origin").where("granularity <> 'all-time'")
    end = (
        F.when(F.col("granularity") == "month", F.add_months(F.to_date(F.concat("period", F.lit("-01"))), 1))
        .when(F.col("granularity") == "quarter", F.add_months(F.make_date(F.substring("period", 1, 4).cast("int"), F.substring("period", 7, 1).cast("int") * 3 - 2, F.lit(1)), 3))
        .otherwise(F.make_date(F.substring("period", 1, 4).cast("int") + 1, F.lit(1), F.lit(1)))
    )
    keyed = keyed.where(end <= as_of).distinct()
    keep = stored.where(F.col("complete") & (F.col("version") == version))
    names = keep.select("granularity", "period").distinct()
    fresh = keyed.join(names, ["granularity", "period"], "left_anti")
    whole = fresh.groupBy("granularity", "period").agg(F.countDistinct("origin").alias("denominator"))
    new = fresh.groupBy("granularity", "period", "tool").agg(F.count("*").alias("active")).join(whole, ["granularity", "period"]).withColumn("score", rollup.score(F.col("active"), F.col("denominator")))
    cols = ["granularity", "period", "tool", "active", "denominator", "score"]
    return keep.select(*cols, F.lit("kept").alias("fate")).unionByName(new.select(*cols, F.lit("closed").alias("fate")))


def checks(rows: DataFrame, keys: list[str], order: list[str], items: str, outcome: str) -> DataFrame:
    """One check for each key: in order, a check replaces the one before if it has as many items or more, or is verified. That is:
    the latest verified one starts anew; from it on, the last of those with the most items so far stands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_start", F.sum((F.col(outcome) == "verified").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy(*keys)
    rows = rows.withColumn("_last", F.max("_start").over(last)).where("_start = _last")
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(items), *(F.desc(c) for c in order))))
    return best.where("_n = 1").drop("_start", "_last", "_n")


def pending(sightings: DataFrame, keys: list[str], at: str, present: str, hours: int = REMOVAL_HOURS) -> DataFrame:
    """keys, state, since: what verified looks at a page (keys, at, present) say of a tool in the end. Absent for `hours` or more,
    from its first absence to a later look: removed; absent for less: pending; else current. A presence ends an absence."""
    w = Window.partitionBy(*keys)
    seen = sightings.withColumn("_p", F.max(F.when(F.col(present), F.col(at))).over(w))
    absent = F.when(~F.col(present) & (F.col("_p").isNull() | (F.col(at) > F.col("_p"))), F.col(at))
    g = seen.groupBy(*keys).agg(F.min(absent).alias("since"), F.max(absent).alias("until"), F.max("_p").alias("last"))
    waited = F.col("until") - F.col("since") >= F.make_dt_interval(F.lit(0), F.lit(hours))
    return g.select(*keys, F.when(F.col("since").isNull(), "current").when(waited, "removed").otherwise("pending").alias("state"), "since").where(F.col("last").isNotNull())


def requests(prior: DataFrame, new: DataFrame, key: str, value: str, checked: str, now: Column, days: int) -> DataFrame:
    """The state of requests by site: a complete reading (new: key, value, checked, complete) replaces what was known, another keeps
    it; what nobody read for `days` goes."""
    good = new.where("complete").select(key, F.col(value).alias("_v"), F.col(checked).alias("_c"))
    both = prior.select(key, value, checked).join(good, key, "full_outer")
    out = both.select(key, F.when(F.col("_c").isNotNull(), F.col("_v")).otherwise(F.col(value)).alias(value), F.coalesce("_c", checked).alias(checked))
    return out.where(F.col(checked) >= now - F.make_dt_interval(F.lit(days)))


def overlay(rows: DataFrame, durable: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields that durable rows of their key fill."""
    d = durable.select(key, *(F.nullif(F.col(f), F.lit("")).alias(f"_{f}") for f in fields))
    return rows.join(d, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def candidates(observations: DataFrame, runs: DataFrame, run: str, status: str, current) -> DataFrame:
    """Observations of committed runs and of the current one."""
    ok = runs.where((F.col(status) == "committed") | (F.col(run) == F.lit(current))).select(run)
    return observations.join(ok, run, "left_semi")


def carried(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """now, and of before the rows whose key now lacks; carried says which."""
    rest = before.join(now.select(key), key, "left_anti")
    return now.withColumn("carried", F.lit(False)).unionByName(rest.select(*now.columns).withColumn("carried", F.lit(True)))


def history_errors(events: DataFrame, key: str, at: str, as_of: Column) -> DataFrame:
    """code, violations: ids that aren't unique, times that lack or lie ahead."""
    g = events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(at).isNull()).alias("none"), F.count_if(F.col(at) > as_of).alias("ahead"))
    t = g.agg(F.count_if(F.col("n") > 1).alias("repeated_id"), F.sum("none").alias("no_time"), F.sum("ahead").alias("future_time"))
    return t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in ("repeated_id", "no_time", "future_time")))).alias("x")).select("x.*")


def drift(metrics: DataFrame) -> DataFrame:
    """metrics (now and before: structs of verified, eligible, items, unresolved, ranked, decisions, abstentions; events_removed,
    corrections, edges; shift, the largest change of a category's share) with reasons, what blocks a release."""
    n, b = (lambda c: F.col(f"now.{c}")), (lambda c: F.col(f"before.{c}"))
    share = lambda a, z: F.coalesce(F.try_divide(a, z), F.lit(0.0))
    rules = {
        "verified_uses_collapsed_to_zero": (b("verified") >= 3) & (n("verified") == 0) & (n("eligible") >= b("eligible")),
        "extraction_items_collapsed_to_zero": (b("items") >= 10) & (n("items") == 0) & (n("verified") > 0),
        "removal_spike": (F.col("events_removed") > 0) & (share(F.col("events_removed"), F.col("edges")) > REMOVAL_SHARE),
        "extraction_drop": (b("items") >= 10) & (n("verified") >= b("verified")) & (n("items") * 2 < b("items")),
        "unresolved_spike": (b("unresolved") >= 5) & (n("unresolved") >= 10) & (n("unresolved") > b("unresolved") * 2),
        "identity_shift": (F.col("corrections") > 0) & (share(F.col("corrections"), F.col("edges")) > REMOVAL_SHARE),
        "abstention_spike": (b("decisions") >= 20) & (n("decisions") >= 20) & (share(n("abstentions"), n("decisions")) - share(b("abstentions"), b("decisions")) > ABSTENTION_GAIN),
        "category_distribution_shift": (b("ranked") >= 20) & (n("ranked") >= 20) & (F.col("shift") > SHARE_SHIFT),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return metrics.withColumn("reasons", found).withColumn("block", F.size("reasons") > 0)


def manifest(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """dataset, n, digest for named tables and the columns that say something: order and partitions change nothing."""
    from loomspan.operators.observation import snapshot_hash

    out = None
    for name, (rows, columns) in tables.items():
        own = snapshot_hash(rows, columns).select(F.lit(name).alias("dataset"), "n", "digest")
        out = own if out is None else out.unionByName(own)
    return out


def to_publish(now: DataFrame, before: DataFrame) -> DataFrame:
    """dataset, publish: which datasets' digests are new or changed."""
    was = before.select("dataset", F.col("digest").alias("_d"))
    return now.join(was, "dataset", "left").select("dataset", (F.col("_d").isNull() | (F.col("_d") != F.col("digest"))).alias("publish"))


def migrated(rows: DataFrame, version: str, steps: dict[tuple[int, int], object], target: int) -> DataFrame:
    """Rows brought to the target version, one step after the other, a direct step first. steps: (from, to) and a function from
    DataFrame to DataFrame. No way from a version that occurs, or a way in a circle, is an error."""
    out, present = None, sorted(r[version] for r in rows.select(version).distinct().collect())  # a few versions
    for v in present:
        own, at, passed = rows.where(F.col(version) == v), v, {v}
        while at != target:
            nxt = target if (at, target) in steps else next((b for a, b in sorted(steps) if a == at), None)
            if nxt is None or nxt in passed:
                raise ValueError(f"no way from version {v} to {target}")
            own, at = steps[at, nxt](own).withColumn(version, F.lit(nxt)), nxt
            passed.add(at)
        out = own if out is None else out.unionByName(own)
    return rows.where("false") if out is None else out


#: Outcomes of a look that failed; coverage and outcomes that prove something.
FAILED = ("timeout", "http_failure", "network_failure", "dns_failure", "tls_failure", "deferred", "robots_disallowed", "budget_exhausted")


def removals(observations: DataFrame, policies: DataFrame, source: str, family: str) -> DataFrame:
    """source, may_remove, reason: whether looks at a source (outcome, coverage, found: why it was looked at) may remove it by the policy
    of its family (family, meaning, feeds: whether looks at feeds prove absences)."""
    rows = observations.join(policies, family, "left")
    complete = (F.col("coverage") == "complete") & F.col("outcome").isin("success", "unchanged")
    proves = (F.col("coverage") == "complete") & (F.col("outcome") == "success") & (F.coalesce("feeds", F.lit(True)) | ~F.coalesce(F.col("found"), F.lit("")).rlike("(?i)feed|rss|atom"))
    g = rows.groupBy(source).agg(F.bool_or(F.col("outcome").isin(*FAILED)).alias("failed"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("complete"), F.bool_or(F.coalesce(proves, F.lit(False))).alias("proves"), F.max("meaning").alias("meaning"))
    meaning = F.coalesce("meaning", F.lit("none"))
    reason = F.when(F.col("failed"), "failed-or-incomplete-fetch").when(~F.col("complete"), "incomplete-coverage").when(~F.col("proves"), "policy-rejects-absence").otherwise(F.concat(F.when(meaning == "none", "disappearance-means-").otherwise("disappearance-"), meaning))
    return g.select(source, (reason == "disappearance-removal").alias("may_remove"), reason.alias("reason"))


def request_view(states: DataFrame, families: DataFrame, site: str) -> DataFrame:
    """site, requests, categories of open requests (site, category, request) by the primary of their site's family."""
    own = families.select(F.col("secondary").alias(site), F.col("primary").alias("_p"))
    rows = states.join(own, site, "left").withColumn(site, F.coalesce("_p", site))
    return rows.groupBy(site).agg(F.countDistinct("request").alias("requests"), F.countDistinct(F.lower("category")).alias("categories"))


def migration_report(claims: DataFrame) -> DataFrame:
    """part, n of classified claims (origin, name, stored, tool, role): merged (an observed id that has a tool now), compounds (names
    joined by and or with), and what each role holds."""
    part = F.array(
        F.when((F.col("role") == "ranked") & F.col("stored").startswith("observed:") & F.col("tool").isNotNull(), "merged"), F.when(F.col("name").rlike(r"(?i)\b(and|with)\b"), "compounds"),
        F.when(F.col("role") == "ranked", "slots").when(F.col("role") == "detail", "details").when(F.col("role") == "rejected", "rejected").otherwise("unsorted"),
    )
    return claims.select(F.explode(F.filter(part, lambda x: x.isNotNull())).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
