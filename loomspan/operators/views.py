"""What is shown and checked: items with their site, listings, registries, aliases, reports of what is wrong."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.functions import labels as lb
from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.operators import graph

#: Enums of an observation; keys of JSON objects that only say when; relations of topics.
OUTCOMES, COMPLETE = ("changed", "unchanged", "missing", "failed"), ("complete", "partial", "unknown")
TIMES = frozenset({"generated_at", "observed_at", "checked_at", "last_checked", "captured_at"})
RELATED = ("broader", "related")


def display(items: DataFrame, sites: DataFrame, public: DataFrame, site: str) -> DataFrame:
    """Items (site, item, url, title, topics: array of slugs) with their site's title, and tags: their topics, each once, and which of
    these are public. A site without a title of several words is shown by its host. Public slugs are joined, never gathered."""
    rows = items.join(sites.select(site, F.col("title").alias("_t"), F.col("domain").alias("_d")), site, "left")
    shown = F.when(F.trim("_t").rlike(r"\s"), F.trim("_t")).otherwise(F.coalesce(F.nullif(F.trim("_t"), F.lit("")), F.nullif(F.col("_d"), F.lit("")), urls.host(F.col(site)), F.col(site)))
    own = items.select("item", F.explode(F.array_distinct("topics")).alias("slug")).join(public.select("slug"), "slug", "left_semi").groupBy("item").agg(F.array_sort(F.collect_list("slug")).alias("neighbourhoods"))
    return rows.join(own, "item", "left").select("item", site, "url", "title", shown.alias("publisher"), F.array_distinct("topics").alias("tags"), F.coalesce("neighbourhoods", F.array().cast("array<string>")).alias("neighbourhoods"))


def publishable(items: DataFrame, site: str, feed: str) -> DataFrame:
    """Items with a web address, on their own site's or their feed's host."""
    web = urls.origin(F.col("url")).isNotNull()
    return items.where(web & (urls.of_site(F.col("url"), F.col(site)) | urls.of_site(F.col("url"), F.col(feed))))


def first_by_url(items: DataFrame, url: str, order: list[Column]) -> DataFrame:
    """One item of each address, the first in order."""
    from loomspan.operators.ranking import first_per

    return first_per(items.withColumn("_u", urls.without_fragment(F.col(url))), ["_u"], order).drop("_u")


def registry(documents: DataFrame, body: str) -> DataFrame:
    """origin, name, count of the members in registry documents (JSON, `nodes`) whose last check was valid; count says how many
    nodes name the origin, so that more than one is an error. Origins that aren't canonical are null."""
    node = "struct<origin:string,name:string,latest_declaration_check_outcome:string>"
    rows = documents.select(F.explode(F.from_json(body, f"struct<version:int,nodes:array<{node}>>")["nodes"]).alias("n")).select("n.*")
    canonical = F.when((urls.origin(F.col("origin")) == F.lower("origin")) & ~F.col("origin").rlike("[/?#]$"), urls.origin(F.col("origin")))
    valid = rows.where("latest_declaration_check_outcome = 'valid'").select(canonical.alias("origin"), "name")
    return valid.groupBy("origin").agg(F.min("name").alias("name"), F.count("*").alias("count"))


def collection(documents: DataFrame, key: str, body: str, name: str, item: str) -> DataFrame:
    """key, n, item of JSON documents that are a list, or hold one under a name; those that hold none give nothing."""
    text = F.trim(F.col(body))
    listed = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, f"$.{name}"))
    return documents.select(key, F.posexplode(F.from_json(listed, f"array<{item}>")).alias("n", "item"))


def alias_rows(aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From aliases (from, to, kind): equivalent ones by folded slug, relations, and errors (code, from, to): aliases that aren't
    equivalent, that have two targets (the least is followed), or that lead in a circle, of whatever length: its least member stands for it."""
    fold = lambda c: tx.singular_slug(tx.slug(F.col(c)))
    rows = aliases.select(fold("from").alias("from"), fold("to").alias("to"), F.coalesce("kind", F.lit("equivalent")).alias("kind")).where("`from` <> '' AND `to` <> '' AND `from` <> `to`").distinct()
    relations, own = rows.where(F.col("kind").isin(*RELATED)), rows.where(~F.col("kind").isin(*RELATED))
    good = own.where("kind = 'equivalent'").groupBy("from").agg(F.min("to").alias("to"), F.countDistinct("to").alias("n"))
    odd = own.where("kind <> 'equivalent'").select(F.lit("alias-not-equivalent").alias("code"), "from", "to")
    several = good.where("n > 1").select(F.lit("alias-conflict").alias("code"), "from", "to")
    ends = graph.closure(good.select("from", "to"), "from", "to").where("`from` = `to`").select("from")
    circle = good.select("from", "to").join(ends, "from").select(F.lit("alias-cycle").alias("code"), "from", "to")
    return good.select("from", "to"), relations, odd.unionByName(several).unionByName(circle)


def catalog_matches(found: DataFrame, declared: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys (origin, slug), hits: topics of a catalog that an origin's items mention (found: keys, item) and that it doesn't declare."""
    return found.join(declared.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.countDistinct(item).alias("hits"))


def assessed(pages: DataFrame, origin: str, order: str) -> DataFrame:
    """origin, url, state: the first page of each origin that lists uses by its path (url, digest, outcome): out_of_scope where it
    was found so or repeats the homepage, else assessed; not_found without such a page."""
    path = urls.path(F.col("url"))
    own = pages.where(path.rlike(r"(?i)/uses(?:\.html?)?$") | (F.col("outcome") == "out_of_scope")).groupBy(origin).agg(F.min_by(F.struct("url", "digest", "outcome"), order).alias("u"))
    home = pages.where(path == "/").groupBy(origin).agg(F.min_by("digest", order).alias("h"))
    rows = pages.select(origin).distinct().join(own, origin, "left").join(home, origin, "left")
    state = F.when(F.col("u").isNull(), "not_found").when((F.col("u.outcome") == "out_of_scope") | F.coalesce(F.col("u.digest") == F.col("h"), F.lit(False)), "out_of_scope").otherwise("assessed")
    return rows.select(origin, "u.url", state.alias("state"))


def repeats_home(pages: DataFrame, origin: str) -> DataFrame:
    """pages (url, title, canonical, digest) with repeats: whether a page is the homepage served again: the same title, and either
    the homepage's canonical place, or none of its own and the same text."""
    home = pages.where(urls.path(F.col("url")) == "/").groupBy(origin).agg(F.min("title").alias("_t"), F.min("digest").alias("_g"))
    rows = pages.join(home, origin, "left")
    same = (urls.path(F.col("url")) != "/") & (F.col("title") != "") & (F.col("title") == F.col("_t"))
    own = F.coalesce(F.col("canonical"), F.lit(""))
    again = F.when(own != "", urls.path(own) == "/").otherwise(F.col("digest") == F.col("_g"))
    return rows.withColumn("repeats", F.coalesce(same & again, F.lit(False))).drop("_t", "_g")


def corrections(events: DataFrame, pairs: DataFrame, current: DataFrame) -> DataFrame:
    """One row: collapses (observed ids removed by a correction whose canonical id is still current) and corrections (the others).
    events: event_type, status, tool_id; pairs: observed, canonical; current: tool_id."""
    gone = events.where("event_type = 'correction' AND status = 'removed' AND tool_id <> ''")
    kept = pairs.join(current.select(F.col("tool_id").alias("canonical")).distinct(), "canonical", "left_semi").select(F.col("observed").alias("tool_id")).distinct().withColumn("_k", F.lit(True))
    rows = gone.join(kept, "tool_id", "left")
    hit = F.coalesce(F.col("_k") & F.col("tool_id").startswith("observed:"), F.lit(False))
    return rows.agg(F.count_if(hit).alias("collapses"), F.count_if(~hit).alias("corrections"))


def provenance(manifests: DataFrame, durable: DataFrame, run: str) -> DataFrame:
    """run, errors of manifests (run, status, sha) against durable records (run, status, sha)."""
    d = durable.select(run, F.col("status").alias("_s"), F.col("sha").alias("_h"), F.lit(True).alias("_d"))
    rows = manifests.join(d, run, "left")
    rules = {"no durable record": F.col("_d").isNull(), "not committed": F.col("_s") != "committed", "no sha": F.col("_d").isNotNull() & (F.coalesce("_h", F.lit("")) == ""), "not validated": F.col("status") != "validated", "sha in manifest": F.coalesce("sha", F.lit("")) != ""}
    found = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return rows.select(run, F.array_join(found, ",").alias("errors"))


def sync_reasons(members: DataFrame, entries: DataFrame, key: str, value: str, captured: str, now: Column) -> DataFrame:
    """key, reason for each member that is new, changed, gone, or captured more than a day ago; nothing where all is in step."""
    both = members.select(key, F.col(value).alias("_n"), F.lit(True).alias("_m")).join(entries.select(key, F.col(value).alias("_o"), captured, F.lit(True).alias("_e")), key, "full_outer")
    stale = F.col(captured).isNull() | (now - F.col(captured) >= F.make_dt_interval(F.lit(1)))
    reason = F.when(F.col("_e").isNull(), "new").when(F.col("_m").isNull(), "gone").when(~F.col("_n").eqNullSafe(F.col("_o")), "changed").when(stale, "stale")
    return both.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def lookup_keys(origin: Column) -> Column:
    """An origin as it is, then with or without www."""
    other = F.when(origin.rlike(r"^https?://www\."), F.regexp_replace(origin, r"//www\.", "//")).otherwise(F.regexp_replace(origin, "//", "//www."))
    return F.array(origin, other)


def rooted(origins: DataFrame, roots: DataFrame, origin: str) -> DataFrame:
    """origins with the path that is set for them (roots: origin, path), by the first of their keys that has one; null without."""
    keys = origins.select(F.col(origin).alias("_o"), F.posexplode(lookup_keys(F.col(origin))).alias("_k", "origin"))
    best = keys.join(roots.select("origin", "path"), "origin").groupBy("_o").agg(F.min_by("path", "_k").alias("path"))
    return origins.join(best.withColumnRenamed("_o", origin), origin, "left")


def under_root(base: Column, href: Column) -> Column:
    """href resolved below a root: / means the root's own path."""
    b = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(href.rlike("^/[^/]|^/$"), F.concat(b, F.regexp_replace(href, "^/+", ""))).otherwise(urls.same_resource(b, href))


def event_id(version: int, *fields: str) -> Column:
    """The digest of an event's fields in the order of their names, with the version of the rules."""
    return tx.content_id(F.concat(F.lit(f"event:v{version}:"), F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})))


@F.pandas_udf(StringType())
def semantic_hash(c: pd.Series) -> pd.Series:
    """The digest of JSON texts without keys that only say when, whatever the order of keys; null for what isn't JSON."""
    import hashlib
    import json

    def strip(v):
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in TIMES}
        return [strip(x) for x in v] if isinstance(v, list) else v

    def one(t):
        try:
            return "sha256:" + hashlib.sha256(json.dumps(strip(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return c.map(one)


def proposals(claims: DataFrame, key: str, prompt: Column, classify, threshold: float, margin: float, cache: DataFrame | None = None) -> DataFrame:
    """key, slot, cached of claims by a model: each distinct prompt is classified once (classify: texts to lists of (slot, score)), unless the
    cache (prompt, slot) knows it. A slot is taken if its score reaches the threshold and leads by the margin."""
    rows = claims.select(key, prompt.alias("prompt"))
    todo = rows.select("prompt").distinct()
    if cache is not None:
        todo = todo.join(cache.select("prompt"), "prompt", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = []
            for scores in classify(b["prompt"].tolist()):
                ranked = sorted(scores, key=lambda s: (-s[1], s[0]))
                ok = ranked and ranked[0][1] >= threshold and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= margin)
                slots.append(ranked[0][0] if ok else None)
            yield pd.DataFrame({"prompt": b["prompt"], "slot": slots})

    new = todo.mapInPandas(run, "prompt string, slot string").withColumn("cached", F.lit(False))
    known = new if cache is None else new.unionByName(cache.select("prompt", "slot").withColumn("cached", F.lit(True)))
    return rows.join(known, "prompt").select(key, "slot", "cached")


def observation_errors(rows: DataFrame, key: str) -> DataFrame:
    """key, errors of observations (outcome, completeness, url, observed_at) whose fields lack or are out of their enums."""
    rules = {"outcome": ~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "completeness": ~F.coalesce(F.col("completeness").isin(*COMPLETE), F.lit(False)), "url": urls.origin(F.col("url")).isNull(), "time": F.col("observed_at").isNull()}
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return rows.select(key, F.array_join(found, ",").alias("errors"))


def attribution_errors(items: DataFrame, key: str, site: str) -> DataFrame:
    """code, key of shown items with weak titles, those that double another by a fragment, and those that lie elsewhere."""
    bad = items.where(tx.is_weak_title(F.col("title"))).select(F.lit("weak-title").alias("code"), key)
    doubled = items.where(F.col("url").contains("#")).withColumn("_u", urls.without_fragment(F.col("url"))).join(items.select(F.col("url").alias("_u")).distinct(), "_u", "left_semi").select(F.lit("fragment-double").alias("code"), key)
    away = items.where(~urls.of_site(F.col("url"), F.col(site))).select(F.lit("elsewhere").alias("code"), key)
    return bad.unionByName(doubled).unionByName(away)


def topic_report(topics: DataFrame, members: DataFrame) -> DataFrame:
    """code, n of public topics (slug) and their members (slug, membership, pages): slugs that name no subject, artifacts, suggested
    members without evidence, topics without members."""
    t = topics.select("slug").distinct()
    rows = t.where(tx.is_no_subject(F.col("slug"))).select(F.lit("no-subject").alias("code")).unionByName(t.where(tx.is_artifact(F.col("slug"))).select(F.lit("artifact").alias("code")))
    rows = rows.unionByName(members.where("membership = 'heuristic' AND pages = 0").select(F.lit("no-evidence").alias("code"))).unionByName(t.join(members, "slug", "left_anti").select(F.lit("no-members").alias("code")))
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def described(c: Column) -> Column:
    """A description as it is shown, and what it is worth: 0 none, 1 short, 2 a sentence or more."""
    d = lb.description(F.coalesce(c, F.lit("")))
    return F.struct(d.alias("text"), F.when(d == "", 0).when(F.length(d) < 40, 1).otherwise(2).alias("worth"))
