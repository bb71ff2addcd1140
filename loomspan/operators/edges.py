"""Link graphs: typed edges, unions with what was known, blogrolls, families of sites, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import urls

#: Relations that pages mark, in order of precedence; relations that may be carried on, and the one that is renamed.
MARKED = (("u-in-reply-to", "reply-to"), ("u-repost-of", "repost-of"), ("u-syndication", "syndication"))
CARRIED, INFERRED = ("homepage-link", "content-link", "blogroll", "reply-to", "repost-of", "syndication"), ("friend", "topic")


def relation(rel: Column, classes: Column, page: Column, source: Column, credit: Column) -> Column:
    """An edge's relation: a credit first, then what the link's classes or rel mark, then whether it stands on the homepage."""
    out = F.when(credit, "credit")
    for name, value in MARKED:
        out = out.when(F.array_contains(classes, name) | F.array_contains(rel, name.removeprefix("u-")), value)
    return out.when(F.regexp_replace(page, r"[/?#]*$", "") == source, "homepage-link").otherwise("content-link")


def observed(links: DataFrame, members: DataFrame, member: str, hub: str | None = None) -> DataFrame:
    """source, target, href, page, rel, classes, text of links (page, href, rel, classes, text) between two different members, each
    (source, target, href, page) once, none to or from the hub. Addresses are resolved and lose what only tracks."""
    rows = links.withColumn("href", urls.without_tracking(urls.same_resource(F.col("page"), F.col("href")))).withColumn("source", urls.origin(F.col("page"))).withColumn("target", urls.origin(F.col("href")))
    rows = rows.where((F.col("source") != F.col("target")) & ~F.col("href").rlike(r"/\.well-known/"))
    if hub:
        rows = rows.where((F.col("source") != hub) & (F.col("target") != hub))
    m = members.select(F.col(member).alias("_m")).distinct()
    rows = rows.join(m, F.col("source") == F.col("_m"), "left_semi").join(m, F.col("target") == F.col("_m"), "left_semi")
    first = rows.groupBy("source", "target", "href", "page").agg(F.min(F.struct("text", "rel", "classes")).alias("x"))
    return first.select("source", "target", "href", "page", "x.*")


def blogroll(outlines: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """source, target, blogroll of outlines (source, url, blogroll): distinct edges between two different members."""
    rows = outlines.select("source", urls.origin(F.col("url")).alias("target"), "blogroll").where("source <> target")
    m = members.select(F.col(member).alias("_m")).distinct()
    near = rows.join(m, F.col("source") == F.col("_m"), "left_semi").join(m, F.col("target") == F.col("_m"), "left_semi")
    return near.groupBy("source", "target").agg(F.min("blogroll").alias("blogroll"))


def carried(edges: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Edges (source, target, relation, href, page) of sources that weren't read this time: inferred relations go, unknown ones are
    content links, addresses lose what only tracks, empty ones become the site's own."""
    rows = edges.join(sources.select(F.col(source).alias("source")).distinct(), "source", "left_semi").where(~F.col("relation").isin(*INFERRED))
    filled = lambda c, site: F.coalesce(F.nullif(F.col(c), F.lit("")), F.concat(F.col(site), F.lit("/")))
    return rows.select("source", "target", F.when(F.col("relation").isin(*CARRIED), F.col("relation")).otherwise("content-link").alias("relation"), urls.without_tracking(filled("href", "target")).alias("href"), filled("page", "source").alias("page"))


def united(new: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, relation, first_page, first_href, evidence_count over new and known edges; credits aren't kept from before."""
    both = new.select("source", "target", "relation", "page", "href").unionByName(known.where("relation <> 'credit'").select("source", "target", "relation", "page", "href")).distinct()
    g = both.groupBy("source", "target", "relation").agg(F.min(F.struct("page", "href")).alias("x"), F.count("*").alias("evidence_count"))
    return g.select("source", "target", "relation", F.col("x.page").alias("first_page"), F.col("x.href").alias("first_href"), "evidence_count")


def promoted(rows: DataFrame, families: DataFrame, ends: list[str]) -> DataFrame:
    """rows with each end replaced by the primary of its family (families: secondary, primary); others stay."""
    for e in ends:
        own = families.select(F.col("secondary").alias(e), F.col("primary").alias("_p"))
        rows = rows.join(own, e, "left").withColumn(e, F.coalesce("_p", e)).drop("_p")
    return rows


def family_errors(families: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """code, origin: origins in several families, secondaries that are primaries too, and those that are no members."""
    m = members.select(F.col(member).alias("origin"))
    twice = families.groupBy(F.col("secondary").alias("origin")).agg(F.countDistinct("primary").alias("n")).where("n > 1").select(F.lit("several-families").alias("code"), "origin")
    both = families.select(F.col("secondary").alias("origin")).distinct().join(families.select(F.col("primary").alias("origin")), "origin", "left_semi").select(F.lit("primary-too").alias("code"), "origin")
    every = families.select(F.explode(F.array("secondary", "primary")).alias("origin")).distinct()
    return twice.unionByName(both).unionByName(every.join(m, "origin", "left_anti").select(F.lit("no-member").alias("code"), "origin"))


def both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs from either side: (a, b) and (b, a)."""
    rest = [c for c in pairs.columns if c not in (left, right)]
    return pairs.unionByName(pairs.select(F.col(right).alias(left), F.col(left).alias(right), *rest))
