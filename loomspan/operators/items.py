"""Content items and topics: merging drafts, joining pages, evidence by precedence, catalogs, views by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.ranking import capped, first_per

#: Precedence of evidence, pieces of it that are shown.
CLASSES, SHOWN, PAGES = ("declared", "heuristic", "observed"), 8, 8


def class_rank(c):
    return F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), c).cast("int"), F.lit(0)) - 1


def merged(drafts: DataFrame, key: str, order: list[str], fields: list[str], sets: list[str]) -> DataFrame:
    """One item for each key: of each field the first value in order that isn't null or empty, of each array column all its values,
    distinct and sorted, and the number of drafts. No list of drafts is built: sums of arrays are of values, each once."""
    where = F.struct(*order)
    first = [F.min_by(F.when(F.col(f).cast("string") != "", F.col(f)), F.when(F.col(f).cast("string") != "", where)).alias(f) for f in fields]
    out = drafts.groupBy(key).agg(*first, F.count("*").alias("drafts"))
    for s in sets:
        own = drafts.select(key, F.explode(s).alias("_v")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(s))
        out = out.join(own, key, "left").withColumn(s, F.coalesce(s, F.array().cast(own.schema[s].dataType)))
    return out


def with_pages(items: DataFrame, pages: DataFrame, url: str, fields: list[str], order: str) -> DataFrame:
    """Items with fields of the last page of their address filled in where they have none of their own."""
    last = pages.groupBy(url).agg(F.max_by(F.struct(*fields), order).alias("_p"))
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_p.{f}")) for f in fields}
    return items.join(last, url, "left").withColumns(filled).drop("_p")


def by_slug(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, label, pages, pieces: evidence (keys, class, label, page, at) of a slug as one: the strongest class decides, the
    latest label stands, pages are counted once."""
    g = evidence.groupBy(*keys).agg(F.min(class_rank(F.col("class"))).alias("_r"), F.max_by("label", F.struct("at", "label")).alias("label"), F.countDistinct("page").alias("pages"), F.count("*").alias("pieces"))
    return g.withColumn("class", F.get(F.array(*map(F.lit, CLASSES)), F.col("_r"))).drop("_r")


def shown_evidence(evidence: DataFrame, keys: list[str], identity: list[str], at: str, most: int = SHOWN) -> DataFrame:
    """Of equal pieces the latest, and of a key the first `most` by identity."""
    latest = first_per(evidence, [*keys, *identity], [F.desc(at)])
    return capped(latest, keys, [F.col(c) for c in identity], most)


def split_topics(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared rows, and those that are only signals."""
    return evidence.where("class = 'declared'"), evidence.where("class <> 'declared'")


def hub(rows: DataFrame, slug: str, site: str, page: str, most: int = PAGES) -> DataFrame:
    """slug, site, pages (the first `most` by address), all: topics by site."""
    own = rows.select(slug, site, page).distinct()
    n = own.groupBy(slug, site).agg(F.count("*").alias("all"))
    first = capped(own, [slug, site], [F.col(page)], most).groupBy(slug, site).agg(F.array_join(F.array_sort(F.collect_list(page)), ",").alias("pages"))
    return n.join(first, [slug, site])


def catalog_origin(topics: DataFrame, origin: str, slug: str) -> DataFrame:
    """One row: the origin with most topics, the least name of equals."""
    return topics.groupBy(origin).agg(F.countDistinct(slug).alias("n")).orderBy(F.desc("n"), origin).limit(1)


def catalog(topics: DataFrame, origin: str, slug: str, label: str) -> DataFrame:
    """slug, label: all topics, each with the label of its first origin."""
    return topics.groupBy(slug).agg(F.min_by(label, F.struct(origin, label)).alias(label))


def site_view(sites: DataFrame, edges: DataFrame, topics: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Sites with their outgoing and incoming edges, topics and latest item: three grouped sides, unmatched sites stay."""
    out = edges.groupBy(F.col("source").alias(key)).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col("target").alias(key)).agg(F.count("*").alias("incoming"))
    many = topics.groupBy(key).agg(F.countDistinct("slug").alias("topics"))
    last = items.groupBy(key).agg(F.max_by("item", F.struct("at", "item")).alias("recent"))
    rows = sites
    for side in (out, into, many, last):
        rows = rows.join(side, key, "left")
    return rows.na.fill(0, ["outgoing", "incoming", "topics"])


def with_related(own: DataFrame, related: DataFrame, keys: list[str], count: str) -> DataFrame:
    """own, and those of related that it lacks, counted 0."""
    more = related.select(*keys).distinct().join(own.select(*keys), keys, "left_anti").withColumn(count, F.lit(0).cast(own.schema[count].dataType))
    return own.select(*keys, count).unionByName(more)
