"""Feeds, calendars, outlines and manifests out of rows: one document for each key, from a bounded number of its rows.

A document is a list by nature (a feed shows its latest entries): `most` bounds what one key's document holds, so that no group
is gathered without a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import escaped
from loomspan.operators.ranking import capped

MOST = 50


def _joined(rows: DataFrame, key: str, order: list[Column], part: Column, most: int) -> DataFrame:
    """key, parts: the parts of each key's first `most` rows, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    top = capped(rows, [key], order, most).withColumn("_k", F.row_number().over(w)).select(key, "_k", part.alias("_p"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_p"))), lambda x: x["_p"]), "").alias("parts"))


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def atom(rows: DataFrame, key: str, url: str, title: str, summary: str, at: str, categories: str | None = None, most: int = MOST) -> DataFrame:
    """key, body: an Atom feed of the latest rows of each key. Rows without a time are left out."""
    c = lambda k: escaped(F.coalesce(F.col(k).cast("string"), F.lit("")))
    terms = F.array_join(F.transform(F.col(categories), lambda x: F.concat(F.lit('<category term="'), escaped(x), F.lit('"/>'))), "") if categories else F.lit("")
    entry = F.concat(F.lit("<entry><id>"), c(url), F.lit('</id><link href="'), c(url), F.lit('"/><title>'), c(title), F.lit("</title><updated>"), _stamp(F.col(at)), F.lit("</updated>"), terms, F.lit("<summary>"), c(summary), F.lit("</summary></entry>"))
    out = _joined(rows.where(F.col(at).isNotNull()), key, [F.desc(at), F.col(url)], entry, most)
    return out.select(key, F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'), escaped(F.col(key).cast("string")), F.lit("</title>"), F.col("parts"), F.lit("</feed>")).alias("body"))


def json_feed(rows: DataFrame, key: str, url: str, title: str, summary: str, at: str, most: int = MOST) -> DataFrame:
    """key, body: a JSON Feed of the latest rows of each key."""
    item = F.to_json(F.struct(F.col(url).alias("id"), F.col(url).alias("url"), F.col(title).alias("title"), F.col(summary).alias("summary"), _stamp(F.col(at)).alias("date_published")))
    out = _joined(rows, key, [F.desc(at), F.col(url)], F.concat(F.lit(","), item), most)
    return out.select(key, F.concat(F.lit('{"version":"https://jsonfeed.org/version/1.1","items":['), F.substring(F.col("parts"), F.lit(2), F.length("parts")), F.lit("]}")).alias("body"))


def calendar(rows: DataFrame, key: str, uid: str, title: str, start: str, days: int = 1, most: int = MOST) -> DataFrame:
    """key, body: an iCalendar of whole-day events in order of their start. Rows without a start are left out; commas, semicolons,
    backslashes and line ends in titles are escaped."""
    t = F.col(title)
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col(uid).cast("string"), F.lit("\r\nDTSTART;VALUE=DATE:"), day(F.col(start)), F.lit("\r\nDTEND;VALUE=DATE:"), day(F.date_add(start, days)), F.lit("\r\nSUMMARY:"), t, F.lit("\r\nEND:VEVENT\r\n"))
    out = _joined(rows.where(F.col(start).isNotNull()), key, [F.col(start), F.col(uid)], event, most)
    return out.select(key, F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), F.col("parts"), F.lit("END:VCALENDAR\r\n")).alias("body"))


def outline(rows: DataFrame, key: str, title: str, page: str, feed: str, most: int = 1000) -> DataFrame:
    """key, body: an outline of pages and their feeds, by title."""
    c = lambda k: escaped(F.coalesce(F.col(k).cast("string"), F.lit("")))
    line = F.concat(F.lit('<outline type="rss" text="'), c(title), F.lit('" htmlUrl="'), c(page), F.lit('" xmlUrl="'), c(feed), F.lit('"/>'))
    return _joined(rows, key, [F.col(title), F.col(page)], line, most).select(key, F.concat(F.lit('<opml version="2.0"><body>'), F.col("parts"), F.lit("</body></opml>")).alias("body"))


def collection(rows: DataFrame, key: str, name: str, item: Column, order: list[Column], most: int = 1000) -> DataFrame:
    """key, body: a JSON document with the rows under a name, which is left out where there are none (rows with a null item)."""
    out = _joined(rows, key, order, F.coalesce(F.concat(F.lit(","), F.to_json(item)), F.lit("")), most)
    listed = F.concat(F.lit(f',"{name}":['), F.substring(F.col("parts"), F.lit(2), F.length("parts")), F.lit("]"))
    return out.select(key, F.concat(F.lit('{"schema_version":1'), F.when(F.col("parts") != "", listed).otherwise(F.lit("")), F.lit("}")).alias("body"))


def markdown(rows: DataFrame, key: str, title: str, url: str, most: int = MOST) -> DataFrame:
    """key, body: a page with a list of links, by title."""
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(url), F.lit(")\n"))
    return _joined(rows, key, [F.col(title), F.col(url)], line, most).select(key, F.concat(F.lit("# "), F.col(key).cast("string"), F.lit("\n\n"), F.col("parts")).alias("body"))
