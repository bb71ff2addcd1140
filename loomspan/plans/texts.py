"""Queries over texts, topics, URLs and pages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import content, urls
from loomspan.functions import text as tx
from loomspan.operators import quality, ranking, topics
from loomspan.plans.registry import query
from loomspan.sources.pages import links, regions
from loomspan.sources.tables import table


@query(r"""
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)
SELECT p_partkey, CASE WHEN s <> '' THEN rtrim(substr(s, 1, 80), '-') ELSE 'u-' END AS slug FROM s
""")
def slugify(spark: SparkSession, root: str) -> DataFrame:
    """Slugs of part names."""
    return table(spark, root, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents)
SELECT word, CASE WHEN word IN ('acoustics', 'alias', 'analysis', 'analytics', 'athletics', 'atlas', 'business', 'canvas', 'chaos', 'classics', 'css', 'devops', 'economics', 'ethics', 'gas', 'go', 'graphics', 'lens', 'linguistics', 'mathematics', 'mechanics',
  'news', 'physics', 'plus', 'politics', 'postgres', 'robotics', 'series', 'species', 'statistics', 'this', 'windows') OR length(word) < 5 THEN word WHEN word LIKE '%ies' THEN substr(word, 1, length(word) - 3) || 'y'
  WHEN regexp_matches(word, '(xes|zes|ches|shes|sses)$') THEN substr(word, 1, length(word) - 2)
  WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|sis|us|is|as|os)$') THEN substr(word, 1, length(word) - 1) ELSE word END AS folded FROM w
""")
def plural_fold(spark: SparkSession, root: str) -> DataFrame:
    """The distinct words of documents and their singulars."""
    w = table(spark, root, "documents").select(F.explode(tx.letter_tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", tx.singular(F.col("word")).alias("folded"))


@query(r"""
SELECT page_id, CASE WHEN contains(url, '?') AND len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'dclid', 'gbraid', 'wbraid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', '_ga', '_gl'))) > 0
  THEN regexp_extract(url, '^([^?#]*)', 1)
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: NOT (starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'dclid', 'gbraid', 'wbraid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', '_ga', '_gl'))), '&'), ''), '')
    || regexp_extract(url, '(#.*)$', 1) ELSE url END AS url FROM pages
""")
def strip_tracking(spark: SparkSession, root: str) -> DataFrame:
    """Page URLs without parameters that only track."""
    return table(spark, root, "pages").select("page_id", urls.without_tracking(F.col("url")).alias("url"))


@query(r"""
WITH o AS (SELECT page_id, url, regexp_extract(lower(url), '^(https?://[^/?#@]+)([/?#]|$)', 1) AS o FROM pages)
SELECT page_id, nullif(regexp_replace(regexp_replace(o, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1'), '') AS origin, regexp_replace(url, '#.*$', '') AS bare FROM o
""")
def url_origin(spark: SparkSession, root: str) -> DataFrame:
    """Origins of pages, and their URLs without fragments."""
    u = F.col("url")
    return table(spark, root, "pages").select("page_id", urls.origin(u).alias("origin"), urls.without_fragment(u).alias("bare"))


@query(r"""
WITH p AS (SELECT page_id, lower(coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')) AS p, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS t FROM pages),
x AS (SELECT page_id, p || unnest(['', '/posts/1', '/a', '/notes/2026-08-30-0952']) AS p, t, unnest(['', 'posts', 'a', 'notes']) AS k FROM p
  UNION ALL SELECT page_id, '/' || w, t, w FROM p, (SELECT unnest(['health', 'homelab.html', 'galleries', 'galleries/x', 'fiction/x', 'fiction', 'photos/', 'speaking', 'tools.php', 'seeking', 'seeking/docs', 'index.htm', 'terms', 'tags/x', 'archive', 'essays/x', 'feed', 'docs/x']) AS w) WHERE page_id % 100 = 0),
y AS (SELECT *, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS q FROM x),
r AS (SELECT page_id, k, CASE WHEN regexp_matches(t, '\b404\b|not found') THEN 'error' WHEN regexp_matches(t, 'license|privacy policy|terms of|datapolicy|datenschutz|impressum') OR regexp_matches(q, 'licen[cs]e|third.?party|privacy|terms|legal|cookie|datenschutz|impressum') THEN 'legal'
  WHEN regexp_matches(q, '/(tag|tags|category|categories|topic|topics)\b') THEN 'tag-index' WHEN regexp_matches(q, '/(archive|archives|index)\b|/(posts|blog)$') THEN 'archive'
  WHEN regexp_matches(q, '/(about|bio|profile)\b') OR regexp_matches(q, '^/(me|now|uses|health|homelab|workouts|social|elsewhere|colophon|neighborhood|interests|site)(/|$|\.html?$)') THEN 'about'
  WHEN regexp_matches(q, '^/(portfolio|work|project|projects|gallery|galleries|albums|photography|photo|photos|art|illustration|artwork|painting|paintings|fiction|music|discography|tracks|videos|film|animation|game|games|interactive|exhibitions|design)/[^/]+') AND NOT q IN ('/photo/x') THEN 'project'
  WHEN substr(q, 2) IN ('portfolio', 'work', 'project', 'projects', 'gallery', 'galleries', 'albums', 'photography', 'photos', 'art', 'illustration', 'artwork', 'music', 'discography', 'tracks', 'videos', 'film', 'animation', 'game', 'games', 'interactive', 'exhibitions', 'design') THEN 'portfolio'
  WHEN regexp_matches(q, '/(doc|docs|documentation|guide|handbook)\b') THEN 'documentation' WHEN q IN ('/seeking', '/seeking.html') OR regexp_matches(q, '/(util|utility|login|search|feed|rss|atom)\b') THEN 'utility'
  WHEN q IN ('/speaking', '/talks', '/presentations', '/slides') THEN 'speaking-archive' WHEN q IN ('/tools.php', '/tools', '/sitemap', '/collections') THEN 'collection' WHEN q IN ('/', '/index.html', '/index.htm') THEN 'home'
  WHEN regexp_matches(q, '/notes/[0-9]{4}-[0-9]{2}-[0-9]{2}(-[0-9]{3,4})?(/|$)') THEN 'note' WHEN regexp_matches(q, '/(post|posts|blog|note|notes|essay|essays|tip|tips)/') THEN 'article' ELSE 'unknown' END AS role FROM y)
SELECT page_id, k, role, CASE WHEN role IN ('article', 'note', 'project') THEN 'full' WHEN role IN ('home', 'about', 'portfolio', 'documentation') THEN 'profile' WHEN role IN ('utility', 'legal', 'error', 'generated') THEN 'none' ELSE 'limited' END AS share FROM r
""")
def page_role(spark: SparkSession, root: str) -> DataFrame:
    """Roles of pages and of places below them, by path and title, and how much each says of its site's topics."""
    p = table(spark, root, "pages").select("page_id", urls.origin(F.col("url")).alias("o"), urls.path(F.col("url")).alias("path"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    below = F.array(*(F.struct(F.lit(k).alias("k"), F.concat("o", "path", F.lit(tail)).alias("u")) for k, tail in (("", ""), ("posts", "/posts/1"), ("a", "/a"), ("notes", "/notes/2026-08-30-0952"))))
    words = ("health", "homelab.html", "galleries", "galleries/x", "fiction/x", "fiction", "photos/", "speaking", "tools.php", "seeking", "seeking/docs", "index.htm", "terms", "tags/x", "archive", "essays/x", "feed", "docs/x")
    more = F.array(*(F.struct(F.lit(w).alias("k"), F.concat("o", F.lit("/" + w)).alias("u")) for w in words))
    rows = p.select("page_id", "title", F.explode(F.when(F.col("page_id") % 100 == 0, F.concat(below, more)).otherwise(below)).alias("x"))
    return rows.select("page_id", "x.k", urls.page_role(F.col("x.u"), F.col("title")).alias("role")).withColumn("share", urls.topic_share(F.col("role")))


@query(r"""
SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM pages
""")
def html_links(spark: SparkSession, root: str) -> DataFrame:
    """The targets of all links of pages."""
    return links(table(spark, root, "pages"))


@query(r"""
WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', ' ', 'g'), '(?s)<title>.*?</title>', ' ', 'g') AS b FROM pages)
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '(?s)<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS main,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(array_to_string(regexp_extract_all(b, '(?s)<nav>.*?</nav>|<footer>.*?</footer>'), ' '), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS around FROM b
""")
def html_regions(spark: SparkSession, root: str) -> DataFrame:
    """Title, language and visible text of pages, from a parser."""
    return regions(table(spark, root, "pages"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def unicode_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Texts in composed form."""
    docs = table(spark, root, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):  # few texts at a time, however long they are
                part = b.slice(a, 64)
                texts = [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.mapInArrow(run, docs.schema)


@query(r"""
WITH c AS (SELECT doc_id, list_transform(string_split(trim(regexp_replace(text, '[\s\x0B\x{a0}\x{2028}\x{2029}\x{202f}\x{3000}\x{feff}\x{1680}\x{205f}\x{2000}-\x{200a}]+', ' ', 'g')), ''), lambda x: unicode(x)) AS c FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, flatten(list_transform(list_filter(c, lambda x: x >= 0), lambda x: CASE WHEN x >= 65536 THEN [55296 + (x - 65536) // 1024, 56320 + (x - 65536) % 1024] ELSE [x] END)) AS u FROM c)
SELECT doc_id, CASE WHEN len(u) = 0 THEN '' ELSE lpad(printf('%x', CAST(list_reduce(list_prepend(2166136261, u), lambda h, x: (xor(CAST(h AS BIGINT), CAST(x AS BIGINT)) * 16777619) & 4294967295) AS BIGINT)), 8, '0') END AS fnv FROM u
""")
def fnv_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """32-bit FNV-1a over the UTF-16 units of whole document texts, as eight hex digits; empty for a blank text."""
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295))
    both = lambda h, x: F.when(x < 65536, step(h, x)).otherwise(step(step(h, F.expr("55296L") + F.floor((x - 65536) / 1024)), F.expr("56320L") + (x - 65536) % 1024))
    chars = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    d = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", tx.squeezed(F.col("text")).alias("t"))
    h = F.aggregate(chars, F.lit(2166136261).cast("bigint"), both)
    return d.select("doc_id", F.when(F.col("t") == "", "").otherwise(F.lower(F.lpad(F.hex(h), 8, "0"))).alias("fnv"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda w: length(w) > 2)) AS slug FROM documents),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t), g AS (SELECT slug, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY slug)
SELECT slug, tf, df, round(tf / n * ln(1 + n / (1 + df)), 6) AS value FROM g, n ORDER BY value DESC, slug LIMIT 200
""")
def topic_tfidf(spark: SparkSession, root: str) -> DataFrame:
    """The 200 weightiest words of documents."""
    words = F.filter(tx.letter_tokens(F.col("text")), lambda w: F.length(w) > 2)
    d = table(spark, root, "documents").select("doc_id", words.alias("w"))
    return topics.tfidf(d, "doc_id", "w", 200)


@query(r"""
WITH s AS (SELECT unnest(regexp_split_to_array(lower(text), '[.!?\n]+')) AS s FROM documents),
w AS (SELECT regexp_extract_all(s, '[\p{L}\p{M}\p{N}]+') AS w FROM s),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w WHERE len(w) > 1)
SELECT phrase, count(*) AS n FROM b GROUP BY phrase ORDER BY n DESC, phrase LIMIT 100
""")
def phrases_bigrams(spark: SparkSession, root: str) -> DataFrame:
    """The 100 commonest pairs of words within sentences of documents."""
    s = table(spark, root, "documents").select(F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s"))
    w = s.select(tx.letter_tokens(F.col("s")).alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return w.select(F.explode(pairs).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(100)


@query(r"""
WITH t AS (SELECT DISTINCT source, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) >= 9)) AS slug FROM documents),
g AS (SELECT slug, source, max(coalesce(quality, 0)) AS d FROM t LEFT JOIN labels USING (doc_id) GROUP BY ALL),
c AS (SELECT slug, count(*) AS members, max(d) = 1 AS declared FROM g GROUP BY slug)
SELECT slug, members, declared FROM c WHERE members >= 2 OR declared
""")
def topic_communities(spark: SparkSession, root: str) -> DataFrame:
    """Long words as topics: public with two sources, or with one document of quality."""
    long = F.filter(tx.letter_tokens(F.col("text")), lambda w: F.length(w) >= 9)
    d = table(spark, root, "documents").select("source", "doc_id", F.array_distinct(long).alias("slugs")).join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select("source", F.explode("slugs").alias("slug"), (F.coalesce("quality", F.lit(0)) == 1).alias("declared"))
    return topics.communities(rows, "slug", "source", "declared").where("public").drop("public")


@query(r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS line FROM documents),
b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:6], ' ') || ' ' AS phrase FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM d JOIN b ON contains(line, phrase)
""")
def mention_join(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold the first six words of a benchmark item."""
    b = table(spark, root, "benchmark").select("item_id", F.array_join(F.slice(tx.letter_tokens(F.col("text")), 1, 6), " ").alias("phrase"))
    return topics.mentions(table(spark, root, "documents"), "doc_id", "text", b, "item_id", "phrase").distinct()


@query(r"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w, lower(text) AS body FROM documents),
s AS (SELECT doc_id, source, CASE WHEN array_to_string(w[1:8], ' ') = 'the' THEN 12 WHEN contains(array_to_string(w[1:8], ' '), 'the') THEN 8 ELSE 0 END + CASE WHEN contains(body, 'the') THEN 2 ELSE 0 END
  + CASE WHEN array_to_string(w[1:8], ' ') = 'tion' THEN 12 WHEN contains(array_to_string(w[1:8], ' '), 'tion') THEN 8 ELSE 0 END + CASE WHEN contains(body, 'tion') THEN 2 ELSE 0 END
  + CASE WHEN source = 'the' OR source = 'tion' THEN 12 ELSE 0 END AS score FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT doc_id, source, CAST(score AS INT) AS score FROM c WHERE n <= 3 ORDER BY score DESC, doc_id LIMIT 40
""")
def search_rank(spark: SparkSession, root: str) -> DataFrame:
    """The best 40 documents for two words, three of a source at most."""
    head = F.regexp_extract("text", r"^(?:[^\p{L}\p{M}\p{N}]*[\p{L}\p{M}\p{N}]+){0,8}", 0)
    d = table(spark, root, "documents").select("doc_id", "source", F.array_join(tx.letter_tokens(head), " ").alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    d = d.select("doc_id", "source", tx.search_score("The tion", F.col("title"), F.col("body"), F.col("source"), F.array().cast("array<string>")).alias("score")).where("score > 0")
    return ranking.capped(d, ["source"], [F.desc("score"), F.col("doc_id")], 3).orderBy(F.desc("score"), "doc_id").limit(40)


@query(r"""
WITH w AS (SELECT DISTINCT source, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) >= 7)) AS slug FROM documents WHERE source IN ('src1', 'src2')),
a AS (SELECT slug FROM w WHERE source = 'src1'), b AS (SELECT slug FROM w WHERE source = 'src2')
SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' ELSE 'retained' END AS state FROM a FULL JOIN b ON a.slug = b.slug
""")
def topic_diff(spark: SparkSession, root: str) -> DataFrame:
    """Long words of two sources: added, removed or retained from one to the other."""
    w = table(spark, root, "documents").where("source IN ('src1', 'src2')").select("source", F.explode(F.filter(tx.letter_tokens(F.col("text")), lambda x: F.length(x) >= 7)).alias("slug")).distinct()
    per = w.groupBy("slug").agg(F.bool_or(F.col("source") == "src1").alias("was"), F.bool_or(F.col("source") == "src2").alias("is"))
    return per.select("slug", F.when(~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("retained").alias("state"))


@query("""
WITH u AS (SELECT vec_id, unnest(embedding[1:8]) AS s, unnest(range(1, 9)) AS id FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS n FROM u),
t AS (SELECT vec_id, max(CASE WHEN n = 1 THEN s END) AS a, max(CASE WHEN n = 2 THEN s END) AS b, max(CASE WHEN n = 1 THEN id END) AS id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN a >= 0.2 AND CAST(a AS DOUBLE) - CAST(b AS DOUBLE) >= 0.05 THEN id END AS INT) AS accepted FROM t
""")
def accept_proposal(spark: SparkSession, root: str) -> DataFrame:
    """The best of eight scores if it is high enough and far enough before the second."""
    scored = F.array_sort(F.transform(F.slice("embedding", 1, 8), lambda s, i: F.struct((-s.cast("double")).alias("s"), (i + 1).alias("id"))))
    a, b = F.col("t")[0], F.col("t")[1]
    ok = (-a["s"] >= F.lit(0.2).cast("float").cast("double")) & ((b["s"] - a["s"]) >= 0.05)
    return table(spark, root, "embeddings").select("vec_id", scored.alias("t")).select("vec_id", F.when(ok, a["id"]).cast("int").alias("accepted"))


@query("""
WITH s AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), h AS (SELECT p_type, list(CAST(round(100.0 * n / t) AS BIGINT) ORDER BY n DESC, p_brand) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY p_type) AS t FROM s) GROUP BY p_type),
x AS (SELECT p_type, list_reverse_sort(s) AS s FROM h), y AS (SELECT *, len(s) AS n, list_sum(s) AS total, s[1] AS f, coalesce(s[2], 0) AS g, s[-1] AS l FROM x)
SELECT p_type, CASE WHEN n <= 1 THEN 'solo' WHEN total > 105 THEN CASE WHEN n >= 5 THEN 'long_tail' WHEN n >= 3 AND (f >= g * 2 OR (f >= 80 AND g < 50)) THEN 'leader_field' ELSE 'overlapping' END
  WHEN n >= 5 THEN 'long_tail' WHEN n = 2 THEN 'head_to_head' WHEN f - l <= 15 THEN 'even_pack' WHEN f >= g * 2 OR (f >= 80 AND g < 50) THEN 'leader_field' ELSE 'even_pack' END AS shape FROM y
""")
def chart_shape(spark: SparkSession, root: str) -> DataFrame:
    """The shape of each type's shares of brands."""
    from pyspark.sql import Window

    s = table(spark, root, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("p_type"))).cast("bigint")
    return s.withColumn("share", share).groupBy("p_type").agg(F.collect_list("share").alias("s")).select("p_type", quality.chart_shape(F.col("s")).alias("shape"))


_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_GOOD = rf"""NOT list_contains([{_IN(tx.STOPWORDS)}], w) AND CASE w WHEN 'go' THEN regexp_matches(s, '\bin Go\b|\bGolang\b|\bGo programming\b') WHEN 'rust' THEN regexp_matches(s, '\bin Rust\b|\bRust programming\b|\bRust language\b')
 WHEN 'python' THEN regexp_matches(s, '\bin Python\b|\bPython programming\b') WHEN 'java' THEN regexp_matches(s, '\bin Java\b|\bJava programming\b') WHEN 'apple' THEN false WHEN 'windows' THEN false ELSE length(w) > 2 END"""
_FOLD = rf"""CASE WHEN {{0}} IN ({_IN(tx.NO_PLURALS)}) OR length({{0}}) < 5 THEN {{0}} WHEN {{0}} LIKE '%ies' THEN substr({{0}}, 1, length({{0}}) - 3) || 'y' WHEN regexp_matches({{0}}, '(xes|zes|ches|shes|sses)$') THEN substr({{0}}, 1, length({{0}}) - 2)
 WHEN {{0}} LIKE '%s' AND NOT regexp_matches({{0}}, '(ss|sis|us|is|as|os)$') THEN substr({{0}}, 1, length({{0}}) - 1) ELSE {{0}} END"""


@query(rf"""
WITH d AS (SELECT doc_id, source, text, regexp_extract(text, '[^.!?\n]+') AS title FROM documents WHERE text <> ''), n AS (SELECT source, count(*) AS pages_n FROM d GROUP BY 1),
ti AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains([{_IN(tx.STOPWORDS)}], w)),
   lambda w: list_aggregate(list_transform(list_filter(string_split(rtrim(substr(trim(regexp_replace(w, '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-'), '-'), lambda v: v <> ''), lambda v: {_FOLD.format("v")}), 'string_agg', '-')) AS named FROM d),
se AS (SELECT doc_id, source, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\n]+'), 1) AS k FROM d),
ra AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: w <> '') AS raw FROM se),
fl AS (SELECT doc_id, source, k, list_filter(raw, lambda w: {_GOOD}) AS own, list_transform(range(1, greatest(len(raw), 1)), lambda i: [raw[i], raw[i + 1]]) AS near, s FROM ra),
ph AS (SELECT doc_id, source, k, list_concat(own, list_transform(list_filter(near, lambda x: list_contains(own, x[1]) AND list_contains(own, x[2])), lambda x: x[1] || ' ' || x[2])) AS phrases FROM fl),
w AS (SELECT doc_id, source, k, unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS p FROM ph),
u AS (SELECT DISTINCT phrase FROM w),
sl AS (SELECT phrase, list_aggregate(list_transform(list_filter(string_split(rtrim(substr(trim(regexp_replace(phrase, '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-'), '-'), lambda v: v <> ''), lambda v: {_FOLD.format("v")}), 'string_agg', '-') AS slug FROM u),
ok AS (SELECT * FROM sl WHERE length(slug) >= 3 AND NOT regexp_matches(slug, '^(quot|x27|nbsp|amp|class|span|div|script|style)$|^(?:feeds?|keywords?|tags?)-|^class-|^\d{{4}}$|^\d{{4}}-') AND NOT (regexp_matches(slug, '\d') AND contains(slug, 'post')) AND NOT slug LIKE 'about-%'
   AND NOT (contains(slug, '-') AND string_split(slug, '-')[1] IN ({_IN(tx.FILLERS)})) AND NOT len(list_filter(string_split(slug, '-'), lambda v: NOT (list_contains([{_IN(tx.STOPWORDS)}], v) OR regexp_matches(v, '^\d+$')))) = 0),
per AS (SELECT source, slug, doc_id, count(*) AS tf, min((k, p, phrase)) AS pos FROM w JOIN ok USING (phrase) GROUP BY ALL),
pt AS (SELECT per.*, list_contains(ti.named, slug) AS titled FROM per JOIN ti USING (doc_id)),
g AS (SELECT source, slug, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, min((doc_id, pos)) AS f, bool_or(titled) AS titled, list_sort(list(doc_id))[1:5] AS pages FROM pt GROUP BY ALL),
v AS (SELECT g.*, f[2][3] AS label, round(tf / pages_n * ln(1 + pages_n / (1 + df)), 6) AS value, pages_n >= 8 AND df / pages_n >= 0.8 AS boilerplate FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
x AS (SELECT *, contains(label, ' ') OR titled AS contextual FROM v WHERE tf >= 2 OR df >= 2 OR titled OR value >= 0.5 QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, slug) <= 200),
y AS (SELECT *, slug IN ({_IN(content.SENSITIVE)}) AS sensitive FROM x), z AS (SELECT *, NOT boilerplate AND NOT sensitive AND contextual AND df >= 2 AND (tf >= 4 OR df >= 3) AS accepted FROM y)
SELECT source, slug, label, tf, df, value, boilerplate, contextual, accepted, CASE WHEN accepted THEN '' WHEN boilerplate THEN 'site-boilerplate' WHEN sensitive THEN 'sensitive-attribute' WHEN NOT contextual THEN 'insufficient-context' ELSE 'low-subject-relevance' END AS reason, array_to_string(pages, ',') AS pages FROM z
""")
def suggested_topics(spark: SparkSession, root: str) -> DataFrame:
    """The topics that the documents of each source suggest, why others don't count, and the first documents that hold them. A document's
    title is its first sentence."""
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    rows = topics.suggested(docs, "source", "doc_id", "text", F.regexp_extract("text", r"[^.!?\n]+", 0))
    return rows.withColumn("pages", F.array_join("pages", ","))
