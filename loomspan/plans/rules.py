"""Queries that apply the rules over texts, addresses, times and items to whole tables. Their SQL states the rules on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import content, times, urls, uses
from loomspan.functions import labels as lb
from loomspan.functions import text as tx
from loomspan.plans.registry import query
from loomspan.sources.tables import spread, table


@query(r"""
SELECT p_partkey, 'x ' || p_name || ' & Ab' || chr(233) || ' &unknown; ' || p_type AS extracted, substr('x ' || p_name || ' & Ab' || chr(233) || ' &unknown; ' || p_type, 1, 12) AS capped,
 CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 7) || '…' END AS truncated, 'links: a ' || p_type || '. ' || p_name || '.' AS readable, p_size % 4 IN (0, 1, 2) AS weak,
 lower(p_name) || ' b2 ' || lower(p_type) AS title_key, p_name || ' ' || p_type AS label, lower(p_name) || ' c++ eclair ' || lower(p_type) AS comparison, p_name || ' &lt;a b=&quot;&amp;&apos;&quot;&gt;' AS escaped, 'sha256:' || sha256(p_name) AS id FROM part
""")
def text_rules(spark: SparkSession, root: str) -> DataFrame:
    """Texts out of markup, cut, compared and escaped."""
    p = table(spark, root, "part")
    n, t = F.col("p_name"), F.col("p_type")
    raw = F.concat(F.lit("<![CDATA[x \n"), n, F.lit("]]> &amp; &#65;&#x62;e&#769; &unknown;\u0007  "), t, F.lit("]]>"))
    two = F.concat(F.lit("links: a "), t, F.lit(": https://a.example/x "), n, F.lit(": https://b.example/y"))
    weak = F.element_at(F.array(F.lit(" Home "), F.lit("Bob's website"), F.lit(""), F.lit("Gardening notes")), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(
        "p_partkey", tx.extracted(raw).alias("extracted"), tx.capped(raw, 12).alias("capped"), tx.truncated(n, 8).alias("truncated"), tx.readable(F.concat(two)).alias("readable"), tx.is_weak_title(weak).alias("weak"),
        tx.title_key(F.concat(n, F.lit(" <i>b²!!</i> - "), t)).alias("title_key"), tx.label(F.concat(F.lit("\t"), n, F.lit("\x01  "), t)).alias("label"), tx.comparison_label(F.concat(F.lit("Observed: "), n, F.lit(" (C++) Éclair, "), t)).alias("comparison"), tx.escaped(F.concat(n, F.lit(" <a b=\"&'\">"))).alias("escaped"), tx.content_id(n).alias("id"),
    )


@query(r"""
WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' and the ' || p_type || ' co'), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) > 2 AND x NOT IN ('and', 'the')) AS w FROM part)
SELECT p_partkey, array_to_string(w, ',') AS tokens, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), ',') AS phrases FROM w
""")
def token_rules(spark: SparkSession, root: str) -> DataFrame:
    """Content words of part names, and the phrases that they make."""
    w = table(spark, root, "part").select("p_partkey", tx.content_tokens(F.concat("p_name", F.lit(" and the "), "p_type", F.lit(" co"))).alias("w"))
    return w.select("p_partkey", F.array_join("w", ",").alias("tokens"), F.array_join(tx.phrases(F.col("w")), ",").alias("phrases"))


@query("""
WITH s AS (SELECT p_partkey, p_size, unnest([('rust', 'I write in Rust'), ('rust', 'the rust on my car'), ('go', 'Golang is fine'), ('python', 'a python'), ('garden', 'any'), ('apple', 'an apple')]) AS x FROM part)
SELECT p_partkey, x[1] AS word, x[2] AS sentence, x[2] IN ('I write in Rust', 'Golang is fine', 'any') AS subject FROM s
""")
def ambiguous_words(spark: SparkSession, root: str) -> DataFrame:
    """Words that are subjects in some sentences only."""
    pairs = (("rust", "I write in Rust"), ("rust", "the rust on my car"), ("go", "Golang is fine"), ("python", "a python"), ("garden", "any"), ("apple", "an apple"))
    rows = table(spark, root, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.lit(s).alias("sentence")) for w, s in pairs))).alias("x")).select("p_partkey", "x.*")
    return rows.withColumn("subject", tx.names_subject(F.col("sentence"), F.col("word")))


_SLUGS = ("gardens", "internet-of-things", "the-and-2", "quot", "2018-gifs", "about-me", "really-good", "post-12", "tags-x", "", "diabetes", "web-maps", "ab")


@query("""
WITH s AS (SELECT p_partkey, p_size, unnest(['gardens', 'internet-of-things', 'the-and-2', 'quot', '2018-gifs', 'about-me', 'really-good', 'post-12', 'tags-x', '', 'diabetes', 'web-maps', 'ab']) AS slug FROM part),
n AS (SELECT *, slug IN ('the-and-2', 'quot', '2018-gifs', 'about-me', 'really-good', 'post-12', 'tags-x', '') AS none FROM s)
SELECT p_partkey, slug, none AS no_subject, slug IN ('quot', '2018-gifs', 'tags-x') AS artifact, NOT none AND slug NOT IN ('diabetes', 'ab') AND p_size % 5 >= 2 AND (p_size % 7 >= 4 OR p_size % 5 >= 3) AND p_size % 3 <> 0 AS qualifies,
 CASE WHEN p_size % 11 = 0 THEN 'site-boilerplate' WHEN slug = 'diabetes' THEN 'sensitive-attribute' WHEN p_size % 3 = 0 THEN 'insufficient-context' WHEN length(slug) < 3 THEN 'invalid-phrase' ELSE 'low-subject-relevance' END AS reason,
 CASE slug WHEN 'gardens' THEN 'garden' WHEN 'diabetes' THEN 'diabete' ELSE slug END AS folded FROM n
""")
def slug_rules(spark: SparkSession, root: str) -> DataFrame:
    """Which slugs name subjects, which may count, and why others don't."""
    rows = spread(table(spark, root, "part")).select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, _SLUGS))).alias("slug"))
    s, k = F.col("slug"), F.col("p_size")
    return rows.select("p_partkey", "slug", tx.is_no_subject(s).alias("no_subject"), tx.is_artifact(s).alias("artifact"), content.qualifies(s, k % 5, k % 7, k % 3 != 0).alias("qualifies"), content.rejection(s, k % 11 == 0, k % 3 != 0).alias("reason"), tx.singular_slug(s).alias("folded"))


@query("""
WITH s AS (SELECT p_partkey, p_type, unnest(['Web Maps', 'a/b', 'THE', '  Rivers &amp; Lakes ', '7', '']) AS raw, unnest(['rss:category', 'meta:keywords', 'schema:keywords', 'nlp', 'tfidf_x', 'my_own:source']) AS source FROM part)
SELECT p_partkey, raw, CASE raw WHEN 'Web Maps' THEN raw WHEN '  Rivers &amp; Lakes ' THEN 'Rivers & Lakes' ELSE '' END AS label, CASE raw WHEN 'Web Maps' THEN 'web-maps' WHEN '  Rivers &amp; Lakes ' THEN 'river-lake' END AS slug,
 source IN ('rss:category', 'schema:keywords') AS eligible, source IN ('meta:keywords', 'schema:keywords') AS discovery,
 CASE WHEN source IN ('nlp', 'tfidf_x') THEN 'text' ELSE regexp_replace(source, '[_:-]+', ' ', 'g') END AS source_label FROM s
""")
def topic_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Raw labels as topic evidence: label, slug, and what their source is worth."""
    both = (("Web Maps", "rss:category"), ("a/b", "meta:keywords"), ("THE", "schema:keywords"), ("  Rivers &amp; Lakes ", "nlp"), ("7", "tfidf_x"), ("", "my_own:source"))
    rows = spread(table(spark, root, "part")).select("p_partkey", F.explode(F.array(*(F.struct(F.lit(r).alias("raw"), F.lit(s).alias("source")) for r, s in both))).alias("x")).select("p_partkey", "x.*")
    r, s = F.col("raw"), F.col("source")
    return rows.select("p_partkey", "raw", content.topic_label(r).alias("label"), content.topic_slug(r).alias("slug"), content.is_eligible(s).alias("eligible"), content.is_discovery(s).alias("discovery"), content.source_label(s).alias("source_label"))


@query(r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o FROM pages)
SELECT page_id, 'url:' || regexp_replace(url, '#.*$', '') AS identity, 'id:' || o || ':' || page_id AS by_id, sha256(o) AS site_id, true AS own, false AS other, o || '/talks.php' AS directory_url, true AS directory, '/a/b' AS path,
 CASE WHEN page_id % 2 = 0 THEN 'PL_1-x' END AS playlist, CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS profile, o || '/dir/x.html' AS relative, o || '/x' AS rooted, 'https://cdn.example/y' AS same_scheme FROM u
""")
def url_rules(spark: SparkSession, root: str) -> DataFrame:
    """Identities, sites and places of pages' addresses."""
    p = table(spark, root, "pages").withColumn("o", urls.origin(F.col("url")))
    u, o, k, none = F.col("url"), F.col("o"), F.col("page_id"), F.lit(None).cast("string")
    host = urls.host(u)
    directory = F.concat(o, F.lit("/talks.php"))
    return p.select(
        "page_id", urls.identity(F.concat(u, F.lit("#part")), none, none, none).alias("identity"), urls.identity(F.lit("mailto:x"), k.cast("string"), o, none).alias("by_id"), urls.site_id(o).alias("site_id"), urls.of_site(F.concat(F.lit("https://sub."), F.regexp_replace(host, r"^www\.", ""), F.lit("/x")), o).alias("own"),
        urls.of_site(F.lit("https://nowhere.example/"), o).alias("other"), directory.alias("directory_url"), urls.is_directory(directory).alias("directory"), urls.segments(F.lit(" A//b/?x#y")).alias("path"),
        urls.playlist_id(F.when(k % 2 == 0, "https://m.youtube.com/playlist?a=1&list=PL_1-x").otherwise("https://vimeo.com/?list=PL_1-x")).alias("playlist"),
        content.profile_rank(F.element_at(F.array(F.lit("https://youtube.com/@me"), F.lit("https://youtube.com/watch?v=1"), F.lit("https://youtube.com/")), (k % 3 + 1).cast("int"))).alias("profile"),
        urls.same_resource(F.concat(o, F.lit("/dir/y?z#w")), F.lit("x.html")).alias("relative"), urls.same_resource(u, F.lit("/x")).alias("rooted"), F.regexp_replace(urls.same_resource(u, F.lit("//cdn.example/y")), "^http:", "https:").alias("same_scheme"),
    )


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders)
SELECT o_orderkey, CAST(CAST(date_trunc('year', d) AS DATE) AS VARCHAR) AS year_start, CAST(CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS year_end, strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m') AS month, strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y') || '-Q' || quarter(date_trunc('month', d) - INTERVAL 1 MONTH) AS quarter,
 strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y') AS year, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS of_month, CAST(NULL AS VARCHAR) AS of_bad_year, o_custkey % 100 AS retry_seconds, epoch(TIMESTAMP '2015-10-21 07:28:00') AS retry_mail, CAST(NULL AS DOUBLE) AS retry_bad, d >= DATE '1995-01-01' AS passed, d > DATE '1994-12-31' AS fresh FROM o
""")
def time_rules(spark: SparkSession, root: str) -> DataFrame:
    """Bounds, keys and instants out of order dates."""
    d, now = F.to_date("o_orderdate"), F.timestamp_seconds(F.lit(1000000000))
    month, quarter, year = times.previous_keys(d)
    start, end = times.year_bounds(F.date_format(d, "yyyy"))
    seconds = lambda c: F.unix_timestamp(c).cast("double")
    return table(spark, root, "orders").select(
        "o_orderkey", start.cast("string").alias("year_start"), end.cast("string").alias("year_end"), month.alias("month"), quarter.alias("quarter"), year.alias("year"), times.of_month(F.date_format(d, "MMMM"), F.date_format(d, "yyyy")).cast("string").alias("of_month"), times.of_year(F.lit("1895")).cast("string").alias("of_bad_year"),
        (F.unix_timestamp(times.retry_at((F.col("o_custkey") % 100).cast("string"), now)) - 1000000000).alias("retry_seconds"), seconds(times.retry_at(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"), now)).alias("retry_mail"), seconds(times.retry_at(F.lit("soon"), now)).alias("retry_bad"),
        times.boundary_passed(F.lit("1995-01-01").cast("date"), d).alias("passed"), times.capture_is_fresh(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-01-01").cast("timestamp") + (F.lit("1995-01-01").cast("date") - d)).alias("fresh"),
    )


_TYPES = ("photograph", "game", "project", "article", "presentation", "collection", "podcast_episode", "")


@query("""
WITH x AS (SELECT p_partkey, p_size, ['photograph', 'game', 'project', 'article', 'presentation', 'collection', 'podcast_episode', ''][p_size % 8 + 1] AS t, CASE p_size % 4 WHEN 0 THEN ['Mobile', 'x'] WHEN 1 THEN ['a book'] WHEN 2 THEN ['software'] ELSE [] END AS c FROM part),
k AS (SELECT *, CASE t WHEN 'photograph' THEN 'photography' WHEN 'presentation' THEN 'talks' WHEN 'podcast_episode' THEN 'podcasts' WHEN 'game' THEN CASE p_size % 4 WHEN 0 THEN 'apps' WHEN 2 THEN 'software' ELSE 'games' END
  WHEN 'project' THEN CASE p_size % 4 WHEN 0 THEN 'apps' WHEN 1 THEN 'books' WHEN 2 THEN 'software' ELSE 'project' END WHEN 'collection' THEN CASE p_size % 4 WHEN 0 THEN 'apps' WHEN 1 THEN 'books' WHEN 2 THEN 'software' ELSE 'project' END ELSE 'other' END AS kind FROM x),
d AS (SELECT *, p_size % 10 = 9 AND t <> 'presentation' AS stale, p_size % 5 = 0 AS portfolio, p_size % 50 AS age FROM k)
SELECT p_partkey, kind, CASE kind WHEN 'photography' THEN 'Photography' WHEN 'talks' THEN CASE WHEN p_size % 2 = 1 THEN 'Talk' ELSE 'Talks' END WHEN 'podcasts' THEN CASE WHEN p_size % 2 = 1 THEN 'Podcast' ELSE 'Podcasts' END WHEN 'apps' THEN CASE WHEN p_size % 2 = 1 THEN 'App' ELSE 'Apps' END WHEN 'books' THEN CASE WHEN p_size % 2 = 1 THEN 'Book' ELSE 'Books' END
  WHEN 'games' THEN CASE WHEN p_size % 2 = 1 THEN 'Game' ELSE 'Games' END WHEN 'project' THEN CASE WHEN p_size % 2 = 1 THEN 'Project' ELSE 'Projects' END WHEN 'software' THEN 'Software' ELSE 'Other' END AS label,
 NOT stale AND (t NOT IN ('article', '') OR portfolio) AS durable, (NOT stale AND (t NOT IN ('article', '') OR portfolio)) OR age <= 14 AS shown, NOT stale AND (t NOT IN ('article', '') OR portfolio OR age <= 30) AS cached, CASE WHEN p_size % 6 = 0 THEN 'photograph' ELSE t END AS typed FROM d
""")
def item_rules(spark: SparkSession, root: str) -> DataFrame:
    """Kinds of items, their labels, and which are works, shown or cached."""
    k = F.col("p_size")
    t = F.element_at(F.array(*map(F.lit, _TYPES)), (k % 8 + 1).cast("int"))
    cats = F.when(k % 4 == 0, F.array(F.lit("Mobile"), F.lit("x"))).when(k % 4 == 1, F.array(F.lit("a book"))).when(k % 4 == 2, F.array(F.lit("software"))).otherwise(F.array().cast("array<string>"))
    now = F.lit("2024-03-01").cast("timestamp")
    rows = table(spark, root, "part").select("p_partkey", "p_size", t.alias("t"), content.kind(t, cats).alias("kind"), F.when(k % 5 == 0, "portfolio").otherwise("feed").alias("source"), F.when(k % 10 == 9, "https://x.example/tools").otherwise("https://x.example/y").alias("url"), (now - F.make_dt_interval((k % 50).cast("int"))).alias("at"))
    own = (F.col("t"), F.col("source"), F.col("url"))
    return rows.select("p_partkey", "kind", content.kind_label(F.col("kind"), k % 2).alias("label"), content.is_durable(*own).alias("durable"), content.is_shown(*own, F.col("at"), now).alias("shown"), content.is_cached(*own, F.col("at"), now).alias("cached"), content.type_of_title(F.when(k % 6 == 0, " [Photo] a lake").otherwise("lake [photo]"), F.col("t")).alias("typed"))


@query("""
WITH p AS (SELECT *, CASE p_size % 5 WHEN 0 THEN 'isbn:0306406152' WHEN 1 THEN 'url:https://x.example/' || p_type WHEN 2 THEN 'ta:' || lower(p_name) || '|' || lower(p_brand) WHEN 3 THEN 'title-only:' || lower(p_name) || '|' || p_partkey ELSE 'unresolved:' || p_partkey END AS book,
 CASE p_size % 3 WHEN 0 THEN 'pub:https://x.example/' || p_type WHEN 1 THEN 'uid:' || p_type ELSE 'unresolved:' || p_partkey END AS publication FROM part)
SELECT 'book' AS kind, book AS key, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY book UNION ALL SELECT 'publication', publication, count(*), min(p_partkey) FROM p GROUP BY publication
""")
def semantic_identities(spark: SparkSession, root: str) -> DataFrame:
    """Books and publications grouped by the strongest identity that they have."""
    k = F.col("p_size")
    some = lambda cond, c: F.when(cond, c)
    p = table(spark, root, "part")
    book = content.book_key(some(k % 5 == 0, F.lit("0-306-40615-2")), some(k % 5 == 1, F.concat(F.lit("https://x.example/"), "p_type", F.lit("#a"))), some((k % 5).isin(2, 3), F.col("p_name")), some(k % 5 == 2, F.col("p_brand")), F.col("p_partkey").cast("string"))
    pub = content.publication_key(some(k % 3 == 0, F.concat(F.lit("https://x.example/"), "p_type")), some(k % 3 == 1, F.col("p_type")), F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", F.explode(F.array(F.struct(F.lit("book").alias("kind"), book.alias("key")), F.struct(F.lit("publication").alias("kind"), pub.alias("key")))).alias("x")).select("p_partkey", "x.*")
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""
WITH t AS (SELECT doc_id, text, position('the' IN lower(text)) - 1 AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, greatest(0, pos - 240) AS a FROM t), l AS (SELECT *, greatest(0, a - 40) AS b FROM s), w AS (SELECT *, CASE WHEN regexp_matches(lower(substr(text, b + 1, pos - b)), '\\b(no longer|not|never|formerly|considering)\\b') THEN b ELSE a END AS c FROM l)
SELECT doc_id, md5(CASE WHEN pos < 0 THEN substr(text, 1, 240) ELSE substr(text, c + 1, pos + 3 + 240 - c) END) AS window_md5 FROM w
""".replace("\\\\b", "\\b"))
def claim_windows(spark: SparkSession, root: str) -> DataFrame:
    """The text around the first `the` of each document, as a claim would be shown."""
    d = table(spark, root, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(content.window_of(F.col("text"), F.lit("the")).cast("binary")).alias("window_md5"))


@query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'links to' WHEN 1 THEN 'links to' WHEN 2 THEN 'thanks' WHEN 3 THEN 'answers' ELSE 'other' END AS relation, CASE WHEN c_custkey % 3 = 0 THEN 'read, counts' ELSE 'odd' END AS reason, CASE c_custkey % 4 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'declined' WHEN 2 THEN 'undeclared' END AS identity,
 c_custkey % 10 < 5 OR c_custkey % 10 < 0.3 * (c_custkey % 40) OR c_custkey % 40 = 0 AS early, CASE WHEN c_custkey % 2 = 0 THEN 'Ada Byron' END AS person FROM customer
""")
def label_rules(spark: SparkSession, root: str) -> DataFrame:
    """Labels of relations and states, declared identities, early samples, names out of hosts."""
    k = F.col("c_custkey")
    rel = F.when(k % 8 == 0, "content-link").when(k % 8 == 1, "").when(k % 8 == 2, "credit").when(k % 8 == 3, "reply-to").otherwise("other")
    return table(spark, root, "customer").select(
        "c_custkey", content.relation_label(rel).alias("relation"), content.coverage_reason(F.when(k % 3 == 0, "verified").otherwise("odd")).alias("reason"),
        content.declared_identity(F.when(k % 4 == 3, 2).otherwise(1), F.when(k % 4 == 0, True).when(k % 4 == 1, False)).alias("identity"), content.is_early(k % 10, k % 40).alias("early"), lb.person_of_domain(F.when(k % 2 == 0, "ada.byron.net").otherwise("docs.byron.net")).alias("person"),
    )


def _holds(words: str) -> str:
    """SQL: whether a label holds one of some words, as whole words."""
    return rf"regexp_matches(t, '(?i)\b(?:{words})\b')".replace("it's", "it''s").replace("let's", "let''s")


def _begins(words: str, then: str = r"\b") -> str:
    return rf"regexp_matches(t, '(?i)^(?:{words}){then}')".replace("it's", "it''s").replace("let's", "let''s")


@query(rf"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS raw FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, substr(trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')), 1, 120) AS t FROM s),
n AS (SELECT doc_id, t, len(string_split(t, ' ')) AS n FROM t WHERE t <> ''),
r AS (SELECT doc_id, {_begins(uses.OPENERS)} OR ({_begins(uses.SPEAKERS, r"\s+\S")} AND {_holds(uses.VERBS)}) OR {_begins(r"i\s+(?:am|was)")} OR (n >= 4 AND (contains(t, '..') OR contains(t, '…'))) OR (n >= 5 AND {_holds(uses.ASIDES)}) OR ({_holds("copilot")} AND {_holds("and yes|i have|occasionally|useful")}) AS sentence,
 {_begins(r"top\s+\d+")} OR {_begins(rf"\d+\s+(?:{uses.COUNTED})")} OR (n >= 3 AND ({_begins(uses.ESSAYS)} OR regexp_matches(t, '(?i)\bvs(?:\b|\.\b)'))) OR (n >= 7 AND {_holds(uses.ESSAY_WORDS)}) OR {_begins(rf"the\s+(?:{uses.OF_THE})")} OR {_holds(uses.TURNS)} AS article,
 regexp_matches(t, '(?i)\b(?:i (?:do not|don''t|dont) use|not using|never use|avoid(?:s|ing)?|formerly|used to use|no longer us(?:e|ing)|stopped using|replaced by|previous(?:ly)?|retired|considering|evaluating|thinking about|might (?:try|use)|looking at|wishlist|want(?:s|ed)? to (?:try|buy|get)|on my list|someday)\b') AS qualified FROM n)
SELECT doc_id, count(*) AS labels, count(*) FILTER (WHERE sentence) AS sentences, count(*) FILTER (WHERE article) AS articles, count(*) FILTER (WHERE qualified) AS not_current FROM r GROUP BY doc_id
""")
def sentence_labels(spark: SparkSession, root: str) -> DataFrame:
    """What the sentences of documents would be as labels of things used: how many read like talk or like titles, or tell another state
    than a present use."""
    d = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", r"[.!?\n]+")).alias("raw"))
    t = d.select("doc_id", tx.label(F.col("raw")).alias("t")).where("t <> ''")
    c = F.col("t")
    rows = t.select("doc_id", uses.is_sentence(c, clean=True).alias("sentence"), uses.is_article(c, clean=True).alias("article"), (uses.status(c) != "current").alias("qualified"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("labels"), F.count_if("sentence").alias("sentences"), F.count_if("article").alias("articles"), F.count_if("qualified").alias("not_current"))


@query("""
SELECT CAST(l_suppkey AS VARCHAR) AS tool, count(*) AS claims, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_tax >= 0.05) AS kept, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_tax >= 0.05 AND l_linestatus = 'O' AND l_quantity > 25) AS adopted FROM lineitem GROUP BY 1
""")
def kept_claims(spark: SparkSession, root: str) -> DataFrame:
    """Lines as claims of a tool (their supplier), sure by ten times their tax: how many a state keeps, and how many are adoptions."""
    tool, kind = F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "F", "equipment")
    own = (tool, F.col("l_returnflag") == "R", kind, F.col("l_tax") * 10)
    rows = table(spark, root, "lineitem").select(tool.alias("tool"), uses.is_kept(*own).alias("kept"), uses.is_adoption(*own, F.when(F.col("l_quantity") > 25, "current").otherwise("former")).alias("adopted"))
    return rows.groupBy("tool").agg(F.count("*").alias("claims"), F.count_if("kept").alias("kept"), F.count_if("adopted").alias("adopted"))


@query("""
WITH g AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS v, min(ts) FILTER (WHERE event_type = 'click') AS c, min(ts) FILTER (WHERE event_type = 'purchase') AS p, min(ts) AS f FROM events GROUP BY 1)
SELECT g.user_id, strftime(CASE WHEN v <= c THEN v ELSE c END, '%Y-%m-%d %H:%M:%S') AS first_look, strftime(coalesce(p, f), '%Y-%m-%d %H:%M:%S') AS active, count(e.event_id) AS later
FROM g LEFT JOIN events e ON e.user_id = g.user_id AND e.ts >= coalesce(p, f) + INTERVAL 1 MILLISECOND GROUP BY ALL
""")
def user_cursors(spark: SparkSession, root: str) -> DataFrame:
    """Each user's first look, the time of their first purchase (of their first event without one), and how many events come after it."""
    e = table(spark, root, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    g = e.groupBy("user_id").agg(times.earlier(first("view"), first("click")).alias("look"), times.activity_time(first("purchase"), F.min("ts")).alias("active"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = e.join(g, "user_id").groupBy("user_id", "look", "active").agg(F.count_if(F.col("ts") >= times.exclusive_after(F.col("active"))).alias("later"))
    return rows.select("user_id", text("look").alias("first_look"), text("active").alias("active"), "later")
