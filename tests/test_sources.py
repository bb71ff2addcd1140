"""Sources, sinks, stores and operators on small awkward inputs: nulls, empties, broken bodies, ties, cycles, repeated rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.functions import content, times, urls, uses
from loomspan.functions import text as tx
from loomspan.operators import catalog, edges, graph, history, items, ranking, rollup, timed, views
from loomspan.sinks import documents as sink
from loomspan.sources import entries, facts, feeds, html, stores, tree


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_feeds_take_broken_bodies(spark):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "<rss><item><title>a</title>"), (4, "<item><title>A &lt;b&gt;x&lt;/b&gt;</title><link>https://x.example/1</link><pubDate>not a date</pubDate></item>"), (5, "{}"), (6, '{"items":[{"id":1,"tags":null},{"url":"https://x.example/2"}]}'), (7, "[1]")], "k int, body string")
    x = feeds.xml_items(b, "k", "body").collect()
    assert [(r["k"], r["n"], r["title"], r["url"], r["published_at"], r["categories"]) for r in x] == [(4, 0, "A x", "https://x.example/1", None, [])]
    j = feeds.json_items(b, "k", "body").collect()
    assert [(r["k"], r["n"], r["url"], r["categories"]) for r in j] == [(6, 0, "", []), (6, 1, "https://x.example/2", [])]
    assert feeds.outline_urls(spark.createDataFrame([(1, "<!DOCTYPE x><outline htmlUrl='https://a.example'/>"), (2, None), (3, "<outline xmlurl='https://b.example/f' text=x />")], "k int, body string"), "k", "body").collect() == [(3, 0, "xmlUrl", "https://b.example/f")]
    assert feeds.sitemap_urls(b, "k", "body").count() == 0 and feeds.robots_groups(b.limit(2), "k", "body").count() == 0


def test_robots(spark):
    b = spark.createDataFrame([(1, "Disallow: /x\nUser-agent: a\nUser-agent: b\nDisallow: /p\nAllow: /p\n# c\nUser-agent: A\nDisallow:"), (2, None)], "k int, body string")
    g = feeds.robots_groups(b, "k", "body")
    assert rows(g.select("g", F.array_join("agents", ","), F.size("rules"))) == [(0, "*", 1), (1, "a,b", 2), (2, "a", 1)]
    paths = spark.createDataFrame([(1, "/p/q"), (1, "x"), (2, "/p"), (3, "/p")], "k int, path string")
    assert rows(feeds.robots_allowed(g, paths, "k", "path", "B")) == [(1, "/p/q", True), (1, "x", True), (2, "/p", True), (3, "/p", True)]
    assert rows(feeds.robots_allowed(g, paths, "k", "path", "other")) == [(1, "/p/q", True), (1, "x", False), (2, "/p", True), (3, "/p", True)]


def test_pages(spark):
    p = spark.createDataFrame([(1, None), (2, ""), (3, "<a href=/x class='A b' rel=me>one <b>two</b><nav><a href=y>z"), (4, "<script><a href=no></script><pre>c</pre><h2>h<i>i</i></h2>&amp;<meta name=robots content=NOINDEX>")], "page_id int, html string")
    got = {r["page_id"]: r["page"] for r in html.parsed(p).collect()}
    assert got[1]["links"] == [] and got[2]["main"] == "" and got[4]["links"] == [] and got[4]["noindex"] and got[4]["code"] == "c" and got[4]["headings"][0]["text"] == "hi"
    assert [(x["href"], x["text"], x["place"], x["classes"], x["rel"]) for x in got[3]["links"]] == [("/x", "one two", "main", ["a", "b"], ["me"]), ("y", "z", "nav", [], [])]
    def fact(source, f):
        t = tree.trees(spark.createDataFrame([(1, source)], "page_id int, html string"))
        return t.select(f(F.col("tree")).alias("x")).first()["x"]

    page = F.lit("https://x.example/a/b")
    assert fact(None, lambda t: facts.meta(t, "x")) is None and fact(None, lambda t: facts.canonical(t, page)) == "" and fact(None, facts.share_text) == ""
    assert fact('<script type="application/ld+json">[{"@type":"A/B"},{"@type":["C"]},5]</script><script type="application/ld+json"></script>', facts.schema_types) == ["B", "C"]
    assert fact("<p>short</p>", facts.first_paragraph) == "" and fact("<link rel=alternate type=text/html href=/x>", lambda t: facts.feeds(t, page)) == []
    assert fact("<meta name=twitter:image content=//i.example/p.png><meta property=og:image content=''>", lambda t: facts.poster(t, page)) == "https://i.example/p.png" and fact("<meta name=twitter:image content=http://i.example/p>", lambda t: facts.poster(t, page)) is None
    assert [tuple(f) for f in fact("<link rel='x alternate' type=application/atom+xml href=f><a href=/feed/>f</a><a href=/feed/>again</a><a href=/x.rss>y</a>", lambda t: facts.feeds(t, page))] == [("https://x.example/a/f", "atom"), ("https://x.example/feed/", "rss")]
    b = entries.outline_blocks(p.union(spark.createDataFrame([(5, "<h2>S</h2><ul><li>a<ul><li>b</li></ul>c</li></ul><table><tr><td>r</td></tr></table>")], p.schema)))
    assert rows(b.select("section", "text", "depth", "parent")) == [("S", "ac", 1, None), ("S", "b", 2, 0), ("S", "r", 1, None)]


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("", ""), ("&#x110000; &#65 &bogus; &AMP; &Eacute;", "&#x110000; &#65 &bogus; & É"), ("<![CDATA[a]]> b ]]>", "a b"), ("é\x00", "é")])
def test_extracted(spark, raw, want):
    assert one(spark, tx.extracted(F.lit(raw).cast("string"))) == want


def test_texts_and_urls(spark):
    assert one(spark, tx.truncated(F.lit("ééé"), 2)) == "é…" and one(spark, tx.truncated(F.lit("ab"), 2)) == "ab"
    assert one(spark, tx.is_no_subject(F.lit(None).cast("string"))) and not one(spark, tx.is_no_subject(F.lit("maps")))
    assert one(spark, urls.same_resource(F.lit("https://x.example"), F.lit("a"))) == "https://x.example/a" and one(spark, urls.same_resource(F.lit("https://x.example/a?b#c"), F.lit("#d"))) == "https://x.example/a?b#d"
    assert one(spark, urls.same_resource(F.lit("https://x.example/"), F.lit("javascript:x"))) is None
    assert one(spark, urls.page_role(F.lit("https://x.example/a"), F.lit("x"), F.array(F.lit("BlogPosting")))) == "article" and one(spark, urls.page_role(F.lit("https://x.example/a"), status=F.lit(404))) == "error"
    assert one(spark, urls.page_role(F.lit("https://x.example/"), made=F.lit(True))) == "generated" and one(spark, urls.page_role(F.lit("nope"))) == "unknown"
    assert one(spark, times.retry_at(F.lit(""), F.current_timestamp())) is None and one(spark, uses.appearance_date(F.lit("Feb 30, 2021"))) is None
    assert one(spark, content.window_of(F.lit(""), F.lit("x"))) == "" and one(spark, uses.is_sentence(F.lit(""))) is False


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(400)]
    p = spark.createDataFrame([*chain, (1000, 1001), (1001, 1002), (1002, 1000), (2000, 1001), (900, 2000), (3000, 3000)], "a int, b int")
    got = {r["a"]: r["b"] for r in graph.closure(p, "a", "b").collect()}
    assert all(got[i] == 400 for i in range(400)) and {got[k] for k in (1000, 1001, 1002, 2000, 900)} == {1000} and got[3000] == 3000
    assert graph.closure(p.limit(0), "a", "b").count() == 0


def test_winners_and_ties(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (4, None, None)], "id int, a string, b string")
    assert [r["id"] for r in ranking.winners(d, ["a", "b"], [F.col("id")]).orderBy("id").collect()] == [1, 4, 4]


def test_as_of_and_spans(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 2, "w"), (None, 1, "n")], "k int, s int, v string")
    assert rows(timed.as_of(a, b, ["k"], "t", "s", ["v"])) == [(1, 1, None), (1, 5, "y"), (2, 9, None), (None, 3, "n")]
    spans = spark.createDataFrame([(1, 0, 25), (2, 10, 10), (3, -7, 1)], "id int, a int, z int")
    assert rows(timed.within(spark.createDataFrame([(0,), (10,), (24,), (25,)], "t int"), spans, "t", "a", "z", 10, ["id"]).select("t", "id")) == [(0, 1), (0, 3), (10, 1), (24, 1)]


def test_history(spark):
    m = rollup.momentum(spark.createDataFrame([("t", "2020-12", 4, 8), ("t", "2021-01", 6, 8), ("t", "2021-03", 1, 0)], "k string, p string, v int, w int"), ["k"], "p", "v", "w", rollup.previous_month(F.col("p")))
    assert rows(m.select("p", "previous", "change", "points")) == [("2020-12", None, None, None), ("2021-01", 4, 2, 25), ("2021-03", None, None, None)]
    checks = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 3, "a"), (1, 3, 1, "verified"), (1, 4, 1, "a"), (1, 5, 0, "a")], "k int, n int, items int, outcome string")
    assert [r["n"] for r in history.checks(checks, ["k"], ["n"], "items", "outcome").collect()] == [4]
    seen = spark.createDataFrame([(1, "2024-01-01 00:00", True), (1, "2024-01-02 00:00", False), (1, "2024-01-02 23:00", False), (2, "2024-01-01 00:00", True), (2, "2024-01-02 00:00", False), (2, "2024-01-03 00:00", False), (3, "2024-01-01 00:00", False), (4, "2024-01-01 00:00", True)], "k int, t string, p boolean").withColumn("t", F.to_timestamp("t"))
    assert rows(history.pending(seen, ["k"], "t", "p").select("k", "state")) == [(1, "pending"), (2, "removed"), (4, "current")]
    with pytest.raises(ValueError, match="no way from version 1"):
        history.migrated(spark.createDataFrame([(1, "a")], "version int, x string"), "version", {(1, 2): lambda d: d, (2, 1): lambda d: d}, 3)


def test_items_and_catalogs(spark):
    d = spark.createDataFrame([("k", 2, "b", ["y"]), ("k", 1, "", None), ("l", 1, None, [])], "key string, o int, f string, s array<string>")
    assert rows(items.merged(d, "key", ["o"], ["f"], ["s"])) == [("k", "b", 2, ["y"]), ("l", None, 1, [])]
    claims = spark.createDataFrame([(1, "a", "", ""), (2, None, None, None), (3, "a", "x", "moon")], "k int, comparison string, section string, context string")
    rules = spark.createDataFrame([("a", "t", ["moon"], None, None)], "alias string, tool string, require_context array<string>, forbid_context array<string>, require_section array<string>")
    assert rows(catalog.resolved(claims, rules, "k")) == [(1, "abstain", None), (2, "none", None), (3, "unique", "t")]
    assert rows(edges.blogroll(spark.createDataFrame([("https://a.example", None, "r"), ("https://a.example", "https://a.example/x", "r"), ("https://a.example", "https://b.example/x", "r"), ("https://a.example", "https://b.example/y", "q")], "source string, url string, blogroll string"), spark.createDataFrame([("https://a.example",), ("https://b.example",), ("https://b.example",)], "o string"), "o")) == [("https://a.example", "https://b.example", "q")]


def test_sinks_escape(spark):
    r = spark.createDataFrame([("k", 'a & "b" <c>', "https://x.example/?a=1&b=2", None), ("k", "z", "https://x.example/z", "2024-01-01 00:00:00")], "k string, t string, u string, at string").withColumn("at", F.to_timestamp("at")).withColumn("s", F.lit(None).cast("string"))
    body = sink.atom(r, "k", "u", "t", "s", "at").first()["body"]
    assert body.count("<entry>") == 1 and "<title>z</title>" in body
    assert "SUMMARY:a\\, b\\; c" in sink.calendar(spark.createDataFrame([("k", 1, "a, b; c", "2024-02-29")], "k string, u int, t string, d string").withColumn("d", F.to_date("d")), "k", "u", "t", "d").first()["body"]


def test_stores(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-05"), (2, "2024-02-05"), (3, None)], "id int, at string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        stores.append_events(spark, e, f"{tmp_path}/log", "id", "at")
    assert stores.stored_periods(spark, f"{tmp_path}/log").agg(F.sum("n")).first()[0] == 3
    assert stores.documents(spark, f"{tmp_path}/none", "x int").count() == 0
    assert views.semantic_hash is not None and rows(spark.createDataFrame([('{"a":1,"generated_at":2}',), ('{"a": 1}',), ("x",), (None,)], "t string").select(views.semantic_hash("t").alias("h")).groupBy("h").count().select("count")) == [(2,), (2,)]


def test_references_end_with_a_semicolon(spark):
    """A reference that was cut short is text, in all parsers alike; scripts are left as they are."""
    from loomspan.sources import html, tree
    from loomspan.sources.pages import regions

    page = '<title>a &amp;&amp;&amp</title><h1>b &lt; &copy 1 &#38 &#x26;</h1><script type="application/ld+json">{"name":"R & D"}</script><a href="/x?a=1&copy=2">c&d</a>'
    rows = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    r = regions(rows).where("page_id = 1").first()
    assert (r["title"], r["main"]) == ("a &&&amp", "b < &copy 1 &#38 & c&d")
    p = html.parsed(rows).where("page_id = 1").first()["page"]
    assert (p["title"], p["headings"][0]["text"], p["links"][0]["href"]) == ("a &&&amp", "b < &copy 1 &#38 &", "/x?a=1&copy=2")
    t = tree.parse(page).row()
    assert (t["title"], t["objects"], t["links"][0]["text"]) == ("a &&&amp", ['{"name": "R & D"}'], "c&d")
