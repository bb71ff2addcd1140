"""The library's own operators on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions import urls
from loomspan.operators import graph, ledger, quality, ranking, rollup, topics
from loomspan.sources.pages import links, regions


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "folded"), [("stories", "story"), ("boxes", "box"), ("tools", "tool"), ("news", "news"), ("cats", "cats"), ("status", "status"), ("classes", "class"), ("glass", "glass"), ("", "")])
def test_singular(spark, word, folded):
    assert one(spark, tx.singular(F.lit(word))) == folded


def test_slug(spark):
    assert one(spark, tx.slug(F.lit("Hello, World!"))) == "hello-world"
    assert one(spark, tx.slug(F.lit("世界"))).startswith("u-")
    assert one(spark, tx.singular_slug(F.lit("static-sites"))) == "static-site"
    assert one(spark, tx.slug(F.lit(None).cast("string"))) is None


def test_text(spark):
    assert one(spark, tx.squeezed(F.lit("  a \n b "))) == "a b"
    assert one(spark, tx.without_tags(F.lit("<p>a<script>x()</script> <b>b</b></p>"))) == "a b"


def test_search_score(spark):
    topics_ = F.array(F.lit("rust"))
    assert one(spark, tx.search_score("rust", F.lit("Rust"), F.lit("on rust"), F.lit("rust.example"), topics_)) == 12 + 5 + 2 + 3
    assert one(spark, tx.search_score("", F.lit("Rust"), F.lit("x"), F.lit("y"), topics_)) == 0


@pytest.mark.parametrize(("url", "out"), [("https://a.org/?utm_source=x&b=1#f", "https://a.org/?b=1#f"), ("https://a.org/?gclid=1", "https://a.org/"), ("https://a.org/x?b=%20", "https://a.org/x?b=%20"), ("mailto:x", "mailto:x")])
def test_tracking(spark, url, out):
    assert one(spark, urls.without_tracking(F.lit(url))) == out


@pytest.mark.parametrize(("url", "out"), [("HTTP://A.org:80/x", "http://a.org"), ("https://a.org:8443", "https://a.org:8443"), ("https://u@a.org/", None), ("ftp://a.org", None)])
def test_origin(spark, url, out):
    assert one(spark, urls.origin(F.lit(url))) == out


@pytest.mark.parametrize(("url", "role"), [("https://a.org/", "home"), ("https://a.org/blog/x", "article"), ("https://a.org/tags/x", "tag-index"), ("https://a.org/about/", "about"), ("https://a.org/privacy", "legal"), ("nothing", "unknown"), ("https://a.org/work/thing", "project")])
def test_role(spark, url, role):
    assert one(spark, urls.page_role(F.lit(url))) == role


def test_rollup_score(spark):
    assert one(spark, rollup.score(F.lit(1), F.lit(4))) == 25
    assert one(spark, rollup.score(F.lit(1), F.lit(0))) is None
    keys = {r["granularity"]: r["period"] for r in one(spark, rollup.periods(F.lit("2026-11-05 00:00:00").cast("timestamp_ntz")))}
    assert keys == {"month": "2026-11", "quarter": "2026-Q4", "year": "2026", "all-time": "all"}


def test_replay(spark):
    rows = [(1, 1, "add", 5), (1, 2, "remove", None), (1, 3, "add", None), (2, 1, "add", 7), (2, 2, "change", None), (3, 1, "add", 1), (3, 2, "remove", None)]
    e = spark.createDataFrame(rows, "k int, at int, kind string, v int")
    got = {r["k"]: r["carried"] for r in ledger.replay(e, ["k"], ["at"], F.col("kind") == "remove", "v").collect()}
    assert got == {1: None, 2: 7}
    before = {r["k"]: r["carried"] for r in ledger.replay(e, ["k"], ["at"], F.col("kind") == "remove", "v", F.col("at") < 2).collect()}
    assert before == {1: 5, 2: 7, 3: 1}


def test_append_is_idempotent(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    more = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id int, v string")
    once = ledger.append(log, more, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ledger.append(once, more, "id").collect())) == sorted(map(tuple, once.collect()))


def test_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "x"), (4, None)], "k int, v string")
    assert {r["k"]: r["event"] for r in ledger.difference(a, b, ["k"], "v").collect()} == {1: "removed", 2: "changed", 3: "added"}


def test_ranking(spark):
    d = spark.createDataFrame([(k, k % 2, None if k > 4 else k // 2) for k in range(8)], "id int, o int, t int")
    assert {r["id"] for r in ranking.capped(d, ["o"], [F.col("id")], 2).collect()} == {0, 1, 2, 3}
    assert [r["id"] for r in ranking.round_robin(d, "o", [F.desc("id")], 4).collect()] == [6, 7, 4, 5]
    assert {r["id"] for r in ranking.winners(d, ["t"], [F.col("id")]).collect()} == {0, 2, 4, 5, 6, 7}
    assert ranking.first_per(d.limit(0), ["o"], [F.col("id")]).count() == 0


def test_topics(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "id int, w array<string>")
    top = topics.tfidf(d, "id", "w", 5).collect()
    assert [(r["slug"], r["tf"], r["df"]) for r in top] == [("a", 3, 2), ("b", 1, 1)]
    pairs = topics.cooccurrence(spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (2, "x")], "i int, s string"), "i", "s").collect()
    assert [tuple(r) for r in pairs] == [("x", "y", 2)]


def test_mentions(spark):
    d = spark.createDataFrame([(1, "We use Static, Sites a lot"), (2, "static and sites"), (3, None)], "id int, t string")
    p = spark.createDataFrame([("s", "static sites"), ("u", "use static sites a lot")], "k string, p string")
    assert sorted(map(tuple, topics.mentions(d, "id", "t", p, "k", "p").collect())) == [(1, "s"), (1, "u")]


def test_graph(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (5, 6), (6, 5)], "a int, b int")
    got = {r["a"]: r["b"] for r in graph.closure(p, "a", "b").collect()}
    assert (got[1], got[2], got[4]) == (3, 3, 4) and got[5] in (5, 6)
    e = graph.aggregate_edges(spark.createDataFrame([("x", "y", 2), ("x", "y", 1), ("x", "y", 1)], "s string, t string, page int"), ["s", "t"], ["page"])
    assert [tuple(r) for r in e.collect()] == [("x", "y", 1, 2)]


@pytest.mark.parametrize(("shares", "shape"), [([100], "solo"), ([60, 40], "head_to_head"), ([34, 33, 33], "even_pack"), ([70, 20, 10], "leader_field"), ([20] * 5, "long_tail"), ([80, 60], "overlapping"), ([90, 20, 20], "leader_field")])
def test_shape(spark, shares, shape):
    assert one(spark, quality.chart_shape(F.array(*map(F.lit, shares)))) == shape


def test_violations(spark):
    d = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    assert [tuple(r) for r in quality.violations(d, {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()}).collect()] == [("positive", 2), ("known", 1)]


def test_pages(spark):
    html = '<html lang="en"><head><title>T</title></head><body><nav><a href="/x">n</a></nav><p>main <b>text</b></p><script>no()</script><a class="c" href="y">z</a></body></html>'
    d = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [r["href"] for r in links(d).collect()] == ["/x", "y"]
    got = {r["page_id"]: r for r in regions(d).collect()}
    assert got[1][1:] == ("en", "T", "main text z", "n")
    assert got[2][2:] == ("", "", "")


def test_phrases_are_counted_by_document(spark):
    """counted() folds as the Column functions do, once for each slug of a document; the first phrase by place names it."""
    odd = ["united states", "internet-of-things", "--- boxes", "-", "--", "cities news", "class glasses", "x" * 90 + " ies", "bus this", "a-b-ties"]
    rows = spark.createDataFrame([(p,) for p in odd], "p string").select("p", tx.singular_slug(tx.slug(F.col("p"))).alias("s")).collect()
    assert {r["p"]: r["s"] for r in rows} == {p: topics._folded(p) for p in odd}
    docs = spark.createDataFrame([("x", 1, "Red gardens. red garden! the in Go go", ["garden"]), (None, 2, "...", None)], "site string, doc long, text string, named array<string>")
    want = [("garden", 2, "gardens", True), ("go", 2, "go", False), ("go-go", 1, "go go", False), ("red", 2, "red", False), ("red-garden", 2, "red gardens", False)]
    assert sorted(map(tuple, topics.counted(docs).collect())) == [("x", 1, *w) for w in want]


def test_names_within_need_no_broadcast_of_what_was_found(spark):
    from loomspan.operators import catalog

    names = spark.createDataFrame([("visual studio code", "vscode"), ("code", "code"), ("studio", "studio"), ("vim", "vim"), ("vi", "vim")], "name string, tool string")
    claims = spark.createDataFrame([(1, "Visual Studio Code, code"), (2, "studio vim vi"), (3, "none"), (4, None), (5, "visual studio code")], "k long, context string")
    found = catalog.named_within(claims, names, "k", "context")
    assert sorted(map(tuple, found.collect())) == [(1, "code"), (1, "vscode"), (2, "studio"), (2, "vim"), (5, "vscode")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_names_are_broadcast_and_not_what_is_joined_with_them(spark, tmp_path, monkeypatch):
    """Runs and parts of contexts are many more rows than Spark takes them for; past a bound of the names' bytes the join shuffles."""
    from loomspan.operators import catalog
    from loomspan.plans import registry

    registry.load()
    spark.range(9).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("umbrella_names", "section_slots"):
        for most, join in ((48 << 20, "BuildRight"), (0, "SortMergeJoin")):
            monkeypatch.setattr(catalog, "BROADCAST_BYTES", most)
            plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
            assert join in plan and "BuildLeft" not in plan, (name, plan)


def test_narrow_tables_are_spread(spark, tmp_path):
    """Long work on rows of a small file is dealt over all cores."""
    from loomspan.plans import registry
    from loomspan.sources.tables import spread

    registry.load()
    spark.createDataFrame([(1, "a b", "T", "B", 3)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(3).coalesce(1)).rdd.getNumPartitions() == 4 * cores
    for name in ("named_things", "page_albums", "page_meta", "label_shapes", "use_items", "topic_evidence", "page_figures", "outbound_links", "marked_requests"):
        assert "Repartition" in registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString(), name


def test_work_is_done_once(spark, tmp_path):
    """Sketches aren't kept for each user beside a distinct count; pages are parsed where their links are read, not for their addresses."""
    from loomspan.plans import registry

    registry.load()
    spark.sql("SELECT 1L AS event_id, timestamp '2024-01-01' AS ts, 5L AS user_id, 'view' AS event_type, 2.0D AS value UNION ALL SELECT 2L, timestamp '2024-01-01', NULL, NULL, 1.0D").write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("SELECT 1L AS page_id, 'https://a.b.example/x' AS url, '<a href=\"/y\">y</a>' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    spark.sql("SELECT 1L AS doc_id, 'é' AS text UNION ALL SELECT 2L, NULL").write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    counts = registry.QUERIES["approximate_counts"](spark, str(tmp_path))
    assert "count(distinct" not in plan(counts) and sorted((r["event_type"] or "", r["n"]) for r in counts.collect()) == [("", 1), ("view", 1)]
    assert plan(registry.QUERIES["link_networks"](spark, str(tmp_path))).count("MapInArrow") == 2
    texts = registry.QUERIES["unicode_normalize"](spark, str(tmp_path))
    assert "MapInArrow" in plan(texts) and sorted(map(tuple, texts.collect())) == [(1, "é"), (2, None)]


def test_rollup_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    """Joins and counts of claims are dealt over tasks by the rows of lineitem; results stay."""
    from loomspan.plans import catalogs
    from loomspan.sources import tables

    root = "/root/testdata/sf0.001"
    for q in (catalogs.whole_rollup, catalogs.one_row_per_tool):
        monkeypatch.setattr(tables, "TASK_ROWS", 1 << 19)
        want = sorted(map(tuple, q(spark, root).collect()))
        monkeypatch.setattr(tables, "TASK_ROWS", 500)
        got = q(spark, root)
        plan = got._jdf.queryExecution().executedPlan().toString()
        n = -(-tables.table(spark, root, "lineitem").count() // 500)
        assert n > 4 and all(f"hashpartitioning({k}" in plan for k in ("l_orderkey", "l_partkey", "origin")) and f", {n}), REPARTITION_BY_NUM" in plan
        assert sorted(map(tuple, got.collect())) == want
