"""Parsed pages against trees that were made at random, and what is made of them against plain versions."""

from __future__ import annotations

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from loomspan.operators import works
from loomspan.sources import tree

URL = "https://site.example/x/y?utm_source=feed#top"


def grow(r, depth=0):
    """A random element: (tag, class, children), children elements or words."""
    tag = r.choice(["div", "section", "ul", "nav", "article", "h1", "h2", "h3", "p", "span", "a"] if depth else ["body"])
    if tag in ("h1", "h2", "h3", "p", "span", "a"):
        inner = [r.choice(["word", "café &amp; bar", "x", ""]) for _ in range(r.randint(0, 2))]
        return tag, "", inner
    kids = [grow(r, depth + 1) if depth < 4 and r.random() < 0.8 else r.choice(["some", "text "]) for _ in range(r.randint(0, 6))]
    if tag == "ul":
        kids = [("li", r.choice(["", "a b", "b a"]), [k if isinstance(k, str) or k[0] not in ("ul",) else k]) for k in kids]
    return tag, r.choice(["", "", "c"]), kids


def source(e):
    if isinstance(e, str):
        return e
    tag, cls, kids = e
    href = f' href="/{abs(hash(str(kids))) % 50}"' if tag == "a" else ""
    return f"<{tag}{f' class=\"{cls}\"' if cls else ''}{href}>{''.join(map(source, kids))}</{tag}>"


def text(e):
    return e.replace("&amp;", "&") if isinstance(e, str) else "".join(map(text, e[2]))


def clean(t):
    return " ".join(t.split())


def plain_paths(root):
    """(tag, text, section) of each p, by walking: headings outside chrome and items, in order."""
    out, stack = [], []

    def walk(e, above):
        if isinstance(e, str):
            return
        tag = e[0]
        chrome, item = {"nav", "header", "footer"} & set(above), {"li", "td", "tr", "dt"} & set(above)
        if tag == "p" and clean(text(e)):
            out.append((clean(text(e)), " / ".join(t for _, t in stack), bool(chrome)))
        if tag in ("h1", "h2", "h3"):
            if clean(text(e)) and not chrome and not item:
                stack[:] = [x for x in stack if x[0] < int(tag[1])] + [(int(tag[1]), clean(text(e)))]
            return
        for k in e[2]:
            walk(k, [*above, tag])

    walk(root, [])
    return out


def plain_repeated(root):
    out = []

    def walk(e):
        groups = defaultdict(list)
        for k in e[2]:
            if not isinstance(k, str):
                groups[k[0], tuple(sorted(k[1].split()))].append(clean(text(k)))
                walk(k)
        out.extend((f"{e[0]}/{tag}", tuple(t for t in own if t)) for (tag, _), own in groups.items() if len(own) >= 3 and len([t for t in own if t]) >= 3)

    walk(root)
    return sorted(out)


def test_trees_equal_the_trees_they_were_made_from():
    r = random.Random(2)
    for _ in range(300):
        root = grow(r)
        row = tree.parse(source(root)).row()
        assert [(p["text"], p["section"], p["chrome"]) for p in row["paragraphs"]] == plain_paths(root)
        assert sorted((b["path"], tuple(i["text"] for i in b["items"])) for b in row["repeated"]) == plain_repeated(root)


def test_what_writers_leave_out():
    row = tree.parse("<p>one<b>two<p>three<ul><li>a<li>b<ul><li>x</ul><li>c</ul><table><tr><th>S<td>no<tr><td>1<td>2</table></b></i></p>tail").row()
    assert [p["text"] for p in row["paragraphs"]] == ["onetwo", "three"]
    assert [[i["text"] for i in b["items"]] for b in row["repeated"]] == [["a", "bx", "c"]]
    assert row["tables"] == [{"n": 9, "names": ["s"], "rows": [["1", "2"]]}]
    row = tree.parse("<title>A &lt;b&gt;</title><script>if (a < b) '</p>'</script><style>p{}</style><h1>C#</h1><p>x</p><h2>Uses #</h2><p>y<h3><p>z</h3></p>").row()
    assert row["title"] == "A <b>" and [p["section"] for p in row["paragraphs"]] == ["C#", "C# / Uses", "C# / Uses"]
    assert tree.parse(None).row()["links"] == [] and tree.parse("").row()["title"] == "" and tree.parse("a < b & c <").row()["passages"] == []
    row = tree.parse('<script type="application/ld+json">[{"a":1},{"@graph":[{"b":2},3]},4]</script><script type="application/ld+json">no</script>').row()
    assert [o for o in row["objects"]] == ['{"a": 1}', '{"@graph": [{"b": 2}, 3]}', '{"b": 2}']


def test_deep_and_long_pages_take_linear_time():
    def took(n):
        began = time.process_time()
        tree.parse("<b><span>" * n + "<h2>h</h2><p>x" * n + "</i>" * n + "<li>y" * n).row()
        return time.process_time() - began

    took(500)
    assert took(16000) < 30 * max(took(2000), 0.05)


TABLE = """<table><thead><tr><th data-sort-col=Year>Y<th data-sort-col="client">C<th data-sort-col="project">P<th data-sort-col="sector">S</thead>
<tbody><tr><td>2020<td>Ann &amp; Co<td>Big Site<td>Health<tr><td><td>Bob<td>App<td>Sport<tr><td><td>Bob<td>App<td>Sport<tr><td>1<td><td><td></tbody></table>"""
LINKS = '<a href="/work/big-site">Case</a><a href="/work/big-site">Case two</a><a href="https://else.example/work/no">no</a><a href="/projects/other-one/"></a>'
LIST = '<div><a href="/1">One</a><a href="/2">Two</a><a href="/1#x">Uno</a></div>'


def test_portfolio(spark):
    pages = [(1, URL, TABLE + LINKS + LIST), (2, URL, "<table><tr><th>sector</table>" + LINKS + LIST), (3, URL, LIST), (4, URL, None), (4, URL, "<p>nothing"), (5, "https://site.example/", TABLE)]
    t = tree.trees(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=("url",))
    got = lambda k, **x: sorted(tuple(r)[2:] for r in works.portfolio(t, "page_id", "url", **x).where(F.col("page_id") == k).collect())
    at = "https://site.example/x/y?utm_source=feed&work="
    assert got(1) == [("table", "", "Bob", "App", "Sport", "", f"{at}bob-app"), ("table", "", "Bob", "App", "Sport", "", f"{at}bob-app-2"), ("table", "2020", "Ann & Co", "Big Site", "Health", "", "https://site.example/work/big-site")]
    assert got(2) == [("link", "", "", "Case two", "", "", "https://site.example/work/big-site"), ("link", "", "", "other one", "", "", "https://site.example/projects/other-one/")]
    assert got(3) == [] and got(4) == [] and [x[3] for x in got(3, lists=True)] == ["Two", "Uno"]
    assert "https://site.example/?work=ann-co-big-site-2020" in [x[-1] for x in got(5)]


def test_collected(spark):
    ld = '<script type="application/ld+json">{"@type":["Thing","Book"],"name":"Named","url":"/w/1","image":"//img.example/1.png"}</script><script type="application/ld+json">{"@type":"Person","name":"No"}</script>'
    fig = '<figure><a href="/w/1"><img src="/a.png" alt="Alt"></a></figure><figure><a href="/a.png"><img src="/a.png" alt="Only a picture"></a></figure><figure><a href=/w/2><img alt="Two" src=b></a></figure>'
    own = '<title>Page one</title><meta property="og:title" content="OG"><meta property="og:description" content="From the page"><p>A paragraph that is long enough to be one.</p>'
    pages = [(1, "https://site.example/", ld + fig), (2, "https://site.example/w/1?utm_source=x", own), (3, "https://other.example/", '<ul><li><a href="/w/1">a<li><a href="/w/1#f">b<li>c</ul>'), (4, None, own), (5, "https://site.example/", None)]
    t = tree.trees(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=("url",))
    got = {r["url"]: tuple(r)[1:] for r in works.collected(works.candidates(t, "page_id", "url"), "page_id").collect()}
    assert got == {
        "https://site.example/w/1": ("Named", "From the page", "https://img.example/1.png", None, "schema", "schema,figure,open-graph,page", 4),
        "https://site.example/w/2": ("Two", None, "https://site.example/b", None, "figure", "figure", 1),
        "https://other.example/w/1": ("a", None, None, None, "list", "list", 2),
    }


def test_passages(spark):
    long = "Sentence one. " * 100
    pages = [(1, f"<h1>T</h1><article><h2>In</h2><p>{long}</p></article><article></article><nav><article>no</article></nav>"), (2, "<h1>T</h1><p>a b. c</p><footer><p>f</p></footer>"), (3, None)]
    got = sorted(tuple(r) for r in works.passages(tree.trees(spark.createDataFrame(pages, "page_id long, html string")), "page_id").drop("n").collect())
    assert got == [(1, "article", "T", ("In" + long)[:800].rstrip(), 57), (2, "paragraph", "T", "a b. c", 2)]


def test_ampersands_of_titles_that_are_cut_short(spark):
    page = "<title>A &amp</title><h1>B &amp&amp</h1><article><h1>C &quot</h1><p>D &amp;amp E &copy F</p></article><script type='application/ld+json'>{\"n\":\"&amp\"}</script>"
    row = tree.trees(spark.createDataFrame([(1, page)], "page_id long, html string"), loose=True).first()["tree"]
    assert (row["title"], row["paragraphs"][0]["section"], row["passages"][0]["section"], row["objects"]) == ("A &", "C &quot", "B &&", ['{"n": "&amp"}'])
    assert row["passages"][0]["text"] == "C &quotD &amp E &copy F" and tree.parse(page).row()["title"] == "A &amp"


def test_queries_read_ampersands_as_their_sql(spark, tmp_path):
    """On a page whose title ends within a reference."""
    import duckdb

    from loomspan.plans import registry

    registry.load()
    words = "A paragraph of enough words &amp; signs"
    page = f"<html><head><title>One &amp</title></head><body><nav><ul>{''.join(f'<li><a href=\"/{k}\">x{k} &amp</a></li>' for k in range(3))}</ul></nav><article><h1>One &amp</h1><p>{words} &amp</p><p>{words}.</p><p>{words}!</p></article></body></html>"
    spark.createDataFrame([(1, URL, page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        for name in ("topic_passages", "section_paragraphs", "collected_works", "repeated_blocks", "portfolio_works"):
            want = con.sql(registry.ORACLES[name])
            got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str), name
