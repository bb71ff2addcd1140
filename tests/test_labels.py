"""Labels, times and observation operators on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.functions import labels, times
from loomspan.operators import observation


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "tag"), [("EN_us", "en-us"), (" fr ", "fr"), ("x", ""), ("en--us", ""), ("a" * 36, ""), (None, "")])
def test_tag(spark, raw, tag):
    assert one(spark, labels.language_tag(F.lit(raw).cast("string"))) == tag


def test_languages(spark):
    assert one(spark, labels.is_english(F.lit("en-GB"))) and not one(spark, labels.is_english(F.lit("fr")))
    assert one(spark, labels.is_right_to_left(F.lit("he_IL"))) and not one(spark, labels.is_right_to_left(F.lit(None).cast("string")))


@pytest.mark.parametrize(("url", "vid"), [("https://youtu.be/abcdef1", "abcdef1"), ("https://www.youtube.com/watch?a=1&v=ABC_def-9", "ABC_def-9"), ("https://m.youtube.com/shorts/zzzzzz", "zzzzzz"), ("https://youtube.com/watch?v=abc", None), ("https://vimeo.com/?v=abcdefg", None)])
def test_video(spark, url, vid):
    assert one(spark, labels.video_id(F.lit(url))) == vid


@pytest.mark.parametrize(("domain", "name"), [("ada.lovelace.org", "Ada Lovelace"), ("blog.ada.org", None), ("ada.org", None), ("a1.b.org", None)])
def test_person(spark, domain, name):
    assert one(spark, labels.person_of_domain(F.lit(domain))) == name


def test_description(spark):
    text = "One two. " + "word " * 10
    assert one(spark, labels.description(F.lit(text), 15)) == "One two."
    assert one(spark, labels.description(F.lit("aaaa bbbb cccc dddd"), 12)) == "aaaa bbbb…"
    assert one(spark, labels.description(F.lit("a" * 30), 12)) == "a" * 12 + "…"
    assert one(spark, labels.description(F.lit(" short "), 12)) == "short"


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, times.fresh(t("2024-02-01"), t("2024-01-01"), 5)) and not one(spark, times.within_days(t("2024-02-01"), t("2024-01-01"), 5))
    assert [str(one(spark, c)) for c in times.quarter_bounds(F.lit("2026-Q4"))] == ["2026-10-01", "2027-01-01"] and one(spark, times.quarter_bounds(F.lit("2026-Q5"))[0]) is None
    assert [str(one(spark, c)) for c in times.month_bounds(F.lit("2026-11"))] == ["2026-11-01", "2026-12-01"]


def test_merge_and_match(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string"), spark.createDataFrame([(2, "y"), (3, "w"), (4, "n")], "k int, v string")
    assert sorted(map(tuple, observation.merged(a, b, "k", "v").collect())) == [(1, "x", "kept"), (2, "y", "same"), (3, "w", "updated"), (4, "n", "added")]
    claims = spark.createDataFrame([(1, "u", "a"), (2, None, "a"), (3, None, None)], "id int, url string, alias string")
    stages = [("url", spark.createDataFrame([("u", "t1")], "url string, target string")), ("alias", spark.createDataFrame([("a", "t2")], "alias string, target string"))]
    assert sorted(map(tuple, observation.first_match(claims, stages, "id").collect()), key=str) == [(1, "url", "t1"), (2, "alias", "t2"), (3, "none", None)]


def test_links(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "m string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z"), ("b", "a")], "s string, t string")
    got = observation.connections(e, m, "s", "t", "m")
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "a")]
    assert sorted(map(tuple, observation.neighbours(got, m, "s", "t", "m").collect())) == [("a", 1, 1), ("b", 1, 1), ("c", 0, 0)]
    walk = {r["start"]: r for r in observation.trail(got, got.select("s").distinct(), "s", "t", 1, 3).collect()}
    assert walk["a"]["path"] == "a>b b>a" and walk["a"]["end"] == "a"
    h = observation.snapshot_hash(m, ["m"]).first()
    assert h == observation.snapshot_hash(m.orderBy(F.desc("m")).repartition(3), ["m"]).first() and h["n"] == 3


def test_words_of_labels_end_at_accents(spark):
    """Ends of words are ASCII, whatever Java takes them for: an accented letter ends a word as any other sign does."""
    from loomspan.functions import uses

    assert one(spark, uses.is_sentence(F.lit("Soé there"))) and not one(spark, uses.is_sentence(F.lit("Sore there")))
    assert one(spark, uses.status(F.lit("éavoid it"))) == "unspecified" and one(spark, uses.status(F.lit("xavoid it"))) == "current"
    assert one(spark, uses.is_article(F.lit("a évs b"))) and one(spark, uses.is_empty_title(F.lit("5 min read")))
