"""Hosts, nearest sites and damaged records against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import hosts, similar
from loomspan.sources import quarantine
from loomspan.streaming.ledger import new_folder


@pytest.mark.parametrize("bound", [48 << 20, 0])
def test_longest_rule(spark, bound, monkeypatch):
    monkeypatch.setattr(hosts, "BROADCAST_BYTES", bound)
    r = random.Random(1)
    labels = ["a", "b", "com", "x"]
    rules = [(".".join(r.choice(labels) for _ in range(r.randint(1, 3))), r.random() < 0.5, f"n{k}") for k in range(12)]
    rows = [(k, ".".join(r.choice(labels) for _ in range(r.randint(1, 4))) + r.choice(["", "."])) for k in range(80)] + [(90, None), (91, ""), (92, " A.COM ")]

    def plain(h):
        h = (h or "").strip().lower().removesuffix(".")
        fits = [(e, len(p), n) for p, e, n in rules if (h == p if e else h.endswith(f".{p}"))] if h else []
        best = max((f[:2] for f in fits), default=None)
        return min((n for *f, n in fits if tuple(f) == best), default="web")

    got = hosts.classified(spark.createDataFrame(rows, "k int, host string"), "host", spark.createDataFrame(rules, "pattern string, exact boolean, network string"))
    assert {x["k"]: x["network"] for x in got.collect()} == {k: plain(h) for k, h in rows}


def test_networks_and_profiles(spark):
    cases = {
        "https://GitHub.com/ann": ("github", True), "https://github.com/ann/repo": ("github", False), "https://github.com/pricing": ("github", False), "https://ann.github.io/": ("github", False), "https://www.linkedin.com/in/ann": ("linkedin", True),
        "https://linkedin.com/in": ("linkedin", False), "https://x.com/i": ("x", False), "https://www.reddit.com/u/ann": ("reddit", True), "https://reddit.com/r/ann": ("reddit", False), "https://youtube.com/@ann": ("youtube", True),
        "https://youtube.com/feed": ("youtube", False), "https://ann.substack.com": ("substack", True), "https://notsubstack.com/": ("web", False), "https://mastodon.social/@ann/1": ("mastodon", True), "https://mastodon.social/a/b": ("mastodon", False),
        "https://discord.gg/abc": ("discord", True), "https://discord.com/abc": ("discord", False), "https://vk.com/share?u=1": ("vk", False), "https://else.example/ann": ("web", False), "https://bsky.app/profile/ann": ("bluesky", True),
    }
    from loomspan.functions import urls

    rows = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("host", urls.host(F.col("url")))
    got = hosts.profiles(hosts.classified(rows, "host", hosts.networks(spark)), "url", hosts.profile_rules(spark))
    assert {r["url"]: (r["network"], r["profile"]) for r in got.collect()} == cases


def test_pairs_lose_none(spark):
    r = random.Random(8)
    sets = {k: {r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 9))} for k in range(60)} | {100: set("abcdef"), 101: set("abcdef"), 102: set("qrs")}
    rows = [(k, t) for k, s in sets.items() for t in s] * 2 + [(5, None), (None, "a")]
    df = spark.createDataFrame(rows, "site int, topic string")
    for least in (0.25, 0.5, 0.8, 1.0):
        want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x | y and len(x & y) / len(x | y) >= least}
        assert {tuple(p)[:3] for p in similar.pairs(df, "site", "topic", least).collect()} == want
    near = [tuple(x) for x in similar.nearest(df, "site", "topic", 0.5, 2).orderBy("site", "rank").collect()]
    for k in sets:
        own = sorted(((-len(sets[k] & s) / len(sets[k] | s), o) for o, s in sets.items() if o != k and sets[k] | s and len(sets[k] & s) / len(sets[k] | s) >= 0.5))[:2]
        assert [(n[1], n[3]) for n in near if n[0] == k] == [(o, -v) for v, o in own]
    assert similar.nearest(df.where("false"), "site", "topic", 0.5, 2).collect() == []


def test_quarantine(spark):
    at = new_folder(spark, "q")
    good = [{"id": 1, "name": 'a "b", c', "v": 1.5}, {"id": 2, "name": None, "v": None}, {"id": 3, "more": [1]}]
    bad = {'{"id": 4': "not a record", "[1]": "not a record", "null": "not a record", "x": "not a record", '{"id": "y", "v": 1}': "wrong type: id", '{"id": 5, "v": "z"}': "wrong type: v", '{"name": "n"}': "missing: id", '{"id": null}': "missing: id"}
    spark.createDataFrame([("﻿" + json.dumps(good[0]),), *((json.dumps(g) + "\r",) for g in good[1:]), ("",), ("  ",), *((b,) for b in bad)], "value string").coalesce(1).write.text(f"{at}/j")
    ok, aside = quarantine.split(quarantine.json_lines(spark, f"{at}/j", "id long, name string, v double", ["id"]), f"{at}/bj")
    assert sorted((r["id"], r["name"], r["v"]) for r in ok.collect()) == [(1, 'a "b", c', 1.5), (2, None, None), (3, None, None)]
    assert {r["line"]: r["reason"] for r in aside.collect()} == bad and all(r["file"].startswith("part-") for r in aside.collect())
    lines = {'1,"a ""b"", c",1.5': (1, 'a "b", c', 1.5), "2,,": (2, None, None), '3,"open,1': "not a record", "4,x": "wrong columns", "5,x,1,2": "wrong columns", "y,x,1": "wrong type: id", "6,x,z": "wrong type: v", ",x,1": "missing: id"}
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{at}/c")
    ok, aside = quarantine.split(quarantine.csv_lines(spark, f"{at}/c", "id long, name string, v double", ["id"]), f"{at}/bc")
    assert sorted(tuple(r)[:3] for r in ok.collect()) == [x for x in lines.values() if isinstance(x, tuple)]
    assert {r["line"]: r["reason"] for r in aside.collect()} == {k: v for k, v in lines.items() if isinstance(v, str)}


def test_nearest_among_copies(spark):
    """Sites with the same topics are held against others once: their pairs aren't made, the nearest sites are those of all pairs."""
    rng = random.Random(5)
    kinds = [sorted(rng.sample(range(9), rng.randint(1, 5))) for _ in range(9)]
    sets = {i: set(kinds[i % 9]) for i in range(40)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "site long, topic long")
    want = set()
    for i, a in sets.items():
        near = sorted((-len(a & b) / len(a | b), j, len(a & b)) for j, b in sets.items() if j != i and len(a & b) / len(a | b) >= 0.25)
        want |= {(i, j, n, -s, k + 1) for k, (s, j, n) in enumerate(near[:3])}
    found = similar.nearest(rows, "site", "topic", 0.25, 3)
    assert {tuple(r) for r in found.collect()} == want
    assert similar.classes(rows, "site", "topic").select("of").distinct().count() == len({tuple(k) for k in kinds})


def test_nearest_by_blocks(spark, monkeypatch):
    """Sets that nearly all meet are held against each other in blocks; what comes out is that of the join, whatever the blocks."""
    rng = random.Random(6)
    kinds = [sorted(rng.sample([f"t{k}" for k in range(30)], rng.randint(1, 20))) for _ in range(60)]
    sets = {f"s{i}": set(kinds[i % 60]) for i in range(70)} | {"é": {"x"}, "z": {"x", "y"}}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [("n", None), (None, "t1")], "site string, topic string")
    want = set()
    for i, a in sets.items():
        near = sorted((-len(a & b) / len(a | b), j, len(a & b)) for j, b in sets.items() if j != i and len(a & b) / len(a | b) >= 0.25)
        want |= {(i, j, n, -s, k + 1) for k, (s, j, n) in enumerate(near[:3])}
    assert {tuple(r) for r in similar.nearest(rows, "site", "topic", 0.25, 3).collect()} == want
    monkeypatch.setattr(similar, "MEETINGS", 0)
    for changed in ({}, {"SETS": 20, "ROWS": 7, "COLUMNS": 4, "CELLS": 40}):
        for name, value in changed.items():
            monkeypatch.setattr(similar, name, value)
        found = similar.nearest(rows, "site", "topic", 0.25, 3)
        assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        assert {tuple(r) for r in found.collect()} == want


def test_crowded_sets_do_not_meet_as_rows(spark):
    """Users who all do much the same make no rows by their square."""
    rows = spark.range(1500).selectExpr("id AS site", "explode(filter(sequence(0, 99), x -> pmod(xxhash64(id, x), 2) = 0)) AS topic")
    plan = similar.nearest(rows, "site", "topic", 0.25, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
