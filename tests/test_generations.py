"""Generations, views published together, periods computed anew where they changed; late rows and spells of streams."""

from __future__ import annotations

import os
import random
import signal
import subprocess
import sys
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspan.operators import history, projections, reconcile
from loomspan.sources.generations import Generations
from loomspan.streaming import absences, late
from loomspan.streaming.ledger import new_folder

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "k long, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {str(p) for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_phases(spark):
    g = Generations(spark, new_folder(spark, "g"))
    assert g.pin() == 0 and g.views() == {} and g.published("d", SCHEMA).collect() == [] and g.status("a") is None
    put = lambda run, *x: g.write(run, "d", spark.createDataFrame(list(x), SCHEMA))
    g.start("a", base="1")
    put("a", (1, "x"))
    put("a", (1, "y"), (2, None))  # writing again replaces
    assert g.published("d", SCHEMA).collect() == [] and len(g.candidate("d", SCHEMA, "a").collect()) == 2
    for early in (lambda: g.commit("a", "1"), lambda: g.start("a"), lambda: g.validate("b"), lambda: g.fate("a", "1")):
        with pytest.raises(ValueError):
            early()
    assert g.validate("a")["sets"]["d"]["n"] == 2
    assert [g.fate("a", *x) for x in (("1",), ("2",), ("2", "retry"), ("1", "abort"))] == ["retry", "supersede", "supersede", "abort"]
    for closed in (lambda: put("a", (3, "z")), lambda: g.commit("a", " ")):
        with pytest.raises(ValueError):
            closed()
    assert g.commit("a", "1") == 1 and g.status("a") == "committed"
    for done in (lambda: g.abort("a"), lambda: g.commit("a", "1")):
        with pytest.raises(ValueError):
            done()
    for run in ("b", "c"):
        g.start(run)
        put(run, (9, run))
        g.validate(run)
    g.abort("c")
    pinned = g.pin()
    g.commit("b", "2")
    assert rows(g.published("d", SCHEMA, pinned)) == [(1, "y", "a"), (2, None, "a")] and rows(g.published("d", SCHEMA)) == [(1, "y", "a"), (2, None, "a"), (9, "b", "b")]
    assert g.status("c") == "aborted" and [c["run"] for c in g.commits()] == ["a", "b"]


def test_two_commits_at_once(spark, monkeypatch):
    g = Generations(spark, new_folder(spark, "g"))
    for run in ("a", "b"):
        g.start(run)
        g.write(run, "d", spark.createDataFrame([(1, run)], SCHEMA))
        g.validate(run)
    g.commit("a", "1")
    whole, seen = g.pin, []
    monkeypatch.setattr(g, "pin", lambda: (seen.append(1), 0 if len(seen) == 1 else whole())[1])  # a pointer that came in between
    monkeypatch.setattr(g, "status", lambda run: "validated")
    assert g.commit("b", "1") == 2 and len(rows(Generations(spark, g.path).published("d", SCHEMA))) == 2


def test_writer_dies_between_phases(spark, tmp_path):
    at = f"{tmp_path}/g"
    script = f"""
import os, signal
from pyspark.sql import SparkSession
from loomspan.sources.generations import Generations
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
g = Generations(spark, {at!r})
for run in ("first", "second"):
    g.start(run)
    g.write(run, "d", spark.range(5).selectExpr("id AS k", "'{{}}' AS v".format(run)))
    g.validate(run)
    if run == "second":
        os.kill(os.getpid(), signal.SIGKILL)
    g.commit(run, "1")
"""
    died = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=120)
    assert died.returncode == -signal.SIGKILL
    g = Generations(spark, at)
    assert g.status("second") == "validated" and {r["run"] for r in g.published("d", SCHEMA).collect()} == {"first"}
    assert g.commit("second", "1") == 2 and g.published("d", SCHEMA).count() == 10


VIEWS = {"a": (["x"], None), "ab": (["x", "y"], None), "some": (["x", "y"], "y = 'p'"), "all": ([], None)}


def test_projections(spark):
    r = random.Random(3)
    data = [(r.choice([None, 1, 2]), r.choice([None, "p", "q"]), r.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(data, "x int, y string, v int")
    want = defaultdict(lambda: [0, 0])
    for x, y, v in data:
        for key in (("a", x, None), ("ab", x, y), ("all", None, None), *([("some", x, y)] if y == "p" else [])):
            want[key][0] += 1
            want[key][1] += v
    got = projections.projections(df, VIEWS, [F.count("*").alias("n"), F.sum("v").alias("s")])
    assert rows(got) == sorted(((*k, *v) for k, v in want.items()), key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {x[0] for x in rows(projections.projections(df.where("false"), VIEWS, [F.count("*").alias("n")]))} <= {"all"}


def test_views_are_written_if_they_changed(spark):
    g = Generations(spark, new_folder(spark, "g"))
    base = [(1, "p", 1), (2, "q", 2)]
    for n, more in enumerate(([], [], [(3, "q", 5)]), 1):
        g.start(str(n))
        g.write_views(str(n), projections.projections(spark.createDataFrame(base + more, "x int, y string, v int"), VIEWS, [F.count("*").alias("n")]))
        g.validate(str(n))
        before = files(g.path)
        g.commit(str(n), "1")
        assert files(g.path) <= before
    assert not files(f"{g.path}/views/run=2")
    assert {v: g.views(3)[v]["run"] for v in VIEWS} == {"a": "3", "ab": "3", "some": "1", "all": "3"} and {d["run"] for d in g.views(2).values()} == {"1"}
    assert g.view("all", 2).first()["n"] == 2 and g.view("all").first()["n"] == 3 and g.view("some").count() == 1


def test_reconcile(spark):
    at = new_folder(spark, "r")
    step = lambda df: df.groupBy("p").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    first = [("1", 1), ("1", 2), ("2", 3), ("3", 4), (None, 5)]
    make = lambda x: spark.createDataFrame(x, "p string, v int").repartition(3)
    state = lambda: {r["period"]: (r["n"], r["s"]) for r in reconcile.state(spark, at).collect()}
    go = lambda x: reconcile.reconcile(make(x), at, "p", ["v"], step)
    assert go(first) == 4 and state() == {"1": (2, 3), "2": (1, 3), "3": (1, 4), "none": (1, 5)}
    before = files(at)
    assert go(first[::-1]) == 0 and files(at) == before
    second = [("1", 1), ("1", 2), ("2", 3), ("2", 9), (None, 5), ("4", 1)]  # one more, one gone, one new
    assert go(second) == 3 and state() == {"1": (2, 3), "2": (2, 12), "none": (1, 5), "4": (1, 1)}
    after = files(at)
    assert {f for f in before if "period=1/" in f or "period=none/" in f} == {f for f in after if "period=1/" in f or "period=none/" in f}
    # A run that died after it had replaced some periods: the rest is seen to be old.
    third = [*second, ("1", 7), ("4", 7)]
    reconcile.reconcile(make([x for x in third if x[0] != "4"] + [("4", 1)]), at, "p", ["v"], step)
    assert go(third) == 1 and state()["4"] == (2, 8) and state()["1"] == (3, 10)


def test_late_rows_go_to_the_side(spark):
    r, folder, day = random.Random(5), new_folder(spark, "late"), datetime(2024, 1, 1)
    batches = [[(100 * b + k, None if r.random() < 0.1 else day + timedelta(hours=r.randint(0, 60 * (b + 1)))) for k in range(40)] for b in range(4)]
    batches[2] = []
    mark, want = None, []
    for b in batches:
        seen = [t for _, t in b if t is not None and (mark is None or t >= mark - timedelta(hours=12))]
        want += [(k, "untimed" if t is None else "late" if mark is not None and t < mark - timedelta(hours=12) else "kept") for k, t in b]
        mark = max([*seen, *([mark] if mark else [])], default=None)
    for b in batches:
        df = spark.createDataFrame(b, "k long, ts timestamp")
        df.write.mode("append").parquet(f"{folder}/input")
        late.route(late.arrivals(df, f"{folder}/input"), folder, "ts", "12 HOURS")
    got = rows(late.routed(spark, folder).select("k", "fate"))
    assert got == sorted(want, key=str) and {f for _, f in got} == {"kept", "late", "untimed"}
    # The last batch runs again, as after a failure: its rows are split as before.
    commits = sorted((p for p in Path(f"{folder}/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    late.route(late.arrivals(df, f"{folder}/input"), folder, "ts", "12 HOURS")
    assert rows(late.routed(spark, folder).select("k", "fate")) == sorted(want, key=str)


def test_spells_equal_the_batch_where_none_expires(spark):
    r, folder, day = random.Random(6), new_folder(spark, "spells"), datetime(2024, 1, 1)
    looks = sorted(((r.randint(1, 6), day + timedelta(minutes=r.randint(0, 6000)), r.random() < 0.3) for _ in range(90)), key=lambda x: x[1])
    schema = "user_id long, ts timestamp, present boolean"
    for part in (looks[:40], looks[40:], []):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/input")
        absences.run(absences.spells(late.arrivals(spark.createDataFrame([], schema), f"{folder}/input"), "900 days", "1 hour"), folder)
    want = history.pending(spark.createDataFrame(looks, schema), ["user_id"], "ts", "present").select("user_id", "state")
    got = absences.results(spark, folder).where("state <> 'unseen'")
    assert rows(got.select("user_id", "state")) == rows(want) and not got.where("expired").count()


def test_spells_of_a_group_share_state_and_timer():
    """A group's users take one row of state and one timer, however many they are; each is forgotten at its own time."""
    import pandas as pd

    class Handle:
        value, timers, calls = None, set(), 0

        def getValueState(self, name, schema):
            return self

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

        def registerTimer(self, at):
            self.calls, self.timers = self.calls + 1, self.timers | {at}

        def deleteTimer(self, at):
            self.calls, self.timers = self.calls + 1, self.timers - {at}

    class Mark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    hour, p, h = 3_600_000_000, absences.Spells(36 * 3_600_000_000), Handle()
    p.init(h)
    rows = pd.DataFrame({"user_id": [*range(50), 7], "us": [*((u + 1) * hour for u in range(50)), 50 * hour], "present": [u % 2 == 0 for u in range(51)]})
    out = pd.concat(p.handleInputRows((0,), iter([rows]), Mark(0)))
    assert len(out) == 51 and out["expired"].sum() == 1 and h.calls <= 5
    assert h.timers == {37 * 3_600_000 + 1}
    h.timers.clear()
    gone = pd.concat(p.handleExpiredTimer((0,), Mark(46 * 3_600_000 + 1), None))
    assert sorted(gone["user_id"]) == [0, 1, 2, 3, 4, 5, 6, 8, 9] and gone["expired"].all()
    assert h.timers == {47 * 3_600_000 + 1}
    h.timers.clear()
    assert len(pd.concat(p.handleExpiredTimer((0,), Mark(10**9), None))) == 41 and h.value is None and not h.timers
