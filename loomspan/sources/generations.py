"""Generations: what a run writes is seen by no reader until one pointer says so, and then all of it at once.

    runs/R/started.json, validated.json, aborted.json    what has happened to a run, each file made once
    data/NAME/run=R/                                     the rows that a run gathered of a dataset
    views/run=R/view=V/                                  the rows of a view as a run made it
    commits/N.json                                       the N-th pointer: its run, and the run that each view is of

A run is started, writes, is validated (its rows are counted and digested as they stand in the files) and is committed. The
commit is one rename onto a name that mustn't exist: of two at once one fails and takes the next number. A reader pins a number
and sees the runs committed up to it, whatever is committed later. A run that dies at any point leaves files that no pointer
names; it can be taken up again, or aborted.

Publishing views writes all of them from one plan in one job. A view whose rows are those of the pointer before keeps its
files there, and the copy goes.

Defined results: an empty store has no pointer, and reads give no rows; a dataset that a run lacks has no rows of it. Paths
are any that Spark writes. Renames are atomic where the file system's are; a local folder, as in tests, checks first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """n and digest of rows, whatever their order and partitions; for each value of `by`, if given."""
    own = F.xxhash64(*(F.col(c) for c in sorted(rows.columns))).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hex(F.coalesce(F.sum(own), F.lit(0)).cast("string")).alias("digest"))


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # Files

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self._conf)

    def _exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def _names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> dict:
        p, fs = self._at(name)
        f = fs.open(p)
        try:
            return json.loads(bytes(f.readAllBytes()))
        finally:
            f.close()

    def _make(self, name: str, record: dict) -> bool:
        """Write a file as a whole, unless there is one of that name; whether it was written."""
        tmp, fs = self._at(f"{name}.{uuid.uuid4().hex[:8]}.tmp")
        f = fs.create(tmp, True)
        f.write(json.dumps(record).encode())
        f.close()
        to, _ = self._at(name)
        gateway = self.spark.sparkContext._gateway
        never = gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self._conf).rename(tmp, to, never)
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _drop(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    # Runs

    def status(self, run: str) -> str | None:
        """started, validated, committed or aborted; None for a run that nobody started."""
        if any(c["run"] == run for c in self.commits()):
            return "committed"
        return next((s for s in ("aborted", "validated", "started") if self._exists(f"runs/{run}/{s}.json")), None)

    def _must(self, run: str, *allowed: str) -> None:
        now = self.status(run)
        if now not in allowed:
            raise ValueError(f"generation {run} is {now or 'unknown'}; it must be {' or '.join(allowed)}")

    def start(self, run: str, base: str = "") -> None:
        """Start a run; `base` is the version of what it builds on."""
        if not self._make(f"runs/{run}/started.json", {"run": run, "base": base}):
            raise ValueError(f"generation {run} was started before")

    def write(self, run: str, name: str, rows: DataFrame) -> None:
        """The rows of a dataset that a started run gathered; writing again replaces them."""
        self._must(run, "started")
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{name}/run={run}")

    def write_views(self, run: str, rows: DataFrame) -> None:
        """The views of a run: rows with a column `view`, all in one job."""
        self._must(run, "started")
        rows.write.mode("overwrite").partitionBy("view").parquet(f"{self.path}/views/run={run}")

    def validate(self, run: str) -> dict:
        """Count and digest what a run's files hold. Nothing may be written to it from here on."""
        self._must(run, "started")
        sets = {n: digests(self.spark.read.parquet(f"{self.path}/data/{n}/run={run}")).first().asDict() for n in self._names("data") if self._exists(f"data/{n}/run={run}")}
        views = {}
        if self._exists(f"views/run={run}"):
            # Each view for itself would read the files as often; columns that a view lacks are null in all its rows.
            views = {r["view"]: {"n": r["n"], "digest": r["digest"]} for r in digests(self.spark.read.parquet(f"{self.path}/views/run={run}"), ["view"]).collect()}
        record = {"run": run, "sets": sets, "views": views}
        if not self._make(f"runs/{run}/validated.json", record):
            raise ValueError(f"generation {run} was validated before")
        return record

    def commit(self, run: str, version: str) -> int:
        """Make a validated run's rows and views visible; the pointer's number."""
        if not version.strip():
            raise ValueError("a commit needs the version it belongs to")
        self._must(run, "validated")
        made = self._read(f"runs/{run}/validated.json")["views"]
        while True:
            n = self.pin() + 1
            views = self._read(f"commits/{n - 1:09d}.json")["views"] if n > 1 else {}
            new = {v: {**d, "run": run} for v, d in made.items() if {k: views.get(v, {}).get(k) for k in ("n", "digest")} != d}
            if self._make(f"commits/{n:09d}.json", {"number": n, "run": run, "version": version, "views": views | new}):
                break
        for v in made.keys() - new.keys():
            self._drop(f"views/run={run}/view={v}")
        return n

    def abort(self, run: str) -> None:
        """End a run that won't be committed. Its rows may stay, but nobody sees them."""
        self._must(run, "started", "validated")
        self._make(f"runs/{run}/aborted.json", {"run": run})

    def fate(self, run: str, base: str, mode: str | None = None) -> str:
        """What to do with a validated run that wasn't committed: retry while its base still holds, else supersede; abort if told so."""
        self._must(run, "validated")
        same = self._read(f"runs/{run}/started.json")["base"] == base
        return mode if mode in ("abort", "supersede") else "retry" if same else "supersede"

    # Readers

    def pin(self) -> int:
        """The number of the latest pointer, 0 without one."""
        return max((int(n[:-5]) for n in self._names("commits") if n.endswith(".json")), default=0)

    def commits(self, at: int | None = None) -> list[dict]:
        """The pointers up to number `at`: one small row for each generation."""
        if not self.pin():
            return []
        rows = self.spark.read.schema("number long, run string, version string").json(f"{self.path}/commits/*.json")
        return [r.asDict() for r in (rows if at is None else rows.where(F.col("number") <= at)).orderBy("number").collect()]

    def _rows(self, name: str, runs: list[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/data/{name}/run={r}" for r in runs if self._exists(f"data/{name}/run={r}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, run string")
        rows = self.spark.read.schema(f"{schema}, run string").option("basePath", f"{self.path}/data/{name}").parquet(*paths)
        return rows

    def published(self, name: str, schema: str, at: int | None = None) -> DataFrame:
        """A dataset's rows of all committed runs, up to pointer `at`, with their run. Only those runs' folders are listed."""
        return self._rows(name, [c["run"] for c in self.commits(at)], schema)

    def candidate(self, name: str, schema: str, run: str) -> DataFrame:
        """What a run would publish: the rows of all committed runs, and its own."""
        done = [c["run"] for c in self.commits()]
        return self._rows(name, done if run in done else [*done, run], schema)

    def views(self, at: int | None = None) -> dict[str, dict]:
        """Of each view that pointer `at` publishes: its run, n and digest."""
        n = self.pin() if at is None else at
        return self._read(f"commits/{n:09d}.json")["views"] if n else {}

    def view(self, name: str, at: int | None = None) -> DataFrame:
        """The rows of a published view."""
        return self.spark.read.parquet(f"{self.path}/views/run={self.views(at)[name]['run']}/view={name}")
