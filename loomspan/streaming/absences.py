"""Absences that wait for proof, as state of a stream with timers.

A look at a user (ts, present) begins or goes on with a spell of looks. Within a spell an absence is pending until a look a day or
more after its first look proves it (removed); a presence ends it (current). A user without a look for `idle` is forgotten:
by a timer when the watermark has passed, or, if looks come back before the timer could run, when they do. Either way a spell
ends where the gap between looks is over `idle`, so results don't depend on how rows are cut into batches.

State is one row for each GROUP users whose ids follow each other, with a spell for each of them: every call from a task to the
state costs time, so that a few are made for each group and batch and not for each user. Ids with gaps make smaller groups, none makes larger
ones. A group's timer is the first of its users' timers. Of a group's rows in one batch only user, time and presence are held, to be put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOURS = 24
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Users of a group are 2**GROUP_BITS at most.
GROUP_BITS = 6
_STATE = "spells binary"
_OUT = "user_id long, start timestamp, last timestamp, looks long, state string, expired boolean"


class Spells(StatefulProcessor):
    """A spell is user, start, last, looks, shown, since, until. Times are in microseconds; 0 in `shown`, `since` and `until` says that
    there was none."""

    def __init__(self, idle_us: int, hours: int = HOURS):
        self.idle, self.wait = idle_us, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.group = handle, handle.getValueState("group", _STATE)

    def _frame(self, spells: np.ndarray, expired: np.ndarray) -> pd.DataFrame:
        user, start, last, looks, shown, since, until = spells.T
        state = np.select([shown == 0, since == 0, until - since >= self.wait], ["unseen", "current", "removed"], "pending").astype(object)
        return pd.DataFrame({"user_id": user, "start": pd.to_datetime(start, unit="us"), "last": pd.to_datetime(last, unit="us"), "looks": looks, "state": state, "expired": expired})

    def _timers(self, spells: np.ndarray) -> np.ndarray:
        return (spells[:, 2] + self.idle) // 1000 + 1

    def _held(self) -> np.ndarray:
        return np.frombuffer(self.group.get()[0], np.int64).reshape(-1, 7) if self.group.exists() else np.zeros((0, 7), np.int64)

    def _hold(self, spells: np.ndarray) -> None:
        self.group.update((spells.astype(np.int64).tobytes(),))
        self.handle.registerTimer(int(self._timers(spells).min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks = [(b["user_id"].to_numpy(np.int64), b["us"].to_numpy(np.int64), b["present"].to_numpy(bool)) for b in rows]
        users, at, present = (np.concatenate(x) for x in zip(*blocks))
        order = np.lexsort((~present, at, users))  # a presence first, of looks at one time
        held, ended, seen = self._held(), [], set()
        if len(held):
            self.handle.deleteTimer(int(self._timers(held).min()))
        spells = {x[0]: tuple(x) for x in held.tolist()}
        for user, t, p in zip(users[order].tolist(), at[order].tolist(), present[order].tolist()):
            s = spells.get(user)
            seen.add(user)
            if s is not None and t - s[2] > self.idle:
                ended.append(s)
                s = None
            _, start, _, looks, shown, since, until = s or (user, t, t, 0, 0, 0, 0)
            if p:
                spells[user] = user, start, t, looks + 1, t, 0, 0
            elif t > shown:
                spells[user] = user, start, t, looks + 1, shown, since or t, t
            else:  # an absence at the time of a presence says nothing
                spells[user] = user, start, t, looks + 1, shown, since, until
        self._hold(np.array(list(spells.values()), np.int64))
        out = np.array([*ended, *(spells[u] for u in sorted(seen))], np.int64)
        yield self._frame(out, np.arange(len(out)) < len(ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._timers(held) <= timerValues.getCurrentWatermarkInMs()
        if due.all():
            self.group.clear()
        else:
            self._hold(held[~due])
        yield self._frame(held[due], np.ones(int(due.sum()), bool))

    def close(self) -> None:
        pass


def spells(looks: DataFrame, idle: str, delay: str, hours: int = HOURS) -> DataFrame:
    """Streaming looks (user_id, ts, present): a row for each user of a batch with its spell so far, and one for each spell that ended."""
    rows = looks.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "present").where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.withColumn("us", F.unix_micros("ts")).withColumn("_group", F.shiftright(F.col("user_id").cast("long"), GROUP_BITS))
    return rows.groupBy("_group").transformWithStateInPandas(Spells(int(pd.Timedelta(idle).total_seconds() * 1e6), hours), _OUT, "update", "EventTime")


def run(rows: DataFrame, folder: str) -> None:
    """Take up what has newly arrived; state is kept in RocksDB, below the checkpoint."""
    spark, key = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={n}")

    spark.conf.set(key, PROVIDER)
    try:
        q = rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)


def results(spark, folder: str) -> DataFrame:
    """user_id, start, last, looks, state, expired: each spell as it stands."""
    rows = spark.read.parquet(f"{folder}/result")
    x = F.max_by(F.struct("last", "looks", "state", "expired"), F.struct("expired", "batch"))
    return rows.groupBy("user_id", "start").agg(x.alias("x")).select("user_id", "start", "x.*")
