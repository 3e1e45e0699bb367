"""Streamed episodes."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that stateful processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of threads that have a state each.
BUCKETS = 1024
CLOSED = "thread_id string, episode_id string, start_utc timestamp, end_utc timestamp, n_events bigint, first_id string"
SESSION = "thread_id string, episode bigint, start_utc timestamp, end_utc timestamp, n_events bigint, first_id string"


def sessions(events: DataFrame, gap_minutes: int = 30, late_minutes: int = 60) -> DataFrame:
    """(thread_id, start_utc, end_utc, n_events) of sessions, each emitted once the watermark passed it.

    Spark's session window ends a session at a gap of exactly its length, so a microsecond
    more makes equal gaps stay together.  Later rows than the watermark are dropped.
    """
    gap = F.lit(f"{gap_minutes} minutes 1 microsecond")
    held = events.where("thread_id IS NOT NULL").withWatermark("t_utc", f"{late_minutes} minutes")
    out = held.groupBy("thread_id", F.session_window("t_utc", gap).alias("w")).agg(F.min("t_utc").alias("start_utc"), F.max("t_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_events"))
    return out.select("thread_id", "start_utc", "end_utc", "n_events")


def exact_episodes(events: DataFrame, gap_minutes: float = 30, late_minutes: int = 60) -> DataFrame:
    """Episodes with their numbers and first ids, by a state for each thread.

    The state holds a thread's events that the watermark has not passed by a gap; when it
    has, they leave as whole episodes.  It is bounded by what arrives in a gap and the
    allowed lateness.
    """
    gap = pd.Timedelta(minutes=gap_minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        rows = [tuple(r) for r in held]
        if not state.hasTimedOut:
            for b in batches:
                rows += list(zip(b["t_utc"].astype("int64") // 1000 if str(b["t_utc"].dtype).endswith("[ns]") else b["t_utc"].astype("int64"), b["ingest_seq"], b["id"], strict=True))
        rows = sorted(rows)
        mark = state.getCurrentWatermarkMs() * 1000
        runs: list[list[tuple]] = []
        for r in rows:
            if runs and r[0] - runs[-1][-1][0] <= gap.value // 1000:
                runs[-1].append(r)
            else:
                runs.append([r])
        done = [run for run in runs if run[-1][0] + gap.value // 1000 < mark]
        rest = [r for run in runs[len(done) :] for r in run]
        state.update((number + len(done), [(int(a), int(b), str(c)) for a, b, c in rest]))
        if rest:
            state.setTimeoutTimestamp(max(runs[len(done)][-1][0] // 1000 + int(gap.total_seconds() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if done:
            time = lambda x: pd.Timestamp(x, unit="us", tz="UTC")
            yield pd.DataFrame(
                [(key[0], number + k, time(run[0][0]), time(run[-1][0]), len(run), run[0][2]) for k, run in enumerate(done)], columns=["thread_id", "episode", "start_utc", "end_utc", "n_events", "first_id"]
            )

    held = events.where("thread_id IS NOT NULL").withWatermark("t_utc", f"{late_minutes} minutes").select("thread_id", "t_utc", "ingest_seq", "id")
    return held.groupBy("thread_id").applyInPandasWithState(step, SESSION, "episode bigint, held array<struct<t: bigint, seq: bigint, id: string>>", "append", GroupStateTimeout.EventTimeTimeout)


class Episodes(StatefulProcessor):
    """The open events of one bucket of threads as a list, and a timer for when the first of their episodes may close.

    An episode closes once the watermark has passed its last event by more than the gap:
    no event that is still let in can belong to it.  A bucket without open events has neither
    rows nor timers, so the state is bounded by what is open.  State and timers are reached
    by messages to the JVM, some for each bucket and batch and not for each thread.
    """

    def __init__(self, gap_minutes: float):
        self.gap = int(gap_minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "thread string, t bigint, seq bigint, id string")

    def _runs(self) -> list[list[tuple[str, int, int, str]]]:
        """The open events in runs of one thread without a gap."""
        runs: list[list[tuple[str, int, int, str]]] = []
        for r in sorted(tuple(r) for r in self.held.get()):
            if runs and r[0] == runs[-1][-1][0] and r[1] - runs[-1][-1][1] <= self.gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        return runs

    def _wait(self, runs: list[list[tuple[str, int, int, str]]]) -> None:
        """One timer, at the first millisecond after which the first run is closed."""
        due = (min(run[-1][1] for run in runs) + self.gap) // 1000 + 1 if runs else None
        set_ = list(self.handle.listTimers())
        for t in set_:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in set_:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            times = b["t_utc"].dt.as_unit("us").astype("int64")
            self.held.appendList(list(zip(b["thread_id"].tolist(), times.tolist(), b["ingest_seq"].tolist(), b["id"].tolist(), strict=True)))
        self._wait(self._runs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        done, open_ = [], []
        for r in self._runs():
            (done if r[-1][1] + self.gap < mark else open_).append(r)
        if open_:
            self.held.put([r for run in open_ for r in run])
        else:
            self.held.clear()
        self._wait(open_)
        if done:
            zero = datetime.datetime(1970, 1, 1)

            def closed(run):
                thread, first, _, id_ = run[0]
                told = (zero + datetime.timedelta(microseconds=first)).isoformat() + "+00:00"
                return thread, hashlib.sha256(f"{thread}\0{id_}\0{told}".encode()).hexdigest()[:16], first, run[-1][1], len(run), id_

            out = pd.DataFrame([closed(r) for r in done], columns=["thread_id", "episode_id", "start_utc", "end_utc", "n_events", "first_id"])
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us", utc=True) for c in ("start_utc", "end_utc")})

    def close(self) -> None:
        pass


def closed_episodes(events: DataFrame, gap_minutes: float = 30, late_minutes: int = 60, buckets: int = BUCKETS) -> DataFrame:
    """Each episode once, when it is closed, with the id that the batch operators give it; numbers are left to readers.

    Needs the state store ``STORE``.  Rows later than the watermark are dropped.  ``buckets``, into
    which threads are dealt by a hash, stays the same for as long as a checkpoint is used.
    """
    held = events.where("thread_id IS NOT NULL").withWatermark("t_utc", f"{late_minutes} minutes").select("thread_id", "t_utc", "ingest_seq", "id")
    dealt = held.withColumn("bucket", F.pmod(F.xxhash64("thread_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Episodes(gap_minutes), CLOSED, "append", "EventTime")
