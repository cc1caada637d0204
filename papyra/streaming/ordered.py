"""Streams that judge rows in order of event time, however triggers and batches bring them.

Rows wait in a list state until the watermark has passed them; one event-time timer a key then hands those that are due,
in order, to the processor, so a result doesn't depend on how rows were dealt over triggers, and goes on after a restart
from its checkpoint. Rows later than the watermark's delay are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Sessions are dealt into so many groups by hash; a reset of everything goes to each of them.
GROUPS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that such streams need, for queries that start inside; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class InOrder(StatefulProcessor):
    """Subclasses give the rows' columns after the key (`waiting`, a schema whose first column is at, the event time in
    microseconds), and say what follows from rows that are due."""

    waiting = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", self.waiting)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Opens the processor's own states."""

    def judge(self, key: tuple, rows: list[tuple], now: int) -> pd.DataFrame | None:
        """What follows from rows in order. now: the watermark in microseconds."""
        raise NotImplementedError

    def _wake(self, rows: list[tuple]) -> None:
        """One timer: when the first row is due."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = [c.strip().split(" ") for c in self.waiting.split(",")]
        # whole numbers beside nulls come as floats
        plain = [(lambda v: None if pd.isna(v) else int(v)) if kind != "string" else (lambda v: None if pd.isna(v) else v) for _, kind in columns]
        new = [tuple(f(v) for f, v in zip(plain, r, strict=True)) for pdf in rows for r in pdf[[n for n, _ in columns]].itertuples(index=False, name=None)]
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        self.rows.appendList(new)
        self._wake(held + new)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        due = sorted((r for r in held if r[0] < now), key=lambda r: tuple((v is None, v) for v in r))
        left = [r for r in held if r[0] >= now]
        if left:
            self.rows.put(left)
        else:
            self.rows.clear()
        self._wake(left)
        out = self.judge(key, due, now) if due else None
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class Limiter(InOrder):
    """Calls and resets of a group of sessions."""

    waiting = "at long, call int, event_id long, session_id long, tool string"

    def __init__(self, most: int, window_s: float):
        self.most, self.window = most, int(window_s * 1e6)

    def open(self, handle):
        self.held = handle.getMapState("held", "session_id long, tool string", "times array<long>")

    def _forget(self, chosen) -> None:
        for k in [k for k in self.held.keys() if chosen(k)]:
            self.held.removeKey(k)

    def judge(self, key, rows, now):
        out = []
        for at, call, event_id, session, tool in rows:
            if not call:
                self._forget(lambda k: (session is None or k[0] == session) and (tool is None or k[1] == tool))  # noqa: B023
                continue
            times = list(self.held.getValue((session, tool))[0]) if self.held.containsKey((session, tool)) else []
            times = [t for t in times if at - t <= self.window]
            out.append((session, tool, event_id, len(times) < self.most))
            if out[-1][3]:
                times.append(at)
            self.held.updateValue((session, tool), (times,))
        # keys whose last call has left the window hold nothing any more
        idle = [k for k, v in self.held.iterator() if not v[0] or max(v[0]) + self.window < now]
        for k in idle:
            self.held.removeKey(k)
        return pd.DataFrame(out, columns=["session_id", "tool", "event_id", "allowed"])


def limit_calls_in_order(calls: DataFrame, resets: DataFrame, most: int, window_s: float, delay: str, groups: int = GROUPS) -> DataFrame:
    """The call limiter on streams of calls (session_id, tool, ts, event_id) and resets (session_id, tool, ts): of one tool
    of a session, of a session where tool is null, of everything where both are null; a reset comes before calls of the
    same time. (session_id, tool, event_id, allowed), as `sessions.limit_calls_with_resets` says of all of them at once.

    Sessions are dealt into groups by hash, so that a reset of everything reaches a bounded number of keys. State: calls that
    the watermark hasn't passed, and at most `most` times of each session and tool within the window."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    rows = calls.select("ts", F.lit(1).alias("call"), "event_id", "session_id", "tool", of("session_id").alias("group_no"))
    # a reset of everything goes to all groups
    where = F.when(F.col("session_id").isNull(), F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(of("session_id")))
    control = resets.select("ts", F.lit(0).alias("call"), F.lit(-1).cast("long").alias("event_id"), "session_id", "tool", F.explode(where).alias("group_no"))
    both = rows.unionByName(control).withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return both.groupBy("group_no").transformWithStateInPandas(Limiter(most, window_s), "session_id long, tool string, event_id long, allowed boolean", "Append", "EventTime")


class Compactor(InOrder):
    """Turns of a session: what has to be summarised, as soon as it has."""

    waiting = "at long, turn long, tokens long"

    def __init__(self, most_tokens: int, keep: int, summary_tokens: int):
        self.most_tokens, self.keep, self.summary_tokens = most_tokens, keep, summary_tokens

    def open(self, handle):
        self.uncovered = handle.getValueState("uncovered", "turns array<long>, tokens array<long>, total long")

    def judge(self, key, rows, now):
        turns, tokens, total = self.uncovered.get() if self.uncovered.exists() else ([], [], 0)
        turns, tokens, out = list(turns), list(tokens), []
        for _, turn, n in rows:
            turns.append(turn)
            tokens.append(n or 0)
            total += n or 0
            if total > self.most_tokens and len(turns) > self.keep:
                out.append((key[0], turns[: -self.keep], total))
                turns, tokens = turns[-self.keep :], tokens[-self.keep :]
                total = sum(tokens) + self.summary_tokens
        self.uncovered.update((turns, tokens, total))
        return pd.DataFrame(out, columns=["session_id", "covers", "total"])


def compactions_in_order(turns: DataFrame, most_tokens: int, keep: int, delay: str, summary_tokens: int = 0) -> DataFrame:
    """(session_id, covers, total) of a stream of turns (session_id, turn, tokens, ts): whenever a session's tokens pass
    most_tokens and it has more than `keep` (1 at least) turns that no summary covers, all of these but the last `keep` are to be
    summarised, and the tokens start anew with the turns kept and the summary's own. As `sessions.compactions` says of all
    turns at once."""
    rows = turns.select("session_id", F.unix_micros("ts").alias("at"), "turn", "tokens", "ts").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(Compactor(most_tokens, keep, summary_tokens), "session_id long, covers array<long>, total long", "Append", "EventTime")
