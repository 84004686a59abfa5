"""Turns of event streams, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type in windows of an hour; later ones than ``late`` are dropped with their window's state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def open_turns(events: DataFrame, cue: str = "signup", boundary: tuple[str, ...] = ("signup", "error")) -> DataFrame:
    """(user_id, turn, event_id): each event with the turn that it falls in as it arrives, state kept by user.

    Within a micro-batch a user's events are put in order of time; the state is the number of turns and whether
    one is open.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, is_open = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if kind in boundary:
                is_open = kind == cue
                turns += is_open
            elif is_open:
                out.append((key[0], turns, event_id))
        state.update((turns, is_open))
        yield pd.DataFrame(out, columns=["user_id", "turn", "event_id"])

    keyed = events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, turn long, event_id long", "turns long, is_open boolean", "append", GroupStateTimeout.NoTimeout)


class OrderedTurns(StatefulProcessor):
    """Holds the rows of a bucket of users until the watermark has passed them, then takes each user's in order of time.

    A timer stands at the earliest row that waits. When it fires, the rows up to the watermark are put in order and walked
    through once; those after it go on waiting under a timer of their own. What lasts of a user is the number of turns,
    whether one is open and its cue. After ``idle_ms`` without a row of a user all of that goes, by a timer, and what comes
    later is numbered from 1 again; that hangs on the rows' times alone, not on when they come. State is read and written
    once for a bucket and batch, as arrays: a call for each user or row would cost more than the rows.
    """

    def __init__(self, cue: str, boundary: tuple[str, ...], idle_ms: int | None) -> None:
        self.cue, self.boundary, self.idle_ms = cue, boundary, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, {}
        self.waiting = handle.getListState("waiting", "user_id array<long>, at array<long>, event_id array<long>, event_type array<string>")
        self.known = handle.getValueState("known", "user_id array<long>, turns array<long>, is_open array<boolean>, cue_id array<long>, last array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(frame[c].tolist() for c in ("who", "at", "event_id", "event_type")) for frame in rows if len(frame)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(min(at) for _, at, *_ in new) // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == passed:  # by an earlier timer of this batch
            return
        self.done[key] = passed
        rows = [row for chunk in self.waiting.get() for row in zip(*chunk, strict=True)] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[1] // 1000 <= passed), key=lambda r: (*r[:3], r[3] or ""))
        rest = [r for r in rows if r[1] // 1000 > passed]
        known = {user: about for user, *about in zip(*self.known.get(), strict=True)} if self.known.exists() else {}
        out = []
        for user, at, event_id, kind in due:
            turns, is_open, cue_id, last = known.get(user, (0, False, None, None))
            if last is not None and self.idle_ms is not None and at // 1000 - last // 1000 >= self.idle_ms:
                turns, is_open, cue_id = 0, False, None
            if kind in self.boundary:
                is_open = kind == self.cue
                turns, cue_id = (turns + 1, event_id) if is_open else (turns, None)
            elif is_open:
                out.append((user, turns, cue_id, event_id))
            known[user] = (turns, is_open, cue_id, at)
        kept = {u: x for u, x in known.items() if self.idle_ms is None or x[3] // 1000 + self.idle_ms > passed}
        if kept and (due or len(kept) < len(known)):
            self.known.update(tuple(map(list, zip(*((u, *x) for u, x in kept.items()), strict=True))))
        elif known and not kept:
            self.known.clear()
        if due and rest:
            self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
        elif due:
            self.waiting.clear()
        timers = [r[1] // 1000 for r in rest] + [x[3] // 1000 + self.idle_ms for x in kept.values() if self.idle_ms is not None]
        if timers:
            self.handle.registerTimer(min(timers))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "turn", "cue_id", "event_id"])

    def close(self) -> None:
        pass


def ordered_turns(events: DataFrame, late: str = "1 hour", idle_ms: int | None = None, cue: str = "signup", boundary: tuple[str, ...] = ("signup", "error"), buckets: int | None = None) -> DataFrame:
    """(user_id, turn, cue_id, event_id): each event with the turn that it falls in by its time, whatever the order of arrival.

    A row is given once, when the watermark has passed its time; rows later than ``late`` are dropped, as any stateful
    operator drops them. ``cue_id``, the event that opened the turn, names it for good; ``turn`` counts on as long as
    the user's state lasts, which is for ever without ``idle_ms``. Rows without a user, time or id are left out. The
    state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``). State is kept by user, or with
    ``buckets`` by one of so many sets of users: fewer calls of Python, and a bucket's waiting rows in memory at once.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late)
    user = F.col("user_id").cast("long")
    key = user.alias("user_id") if buckets is None else F.pmod(F.xxhash64(user), F.lit(buckets).cast("long")).alias("bucket")
    keyed = rows.select(key, user.alias("who"), "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type").groupBy("user_id" if buckets is None else "bucket")
    return keyed.transformWithStateInPandas(OrderedTurns(cue, boundary, idle_ms), "user_id long, turn long, cue_id long, event_id long", "append", "eventTime")
