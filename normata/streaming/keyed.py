"""Keyed checks over streams in event-time order: limits, two buckets, cooldowns and cached histories.

Events may come late and in any order within the watermark's delay. A key's events wait in list state until the
watermark has passed them; an event-time timer then takes them in order of time and id through the same fold as
the batch form, so the stream's decisions are those of the batch form. What a fold remembers (a few times) is the key's
value state; when nothing waits and what is remembered is out of date, a last timer clears the key.

An event without time is decided at once, as in the batch forms, and counts for nothing; an event behind the watermark
is dropped. Decisions come once the watermark is past their events. The session needs the RocksDB state store
(:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from normata.streaming.limits import COOLDOWN_MINUTES, RATE, SPAN

WAITING = "at long, id long, flag boolean, other string, due long"
#: ``at``: the event's time; ``ts``: that of the decision, just behind the watermark, by which a further pass knows when it has all.
DECIDED = "id long, key string, other string, at long, ts timestamp, passed boolean"
#: What a fold gives for an event: what it remembers from now on, and the decision; None if the event has none.
Fold = Callable[[list[int], int, bool], tuple[list[int], bool | None]]


@dataclass(frozen=True)
class Limit:
    """At most ``rate`` accepted in any trailing ``span`` microseconds; an event whose flag is off is refused and not charged."""

    rate: int
    span: int
    ends_count: bool = True

    def __call__(self, held: list[int], at: int, flag: bool) -> tuple[list[int], bool | None]:
        held = [x for x in held if at - x < self.span or self.ends_count and at - x == self.span]
        passed = flag and len(held) < self.rate
        return held + [at] * passed, passed


@dataclass(frozen=True)
class Cached:
    """Whether a history stored at most ``span`` microseconds ago is there; else the read stores its own. A flagged event, a new
    turn, drops what is stored and has no decision."""

    span: int

    def __call__(self, held: list[int], at: int, flag: bool) -> tuple[list[int], bool | None]:
        if flag:
            return [], None
        cached = bool(held) and at - held[0] < self.span
        return held if cached else [at], cached


class InOrder(StatefulProcessor):
    """Lets a key's events wait for the watermark and folds them in order."""

    def __init__(self, fold: Fold, span: int):
        self.fold, self.span = fold, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.held = handle.getValueState("held", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([r[["at", "id", "flag", "other", "due"]] for r in rows])
        timeless = frame[frame["at"].isna()]
        if len(timeless):
            yield self.decided(key, [(None, int(i), o, False) for i, o in zip(timeless["id"], timeless["other"], strict=True)], timerValues)
        timed = frame[frame["at"].notna()]
        if len(timed):
            new = [(int(at), int(i), bool(f), o, int(due)) for at, i, f, o, due in timed.itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            self.wake(min(n[4] for n in new), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        held = list(self.held.get()[0]) if self.held.exists() else []
        out = []
        for at, number, flag, other, _ in sorted((w for w in waiting if w[4] <= mark), key=lambda w: w[:2]):
            held, passed = self.fold(held, at, flag)
            if passed is not None:
                out.append((at, number, other, passed))
        later = [w for w in waiting if w[4] > mark]
        if later:
            self.waiting.put(later)
            self.wake(min(w[4] for w in later), timerValues)
        else:
            self.waiting.clear()
            ends = [(x + self.span) // 1000 + 1 for x in held]
            held = held if ends and max(ends) > mark else []
            if held:
                self.wake(max(ends), timerValues)
        if held:
            self.held.update((held,))
        else:
            self.held.clear()
        if out:
            yield self.decided(key, out, timerValues)

    def wake(self, due: int, timerValues) -> None:
        """Ask for a timer at a time in milliseconds, unless one before it is still to come."""
        mark = timerValues.getCurrentWatermarkInMs()
        if not any(mark < t <= due for t in self.handle.listTimers()):  # one at the watermark is just being served
            self.handle.registerTimer(due)

    def decided(self, key, rows: list[tuple], timerValues) -> pd.DataFrame:
        ats, ids, others, passed = zip(*rows, strict=True)
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms", tz="UTC")
        return pd.DataFrame({"id": ids, "key": key[0], "other": others, "at": pd.Series(ats, dtype="Int64"), "ts": now, "passed": passed})


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that list state and timers need, for the streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(events: DataFrame, key: Column, fold: Fold, span: int, flag: Column, other: Column, number: str, time: str, at: Column | None = None) -> DataFrame:
    """:data:`DECIDED` of a stream with a watermark on ``time``; ``at`` is the event's time in microseconds, that of ``time`` if not given."""
    due = F.ceil(F.unix_micros(time) / 1000).cast("long")
    rows = events.select(
        F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.col(number).cast("long").alias("id"), F.col(time).alias("ts"), (F.unix_micros(time) if at is None else at).alias("at"),
        flag.alias("flag"), other.cast("string").alias("other"), due.alias("due"),
    )
    return rows.groupBy("key").transformWithStateInPandas(InOrder(fold, span), DECIDED, "Append", "EventTime", eventTimeColumnName="ts")


def limited_stream(events: DataFrame, key: str, time: str, number: str, rate: int = RATE, span: float = SPAN, delay: str = "1 minute") -> DataFrame:
    """Streaming form of ``rate_limited_batch``: (id, accepted) for each event with ``number`` as its id."""
    width = int(span * 1_000_000)
    out = folded(events.withWatermark(time, delay), F.col(key), Limit(rate, width), width, F.lit(True), F.lit(None), number, time)
    return out.select("id", F.col("passed").alias("accepted"))


def two_buckets_stream(events: DataFrame, session: str, address: str, time: str, number: str, rate: int = RATE, span: float = SPAN, delay: str = "1 minute") -> DataFrame:
    """Streaming form of ``two_buckets``, in two chained passes: what the session's limit refuses goes through the address's uncharged."""
    width = int(span * 1_000_000)
    limit = Limit(rate, width)
    first = folded(events.withWatermark(time, delay), F.col(session), limit, width, F.lit(True), F.col(address), number, time)
    second = folded(first, F.col("other"), limit, width, F.col("passed"), F.lit(None), "id", "ts", F.col("at"))
    return second.select("id", F.col("passed").alias("accepted"))


def cooled_down_stream(alerts: DataFrame, kind: str, time: str, number: str, minutes: int = COOLDOWN_MINUTES, delay: str = "1 minute") -> DataFrame:
    """Streaming form of ``cooled_down``: (kind, time) of the alerts that go out."""
    pause = minutes * 60_000_000
    out = folded(alerts.withWatermark(time, delay), F.col(kind), Limit(1, pause, ends_count=False), pause, F.lit(True), F.lit(None), number, time)
    return out.where("passed").select(F.col("key").alias(kind), F.timestamp_micros("at").alias(time))


def cached_reads_stream(log: DataFrame, key: str, time: str, number: str, is_turn: str, ttl: float = 3600.0, delay: str = "1 minute") -> DataFrame:
    """Streaming form of ``cached_reads``: (id, cached) for each read."""
    width = int(ttl * 1_000_000)
    out = folded(log.withWatermark(time, delay), F.col(key), Cached(width), width, F.col(is_turn), F.lit(None), number, time)
    return out.select("id", F.col("passed").alias("cached"))
