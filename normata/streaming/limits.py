"""Keyed checks over event streams: duplicates, rate limits, error surges and alert cooldowns.

Each has a streaming form with bounded state and a batch form over a stored table with equal results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, SPAN = 10, 60.0
NEVER = -(1 << 62)  # stands for no time
COOLDOWN_MINUTES = 30


def drop_repeats(events: DataFrame, key: str = "update_id", time: str = "ts", hours: int = 24) -> DataFrame:
    """First event of each key within ``hours``; state is dropped behind the watermark."""
    return events.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def within_rate(times: list[float], held: deque, rate: int, span: float, ends_count: bool = True) -> list[bool]:
    """Which events pass a sliding limit; those that do not are not counted against later ones.

    An event just ``span`` ago still counts if ``ends_count``.
    """
    out = []
    for at in times:
        while held and (at - held[0] > span or not ends_count and at - held[0] == span):
            held.popleft()
        ok = len(held) < rate
        if ok:
            held.append(at)
        out.append(ok)
    return out


def rate_limited_batch(events: DataFrame, key: str, time: str, tie: str, rate: int = RATE, span: float = SPAN, ends_count: bool = True) -> DataFrame:
    """``events`` with ``accepted``: at most ``rate`` accepted per key in any trailing ``span`` seconds.

    Partitions are sorted by key and time and read once; a key's state is its last ``rate`` accepted times.
    Runs in which no event is too near to the ``rate``-th before it pass as they are; only the others are
    walked. Events without key share one; an event without time is not accepted and counts for nothing.
    """
    names = [c for c in events.columns if c != "accepted"]
    schema = T.StructType([*events.select(*names).schema.fields, T.StructField("accepted", T.BooleanType())])
    width = int(span * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, deque()
        for batch in batches:
            run_of, at = (batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            accepted = at != NEVER
            begins = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1])) if len(at) else []
            for begin, end in zip(begins, [*begins[1:], len(at)], strict=True):
                if run_of[begin] != current:
                    current, held = run_of[begin], deque()
                times = at[begin:end][accepted[begin:end]]
                gaps = times[rate:] - times[:-rate] if len(times) > rate else np.zeros(0, np.int64)
                if not held and (gaps > width if ends_count else gaps >= width).all():
                    held = deque(times[-rate:].tolist())
                else:
                    ok = within_rate(times.tolist(), held, rate, width, ends_count)
                    accepted[begin + np.flatnonzero(accepted[begin:end])] = ok
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(accepted, pa.bool_())], [*names, "accepted"])

    # The key's number tells runs apart, whatever the key's type: a hash, with the sort by the key itself.
    rows = events.select(*names, F.xxhash64(key, F.col(key).isNull()).alias("__run"), F.coalesce(F.unix_micros(time), F.lit(NEVER)).alias("__at"))
    return rows.repartition(key).sortWithinPartitions(key, "__at", tie).mapInArrow(run, schema)


def two_buckets(events: DataFrame, session: str, address: str, time: str, tie: str, rate: int = RATE, span: float = SPAN) -> DataFrame:
    """``events`` with ``accepted``: the session's limit is charged first, then, for what passes, the address's.

    What the address's limit rejects was charged to the session all the same.
    """
    first = rate_limited_batch(events, session, time, tie, rate, span).withColumnRenamed("accepted", "__passed")
    second = rate_limited_batch(first.where("__passed"), address, time, tie, rate, span).drop("__passed")
    return second.unionByName(first.where("NOT __passed").drop("__passed").withColumn("accepted", F.lit(False)))


def cached_reads(log: DataFrame, key: str, time: str, tie: str, is_turn: str, ttl: float = 3600.0) -> DataFrame:
    """The reads of a log with ``cached``: whether a history stored by an earlier read is still there.

    A read that finds none stores its own, for ``ttl`` seconds from then, whatever reads follow; a new turn
    (``is_turn``) drops what is stored.
    """
    order = Window.partitionBy(key).orderBy(time, tie)
    parts = log.withColumn("__part", F.count_if(is_turn).over(order)).where(~F.col(is_turn)).withColumn("__bucket", F.xxhash64(key, "__part"))
    out = rate_limited_batch(parts, "__bucket", time, tie, 1, ttl, ends_count=False)
    return out.withColumn("cached", ~F.col("accepted")).drop("accepted", "__part", "__bucket")


def drop_repeats_batch(events: DataFrame, key: str, time: str, tie: str, hours: int = 24) -> DataFrame:
    """Events of a key that are the first, or come ``hours`` or more after the last one kept."""
    return rate_limited_batch(events, key, time, tie, 1, hours * 3600.0, ends_count=False).where("accepted").drop("accepted")


def rate_limited(events: DataFrame, key: str, time: str, rate: int = RATE, span: float = SPAN) -> DataFrame:
    """Streaming form: (key, at, accepted) with the accepted times as state, which goes when idle for a span."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        came = [t for b in batches for t in b["at"]]
        times = sorted(t.timestamp() for t in came if not pd.isna(t))
        timeless = len(came) - len(times)  # not accepted, and counted for nothing
        accepted = within_rate(times, held, rate, span) + [False] * timeless
        state.update((list(held),))
        state.setTimeoutTimestamp(max(int((times[-1] + span + 1) * 1000) if times else 0, state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame({"key": [keys[0]] * len(came), "at": pd.array(times + [None] * timeless, "Float64"), "accepted": accepted})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at")).withWatermark("at", "1 minute")
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, at double, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def error_surges(errors: DataFrame, time: str = "ts", least: int = 3, span: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Windows with at least ``least`` errors; on a stream put a watermark on ``time`` first."""
    counts = errors.groupBy(F.window(time, span, every).alias("w")).agg(F.count(F.lit(1)).alias("errors"))
    return counts.where(F.col("errors") >= least).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors")


def cooled_down(alerts: DataFrame, kind: str, time: str, minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Alerts that go out: per kind, one opens a pause of ``minutes`` in which the others are silent.

    Alerts of one kind and time are one before the shuffle. A kind's times are then sorted and read once,
    with the last one sent as the state.
    """
    rows = alerts.select(F.col(kind), F.unix_micros(F.col(time)).alias("__t")).distinct()
    schema, pause = rows.schema, minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), 0
        for batch in batches:
            sent = []
            for value, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                opens = at is not None and (value != current or at - last >= pause)
                if opens:
                    current, last = value, at
                sent.append(opens)
            yield batch.filter(pa.array(sent, pa.bool_()))

    sent = rows.repartition(kind).sortWithinPartitions(kind, "__t").mapInArrow(run, schema)
    return sent.select(kind, F.timestamp_micros("__t").alias(time))


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "60 minutes") -> DataFrame:
    """Sessions of activity that end after a gap."""
    return events.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "events")


def tumbling_counts(events: DataFrame, time: str = "ts", span: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window(time, span).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("hour"), "event_type", "events")
