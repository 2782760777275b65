"""Streaming forms on files as a source, and the batch forms on edge cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from normata.streaming import limits as L

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def table(spark, rows):
    return spark.createDataFrame([(i, k, at(s)) for i, (k, s) in enumerate(rows)], "id long, key string, ts timestamp")


def test_rejected_events_are_not_counted(spark):
    rows = [("a", s) for s in (0, 0, 1, 2, 60, 60.5, 61)] + [("b", 5)]
    out = L.rate_limited_batch(table(spark, rows), "key", "ts", "id", rate=2, span=60.0).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, True, False, False, False, True, True, True]


def test_repeats_pass_after_the_time_to_live(spark):
    hours = [0, 23, 24, 30, 47, 48]
    out = L.drop_repeats_batch(table(spark, [("a", h * 3600) for h in hours]), "key", "ts", "id").orderBy("id").collect()
    assert [r.id for r in out] == [0, 2, 5]


def test_cooldown_and_surges(spark):
    rows = table(spark, [("x", m * 60) for m in (0, 10, 29, 30, 45, 61)])
    assert [r.ts for r in L.cooled_down(rows, "key", "ts").orderBy("ts").collect()] == [at(0), at(1800), at(3660)]
    found = L.error_surges(rows.where("id < 3")).collect()
    assert found == []
    assert L.error_surges(table(spark, [("x", 1), ("x", 2), ("x", 3)])).count() == 2


@pytest.fixture
def stream(spark, tmp_path):
    def start(rows, build, mode="append"):
        folder = f"{tmp_path}/in"
        table(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("id long, key string, ts timestamp").parquet(folder)
        query = build(source).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table("out").collect()

    return start


def test_stream_drops_repeats(stream):
    out = stream([("a", 0), ("b", 1), ("a", 2), ("a", 3)], lambda s: L.drop_repeats(s, "key", "ts"))
    assert sorted(r.key for r in out) == ["a", "b"]


def test_stream_rate_limit_equals_batch(stream):
    rows = [("a", s) for s in (0, 0, 1, 2, 60, 60.5, 61)] + [("b", 5)]
    out = stream(rows, lambda s: L.rate_limited(s, "key", "ts", rate=2, span=60.0))
    assert [r.accepted for r in sorted(out, key=lambda r: (r.key, r["at"]))] == [True, True, False, False, False, True, True, True]


def test_stream_surges(stream):
    rows = [("e", s) for s in (1, 2, 3)] + [("e", 7200)]
    out = stream(rows, lambda s: L.error_surges(s.withWatermark("ts", "1 minute")))
    assert [(r.window_start, r.errors) for r in sorted(out, key=lambda r: r.window_start)] == [(at(-300), 3), (at(0), 3)]


def test_sessions(spark):
    events = table(spark, [("a", 0), ("a", 100), ("a", 4000), ("b", 1)])
    assert sorted((r.key, r.events) for r in L.sessions(events, "key").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert events.select(F.max("ts")).first()[0] == at(4000)


def test_cooldown_thins_before_the_shuffle(spark):
    rows = table(spark, [(k, s) for k in ("x", "y", None) for s in (1800, 0, 0, 1799, 1799)] + [("z", 5)])
    out = L.cooled_down(rows, "key", "ts")
    assert sorted(((r.key, r.ts) for r in out.collect()), key=repr) == sorted([(k, at(s)) for k in ("x", "y", None) for s in (0, 1800)] + [("z", at(5))], key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "HashAggregate" in plan


def test_null_keys_share_a_bucket_and_null_times_count_for_nothing(spark):
    rows = [(i, None, at(i)) for i in range(4)] + [(10 + i, "a", at(i) if i else None) for i in range(4)]
    out = L.rate_limited_batch(spark.createDataFrame(rows, "id long, key string, ts timestamp"), "key", "ts", "id", rate=2, span=60.0).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, True, False, False, False, True, True, False]


def test_batch_limit_equals_a_plain_walk(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), at(rng.randrange(0, 3000))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    want, held = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held[k] = [x for x in held.get(k, []) if (t - x).total_seconds() <= 30]
        want[i] = len(mine) < 3
        if want[i]:
            mine.append(t)
    got = {r.id: r.accepted for r in L.rate_limited_batch(frame, "key", "ts", "id", rate=3, span=30.0).collect()}
    assert got == want


def test_two_buckets_charge_the_session_first(spark):
    rows = [(i, "s1" if i < 3 else "s2", "ip", at(i)) for i in range(6)]
    events = spark.createDataFrame(rows, "id long, session string, ip string, ts timestamp")
    out = L.two_buckets(events, "session", "ip", "ts", "id", rate=2, span=60.0).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, True, False, False, False, False]


def test_history_cache_lives_from_its_write(spark):
    rows = [(0, "c", at(0), False), (1, "c", at(3599), False), (2, "c", at(3600), False), (3, "c", at(3700), True), (4, "c", at(3701), False), (5, "d", at(3701), False)]
    log = spark.createDataFrame(rows, "id long, conversation string, ts timestamp, turn boolean")
    out = {r.id: r.cached for r in L.cached_reads(log, "conversation", "ts", "id", "turn").collect()}
    assert out == {0: False, 1: True, 2: False, 4: False, 5: False}


def test_streamed_buckets_decide_the_last_events_of_several_files(spark, tmp_path):
    from normata.plans import streams as P

    rows = spark.range(60).selectExpr("id AS event_id", "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS ts", "id % 5 AS user_id", "'click' AS event_type", "1.0D AS value")
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    told = lambda name: sorted(map(tuple, P.QUERIES[name](spark, str(tmp_path)).collect()))
    assert told("two_buckets_stream") == told("two_buckets") and len(told("two_buckets")) == 60
