"""Streaming sinks: a replayed batch changes nothing; streams equal batches."""

import datetime

from normata.sources import tables as S
from normata.sources import versions as V
from normata.streaming import limits as L
from normata.streaming import sinks as K

START = datetime.datetime(2024, 1, 1)
CONVERSATIONS = "id int, platform string, chat_id string, started_at timestamp"
CACHE = "id int, question string, hit_count int, last_used_at timestamp"
HITS = "cache_id int, at timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def shown(spark, path, schema):
    return sorted(map(tuple, V.read_versions(spark, path, schema, "id").collect()), key=repr)


def test_conversations(spark, tmp_path):
    put = K.conversations_sink(f"{tmp_path}/t", CONVERSATIONS)
    first = spark.createDataFrame([(1, "web", "a", at(5)), (2, "web", "a", at(1)), (3, "web", "b", at(2))], CONVERSATIONS)
    second = spark.createDataFrame([(4, "web", "a", at(0)), (5, "telegram", "a", at(9))], CONVERSATIONS)
    put(first, 0)
    put(first, 0)
    put(second, 1)
    put(first, 0)
    assert shown(spark, f"{tmp_path}/t", CONVERSATIONS) == [(2, "web", "a", at(1)), (3, "web", "b", at(2)), (5, "telegram", "a", at(9))]
    assert [m["tag"] for m in V.manifests(f"{tmp_path}/t")] == ["conversations:0", "conversations:1"]


def test_hits_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    cache = spark.createDataFrame([(i, f"q{i}", i, None) for i in range(6)], CACHE)
    V.write_version(cache, f"{tmp_path}/cache", "id")
    hits = [(i % 4, at(i)) for i in range(30)] + [(77, at(1)), (None, at(2))]
    for i in range(0, len(hits), 8):
        spark.createDataFrame(hits[i : i + 8], HITS).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    put = K.hits_sink(f"{tmp_path}/cache", CACHE)
    seen = []

    def twice(batch, number):
        put(batch, number)
        put(batch, number)  # as after a failure between the write and the stream's own commit
        seen.append(number)

    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4
    want = S.count_hits(cache, spark.createDataFrame(hits, HITS))
    assert shown(spark, f"{tmp_path}/cache", CACHE) == sorted(map(tuple, want.collect()), key=repr)


def test_rows_take_the_place_of_their_keys(spark, tmp_path):
    put = K.rows_sink(f"{tmp_path}/t", "id int, v string", "id", "rows")
    put(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string"), 0)
    put(spark.createDataFrame([(1, "new")], "id int, v string"), 1)
    assert shown(spark, f"{tmp_path}/t", "id int, v string") == [(1, "new"), (2, "c")]


def test_an_event_without_time_does_not_stop_the_limiter(spark, tmp_path):
    schema = "id long, key string, ts timestamp"
    spark.createDataFrame([(1, "a", at(0)), (2, "a", None), (3, "a", at(0)), (4, "a", at(0))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = L.rate_limited(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "key", "ts", 2, 60.0)
    out.writeStream.format("memory").queryName("timeless").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    told = sorted((r["at"] is None, r.accepted) for r in spark.table("timeless").collect())
    assert told == [(False, False), (False, True), (False, True), (True, False)]
