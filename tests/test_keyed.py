"""Keyed state over streams: equal to the batch forms, whatever the order of arrival."""

import datetime
import json
import random

import pytest

from normata.streaming import keyed as K
from normata.streaming import limits as L

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, key string, address string, ts timestamp, turn boolean"
FAR = (999, "end", "end", START + datetime.timedelta(days=9), False)


def events(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), rng.choice("xy"), START + datetime.timedelta(seconds=rng.randrange(0, 7200) // 10 * 10), rng.random() < 0.1) for i in range(n)]


@pytest.fixture
def stream(spark, tmp_path):
    def run(rows, build, parts=4, disorder=300):
        """Parts in order of time but for ``disorder`` seconds, then two late ones that only move the watermark."""
        K.use_rocksdb(spark)
        rng = random.Random(1)
        ordered = sorted(rows, key=lambda r: (r[3] - START).total_seconds() + rng.uniform(0, disorder) if r[3] else 0)
        size = -(-len(ordered) // parts)
        batches = [ordered[a : a + size] for a in range(0, len(ordered), size)]
        batches += [[FAR], [(*FAR[:3], FAR[3] + datetime.timedelta(days=1), False)]]
        for i, batch in enumerate(batches):
            rng.shuffle(batch)
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        name = f"t{abs(hash(str(tmp_path)))}"
        query = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect(), [json.loads(str(p.json)) if hasattr(p, "json") else p for p in query.recentProgress]

    return run


def test_limit(spark, stream):
    rows = [*events(), (1000, "a", "x", None, False)]
    want = {r.id: r.accepted for r in L.rate_limited_batch(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 3, 600.0).collect()}
    got, progress = stream(rows, lambda s: K.limited_stream(s, "key", "ts", "id", 3, 600.0, "10 minutes"))
    assert {r.id: r.accepted for r in got if r.id != 999} == want and 0 < sum(want.values()) < len(want)
    assert not want[1000]
    # All keys but the last event's have left the state store.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"])


def test_two_buckets(spark, stream):
    rows = events()
    want = {r.id: r.accepted for r in L.two_buckets(spark.createDataFrame(rows, SCHEMA), "key", "address", "ts", "id", 4, 600.0).collect()}
    got, _ = stream(rows, lambda s: K.two_buckets_stream(s, "key", "address", "ts", "id", 4, 600.0, "10 minutes"))
    assert {r.id: r.accepted for r in got if r.id != 999} == want and 0 < sum(want.values()) < len(want)


def test_cooldown(spark, stream):
    rows = events()
    want = {tuple(r) for r in L.cooled_down(spark.createDataFrame(rows, SCHEMA), "key", "ts", 7).collect()}
    got, _ = stream(rows, lambda s: K.cooled_down_stream(s, "key", "ts", "id", 7, "10 minutes"))
    assert {tuple(r) for r in got if r.key != "end"} == want and len(want) > 30


def test_history_cache(spark, stream):
    rows = events()
    want = {r.id: r.cached for r in L.cached_reads(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", "turn", 500.0).collect()}
    got, _ = stream(rows, lambda s: K.cached_reads_stream(s, "key", "ts", "id", "turn", 500.0, "10 minutes"))
    assert {r.id: r.cached for r in got if r.id != 999} == want and 0 < sum(want.values()) < len(want)
