import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from normata.llm import sharding as S


def test_curve_visits_every_cell_once_with_steps_of_one():
    for dims, bits in ((2, 1), (2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        index = S.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_rows_law_slots_and_edges(spark, tmp_path):
    rows = [(i % 7 or None, f"t{i % 3}" if i % 5 else None, f"s{i % 4}", "hot") for i in range(403)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr(
        "*", "1 AS shard", "2 AS slot"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op10_hilbert_sharding(spark, str(tmp_path)).collect()
    count = Counter(r.shard for r in out)
    assert len(out) == 403 and set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert all(r.size == 16 and r.text_crc32 == 0 for r in out if r.text_crc32 == 0)
    assert {r.text_crc32 for r in out} == {0, *(zlib.crc32(f"t{i}".encode()) for i in range(3))}


def test_small_and_empty(spark):
    df = S.with_curve(spark.range(3), [F.col("id").cast("int")])
    out = S.shard_by_curve(df, ["id"], 40).collect()
    assert len({r.shard for r in out}) == 3 and all(r.slot == 0 for r in out)
    assert S.shard_by_curve(df.limit(0), ["id"], 40).count() == 0


def test_written_shards_prune_by_metadata(spark, tmp_path):
    df = spark.range(4096).select((F.col("id") % 64).cast("int").alias("a"), (F.col("id") / 64).cast("int").alias("b"))
    S.write_shards(df, [F.col("a"), F.col("b")], ["a", "b"], f"{tmp_path}/out", 16)
    boxes = spark.read.parquet(f"{tmp_path}/out").groupBy("shard").agg(
        F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")
    )
    assert boxes.count() == 16 and max(max(r.a, r.b) for r in boxes.collect()) <= 16


def test_order_is_that_of_a_plain_sort_and_columns_pass(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 64, (700, 3))
    rows = [(i, *map(int, g), "mine", "own", 9) for i, g in enumerate(grid)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, salt string, part string, shard int")
    out = S.shard_by_curve(S.with_curve(df.repartition(5), [F.col(x) for x in "abc"]), ["id"], 9).collect()
    index = dict(enumerate(S.hilbert_index(grid, S.BITS)))
    order = [index[r.id] for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(index.values())
    assert set(out[0].asDict()) == {"id", "a", "b", "c", "salt", "part", "shard", "slot"} and {r.salt for r in out} == {"mine"}
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, None)], "id long, text string")
    assert S.shard_by_curve(S.with_curve(long, [S.log_cell(F.octet_length("text"), S.BITS)]), ["id"]).count() == 2
