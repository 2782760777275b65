import math

import numpy as np
from pyspark.sql import functions as F

from normata.llm import hashing as H


def brute(rows, query_ids, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in fine:
        if q in query_ids:
            scored = sorted((-round(float(v @ w / math.sqrt((v @ v) * (w @ w))), 12), i) for i, w in fine if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_probing_retrieves_every_code_in_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, (500, 8)).astype(np.uint8)
    codes[100:140] = codes[0]
    index = H.MultiIndex(codes)
    for q in range(0, 500, 50):
        distance = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        for radius in (0, 3, 8, 21, 28):
            assert sorted(index.within(codes[q], radius)) == np.flatnonzero(distance <= radius).tolist()


def test_recall_on_weak_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4000, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    got = {}
    for r in H.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, set(range(0, 4000, 50)))
    hits = sum(len({r.vec_id for r in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    assert hits / (5 * len(want)) >= 0.9
    for q, found in got.items():
        assert [r.rank for r in found] == [*range(1, len(found) + 1)]
        for r in found:
            a, b = vectors[q].astype(float), vectors[r.vec_id].astype(float)
            assert abs(r.score - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-12


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5, 1.0, 0.0, 0.0, 0.0, 3.0]) for i in range(0, 40)] + [(40, [2.0, 4.0, 1.0, 2.0, 0.0, 0.0, 0.0, 6.0])]
    odd = [(100, None), (150, []), (200, [0.0] * 8), (250, [nan] + [1.0] * 7), (300, [None] + [1.0] * 7), (350, [inf] + [1.0] * 7), (None, [1.0] * 8), (400, [1.0])]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>")
    got = H.search(table.repartition(4), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)]
    assert H.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = table.where("vec_id IN (0, 40)")
    assert [(r.query_id, r.vec_id) for r in H.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 40)]


def test_grid_of_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = {(r.query_id, r.rank, r.vec_id) for r in H.search(df, F.col("vec_id") % 10 == 0, radius=1.0).collect()}
    monkeypatch.setattr(H, "SHARD_ROWS", 50)
    monkeypatch.setattr(H, "BLOCK_QUERIES", 7)
    assert {(r.query_id, r.rank, r.vec_id) for r in H.search(df, F.col("vec_id") % 10 == 0, radius=1.0).collect()} == every
    want = brute(rows, set(range(0, 300, 10)))
    assert every == {(q, n + 1, i) for q, w in want.items() for n, (i, _) in enumerate(w)}


def test_queries_with_few_neighbours_get_all_their_rows(spark):
    unlike = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-0.5, 0.87]), (2, [-0.5, -0.87])], "vec_id long, embedding array<double>")
    found = H.search(unlike, F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(q, v) for q in range(3) for v in range(3) if q != v]
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 32)) * 0.1 + 1)] + [(1000, [-1.0] * 31 + [-1.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in H.search(df, F.col("vec_id").isin(0, 1000)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[1000] == [i for i, _ in brute(rows, {1000})[1000]] and len(got[0]) == 5


def test_strong_neighbours_are_settled_by_the_join(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 64))
    rows = [(i, (centres[i % 40] + 0.01 * rng.standard_normal(64)).tolist()) for i in range(600)] + [(600 + i, centres[0].tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = set(range(0, 608, 10))
    want = {(q, n + 1, i) for q, w in brute(rows, queries).items() for n, (i, _) in enumerate(w)}
    asked = H.coded(df.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector"), spark.sparkContext.broadcast(np.eye(64)))
    entries = H.coded(df.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumnRenamed("embedding", "vector"), spark.sparkContext.broadcast(np.eye(64)))
    settled = H.near_search(entries, asked, 5, 64)
    assert settled.select("query_id").distinct().count() >= 0.9 * len(queries)
    for bucket in (H.BUCKET, 3):
        monkeypatch.setattr(H, "BUCKET", bucket)
        got = {(r.query_id, r.rank, r.vec_id) for r in H.search(df, F.col("vec_id") % 10 == 0).collect()}
        assert len(got & want) >= 0.97 * len(want) and len(got) == len(want)


def test_recall_on_the_given_vectors(spark):
    import os

    folder = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in H.op1_multi_index_hashing(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == len(w) for q, w in want.items())
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
