"""Proximity graphs against the exact search."""

import numpy as np

from normata.operators import graph as G
from normata.operators import retrieval as R


def clustered(n, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    return centres[rng.integers(0, 40, n)] + 0.6 * rng.standard_normal((n, dim))


def table(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def test_walk_finds_the_nearest_with_few_distances():
    x = clustered(6000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    links = G.nearest_links(x, G.DEGREE)
    hit = work = 0
    for i in range(0, 6000, 60):
        at, score, count = G.walk(x, links, x[i], G.BEAM)
        assert len(at) <= G.BEAM and len(set(at.tolist())) == len(at)
        want = set(np.argsort(-(x @ x[i]))[:10].tolist())
        hit += len(want & set(at[np.argsort(-score)[:10]].tolist()))
        work += count
    assert hit >= 0.9 * 1000 and work < 0.25 * 100 * 6000


def test_recall_over_several_shards(spark, tmp_path):
    chunks, asked = table(spark, clustered(3000), "chunk_id"), table(spark, clustered(120), "query_id")
    G.build_graphs(chunks, f"{tmp_path}/g", shard=800)
    assert spark.read.parquet(f"{tmp_path}/g").count() == 4
    got = G.search_graphs(spark, f"{tmp_path}/g", asked, 10, 0.2).collect()
    exact = {(r.query_id, r.chunk_id): r for r in R.dense_search(chunks, asked, 10, 0.2).collect()}
    found = [r for r in got if (r.query_id, r.chunk_id) in exact]
    assert len(found) >= 0.9 * len(exact) and all(abs(r.similarity - exact[r.query_id, r.chunk_id].similarity) < 1e-5 for r in found)
    assert all(r.distances < 3000 for r in got)


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [None, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = chunks.withColumnRenamed("chunk_id", "query_id")
    G.build_graphs(chunks, f"{tmp_path}/g")
    got = G.search_graphs(spark, f"{tmp_path}/g", asked, 2, 0.1).collect()
    assert {(r.query_id, r.chunk_id, r.position) for r in got} == {(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)}
    assert G.search_graphs(spark, f"{tmp_path}/g", asked.limit(0), 2).count() == 0
    G.build_graphs(chunks.limit(0), f"{tmp_path}/none")
    assert G.search_graphs(spark, f"{tmp_path}/none", asked, 2).count() == 0


def test_dense_search_goes_in_blocks(spark, monkeypatch):
    chunks, asked = table(spark, clustered(300), "chunk_id"), table(spark, clustered(50), "query_id")
    whole = sorted(map(tuple, R.dense_search(chunks, asked, 5, 0.1).collect()))
    monkeypatch.setattr(R, "BLOCK", 7)
    assert sorted(map(tuple, R.dense_search(chunks, asked, 5, 0.1).collect())) == whole
