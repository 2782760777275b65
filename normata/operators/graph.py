"""Approximate nearest neighbours by proximity graphs, one for each shard of the chunks.

A shard is a part of the chunks by a hash of their ids. Its graph links every vector with its nearest ones in the
shard, the other way round with some of those that it is near to, and with a few far ones, by which a walk leaves
a group of vectors that are near to each other only. A shard is
stored as one row: ids, unit vectors and the adjacency lists. A search walks each graph from a few
entries, always on from the best vectors that it has not left yet, and keeps a beam of bounded width; the shards'
finds are merged. How many distances were worked out is counted for every question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.operators.retrieval import THRESHOLD, asked_in_blocks, best_of, nearest_first, top_per_query, unit_rows

#: Vectors of a shard, links out of a vector and as many back at most, far links, width of the beam, fewest entries of a walk.
SHARD, DEGREE, FAR, BEAM, ENTRIES = 20_000, 12, 4, 96, 16
#: Vectors of the beam that a step leaves from.
STRIDE = 4
GRAPH = "shard int, dim int, ids array<long>, vectors array<float>, degree int, links array<int>"


def nearest_links(vectors: np.ndarray, degree: int) -> np.ndarray:
    """Each vector's ``degree`` nearest others, up to as many of those that have it among theirs, and far ones; -1 where there is none."""
    n = len(vectors)
    out = np.full((n, 2 * degree + FAR), -1, np.int32)
    own = min(degree, n - 1)
    if own <= 0:
        return out
    out[:, 2 * degree :] = np.random.default_rng(n).integers(0, n, (n, FAR))
    for at in range(0, n, 1024):
        likeness = vectors[at : at + 1024] @ vectors.T
        likeness[np.arange(len(likeness)), np.arange(at, at + len(likeness))] = -np.inf
        out[at : at + 1024, :own] = np.argpartition(-likeness, own - 1, axis=1)[:, :own]
    to, back = out[:, :own].ravel(), np.repeat(np.arange(n, dtype=np.int32), own)
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    kept = rank < degree
    out[to[kept], degree + rank[kept]] = back[kept]
    return out


def walk(vectors: np.ndarray, links: np.ndarray, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, likeness, distances worked out) of the beam in which a walk ends."""
    n = len(vectors)
    seen = np.zeros(n, bool)
    at = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, int(n**0.5)))).astype(np.int64))
    seen[at] = True
    score, left = vectors[at] @ asked, np.zeros(len(at), bool)
    count = len(at)
    while not left.all():
        ahead = np.flatnonzero(~left)
        ahead = ahead[np.argsort(-score[ahead])[:STRIDE]]
        left[ahead] = True
        more = np.unique(links[at[ahead]])
        more = more[more >= 0]
        more = more[~seen[more]]
        if not len(more):
            continue
        seen[more] = True
        count += len(more)
        at, score, left = np.append(at, more), np.append(score, vectors[more] @ asked), np.append(left, np.zeros(len(more), bool))
        if len(at) > beam:
            kept = np.argpartition(-score, beam)[:beam]
            at, score, left = at[kept], score[kept], left[kept]
    return at, score, count


def build_graphs(chunks: DataFrame, path: str, shard: int = SHARD, degree: int = DEGREE) -> None:
    """Write the graphs of ``chunks`` (chunk_id, embedding). Vectors with nulls, of another length than most of their shard, or zero take no part."""
    shards = max(1, -(-chunks.count() // shard))
    keyed = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"))

    def linked(table: pa.Table) -> pa.Table:
        column = table.column("embedding").combine_chunks()
        widths = [w for w in pc.list_value_length(column).to_pylist() if w]
        dim = max(set(widths), key=widths.count) if widths else 0
        at, rows = unit_rows(column, dim)
        rows = rows.astype(np.float32)
        links = nearest_links(rows, degree)
        values = {
            "shard": [table.column("shard")[0].as_py()],
            "dim": [dim],
            "ids": [table.column("chunk_id").to_numpy()[at]],
            "vectors": [rows.ravel()],
            "degree": [links.shape[1]],
            "links": [links.ravel()],
        }
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.int32(), pa.list_(pa.int32()))
        return pa.table({name: pa.array(value, kind) for (name, value), kind in zip(values.items(), kinds, strict=True)})

    keyed.groupBy("shard").applyInArrow(linked, GRAPH).write.parquet(path)


def search_graphs(spark: SparkSession, path: str, queries: DataFrame, k: int, threshold: float = THRESHOLD, beam: int = BEAM) -> DataFrame:
    """(query_id, chunk_id, similarity, position, distances): the nearest chunks that the walks found, strictly above the threshold.

    ``distances`` are those worked out for the question in all graphs. Questions go in blocks, as in a dense search.
    """
    graphs = spark.read.schema(GRAPH).parquet(path)
    schema = "query_id long, chunk_id long, similarity double, distances long"

    def nearest(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, wanted, dim = shared.value
            for batch in batches:
                for i in range(len(batch)):
                    row = {name: batch.column(name)[i] for name in ("dim", "ids", "vectors", "degree", "links")}
                    own = row["ids"].values.to_numpy()
                    if row["dim"].as_py() != dim or not len(own):
                        continue
                    vectors = row["vectors"].values.to_numpy().reshape(len(own), dim)
                    links = row["links"].values.to_numpy().reshape(len(own), row["degree"].as_py())
                    found: list[tuple] = []
                    for query, asked in zip(ids.tolist(), wanted, strict=True):
                        at, _, count = walk(vectors, links, asked.astype(np.float32), max(beam, k))
                        exact = vectors[at].astype(np.float64) @ asked
                        near = best_of(exact, k, threshold)
                        # A question whose walk found nothing tells its distances all the same.
                        found.append((np.full(len(near) + 1, query), np.append(own[at][near], -1), np.append(exact[near], np.nan), np.append(np.zeros(len(near), np.int64), count)))
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "chunk_id", "similarity", "distances"])

        return graphs.mapInArrow(run, schema)

    found = asked_in_blocks(queries, nearest, "graph")
    if "distances" not in found.columns:
        return spark.createDataFrame([], "query_id long, chunk_id long, similarity double, position int, distances long")
    counts = found.groupBy("query_id").agg(F.sum("distances").alias("distances"))
    best = top_per_query(found.where(~F.isnan("similarity")).drop("distances"), k, *nearest_first())
    return best.join(counts, "query_id").select("query_id", "chunk_id", "similarity", "position", "distances")
