"""A stored inverted index for BM25: built once for a corpus, searched without reading texts.

Three tables lie in a folder named by the corpus signature: ``forward`` (each chunk with its length and terms),
``terms`` (document frequency, idf and largest impact) and ``postings``. An impact is a term's BM25 part in
a chunk without the idf. A posting list is parted into blocks by level of impact and by shard of chunks, so none
grows with the corpus, and each block knows its largest impact. A shard is made where its chunks lie: no posting is shuffled.
A folder without its last table is not used.

A search reads what can matter. Some chunks that hold a query's weightiest terms are scored in whole; the
k-th best of these is a floor. A chunk that has only terms whose largest parts sum to less than the floor cannot
be among the best, so the lists of these terms, which are the long ones, are not read, nor are blocks that cannot
reach it. Chunks that remain are scored in whole from ``forward``. Results equal those of scoring all chunks.
Many or long queries hold terms whose lists are longer together than all of ``forward``: that is then read instead, once
for each block of queries, and chunks are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.functions.text import words
from normata.operators.retrieval import EPSILON, K1, B, best_first, best_in_blocks, corpus_signature, kept_once, only_kept, scaled, term_counts, term_lists, top_per_query
from normata.sources.scratch import remove, stored

#: Levels of impact that part a list; postings of a shard, about, and chunks that go to it at a time.
LEVELS, SHARD, SLICE = 16, 1_000_000, 1024
#: A query's terms that lead to its first candidates, and how many of these are scored for each result asked for.
LEADING, FIRST = 16, 4
SLACK = 1e-6
FORWARD = "chunk_id long, length int, terms array<struct<term: string, tf: long, impact: double>>"
TERMS = "term string, df long, largest double, idf double"
POSTINGS = "term string, shard int, level int, block_max double, chunks array<struct<chunk_id: long, impact: double>>"


@dataclass
class Index:
    """An open index: where it lies, the signature it was built for, and its tables."""

    path: str
    signature: tuple[int, int]
    forward: DataFrame
    terms: DataFrame
    postings: DataFrame


def part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


def posting_blocks(impacts: DataFrame) -> DataFrame:
    """Blocks of the posting lists (:data:`POSTINGS`) of chunks (chunk_id, terms, impacts), by term in each shard; a shard is some chunks of one task."""

    def blocks(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, impacts = (pa.concat_arrays([batch.column(i) for batch in held]) for i in range(3))
        coded, number = terms.flatten().dictionary_encode(), ids.take(pc.list_parent_indices(terms))
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        impact = impacts.flatten().to_numpy()
        key = place[coded.indices.to_numpy()] * (LEVELS + 1) + LEVELS - (impact / (K1 + 1) * LEVELS).astype(np.int64)  # impacts are below K1 + 1
        by = np.argsort(key, kind="stable")
        key, impact = key[by], impact[by]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        each = pa.StructArray.from_arrays([number.take(pa.array(by)), pa.array(impact)], ["chunk_id", "impact"])
        columns = [
            coded.dictionary.take(pa.array(order[key[begins] // (LEVELS + 1)])), pa.array(np.full(len(begins), shard), pa.int32()), pa.array(LEVELS - key[begins] % (LEVELS + 1), pa.int32()),
            pa.array(np.maximum.reduceat(impact, begins) if len(key) else impact), pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)), pa.int32()), each),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["term", "shard", "level", "block_max", "chunks"])
        yield from (whole.slice(at, 50_000) for at in range(0, len(whole), 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, many = TaskContext.get().partitionId() << 12, [], 0
        for batch in batches:
            for some in (batch.slice(at, SLICE) for at in range(0, len(batch), SLICE)):
                held.append(some)
                many += len(some.column(1).flatten())
                if many >= SHARD:
                    yield from blocks(shard, held)
                    shard, held, many = shard + 1, [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from blocks(shard, held)

    return impacts.mapInArrow(run, POSTINGS)


def chunk_impacts(forward: DataFrame) -> DataFrame:
    return forward.select("chunk_id", F.col("terms.term").alias("terms"), F.col("terms.impact").alias("impacts"))


def build_index(chunks: DataFrame, path: str) -> None:
    """Write the three tables for ``chunks`` (chunk_id, content); texts are tokenised once."""
    spark = chunks.sparkSession
    term_lists(chunks).write.mode("overwrite").parquet(f"{path}/counted")
    held = spark.read.parquet(f"{path}/counted")
    n, mean = held.agg(F.count(F.lit(1)), F.avg("length")).first()
    impact = lambda t: part(t["tf"], F.col("length"), mean)
    with_impact = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), impact(t).alias("impact")))
    held.select("chunk_id", "length", with_impact.alias("terms")).write.mode("overwrite").parquet(f"{path}/forward")
    remove(spark, f"{path}/counted")
    impacts = chunk_impacts(spark.read.schema(FORWARD).parquet(f"{path}/forward"))
    posting_blocks(impacts).write.mode("overwrite").parquet(f"{path}/postings")
    sizes = stored(term_counts(impacts), "sizes")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    average = sizes.agg(F.avg(raw)).first()[0]
    idf = F.when(raw < 0, EPSILON * (average or 0.0)).otherwise(raw)
    sizes.select("term", "df", "largest", idf.alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")


def open_index(chunks: DataFrame, path: str) -> Index:
    """The index of ``chunks`` under ``path``: that of their signature if it is there, else a new one."""
    spark = chunks.sparkSession
    count, largest = corpus_signature(chunks).first()
    own = f"{path}/{count}-{largest}"
    if not exists(spark, f"{own}/terms/_SUCCESS"):
        build_index(chunks, own)
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{own}/{name}")
    return Index(own, (count, largest), read(FORWARD, "forward"), read(TERMS, "terms"), read(POSTINGS, "postings"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, high, low): what a term of a query adds at most and at least to a chunk's score."""
    times = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weight = F.col("times") * F.col("idf")
    most = weight * F.col("largest")
    return times.join(index.terms, "term").select("query_id", "term", weight.alias("weight"), F.greatest(most, F.lit(0.0)).alias("high"), F.least(most, F.lit(0.0)).alias("low"))


def whole_scores(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of the given pairs, from the chunks' own terms."""
    held = pairs.join(index.forward.select("chunk_id", "terms"), "chunk_id").select("query_id", "chunk_id", F.inline("terms"))
    parts = held.join(asked.select("query_id", "term", "weight"), ["query_id", "term"])
    return parts.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def floors(index: Index, asked: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
    """(query_id, floor): a score that the k-th best chunk reaches at least, where k chunks were found that easily."""
    leading = asked.withColumn("__at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "term"))).where(F.col("__at") <= LEADING)
    met = leading.join(index.postings, "term").select("query_id", "weight", F.inline("chunks"))
    partial = only_kept(met, keep).groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("partial"))
    first = top_per_query(partial, FIRST * k, F.desc("partial"), "chunk_id").select("query_id", "chunk_id")
    best = top_per_query(whole_scores(index, asked, first), k, F.desc("score"))
    return best.where(F.col("position") == k).select("query_id", F.col("score").alias("floor"))


def essential(asked: DataFrame, floor: DataFrame) -> DataFrame:
    """Terms of which a chunk must hold one to reach its query's floor, with ``rest``, what the other terms add at most,
    ``others``, what all terms but this one add at most, and ``floor``."""
    by = Window.partitionBy("query_id")
    summed = F.sum("high").over(by.orderBy("high", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = asked.join(floor, "query_id", "left").withColumn("__upto", summed).withColumn("__total", F.sum("high").over(by))
    low = F.col("__upto") < F.col("floor") - SLACK
    marked = told.withColumn("rest", F.coalesce(F.max(F.when(low, F.col("__upto"))).over(by), F.lit(0.0)))
    return marked.where(F.col("floor").isNull() | ~low).select("query_id", "term", "weight", "rest", "floor", (F.col("__total") - F.col("high")).alias("others"))


def search_index(index: Index, queries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, position): as :func:`normata.operators.retrieval.sparse_search` over the index's corpus.

    ``keep`` (chunk_id) narrows what is ranked. A query without words that the corpus knows finds nothing.
    """
    asked = stored(asked_terms(index, queries), "asked")
    postings = asked.join(index.terms, "term").agg(F.sum("df")).first()[0] or 0
    if postings > (index.terms.agg(F.sum("df")).first()[0] or 0):
        return whole_search(index, asked, k, keep)
    needed = essential(asked, floors(index, asked, k, keep))
    reach = F.greatest(F.col("weight") * F.col("block_max"), F.lit(0.0)) + F.col("others")
    read = needed.join(index.postings, "term").where(F.col("floor").isNull() | (reach >= F.col("floor") - SLACK))
    met = only_kept(read.select("query_id", "weight", "rest", "floor", F.inline("chunks")), keep)
    partial = met.groupBy("query_id", "chunk_id").agg(F.sum(F.greatest(F.col("weight") * F.col("impact"), F.lit(0.0))).alias("partial"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    # What a block that was left out would add is missing for chunks only that cannot reach the floor.
    hopeful = partial.where(F.col("floor").isNull() | (F.col("partial") + F.col("rest") >= F.col("floor") - SLACK))
    scored = whole_scores(index, asked, hopeful.select("query_id", "chunk_id"))
    return scaled(top_per_query(scored, k, *best_first()))


def whole_search(index: Index, asked: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
    """The search by ``forward``: every chunk is scored where it lies, by all questions of a block at once."""
    impacts = kept_once(chunk_impacts(index.forward), keep)
    return scaled(top_per_query(best_in_blocks(asked.select("query_id", "term", "weight"), impacts, k), k, *best_first()))
