"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are turned by a rotation learned on a bounded sample (``SAMPLE``; iterative quantisation),
and the signs of their components are the bits. A code is split into substrings; each is indexed.
Within a Hamming radius ``r`` some substring of a match differs in at most ``r // m`` bits (less one for
all but the first ``r % m + 1`` substrings), so probing all values that near to the query's substrings
retrieves every code in the radius; those are reranked by the exact cosine of the original vectors.

1. Near: the substrings of ``WIDTH`` bits of all rows are a table by (substring, value). A query joins it
   with its own values and all that differ in one bit, which finds every code within ``2 m - 1`` bits. It is
   settled if it has ``k`` rows at least as near as codes beyond that radius could well be (``SURE``
   standard deviations), and if no value that it probes has more than ``BUCKET`` rows.
2. Far: the other queries are held against all rows in blocks, as their neighbours are too weak for a
   substring to select by, or too many. Rows lie in shards and queries in blocks by a hash; each pair of
   them probes the shard's indexes for the block, and each query's best of all shards are merged.
   Queries for which that finds fewer than ``k`` rows probe again in a larger radius (``WIDER``), in the
   end over all bits.

Equal vectors are one entry that carries its smallest ids, so a hot vector is one row.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without id; ties go to the smaller id; a query's own
row is no candidate, but other rows with its vector are; repeated ids count once each; with no
candidates there are no rows; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.llm.common import materialise

SAMPLE, ROUNDS = 20_000, 30
SUBSTRINGS = 8
RADIUS = 0.4375  # of the code's bits: 28 of 64, for a recall of 0.98 on vectors with weak neighbours
WIDER = (0.625, 1.0)  # of the bits, for the queries with too few rows inside
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
WIDTH, BUCKET, SURE = 16, 4096, 3.0
K = 5


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = typed.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    common = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("vector") == (common.n if common else 0))


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Rotation whose signs lose least of the sample: principal axes, then iterative quantisation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(unit.T @ unit)
    turned = unit @ axes.T
    start = np.random.default_rng(3).standard_normal((unit.shape[1],) * 2)
    rotation = np.linalg.qr(start)[0]
    for _ in range(rounds):
        bits = np.where(turned @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(bits.T @ turned)
        rotation = (u @ vt).T
    return axes.T @ rotation


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes, each byte one substring of eight bits."""
    return np.packbits(vectors @ rotation >= 0, axis=1)


POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class MultiIndex:
    """One table per substring: entries in the order of their substring's value, and where each value begins."""

    codes: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.begin = np.stack([np.searchsorted(np.sort(c), np.arange(257)) for c in self.codes.T])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Entries whose codes differ from ``code`` in at most ``radius`` bits; all of them."""
        m = self.codes.shape[1]
        near, rest = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = near if j <= rest else near - 1
            if reach < 0:
                continue
            begin = self.begin[j]
            for value in np.flatnonzero(POPCOUNT[code[j]] <= reach):
                hit[self.order[begin[value] : begin[value + 1], j]] = True
        found = np.flatnonzero(hit)
        distance = np.bitwise_count(self.codes[found] ^ code).sum(axis=1)
        return found[distance <= radius]


def best_of(query: np.ndarray, query_norm: float, found: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` entries of largest cosine with all that tie with the last, and their cosines."""
    score = (vectors[found] * query).sum(axis=1) / (norms[found] * query_norm)
    if len(found) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= least - 1e-12
        found, score = found[keep], score[keep]
    return found, np.clip(score, -1.0, 1.0)


def cosines(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, or with its own."""
    norms = np.sqrt((vectors**2).sum(axis=1)) * np.sqrt((queries**2).sum(axis=-1))
    return np.clip((vectors * queries).sum(axis=1) / norms, -1.0, 1.0)


def coded(rows: DataFrame, rotation) -> DataFrame:
    """``rows`` with ``code`` and its substrings of ``WIDTH`` bits, ``subs``, at the end."""

    @F.pandas_udf("struct<code:binary,subs:array<int>>")
    def code(vectors: pd.Series) -> pd.DataFrame:
        codes = encode(np.stack(vectors.to_numpy()), rotation.value)
        subs = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).view(">u2").astype(np.int32)
        return pd.DataFrame({"code": [c.tobytes() for c in codes], "subs": [*subs]})

    return rows.withColumn("__c", code("vector")).withColumns({"code": F.col("__c.code"), "subs": F.col("__c.subs")}).drop("__c")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of distinct (query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return materialise(top.select("query_id", "rank", "vec_id", "score"), "nearest")


def near_search(entries: DataFrame, asked: DataFrame, k: int, bits: int) -> DataFrame:
    """The ``k`` best for each query of ``asked`` that its near codes settle."""
    m = -(-bits // WIDTH)
    radius = 2 * m - 1
    index = entries.select(F.element_at("ids", 1).alias("key"), F.posexplode("subs").alias("j", "value"))
    masks = F.array(*[F.lit(x) for x in (0, *(1 << i for i in range(WIDTH)))])
    own = asked.select("query_id", F.posexplode("subs").alias("j", "sub"))
    probes = own.select("query_id", "j", F.explode(F.transform(masks, lambda x: F.col("sub").bitwiseXOR(x))).alias("value"))
    hot = materialise(index.groupBy("j", "value").count().where(F.col("count") > BUCKET).select("j", "value"), "hot")
    crowded = probes.join(hot, ["j", "value"], "left_semi").select("query_id").distinct()
    calm = probes.join(crowded, "query_id", "left_anti")
    pairs = calm.join(index, ["j", "value"]).select("query_id", "key").distinct()
    rows = entries.select(F.element_at("ids", 1).alias("key"), "ids", "vector", "code")
    met = pairs.join(rows, "key").join(asked.select("query_id", F.col("vector").alias("q_vector"), F.col("code").alias("q_code")), "query_id")

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, asking = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("code", "q_code"))
            batch = batch[np.bitwise_count(codes ^ asking).sum(axis=1) <= radius]
            if len(batch):
                score = cosines(np.stack(batch["vector"].to_numpy()), np.stack(batch["q_vector"].to_numpy()))
                out = [(q, v, s) for q, ids, s in zip(batch["query_id"], batch["ids"], score, strict=True) for v in ids if v != q]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    best = ranked(met.mapInPandas(rerank, "query_id long, vec_id long, score double"), k)
    share = F.acos(F.least("score", F.lit(1.0))) / math.pi
    sure = share * bits + SURE * F.sqrt(share * (1 - share) * bits) <= radius
    return best.join(best.where((F.col("rank") == k) & sure).select("query_id"), "query_id", "left_semi")


def search(rows: DataFrame, is_query: Column, k: int = K, radius: float = RADIUS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row where ``is_query``."""
    spark = rows.sparkSession
    table = materialise(valid_vectors(rows), "vectors")
    picked = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if picked.empty:
        return spark.createDataFrame([], schema)
    sample = np.stack(picked["vector"].to_numpy())
    sample = sample[np.argsort(picked["vec_id"].to_numpy(), kind="stable")]
    rotation = spark.sparkContext.broadcast(learn_rotation(sample))
    # Equal vectors are one entry with their k + 1 smallest ids: enough for any query, its own row left out.
    # Salted first, so that a hot vector's ids are thinned in many tasks.
    salted = Window.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = table.distinct().withColumn("at", F.row_number().over(salted)).where(F.col("at") <= k + 1)
    distinct = few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = materialise(coded(distinct, rotation), "entries")
    shards = max(1, -(-entries.count() // SHARD_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def probe(held: pd.DataFrame, queries: pd.DataFrame, radius: float) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(queries):
            vectors = np.stack(held["vector"].to_numpy())
            norms, ids = np.sqrt((vectors**2).sum(axis=1)), held["ids"].to_numpy()
            index = MultiIndex(np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1))
            bits = int(radius * vectors.shape[1])
            asking = np.stack(queries["vector"].to_numpy())
            codes = np.frombuffer(b"".join(queries["code"]), np.uint8).reshape(len(queries), -1)
            for i, query_id in enumerate(queries["query_id"].tolist()):
                found = index.within(codes[i], bits)
                found, score = best_of(asking[i], float(np.sqrt((asking[i] ** 2).sum())), found, vectors, norms, k + 1)
                for at, s in zip(found, score, strict=True):
                    out += [(query_id, v, float(s)) for v in ids[at] if v != query_id]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def far_search(asked: DataFrame, n: int, radius: float) -> DataFrame:
        """The ``k`` best inside ``radius`` for each of the ``n`` rows ``asked``."""
        blocks = max(1, -(-n // BLOCK_QUERIES))
        left = entries.drop("subs").withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
        right = asked.drop("subs").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
        near = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
            lambda held, queries: probe(held, queries, radius), "query_id long, vec_id long, score double"
        )
        return ranked(near, k)

    asked = materialise(coded(table.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct(), rotation), "asked")
    out = near_search(entries, asked, k, sample.shape[1])
    asked = asked.join(out.select("query_id").distinct(), "query_id", "left_anti")
    n = asked.count()
    for reach in [radius, *(w for w in WIDER if w > radius)]:  # the last reach is all bits and returns
        if not n:
            return out
        found = far_search(asked, n, reach)
        if reach >= 1:
            return out.unionByName(found)
        full = found.where(F.col("rank") == k).select("query_id")
        asked = asked.join(full, "query_id", "left_anti")
        n = asked.count()
        out = out.unionByName(found.join(full, "query_id", "left_semi"))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all rows for each row whose vec_id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
