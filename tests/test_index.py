"""The stored BM25 index gives what scoring every chunk gives."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from normata.operators import index as X
from normata.operators import retrieval as R


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, " "), (n + 2, rows[0][1]), (n + 3, "Alone alone")], "chunk_id long, content string")


def found(df):
    return sorted((r.query_id, r.position, r.chunk_id, round(r.similarity, 9)) for r in df.collect())


def test_equals_scoring_all(spark, tmp_path):
    chunks = corpus(spark, 600)
    texts = ["w0 w1", "w250 w0 w0", "w3 w150 w299 unknown", "alone", "nothing here", "", " ".join(f"w{i}" for i in range(0, 300, 7))]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
    index = X.open_index(chunks, str(tmp_path))
    keep = chunks.where("chunk_id % 3 = 0").select("chunk_id")
    for k, only in ((1, None), (5, None), (700, None), (5, keep), (5, keep.limit(0))):
        assert found(X.search_index(index, asked, k, only)) == found(R.sparse_search(chunks, asked, k, only)), k


def test_few_chunks_and_negative_idf(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a"), (2, "a b c"), (3, "c c a")], "query_id long, query_text string")
    index = X.open_index(chunks, f"{tmp_path}/few")
    assert found(X.search_index(index, asked, 2)) == found(R.sparse_search(chunks, asked, 2))
    none = X.open_index(chunks.limit(0), f"{tmp_path}/none")
    assert found(X.search_index(none, asked, 2)) == []


def test_built_once_for_each_signature(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "uno dos"), (2, "dos tres")], "chunk_id long, content string")
    first = X.open_index(chunks, str(tmp_path))
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    watched = chunks.withColumn("content", F.udf(count)("content"))
    again = X.open_index(watched, str(tmp_path))
    again.terms.collect()
    assert again.path == first.path and seen.value == 0  # no text was read
    more = X.open_index(watched.union(spark.createDataFrame([(3, "tres")], chunks.schema)), str(tmp_path))
    more.terms.collect()
    assert more.path != first.path and more.signature == (3, 3) and seen.value == 2  # each once
    assert {r.term: r.df for r in more.terms.collect()} == {"uno": 1, "dos": 2, "tres": 2}


def test_long_lists_are_not_read(spark, tmp_path):
    rare = [(i, "common " + ("rare " * 3 if i % 100 == 0 else "") + f"own{i}") for i in range(2000)]
    chunks = spark.createDataFrame(rare, "chunk_id long, content string")
    index = X.open_index(chunks, str(tmp_path))
    asked = X.asked_terms(index, spark.createDataFrame([(1, "common rare")], "query_id long, query_text string"))
    needed = X.essential(asked, X.floors(index, asked, 5, None))
    assert [r.term for r in needed.collect()] == ["rare"]
    everything = X.essential(asked, X.floors(index, asked, 21, None))  # only 20 hold it, so there is no floor
    assert everything.count() == 2


def test_blocks_hold_all_postings(spark, tmp_path):
    index = X.open_index(corpus(spark, 300), str(tmp_path))
    blocks = index.postings.select("block_max", F.array_max(F.transform("chunks", lambda c: c["impact"])).alias("m"), F.size("chunks").alias("n"))
    assert blocks.where("abs(block_max - m) > 1e-12").count() == 0
    assert blocks.agg(F.sum("n")).first()[0] == index.forward.agg(F.sum(F.size("terms"))).first()[0]


def test_scores_without_moving_pairs(spark, monkeypatch):
    chunks = corpus(spark, 200)
    texts = ["w0 w1", "w250 w0 w0", "w3 w150 w299 unknown", "alone", "nothing here", "", " ".join(f"w{i}" for i in range(0, 300, 7))]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
    held = [(r.chunk_id, (r.content or "").lower().split()) for r in chunks.collect()]
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(held) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else R.EPSILON * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(len(words) for _, words in held) / len(held)
    part = lambda w, words: idf[w] * words.count(w) * (R.K1 + 1) / (words.count(w) + R.K1 * (1 - R.B + R.B * len(words) / mean))
    met = [(q, c, [w for w in text.split() if w in words], words) for q, text in enumerate(texts) for c, words in held]
    want = {(q, c): round(sum(part(w, words) for w in shared), 9) for q, c, shared, words in met if shared}
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "DENSE", 2)
    got = R.bm25_scores(chunks, asked)
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_weights_that_are_not_above_zero(spark):
    rows = [(1, "a", -1.0), (1, "b", 1.0), (2, "b", 0.0), (2, "c", 2.0)]
    weights = R.Weights.of(spark.createDataFrame(rows, "query_id long, term string, weight double").toArrow())
    code = weights.terms
    got = weights.scores(np.array([0, 0, 1, 2]), np.array([code["a"], code["b"], code["b"], code["c"]]), np.array([1.0, 1.0, 3.0, 1.0]), 4)
    nan = np.nan
    assert np.array_equal(got[[weights.ids.to_pylist().index(i) for i in (1, 2)]], [[0.0, 3.0, nan, nan], [0.0, 0.0, 2.0, nan]], equal_nan=True)


def test_postings_are_made_where_chunks_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 100)
    monkeypatch.setattr(X, "SLICE", 16)
    chunks = corpus(spark, 300)
    index = X.open_index(chunks, str(tmp_path))
    assert "Exchange" not in X.posting_blocks(X.chunk_impacts(index.forward))._jdf.queryExecution().executedPlan().toString()
    listed = index.postings.select("term", "shard", "level", F.inline("chunks"))
    assert listed.select("shard").distinct().count() > 4 and not (tmp_path / f"{index.signature[0]}-{index.signature[1]}" / "counted").exists()
    want = index.forward.select("chunk_id", F.inline("terms"))
    assert sorted(map(tuple, listed.select("chunk_id", "term", "impact").collect())) == sorted(map(tuple, want.select("chunk_id", "term", "impact").collect()))
    assert listed.where(F.col("level") != F.floor(F.col("impact") / (R.K1 + 1) * X.LEVELS)).count() == 0
    told = {r.term: (r.df, r.largest) for r in index.terms.collect()}
    assert told == {r.term: (r.n, r.m) for r in want.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("m")).collect()}
    asked = spark.createDataFrame([(1, "w3 w150"), (2, "w250")], "query_id long, query_text string")
    assert found(X.search_index(index, asked, 5)) == found(R.sparse_search(chunks, asked, 5))


def test_chunks_to_keep_are_told_once(spark, monkeypatch):
    chunks = corpus(spark, 200)
    asked = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query_text"))
    keep = chunks.where("chunk_id % 3 = 0").select("chunk_id")
    whole = found(R.sparse_search(chunks, asked, 5, keep))
    passes, best = [], R.best_scores

    def watched(shared, impacts, k):
        passes.append((len(shared.value), "Join" in impacts._jdf.queryExecution().executedPlan().toString()))
        return best(shared, impacts, k)

    monkeypatch.setattr(R, "best_scores", watched)
    monkeypatch.setattr(R, "BLOCK", 3)
    assert found(R.sparse_search(chunks, asked, 5, keep)) == whole and len(whole) > 60
    assert sum(n for n, _ in passes) > 4 and len(passes) <= 2 and not any(joined for _, joined in passes)


def test_words_are_those_of_the_column(spark):
    from normata.functions.text import words

    texts = ["", " ", "a", " A  b\ta\r\nB\x0bÀ\x0cİ ", "x\x1cy\xa0z w", None, "ß ẞ SS", "\n\nfin "]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    want = {r.chunk_id: sorted(r.w or []) for r in chunks.select("chunk_id", words(F.col("content")).alias("w")).collect()}
    got = R.term_lists(chunks).collect()
    assert {r.chunk_id: sorted(t.term for t in r.terms for _ in range(t.tf)) for r in got} == want and all(r.length == len(want[r.chunk_id]) for r in got)


def test_chunks_are_read_once_for_several_blocks(spark, monkeypatch):
    chunks = corpus(spark, 120)
    asked = chunks.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query_text"))
    whole, passes, best = found(R.sparse_search(chunks, asked, 7)), [], R.best_scores
    monkeypatch.setattr(R, "best_scores", lambda shared, *more: passes.append(len(shared.value)) or best(shared, *more))
    monkeypatch.setattr(R, "BLOCK", 4)
    assert found(R.sparse_search(chunks, asked, 7)) == whole
    assert sum(passes) > R.BLOCKS and len(passes) == -(-sum(passes) // R.BLOCKS)


def test_few_chunks_are_moved_to_the_join(spark, monkeypatch):
    chunks, moved, join = corpus(spark, 200), [], R.only_kept
    monkeypatch.setattr(R, "only_kept", lambda rows, keep: moved.append(rows.count()) or join(rows, keep))
    keep = chunks.where("chunk_id % 10 = 0").select("chunk_id")
    assert R.kept_once(chunks, keep).count() == keep.count() == moved[0]
    monkeypatch.setattr(R, "MARKS", 2)  # marks that tell nothing apart
    assert R.kept_once(chunks, keep).count() == keep.count() and moved[1] > moved[0]
