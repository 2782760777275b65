"""Versioned tables and the ingest that writes them."""

import os

import pytest
from pyspark.sql import functions as F

from normata.sources import tables as S
from normata.sources import versions as V

SCHEMA = "k int, v string"


def shown(spark, path, version=None):
    return sorted(map(tuple, V.read_versions(spark, path, SCHEMA, "k", version).collect()), key=repr)


def test_replace_append_and_earlier_versions(spark, tmp_path):
    path, rows = f"{tmp_path}/t", lambda r: spark.createDataFrame(r, SCHEMA)
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert shown(spark, path) == []
    V.write_version(rows([(1, "a"), (1, "b"), (2, "c"), (None, "n")]), path, "k", keys([1, 2, None]))
    V.write_version(rows([(1, "new")]), path, "k", keys([1, 2, 9]))
    assert shown(spark, path) == [(1, "new"), (None, "n")]
    assert len(shown(spark, path, 1)) == 4
    V.write_version(rows([(1, "more"), (3, "d")]), path, "k")
    assert shown(spark, path) == [(1, "more"), (1, "new"), (3, "d"), (None, "n")]
    V.write_version(rows([]), path, "k", keys([None]))
    assert shown(spark, path) == [(1, "more"), (1, "new"), (3, "d")]
    before = shown(spark, path)
    assert V.compact(spark, path, SCHEMA, "k")["version"] == 5
    assert shown(spark, path) == before and shown(spark, path, 1) == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]


def test_a_failing_task_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    V.write_version(spark.createDataFrame([(1, "old")], SCHEMA), path, "k")
    bad = spark.range(0, 4000, 1, 4).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3999, F.raise_error(F.lit("half way"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="half way"):
        V.write_version(bad, path, "k", bad.select("k"))
    assert shown(spark, path) == [(1, "old")]
    assert len(os.listdir(f"{path}/versions")) == 1 and len(os.listdir(f"{path}/data")) == 1


def test_the_later_of_two_writers_fails(spark, tmp_path):
    path = f"{tmp_path}/t"
    first, second = V.VersionWriter(path, "k", 1), V.VersionWriter(path, "k", 1)
    first.commit([])
    with pytest.raises(FileExistsError):
        second.commit([])
    assert [m["version"] for m in V.manifests(path)] == [1]


def laws(spark, n, other="nada"):
    text = "TITULO I\n" + "".join(f"Articulo {i}.- Uno.\n" for i in range(1, n + 1))
    return spark.createDataFrame([(1, "Ley Uno", text), (2, "Ley Dos", other)], "id int, nombre string, raw_text string")


def test_ingest_replaces_all_or_nothing(spark, tmp_path):
    chunks, log = f"{tmp_path}/chunks", f"{tmp_path}/log"
    counts = lambda *a, **k: {r.document_id: r.chunks_created for r in S.ingest(spark, *a, chunks, log, "m", **k).collect()}
    assert counts(laws(spark, 0)) == {1: 0, 2: 0} and S.read_chunks(spark, chunks).count() == 0
    assert counts(laws(spark, 3, "Articulo 1.- Dos.")) == {1: 3, 2: 1}
    assert counts(laws(spark, 2)) == {1: 2, 2: 0}  # the second law has no article any more
    rows = S.read_chunks(spark, chunks).orderBy("position").collect()
    assert [(r.document_id, r.articulo_numero) for r in rows] == [(1, "1"), (1, "2")]
    assert rows[0].embedding_text == "Ley Uno, Titulo I, Articulo 1: Articulo 1.- Uno." and rows[0].chunk_metadata.parte is None
    broken = laws(spark, 5).withColumn("raw_text", F.when(F.col("id") == 1, F.raise_error(F.lit("no text"))).otherwise(F.col("raw_text")))
    with pytest.raises(Exception, match="no text"):
        S.ingest(spark, broken, chunks, log, "m")
    assert S.read_chunks(spark, chunks).count() == 2
    assert counts(laws(spark, 2), replace=False) == {1: 2, 2: 0} and S.read_chunks(spark, chunks).count() == 4
    state = S.ingestion_log(spark, log).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in state} == {"success": 8, "failed": 2}
    failed = S.ingestion_log(spark, log).where("status = 'failed'").first()
    assert failed.error_message.startswith("Traceback") and len(failed.error_message) <= 4000 and failed.started_at <= failed.completed_at
    assert spark.read.parquet(log).where("status = 'running'").count() == 10


def test_unknown_documents_fail(spark, tmp_path):
    known = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="no document 2"):
        S.ingest(spark, laws(spark, 1), f"{tmp_path}/c", f"{tmp_path}/l", "m", documents=known)
    assert S.ingestion_log(spark, f"{tmp_path}/l").where("status = 'failed'").count() == 2
