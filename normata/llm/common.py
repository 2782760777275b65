"""Helpers shared by the operators: shared storage and label splits."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary one is set if all runs in one process (a local master);
    on a cluster, whose machines would not see it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="normata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a file read and not a recomputation,
    and so that several readers see the very same rows.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`materialise`, in buckets of ``key``: joins on it shuffle their other side only.

    The table lies in the shared folder; the catalogue knows it until :func:`discard`.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.scratch, out.known_as = path, table
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = table.sparkSession
    if name := getattr(table, "known_as", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, rows: int = 50_000) -> DataFrame:
    """A stored table of short rows, with a hint to broadcast it if it has few of them; else Spark joins as it sees fit."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def give_back() -> None:
    """Return what a task has freed to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that only these become Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    give_back()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def pick_labelled(labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out remainder, in a fixed hash order.

    Rows without id are left out, and so are labels other than 0 and 1; an id with several labels
    keeps the largest. The bound makes the result small enough to broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    one = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sample_texts(documents: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the picked ids, a row for each, so no more rows than ids.

    Of an id's stored texts that of the least hash counts, so that no document outweighs the others;
    the rows are thinned before they are shuffled.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return one.select("doc_id", "label", F.col("first.text").alias("text"))
