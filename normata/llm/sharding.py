"""Sharding along a Hilbert curve over metadata.

Several metadata columns are quantised, a row's position on the Hilbert curve through that grid is
its sort key, and the sorted rows are cut into runs. Neighbours on the curve are close in every
dimension, so a run covers a small box of the metadata and files can be skipped by any of it.

The cut follows the law ``rows``: shard sizes differ by one row at most. The order is made by a range
exchange on (curve index, salt), where the salt is a hash of the row: a hot cell is spread over many
ranges. Each range is ranked on its own and shifted by the sizes of those before it; only one count
per range reaches the driver.

Defined results: null text has 0 bytes and no CRC input (that of the empty text); null metadata takes
cell 0; repeated rows are ranked apart; an empty table gives no rows; other columns pass through, but ones
named ``shard`` or ``slot`` are replaced; with fewer rows than shards some shards stay empty;
a text of any length is one row, of which only its size and hash are read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.llm.common import materialise

SHARDS, BITS, OVERHEAD = 40, 6, 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each grid cell (rows of ``cells``, values below 2**bits) on the Hilbert curve.

    The coordinates are turned into the curve's transposed index bit by bit, from the highest, by
    exchanges and inversions of the lower bits, then into Gray code; interleaved bits are the index.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            set_here = (x[d] & bit) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | x[d] >> level & 1
    return index


def log_cell(size: Column, bits: int) -> Column:
    """Cell of a size on a logarithmic scale, four cells to a doubling."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(0)) + 1) * 4), F.lit((1 << bits) - 1)).cast("int")


def name_cell(name: Column, bits: int) -> Column:
    """Cell of a category, by its hash."""
    return F.when(name.isNull(), 0).otherwise(F.pmod(F.xxhash64(name.cast("string")), F.lit(1 << bits))).cast("int")


def with_curve(df: DataFrame, cells: list[Column], bits: int = BITS) -> DataFrame:
    """``df`` with the curve index of ``cells`` as column ``__curve`` at the end."""

    @F.pandas_udf("long")
    def curve(grid: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(grid.fillna(0).to_numpy(), bits))

    named = [F.coalesce(c, F.lit(0)).alias(f"c{i}") for i, c in enumerate(cells)]
    return df.withColumn("__curve", curve(F.struct(*named)))


def shard_by_curve(rows: DataFrame, tie: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` (with ``__curve``, which goes) plus ``shard`` and ``slot``; shard sizes differ by one at most."""
    salted = rows.drop("shard", "slot").withColumn("__salt", F.xxhash64(*tie, F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange("__curve", "__salt").withColumn("__part", F.spark_partition_id())
    kept = materialise(ranged, "shards")
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, parts = sum(sizes.values()), sorted(sizes)
    before = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)]), strict=False))
    inner = ("__part", "__salt", "__curve", "__position", "__before")
    if not total:
        return kept.drop(*inner).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    offsets = rows.sparkSession.createDataFrame([(p, before[p]) for p in parts], "__part int, __before long")  # a row per range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__curve", "__salt")) - 1 + F.col("__before")
    shard = F.expr(f"CAST(((__position + 1) * {shards} - 1) div {total} AS INT)")
    first = F.expr(f"(shard * {total}L) div {shards}")
    placed = kept.join(F.broadcast(offsets), "__part").withColumn("__position", rank.cast("long")).withColumn("shard", shard)
    return placed.withColumn("slot", F.col("__position") - first).drop(*inner)


def write_shards(df: DataFrame, cells: list[Column], tie: list[str], path: str, shards: int = SHARDS) -> None:
    """Write ``df`` as one folder per shard, rows in curve order, for pruning by file statistics."""
    placed = shard_by_curve(with_curve(df, cells), tie, shards)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, ordered by source, language and length on the curve."""
    text = F.col("text").cast("string")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        "source",
        "lang",
    )
    cells = [name_cell(F.col("source"), BITS), name_cell(F.col("lang"), BITS), log_cell(F.col("size"), BITS)]
    rows = with_curve(documents, cells).drop("source", "lang")
    return shard_by_curve(rows, ["doc_id", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
