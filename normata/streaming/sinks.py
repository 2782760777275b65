"""Sinks of streams: tables that a micro-batch changes once, however often it comes.

Each sink is a function for ``foreachBatch``. It works out what a batch changes in the stored table and writes that
as one version (:mod:`normata.sources.versions`), tagged with the stream's name and the batch's number; a batch
that was written before, and comes again after a failure, finds its tag and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normata.sources.tables import count_hits, upsert_conversations
from normata.sources.versions import read_versions, write_version

#: A batch's change: new rows, and the keys whose old rows they replace (none: they are added).
Change = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def sink(path: str, schema: str, key: str, name: str, change: Change) -> Callable[[DataFrame, int], None]:
    """``change(stored, batch)`` of every batch, written to the table at ``path`` once."""

    def put(batch: DataFrame, number: int) -> None:
        stored = read_versions(batch.sparkSession, path, schema, key)
        rows, replaced = change(stored, batch)
        write_version(rows, path, key, replaced, f"{name}:{number}")

    return put


def conversations_sink(path: str, schema: str, name: str = "conversations") -> Callable[[DataFrame, int], None]:
    """Adds a batch's conversations whose (platform, chat_id) is not there yet, the earliest of each."""

    def change(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, None]:
        none = stored.limit(0)
        new = upsert_conversations(none, batch)
        return new.join(stored.select("platform", "chat_id"), ["platform", "chat_id"], "left_anti").select(stored.columns), None

    return sink(path, schema, "id", name, change)


def hits_sink(path: str, schema: str, name: str = "hits") -> Callable[[DataFrame, int], None]:
    """Adds a batch's hits (cache_id, at) to the counters of the cache entries that they met, and to no others."""

    def change(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = stored.join(batch.select(F.col("cache_id").alias("id")).distinct(), "id", "left_semi").select(stored.columns)
        return count_hits(met, batch), met.select("id")

    return sink(path, schema, "id", name, change)


def rows_sink(path: str, schema: str, key: str, name: str) -> Callable[[DataFrame, int], None]:
    """Puts a batch's rows in place of all rows of their keys; of one key, all rows of the batch stay."""
    return sink(path, schema, key, name, lambda stored, batch: (batch.select(stored.columns), batch.select(key)))
