"""Tables that are replaced or appended to key by key, all or nothing.

Every write makes a version. Its tasks write new files beside the old ones; when all are done, the commit adds one
manifest, ``versions/<number>.json``, that names them: before it the table is as it was, after it all of the
version is there. A version that replaces keys lists them in files of their own, so a key without new rows loses
its old ones too. Nothing is rewritten: a reader takes the files of all manifests and leaves out the rows of
versions before the last that replaced their key. :func:`compact` writes what is visible as one version.

The path must be one that the tasks and the driver share; it is opened through Arrow's file systems. Of two
writers that meet, the later commit fails and leaves no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "versioned"
#: Column that tells rows from the keys that a version replaces.
MARK = "__replaces"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path with or without scheme, and the path in it."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(path)


def manifests(path: str) -> list[dict]:
    """All manifests of a table, oldest first; none if nothing was written yet."""
    files, at = opened(path)
    listed = files.get_file_info(fs.FileSelector(f"{at}/versions", allow_not_found=True))
    found = []
    for info in sorted((i for i in listed if i.path.endswith(".json")), key=lambda i: i.path):
        with files.open_input_stream(info.path) as stream:
            found.append(json.loads(stream.read()))
    return found


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: paths under the table, and rows."""

    files: list[str]
    replaced: list[str]
    rows: int


class VersionWriter(DataSourceArrowWriter):
    """Writes the rows of each task to files of the new version; the commit names them in its manifest."""

    def __init__(self, path: str, key: str, version: int, tag: str | None = None):
        self.path, self.key, self.version, self.tag = path, key, version, tag

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        name = f"{self.version:09d}-{uuid.uuid4().hex}"
        made: dict[str, pq.ParquetWriter] = {}
        rows = 0

        def put(folder: str, batch: pa.RecordBatch) -> None:
            if len(batch):
                place = f"{folder}/{name}.parquet"
                if place not in made:
                    files.create_dir(f"{at}/{folder}", recursive=True)
                    made[place] = pq.ParquetWriter(f"{at}/{place}", batch.schema, filesystem=files)
                made[place].write_batch(batch)

        try:
            for batch in iterator:
                mark = batch.column(batch.schema.get_field_index(MARK))
                data = batch.filter(pc.invert(mark)).drop_columns([MARK])
                put("data", data)
                put("replaced", batch.filter(mark).select([self.key]))
                rows += len(data)
            for writer in made.values():
                writer.close()
        except BaseException:  # a task that fails or is stopped leaves no file behind
            self.remove(list(made))
            raise
        return Written([p for p in made if p.startswith("data/")], [p for p in made if p.startswith("replaced/")], rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        manifest = {
            "version": self.version,
            "files": sorted(f for m in done for f in m.files),
            "replaced": sorted(f for m in done for f in m.replaced),
            "rows": sum(m.rows for m in done),
            "tag": self.tag,
        }
        files, at = opened(self.path)
        place = f"{at}/versions/{self.version:09d}.json"
        files.create_dir(f"{at}/versions", recursive=True)
        raw = json.dumps(manifest).encode()
        if isinstance(files, fs.LocalFileSystem):
            with open(place, "xb") as stream:  # fails if another writer was first
                stream.write(raw)
            return
        if files.get_file_info(place).type != fs.FileType.NotFound:
            raise FileExistsError(place)
        with files.open_output_stream(place) as stream:
            stream.write(raw)

    def abort(self, messages: list[Written | None]) -> None:
        self.remove([f for m in messages if m for f in (*m.files, *m.replaced)])

    def remove(self, places: list[str]) -> None:
        files, at = opened(self.path)
        for place in places:
            if files.get_file_info(f"{at}/{place}").type != fs.FileType.NotFound:
                files.delete_file(f"{at}/{place}")


class VersionedTable(DataSource):
    """``df.write.format("versioned")`` with options ``path`` and ``key``; rows marked by :data:`MARK` are replaced keys."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        path, key = self.options["path"], self.options["key"]
        known = manifests(path)
        return VersionWriter(path, key, known[-1]["version"] + 1 if known else 1, self.options.get("tag"))


def write_version(rows: DataFrame, path: str, key: str, replaced: DataFrame | None = None, tag: str | None = None) -> dict:
    """Append ``rows``, or with ``replaced`` (a column ``key``) put them in place of all rows of these keys. Its manifest.

    Defined results: no rows and no keys make a version without files; a null key is a key like others; a key
    that is replaced and has no row is gone; a key that has rows and is not in ``replaced`` keeps its old ones.
    With a ``tag`` that a version already has, nothing is written: a batch that comes again changes nothing.
    """
    spark = rows.sparkSession
    if tag is not None:
        for known in manifests(path):
            if known.get("tag") == tag:
                return known
    spark.dataSource.register(VersionedTable)
    marked = rows.withColumn(MARK, F.lit(False))
    if replaced is not None:
        marked = marked.unionByName(replaced.select(F.col(key)).distinct().withColumn(MARK, F.lit(True)), allowMissingColumns=True)
    writer = marked.write.format(FORMAT).option("path", path).option("key", key)
    (writer if tag is None else writer.option("tag", tag)).mode("append").save()
    return manifests(path)[-1]


def read_versions(spark: SparkSession, path: str, schema: str, key: str, version: int | None = None) -> DataFrame:
    """What the table holds, now or as of ``version``; no rows if nothing was written yet."""
    listed = [m for m in manifests(path) if version is None or m["version"] <= version]
    under = lambda kind: [f"{path}/{f}" for m in listed for f in m[kind]]
    kind = StructType.fromDDL(schema)
    if not under("files"):
        return spark.createDataFrame([], kind)
    at = F.substring_index(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "-", 1).cast("int")
    rows = spark.read.schema(kind).parquet(*under("files"))
    if not under("replaced"):
        return rows
    keys = spark.read.schema(StructType([kind[key]])).parquet(*under("replaced"))
    last = keys.select(F.col(key).alias("__key"), at.alias("__version")).groupBy("__key").agg(F.max("__version").alias("__last"))
    versioned = rows.withColumn("__version", at)
    joined = versioned.join(last, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.where(F.col("__last").isNull() | (F.col("__version") >= F.col("__last"))).select(rows.columns)


def compact(spark: SparkSession, path: str, schema: str, key: str) -> dict:
    """Write what is visible as one version that replaces all keys; readers of earlier versions are not disturbed."""
    rows = read_versions(spark, path, schema, key)
    held = [f"{path}/{f}" for m in manifests(path) for f in m["files"]]
    if not held:
        return write_version(rows, path, key)
    every = spark.read.schema(StructType([StructType.fromDDL(schema)[key]])).parquet(*held)
    return write_version(rows, path, key, every)
