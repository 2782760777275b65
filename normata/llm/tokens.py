"""Token ids as compressed binary files, and their reading.

Documents are dealt into ranges of doc_id and sorted, so the files hold them in ascending order. A task encodes
its range and writes segments: whole documents, some millions of ids, with a list of the documents and the ids in
independent blocks (see :mod:`normata.llm.mixing`). A segment is one binary value of a Parquet file beside
its range, its number and its counts; Parquet brings the commit of finished tasks and column pruning, so where
segments begin is known without reading any. Reading decodes each segment where it lies and checks every block.

Defined results: null and empty texts are the end id alone; rows of equal doc_id are written one after the other,
in the order of their texts' hashes, null ids first; a text of any length is one document in one segment, which
is then as large as the document; a segment or block that does not match its checksum is an error; an empty table
writes files without rows and reads as none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.llm.common import shared_folder, small
from normata.llm.encoding import encoder_for
from normata.llm.mixing import BLOCK, LANES, coded, decoded
from normata.llm.packing import END_ID, vocabulary_path

MAGIC = b"NTOK\x01\x00\x00\x00"
#: Ids that a segment has before it is closed: as many as fill the coder's lanes.
SEGMENT = LANES * BLOCK
#: Bytes of text that become ids at a time, and words that a worker knows.
PART, KNOWN = 12 << 20, 1_500_000
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
FILES = "part int, segment int, documents long, tokens long, data binary"


def segment(doc_ids: np.ndarray, null: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: magic, number of documents, checksum of their list, the list, the coded ids."""
    listed = np.zeros(len(doc_ids), DOCUMENT)
    listed["doc_id"], listed["null"], listed["tokens"] = doc_ids, null, tokens
    raw = listed.tobytes()
    return MAGIC + np.array([len(listed), zlib.crc32(raw)], "<u4").tobytes() + raw + coded(ids)


def parsed(data: bytes, where: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The documents' list and all ids of :func:`segment`."""
    if data[:8] != MAGIC:
        raise ValueError(f"not a segment of token ids{where}")
    n, crc = np.frombuffer(data, "<u4", 2, 8).tolist()
    end = 16 + n * DOCUMENT.itemsize
    if zlib.crc32(data[16:end]) != crc:
        raise ValueError(f"the list of documents{where} does not match its checksum")
    return np.frombuffer(data, DOCUMENT, n, 16), decoded(data[end:], where)


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, size: int = SEGMENT) -> None:
    """Write the ids of (doc_id, text), each document's ended by ``end_id``, in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(vocabulary, KNOWN), TaskContext.get().partitionId()
        rows: list[tuple] = []
        count = number = 0

        def closed() -> pa.RecordBatch:
            doc_ids, null, tokens, ids = map(np.concatenate, zip(*rows, strict=True))
            data = segment(doc_ids, null, tokens, ids)
            values = [[part], [number], [len(doc_ids)], [len(ids)], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "segment", "documents", "tokens", "data"])

        for batch in batches:
            at = 0
            for ids, bounds in encoder.arrays(batch.column(1), PART):
                own = batch.column(0).slice(at, len(bounds) - 1)
                at += len(own)
                doc_ids, null = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                ended, edges = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                begin = 0
                while begin < len(own):  # up to the document that fills the segment
                    stop = min(len(own), int(np.searchsorted(edges, edges[begin] + size - count)))
                    rows.append((doc_ids[begin:stop], null[begin:stop], np.diff(edges[begin : stop + 1]), ended[edges[begin] : edges[stop]]))
                    count += int(edges[stop] - edges[begin])
                    begin = stop
                    if count >= size:
                        yield closed()
                        rows, count, number = [], 0, number + 1
        if rows:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    own = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, FILES).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: its id, where its ids start, their number and the CRC-32 of their 32-bit bytes."""
    files = spark.read.schema(FILES).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                listed, ids = parsed(data.as_py(), f" in segment {number} of range {part}")
                ends = np.cumsum(listed["tokens"].astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = ends - listed["tokens"].astype(np.int64)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(listed)
                columns = [
                    pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(np.full(n, number.as_py(), np.int32)),
                    pa.array(listed["doc_id"].astype(np.int64), mask=listed["null"].astype(bool)),
                    pa.array(begins),
                    pa.array(listed["tokens"].astype(np.int64)),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    schema = "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long"
    found = files.select("part", "segment", "data").mapInArrow(decode, schema)
    back = (Window.unboundedPreceding, -1)
    sums = lambda by: F.coalesce(F.sum("tokens").over(by.rowsBetween(*back)), F.lit(0))
    ranges = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("part", sums(Window.orderBy("part")).alias("range_start"))  # a row for each range
    inner = files.select("part", "segment", sums(Window.partitionBy("part").orderBy("segment")).alias("inner"))
    starts = small(inner.join(ranges, "part").select("part", "segment", (F.col("inner") + F.col("range_start")).alias("first")))
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as files and read back from them."""
    path = f"{shared_folder(spark)}/token_ids-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_path())
    return read_tokens(spark, path)
