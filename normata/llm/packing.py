"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each partition is one stream of documents. A document's ids are cut into full windows and a
remainder; the remainder goes to the fill level that minimises the sum over levels of the squared
number of partially filled windows at that level (a level array holds the counts). When too many
windows are open, and at the end of the stream, the fullest is filled from the emptiest, piece by piece,
which leaves all others as they are. So only the very last sequence of a partition may fall short; it is
cut into powers of two, which need no padding.

Defined results: null text counts as empty and is the end id alone; an empty table gives no rows;
repeated rows are packed once each; columns other than doc_id and text are ignored; a document of
any length is cut into as many windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.encoding import WordEncoder, encoder_for

__all__ = ["WordEncoder", "op6_packing", "pack", "pack_documents"]

WINDOW = 4096
END_ID = 2
#: Open windows of one stream; beyond it the emptiest goes, which bounds memory at 64 MB of ids.
MAX_OPEN = 4096
VOCABULARY = "word_bpe_49k.json"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
)


class SumOfSquares:
    """Windows of ``size`` tokens, filled online; pieces are (document, start, ids as bytes)."""

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open, self.open, self.sequences = size, max_open, 0, 0
        self.count = np.zeros(size, np.int64)
        self.levels: dict[int, list[list]] = {}

    def level_for(self, n: int) -> int:
        """The level, 0 for a new window, at which a piece of ``n`` adds least to the sum of squares."""
        count, reach = self.count, self.size - n
        gain = np.full(reach + 1, np.iinfo(np.int64).max)
        can = np.flatnonzero(count[1 : reach + 1]) + 1
        after = np.append(count, 0)[can + n]  # a full window counts no more
        gain[can] = -2 * count[can] + 1 + np.where(can + n == self.size, 0, 2 * after + 1)
        gain[0] = 0 if n == self.size else 2 * count[n] + 1
        return int(gain.argmin())

    def add(self, piece: tuple) -> Iterator[list]:
        n = len(piece[2]) // 4
        if n == self.size:
            yield [piece]
            return
        level = self.level_for(n)
        window = self.take(level) if level else []
        window.append(piece)
        if level + n == self.size:
            yield window
            return
        self.put(level + n, window)
        yield from self.merge(self.max_open)

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def put(self, level: int, window: list) -> None:
        self.levels.setdefault(level, []).append(window)
        self.count[level] += 1
        self.open += 1

    def merge(self, most: int) -> Iterator[list]:
        """Fill the fullest window from the emptiest one until ``most`` are open."""
        while self.open > most:
            levels = np.flatnonzero(self.count)
            low, high = int(levels[0]), int(levels[-1])
            window, rest = self.take(high), self.take(low)
            room = self.size - high
            left = []
            for key, start, ids in rest:
                n = min(room, len(ids) // 4)
                if n:
                    window.append((key, start, ids[: 4 * n]))
                    room -= n
                if 4 * n < len(ids):
                    left.append((key, start + n, ids[4 * n :]))
            if room:
                self.put(self.size - room, window)
            else:
                yield window
            if left:
                self.put(sum(len(p[2]) for p in left) // 4, left)

    def close(self) -> Iterator[list]:
        """Fill what can be filled; the rest, one window, is cut at powers of two."""
        yield from self.merge(1)
        left = [p for windows in self.levels.values() for window in windows for p in window]
        total = sum(len(p[2]) // 4 for p in left)
        room, window = 0, []
        for key, start, ids in left:
            while ids:
                room = room or 1 << (total.bit_length() - 1)
                n = min(room, len(ids) // 4)
                window.append((key, start, ids[: 4 * n]))
                start, ids, room, total = start + n, ids[4 * n :], room - n, total - n
                if not room:
                    yield window
                    window = []


def pack(documents: Iterable[tuple[int | None, bytes]], size: int = WINDOW, max_open: int = MAX_OPEN) -> Iterator[list[tuple]]:
    """Windows of (doc_id, start, ids, doc_tokens) over a stream of (doc_id, ids as bytes)."""
    packer = SumOfSquares(size, max_open)
    for doc_id, ids in documents:
        key = (doc_id, len(ids) // 4)
        for at in range(0, len(ids), 4 * size):
            yield from packer.add((key, at // 4, ids[at : at + 4 * size]))
    yield from packer.close()


def pack_documents(documents: DataFrame, vocabulary: str, size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    No shuffle: each input split is packed where it is read, and its sequences carry the number
    of the split in their upper bits.
    """
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        stream = (
            (doc_id, ids + end)
            for batch in batches
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True)
        )
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for sequence, window in enumerate(pack(stream, size)):
            offset, whole = 0, sum(len(ids) for _, _, ids in window) // 4
            for (doc_id, tokens), start, ids in window:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), tokens, base + sequence, offset, whole))
                offset += n
            if len(rows) >= 20_000:
                yield to_batch(rows)
                rows = []
        if rows:
            yield to_batch(rows)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
