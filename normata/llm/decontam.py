"""Benchmark decontamination by latent semantic retrieval.

1. Texts are cut into passages of ``CELL`` words. One pass over all documents counts in how many
   passages each benchmark term occurs and sketches ``N'N W`` for the passage-by-term counts ``N`` and
   a random matrix ``W``; tasks send partial sums of fixed size, which Spark adds up by term.
   With idf weights ``D`` that is the sketch of ``C = D N'N D`` by the test matrix ``W / D``, and its
   Nystroem approximation gives the leading eigenvectors, that is the right singular vectors of the
   TF-IDF passages (randomised SVD in a single pass). The benchmark's own passages take part, weighted
   so that their directions are kept.
2. A second pass maps windows of two passages into that space. A window whose cosine with an item's part
   is ``COSINE`` or more makes the item a candidate; so does one that holds ``SHARED`` of the distinct
   telling terms of the part, since a space of ``RANK`` dimensions does not hold the terms
   of more than about as many items. Around the window, the
   longest common subsequence of words with the item and with its answer (the item's last words)
   decide: a copy keeps the order of most words (``COPIED``) and of its answer's (``ANSWERED``), a paraphrase
   near in the space that of half of them (``LOOSE``) and its answer nearly whole (``STRICT``). A text
   that says the same in other words altogether is not found.

Terms that no item holds add nothing to a cosine with an item and are left out; so are those in very
many items. The benchmark is broadcast in blocks of ``ITEMS`` items, each with a space of its own; up
to ``TOGETHER`` blocks share the two passes, so memory does not grow with the benchmark. Texts are read
in pieces of ``WINDOWS`` windows, so it does not grow with them either, but for a text's own words.

Defined results: null and empty texts match nothing, nor do items without words; items of fewer than
``SHORT`` words match as whole runs only; equal items match alike; repeated documents are each reported; an empty benchmark or table gives no rows; columns
other than doc_id, text and item_id are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.common import slices

CELL, ITEMS, TOGETHER, WINDOWS = 32, 1000, 8, 256
RANK, OVERSAMPLE = 96, 16
SHARED, COPIED, ANSWERED = 0.4, 0.65, 0.6
COSINE, LOOSE, STRICT = 0.55, 0.5, 0.85
#: Telling words that a window must hold to be mapped into the space.
MAPPED = 3
SHORT = 8
#: Telling words that a task gathers before it adds them to its sketch.
BUFFER = 20_000
STOP_SHARE, LEAST_TERMS, LONG_TERM_CHUNK = 0.05, 6, 256
PUNCTUATION = b".,;:!?\"'()[]"
MATCHES = "doc_id long, item_id long, start_word long, cosine double, lcs double, answer double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(None, PUNCTUATION).split()


@dataclass
class Items:
    """A block of the benchmark: words by number; the first ``terms`` numbers carry weight."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    terms: int

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        ids, texts = [], []
        for item_id, text in rows:
            if found := words_of(text):
                ids.append(item_id)
                texts.append(found)
        held = Counter(w for t in texts for w in set(t))
        most = max(3, STOP_SHARE * len(texts))
        telling = {w for w, n in held.items() if n <= most}
        for t in texts:  # an item of common words only keeps its rarest
            if len(telling.intersection(t)) < LEAST_TERMS:
                telling.update(sorted(set(t), key=lambda w: (held[w], w))[:LEAST_TERMS])
        order = sorted(telling) + sorted(held.keys() - telling)
        vocabulary = {w: i for i, w in enumerate(order)}
        return Items(ids, [np.array([vocabulary[w] for w in t]) for t in texts], vocabulary, len(telling))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A text's words as vocabulary numbers, -1 for others."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))


def test_matrix(terms: int, width: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((terms, width)).astype(np.float32)


class Sketch:
    """Sums over passages: ``df`` (passages with a term) and ``y`` (``N'N W``)."""

    def __init__(self, terms: int, width: int):
        self.w = test_matrix(terms, width)
        self.df, self.y, self.n = np.zeros(terms, np.int64), np.zeros((terms, width)), 0

    def add(self, numbers: np.ndarray, cells: np.ndarray, passages: int, weight: float = 1.0) -> None:
        """``numbers``: terms of the tokens; ``cells``: their passages, ascending, numbered from 0."""
        self.n += passages
        if not len(numbers):
            return
        pair, count = np.unique(cells.astype(np.int64) * len(self.df) + numbers, return_counts=True)
        cell, term = np.divmod(pair, len(self.df))
        self.df += np.bincount(term, minlength=len(self.df))
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        z = np.add.reduceat(self.w[term] * count[:, None].astype(np.float32), begin, axis=0)
        which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(cell))))
        by = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.append(True, term[by][1:] != term[by][:-1]))
        parts = z[which[by]] * (weight * count[by, None]).astype(np.float32)
        self.y[term[by][first]] += np.add.reduceat(parts, first, axis=0)


class Buffered:
    """A sketch of one block's terms that takes whole texts and adds them in small buffers."""

    def __init__(self, items: Items, width: int):
        self.items, self.sketch = items, Sketch(items.terms, width)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.cells, self.passages, self.held = [], [], 0, 0

    def add(self, words: list[bytes]) -> None:
        found = self.items.numbers(words)
        at = np.flatnonzero((found >= 0) & (found < self.items.terms))
        self.numbers.append(found[at])
        self.cells.append(at // CELL + self.passages)
        self.passages += -(-len(found) // CELL)
        self.held += len(at)
        if self.held > BUFFER:
            self.flush()

    def flush(self) -> Sketch:
        if self.numbers:
            self.sketch.add(np.concatenate(self.numbers), np.concatenate(self.cells), self.passages)
        self.clear()
        return self.sketch


def sketch_corpus(documents: DataFrame, blocks: list[Items], width: int) -> list[Sketch]:
    """The sketches of all documents' passages, one a block, added up by ranges of terms; one pass for all."""
    names = ["block", "chunk", "n", "df", "y"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [Buffered(items, width) for items in blocks]
        for texts in slices(batches):
            for text in texts.column(0).to_pylist():
                words = words_of(text)
                for one in open_:
                    one.add(words)
        for number, one in enumerate(open_):
            sketch = one.flush()
            for i, at in enumerate(range(0, len(sketch.df), LONG_TERM_CHUNK)):
                df, y = sketch.df[at : at + LONG_TERM_CHUNK], sketch.y[at : at + LONG_TERM_CHUNK]
                if sketch.n:
                    yield batch([(number, i, sketch.n, df.tobytes(), y.tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for part in batches:
            for number, chunk, n, df, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held = sums.setdefault((number, chunk), [0, 0, 0])
                sums[number, chunk] = [held[0] + n, held[1] + np.frombuffer(df, np.int64), held[2] + np.frombuffer(y)]
        for (number, chunk), (n, df, y) in sums.items():
            yield batch([(number, chunk, n, df.tobytes(), y.tobytes())])

    schema = "block int, chunk int, n long, df binary, y binary"
    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    chunks = sum(-(-items.terms // LONG_TERM_CHUNK) for items in blocks)
    totals = [Sketch(items.terms, width) for items in blocks]
    for row in parts.repartition(max(1, min(chunks, 64)), "block", "chunk").mapInArrow(add, schema).toLocalIterator():
        at, total = slice(row.chunk * LONG_TERM_CHUNK, (row.chunk + 1) * LONG_TERM_CHUNK), totals[row.block]
        total.df[at] = np.frombuffer(row.df, np.int64)
        total.y[at] = np.frombuffer(row.y).reshape(-1, width)
        total.n = row.n
    return totals


def latent_terms(sketch: Sketch, items: Items, rank: int) -> np.ndarray:
    """Each term's latent vector: idf times its row of the leading right singular vectors."""
    weight = max(1.0, sketch.n / max(1, len(items.ids)))
    own = Sketch(items.terms, sketch.w.shape[1])
    for words in items.words:
        at = np.flatnonzero(words < items.terms)
        own.add(words[at], at // CELL, -(-len(words) // CELL), weight)
    passages = sketch.n + own.n
    idf = np.log((1 + passages) / (1 + sketch.df + own.df)) + 0.1
    x = sketch.w.astype(np.float64) / idf[:, None]
    y = (sketch.y + own.y) * idf[:, None]
    shift = 1e-9 * np.linalg.norm(y)
    y = y + shift * x
    core = x.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value.max() * 1e-10
    half = y @ (vector[:, keep] / np.sqrt(value[keep]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return (left[:, :rank] * idf[:, None]).astype(np.float32)


def windows_in(numbers: np.ndarray, terms: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, term) of the telling words in windows ``begin`` to ``end`` of two neighbouring passages, with repeats."""
    part = numbers[begin * CELL : (end + 1) * CELL]
    at = np.flatnonzero((part >= 0) & (part < terms))
    cell, term = at // CELL + begin, part[at]
    window, term = np.concatenate([cell, cell - 1]), np.concatenate([term, term])
    inside = (window >= begin) & (window < end)
    return window[inside] - begin, term[inside]


def window_count(numbers: np.ndarray) -> int:
    return max(1, -(-len(numbers) // CELL) - 1)


def sums_by(group: np.ndarray, rows: np.ndarray, groups: int, dtype) -> np.ndarray:
    """Sums of ``rows`` by ``group``, which ascends."""
    sums = np.zeros((groups, rows.shape[1]), dtype)
    if len(group):
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sums[group[begin]] = np.add.reduceat(rows, begin, axis=0, dtype=dtype)
    return sums


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 1e-6)


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, 64 or more item words at a time in one integer."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


class Matcher:
    """Candidate search and checks for one block of items, in a task."""

    def __init__(self, items: Items, latent: np.ndarray):
        self.items, self.latent = items, latent
        vectors, self.owner, self.offset = [], [], []
        for i, words in enumerate(items.words):
            n = window_count(words)
            window, term = windows_in(words, items.terms, 0, n)
            by = np.argsort(window, kind="stable")
            vectors.append(sums_by(window[by], latent[term[by]], n, latent.dtype))
            self.owner += [i] * n
            self.offset += [CELL * k for k in range(n)]
        # Which terms each part of an item holds; a window holds 64 of them at most.
        self.has = np.zeros((items.terms, len(self.owner)), np.uint8)
        for q, (i, at) in enumerate(zip(self.owner, self.offset, strict=True)):
            part = items.words[i][at : at + 2 * CELL]
            self.has[part[part < items.terms], q] = 1
        self.need = np.maximum(1, np.ceil(SHARED * self.has.sum(axis=0, dtype=np.int64)))
        self.queries = unit(np.concatenate(vectors)) if vectors else np.zeros((0, latent.shape[1]), np.float32)
        self.masks = [self.positions(w) for w in items.words]
        self.tails = [w[-max(3, len(w) // 4) :] for w in items.words]
        self.tail_masks = [self.positions(w) for w in self.tails]

    @staticmethod
    def positions(words: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def check(self, numbers: np.ndarray, item: int, begin: int, end: int) -> tuple[float, float]:
        """Shares of the item's and of its answer's words that the region keeps in order."""
        n = len(self.items.words[item])
        region = numbers[max(0, begin) : end]
        if n < SHORT:  # too few words for a subsequence to tell: they must stand together
            want = self.items.words[item]
            runs = np.lib.stride_tricks.sliding_window_view(region, n) if len(region) >= n else np.zeros((0, n))
            return (1.0, 1.0) if (runs == want).all(axis=1).any() else (0.0, 0.0)
        region = region[region >= 0]
        if len(region) < LOOSE * n:
            return 0.0, 0.0
        region = region.tolist()
        whole = common_subsequence(self.masks[item], n, region) / n
        if whole < LOOSE:
            return whole, 0.0
        tail = self.tails[item]
        return whole, common_subsequence(self.tail_masks[item], len(tail), region) / len(tail)

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, part, cosine) where the window is near the part or holds enough of its distinct terms."""
        for begin in range(0, window_count(numbers), WINDOWS):
            end = min(begin + WINDOWS, window_count(numbers))
            window, term = windows_in(numbers, self.items.terms, begin, end)
            if not len(window):
                continue
            pair, count = np.unique(window.astype(np.int64) * self.items.terms + term, return_counts=True)
            window, term = np.divmod(pair, self.items.terms)
            shared = sums_by(window, self.has[term], end - begin, np.uint8) >= self.need
            full = np.flatnonzero(np.bincount(window, minlength=end - begin) >= MAPPED)
            cosine = np.zeros(shared.shape, np.float32)
            if len(full):
                own = np.isin(window, full)
                vectors = sums_by(window[own], self.latent[term[own]] * count[own, None].astype(np.float32), end - begin, np.float32)
                cosine[full] = unit(vectors[full]) @ self.queries.T
            for w, q in zip(*np.nonzero(shared | (cosine >= COSINE)), strict=True):
                yield begin + int(w), int(q), float(cosine[w, q])

    def match(self, words: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
        """(item, first word, cosine, lcs, answer) of each item that a text of these words holds."""
        numbers = self.items.numbers(words)
        best: dict[int, tuple] = {}
        for window, part, cosine in self.candidates(numbers):
            item = self.owner[part]
            held = best.get(item)
            if held and held[2] >= 1:
                continue
            first = window * CELL - self.offset[part]
            n = len(self.items.words[item])
            lcs, answer = self.check(numbers, item, first - CELL, first + max(n, 2 * CELL) + CELL)
            copied = lcs >= COPIED and answer >= ANSWERED
            reworded = cosine >= COSINE and lcs >= LOOSE and answer >= STRICT
            if (copied or reworded) and (held is None or lcs > held[2]):
                best[item] = (max(0, first), cosine, lcs, answer)
        for item, found in best.items():
            yield self.items.ids[item], *found


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's distinct rows in blocks of about ``ITEMS`` items, by a hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    parts = -(-rows.count() // ITEMS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts)))
    for i in range(parts):
        yield Items.of([tuple(r) for r in rows.where(part == i).orderBy("item_id", "text").collect()])


def find_matches(documents: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, start_word, cosine, lcs, answer): documents that hold benchmark items."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "start_word": pa.int64()} | dict.fromkeys(("cosine", "lcs", "answer"), pa.float64())
    found = spark.createDataFrame([], MATCHES)
    for together in batched((b for b in blocks(benchmark) if b.ids), TOGETHER):
        sketches = sketch_corpus(docs, together, rank + OVERSAMPLE)
        shared = spark.sparkContext.broadcast([(b, latent_terms(s, b, rank)) for b, s in zip(together, sketches, strict=True)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(*one) for one in shared.value]
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    rows += [(doc_id, *hit) for m in matchers for hit in m.match(words)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])

        found = found.unionByName(docs.mapInArrow(run, MATCHES))
    return found


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, whole or paraphrased."""
    return find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
