"""Runs of words: stretches that repeat themselves with a period, found through longest previous factors.

The words of several texts are sorted together as suffixes, by prefix doubling; a word counts as another in another
text, so texts don't mix. From the suffix array and its LCP array comes the longest previous factor of each
place, and from that each text's blocks (Lempel and Ziv): a block is the longest piece that began before, or a new
word. A run that touches the edge of a block is found there, by extending equal words from the edge
both ways for every period that fits (Main); a run inside a block is a copy of one in the piece's earlier
place, and is taken over from the bucket of its start there (Kolpakov and Kucherov).

A run of ``least`` words that has its period ``ratio`` times holds a place whose previous factor has at least
``least * (ratio - 1) / ratio`` words. Texts without such a place, most of them, hold no run and are left
after a few rounds of sorting.

Defined results: words are separated by ASCII white space; null and empty texts, and those of white space, have no
words and no runs, and collapse to the empty text; equal texts have equal runs; a text of any length is
read whole, in memory of some hundred bytes for each of its words; an empty table gives no rows; columns other than
the id and the text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.encoding import parts, split_words

LEAST, RATIO = 24, 3
#: Bytes of text that are sorted together (one text at least).
TOGETHER = 4 << 20
SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def sort_suffixes(keys: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array of ``keys``, the ranks of all pieces of 1, 2, 4, ... keys, and the places still tied at the end.

    Only tied places are sorted again. The rounds end when none is left or pieces would exceed ``longest``.
    """
    n = len(keys)
    order = np.argsort(keys)
    new = np.ones(n, bool)
    new[1:] = np.diff(keys[order]) != 0
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), -1
    ranks, step = [rank], 1
    while True:
        group = rank[order]
        alone = np.ones(n + 1, bool)
        alone[1:n] = group[1:] != group[:-1]
        tied = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(tied) or (longest and 2 * step > longest):
            return order, ranks, order[tied]
        places = order[tied]
        key = group[tied] * (n + 1) + rank[np.minimum(places + step, n)] + 1
        by = np.argsort(key)
        places, key = places[by], key[by]
        first = np.ones(len(key), bool)
        first[1:] = np.diff(key) != 0
        rank = rank.copy()
        rank[places] = tied[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        order[tied] = places
        ranks.append(rank)
        step *= 2


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many keys agree from the places ``a`` and ``b`` on, forward or backward."""
    a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    last = len(ranks[0]) - 1
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << level, ranks[level]
        if back:
            at, to = a - width + 1, b - width + 1
            same = (at >= 0) & (to >= 0) & (rank[np.maximum(at, 0)] == rank[np.maximum(to, 0)])
        else:
            same = (a < last) & (b < last) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        moved = np.where(same, width, 0)
        found += moved
        a, b = (a - moved, b - moved) if back else (a + moved, b + moved)
    return found


def previous_factors(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The longest previous factor of each place, and where it began before (-1: nowhere).

    Places leave the list of suffixes from the last to the first, so the neighbours that remain began before; LCPs
    of neighbours that come to meet are the lesser of the two.
    """
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = common(ranks, order[:-1], order[1:])
    lcp, place = lcp.tolist(), order.tolist()
    above, below = list(range(-1, n - 1)), list(range(1, n + 1))
    length, source = [0] * n, [-1] * n
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    slot = slot.tolist()
    for at in range(n - 1, -1, -1):
        r = slot[at]
        up, down = above[r], below[r]
        a, b = lcp[r], lcp[down]
        if a >= b:
            length[at] = a
            if a:
                source[at] = place[up]
            lcp[down] = b
        else:
            length[at], source[at] = b, place[down]
            lcp[down] = a
        if up >= 0:
            below[up] = down
        if down < n:
            above[down] = up
    return length, source


def blocks_of(length: list[int], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of all texts, and the first place after each."""
    starts: list[int] = []
    for at, end in zip(bounds, bounds[1:], strict=False):
        while at < end:
            starts.append(at)
            at += length[at] or 1
    found = np.array(starts, np.int64)
    return found, np.append(found[1:], bounds[-1])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, 1 .. counts[i]) for all i, as two arrays."""
    ends = np.cumsum(counts)
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(1, len(which) + 1) - (ends - counts)[which]


def edge_runs(ranks: list[np.ndarray], edges: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, ratio: int) -> np.ndarray:
    """(start, length, period) of the runs that touch ``edges``, between blocks of ``left`` and ``right`` words.

    A whole period lies before the edge or behind it. Before it, a period is shorter than both
    blocks together, or else the block on the left would have been longer.
    """
    rank, found = ranks[0], []
    for counts, ahead in ((right, True), (left + right, False)):
        which, period = spread(counts)
        a = edges[which] if ahead else edges[which] - period
        b = a + period
        fits = (a >= 0) & (b < len(rank))
        a, b, period = a[fits], b[fits], period[fits]
        near = rank[a] == rank[b]
        near |= (a > 0) & (rank[np.maximum(a - 1, 0)] == rank[b - 1])
        a, b, period = a[near], b[near], period[near]
        forward, backward = common(ranks, a, b), common(ranks, a - 1, b - 1, back=True)
        size = period + forward + backward
        kept = size >= np.maximum(least, ratio * period)
        found.append(np.stack([a - backward, size, period], axis=1)[kept])
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (np.diff(out[:, :2], axis=0) != 0).any(axis=1)  # of equal stretches the smallest period counts
    return out[first]


def runs_of(keys: np.ndarray, bounds: np.ndarray, least: int = LEAST, ratio: int = RATIO) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; text t has the places bounds[t] to bounds[t + 1]."""
    if not len(keys):
        return np.zeros((0, 3), np.int64)
    order, ranks, _ = sort_suffixes(keys)
    length, source = previous_factors(order, ranks)
    starts, ends = blocks_of(length, bounds.tolist())
    inner = ~np.isin(starts, bounds)  # edges have a block of the same text on their left
    sizes = ends - starts
    left = np.where(inner, np.append(0, sizes[:-1]), 0)
    edges = np.concatenate([starts, bounds[1:]])
    last = sizes[np.searchsorted(starts, bounds[1:]) - 1]
    found = edge_runs(ranks, edges, np.concatenate([left, last]), np.concatenate([sizes, np.zeros_like(last)]), least, ratio)
    if not len(found):
        return found
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, size, period in found.tolist():
        buckets.setdefault(start, []).append((size, period))
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        back = start - source[start]
        if end - start < least + 2 or source[start] < 0:
            continue
        for at in range(start + 1, end - least):
            for size, period in buckets.get(at - back, ()):
                if at + size < end:
                    buckets.setdefault(at, []).append((size, period))
    out = np.array([(start, size, period) for start, many in buckets.items() for size, period in many], np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_in_texts(texts: pa.Array, least: int = LEAST, ratio: int = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, their texts, words of each text); runs begin at the words of their own text."""
    _, codes, bounds = split_words(texts)
    sizes = np.diff(bounds)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    keys = text_of * (int(codes.max(initial=0)) + 1) + codes
    need = max(1, -(-least * (ratio - 1) // ratio))
    open_texts = np.zeros(len(texts), bool)
    if len(keys):
        open_texts[text_of[sort_suffixes(keys, need)[2]]] = True
    which = np.flatnonzero(open_texts)
    begins = np.append(0, np.cumsum(sizes[which]))
    found = runs_of(keys[open_texts[text_of]], begins, least, ratio)
    of = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[of]
    return found, which[of], sizes


def collapse(text: str, runs: np.ndarray) -> str:
    """The words of ``text`` without what runs repeat, joined by spaces."""
    words = text.encode("utf-8", "surrogatepass").split()
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(drop).tolist()
    return b" ".join(w for w, d in zip(words, gone, strict=False) if not d).decode("utf-8", "replace")


def find_runs(documents: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """For each (doc_id, text): its number of words, its runs in order, and the text with each run cut to one period."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in parts(batch.column(1), TOGETHER):
                texts = pc.fill_null(texts, "")
                found, of, sizes = runs_in_texts(texts, least, ratio)
                edges = np.searchsorted(of, np.arange(len(texts) + 1))
                collapsed = [
                    collapse(text, found[a:b]) if b > a else b" ".join(text.encode("utf-8", "surrogatepass").split()).decode("utf-8", "replace")
                    for text, a, b in zip(texts.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                ]
                fields = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)]
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(emit, SCHEMA)


def with_tails(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids its words with a tail that repeats one piece over and over."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10).cast("long")
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    piece = F.slice(words, start + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(piece, F.ceil((n - start) / period).cast("int"))), F.lit(1), n - start)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), start), tail), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a repetitive tail: their runs, the strongest of them, and digests."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = find_runs(documents.select("doc_id", with_tails(F.col("text"), F.col("doc_id")).alias("text")))
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
