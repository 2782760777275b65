"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences that is long enough is hashed (128 bits): from each
sentence, and back from each, the shortest run of at least ``LEAST`` sentences with ``WORDS`` words.
Short sentences make runs of more of them, at most one a word. A sentence of more than ``LONG`` words
is read as its clauses, and a clause of more than that in pieces of so many words, so that a passage
inside long sentences has several of its own; all of these are called sentences here. Runs join
globally by hash. A sentence goes if a run that covers it has occurred before: in a document with a
smaller doc_id, or earlier in its own.

Only runs met in several documents, with the first of those, leave the aggregation, which combines
before its shuffle; the join back to a hot run's documents is one that Spark can split.

Defined results: null and empty texts have no sentences and stay as they are; documents without
doc_id come after all others, in the order of a hash of their text; rows that share a doc_id are
versions of one document and do not repeat each other; a document that loses every sentence keeps an
empty text; an empty table gives no rows; other columns pass through; columns named ``n_sentences``
or ``n_removed`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normata.llm.common import materialise, slices

#: Least sentences and words of a run; words beyond which a sentence is parted.
LEAST, WORDS, LONG = 2, 25, 20
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r\n\f]*|[^.!?\n]+\Z")
CLAUSE = re.compile(r"[^,;:]*[,;:]+[ \t\r\n\f]*|[^,;:]+\Z")
PIECE = re.compile(rf"\s*\S+(?:\s+\S+){{0,{LONG - 1}}}\s*")
SPACE = " \t\r\n\f"


def sentences(text: str | None) -> list[str]:
    """Pieces of a text that end after a sentence's stop or line, long ones parted; together they are the text."""
    out = []
    for sentence in SENTENCE.findall(text or ""):
        if len(sentence) <= 2 * LONG or len(sentence.split()) <= LONG:
            out.append(sentence)
            continue
        for clause in CLAUSE.findall(sentence):
            out += [clause] if len(clause.split()) <= LONG else PIECE.findall(clause)
    return out


def runs_in(lens: np.ndarray, least: int = LEAST, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) of each run, from the sentences' numbers of words; those without words count for none."""
    at = np.flatnonzero(lens)
    sums = np.concatenate([[0], np.cumsum(lens[at])])
    m = len(at)
    begin, last = np.arange(m), np.arange(1, m + 1)
    end = np.maximum(np.searchsorted(sums, sums[:-1] + words), begin + least)
    back = np.minimum(np.searchsorted(sums, sums[1:] - words, side="right") - 1, last - least)
    pairs = np.concatenate([np.stack([begin, end], 1)[end <= m], np.stack([back, last], 1)[back >= 0]])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def run_hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run's first sentence, end (exclusive) and hash (n x 2, signed 64 bits)."""
    words = [p.lower().split() for p in pieces]
    lens = np.array([*map(len, words)], np.int64)
    begin, end = runs_in(lens)
    if not len(begin):
        return begin, end, np.zeros((0, 2), np.int64)
    at = np.flatnonzero(lens)
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(words[i]).encode("utf-8", "replace")) for i in at)
    own = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    n = end - begin
    h = np.repeat(n.astype(np.uint64)[:, None], 2, axis=1)
    for j in range(int(n.max())):
        more = np.flatnonzero(n > j)
        x = (h[more] ^ own[begin[more] + j]) * np.uint64(0x9E3779B97F4A7C15)
        h[more] = x ^ (x >> np.uint64(31))
    return at[begin], at[end - 1] + 1, h.view(np.int64)


def order_of(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__ord``: the doc_id, or for rows without one a number beyond all ids."""
    spare = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return documents.withColumn("__ord", F.coalesce(F.col("doc_id").cast("long"), spare))


def runs_of(documents: DataFrame) -> DataFrame:
    """(h1, h2, ord): the distinct runs of each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, owners = [], []
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, found = run_hashes(sentences(text))
                if len(found):
                    own = np.unique(found, axis=0)
                    hashes.append(own)
                    owners.append(np.full(len(own), order, np.int64))
            if hashes:
                both, who = np.concatenate(hashes), np.concatenate(owners)
                arrays = [pa.array(np.ascontiguousarray(x)) for x in (both[:, 0], both[:, 1], who)]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "ord"])

    texts = order_of(documents).select("__ord", F.col("text").cast("string"))
    return texts.mapInArrow(emit, "h1 long, h2 long, ord long")


def covered(pieces: list[str], taken: set[tuple[int, int]]) -> np.ndarray:
    """Which sentences a taken run covers, or a run that occurred earlier in the same text."""
    gone = np.zeros(len(pieces), bool)
    begin, end, hashes = run_hashes(pieces)
    seen: set[tuple[int, int]] = set()
    for a, b, key in zip(begin.tolist(), end.tolist(), map(tuple, hashes.tolist()), strict=True):
        if key in taken or key in seen:
            gone[a:b] = True
        seen.add(key)
    return gone


def drop_repeated_spans(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated sentences cut from ``text``, plus ``n_sentences`` and ``n_removed``."""
    documents = documents.drop("n_sentences", "n_removed")
    spans = materialise(runs_of(documents), "spans")
    repeated = (
        spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1").drop("n")
    )
    taken = (
        spans.join(repeated, ["h1", "h2"])
        .where("ord <> first")
        .groupBy(F.col("ord").alias("__ord"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__taken"))
    )
    joined = order_of(documents).join(taken, "__ord", "left").drop("__ord")
    columns = documents.columns
    at = columns.index("text")
    extra = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields = [T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in documents.schema.fields]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, cuts = [], [], []
            for text, taken_here in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                pieces = sentences(text)
                gone = covered(pieces, {(t["h1"], t["h2"]) for t in taken_here or ()})
                cut = int(gone.sum())
                texts.append("".join(p for p, g in zip(pieces, gone, strict=True) if not g).strip(SPACE) if cut else text)
                totals.append(len(pieces))
                cuts.append(cut)
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            arrays += [pa.array(totals, pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_sentences", "n_removed"])

    text = joined.withColumn("text", F.col("text").cast("string")).select(*columns, "__taken")
    return text.mapInArrow(clean, T.StructType([*fields, *extra]))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated spans, and how many sentences it had and lost."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_spans(documents).select("doc_id", "n_sentences", "n_removed", "text")


OP3_SQL = r"""
WITH s AS (
  SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n\f]*|[^.!?\n]+$'), lambda s:
    CASE WHEN len(regexp_extract_all(s, '\S+')) <= 20 THEN [s] ELSE flatten(list_transform(regexp_extract_all(s, '[^,;:]*[,;:]+[ \t\r\n\f]*|[^,;:]+$'), lambda c:
      CASE WHEN len(regexp_extract_all(c, '\S+')) <= 20 THEN [c] ELSE regexp_extract_all(c, '\s*\S+(?:\s+\S+){0,19}\s*') END)) END)) AS pieces
  FROM documents
), w AS (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM s
), v AS (
  SELECT *, len(regexp_extract_all(piece, '\S+')) AS words, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS norm FROM w
), u AS (
  SELECT doc_id, i, norm, words, row_number() OVER d AS j, sum(words) OVER d AS upto FROM v WHERE words > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), met AS (
  SELECT a.doc_id, a.j AS b, z.j AS e FROM u a JOIN u z ON z.doc_id = a.doc_id AND z.j BETWEEN a.j + 1 AND a.j + 25 AND z.upto - a.upto + a.words >= 25
), r AS (
  SELECT doc_id, b, min(e) AS e FROM met GROUP BY doc_id, b
  UNION SELECT doc_id, max(b) AS b, e FROM met GROUP BY doc_id, e
), k AS (
  SELECT r.doc_id, r.b, r.e, min(u.i) AS first, max(u.i) AS last, string_agg(u.norm, chr(31) ORDER BY u.j) AS k
  FROM r JOIN u ON u.doc_id = r.doc_id AND u.j BETWEEN r.b AND r.e GROUP BY r.doc_id, r.b, r.e
), late AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, b) AS o FROM k) WHERE o > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM late
), kept AS (
  SELECT v.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed,
         coalesce(string_agg(piece, '' ORDER BY v.i) FILTER (WHERE g.i IS NULL), '') AS rest
  FROM v LEFT JOIN gone g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY v.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN coalesce(n_removed, 0) > 0 THEN trim(rest, chr(32) || chr(9) || chr(13) || chr(10) || chr(12)) ELSE d.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
