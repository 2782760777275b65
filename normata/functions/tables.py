"""Table functions for SQL: a law's articles, an article's pieces, a text's amendment markers.

``register(spark)`` makes them known to a session, as Arrow table functions with table arguments:

* ``chunk_law(TABLE(lines) PARTITION BY id ORDER BY at)`` over the lines of laws (:func:`lines_view`), a row for each text: a row
  for each article, as :func:`normata.operators.chunking.chunk_laws` gives;
* ``split_pieces(TABLE(SELECT id, content ...))``: a row for each piece of at most 900 characters;
* ``extract_markers(TABLE(SELECT document_id, chunk_id, articulo_numero, content ...))``: a row for each marker.

Null texts have no pieces and no markers; a law without articles has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.functions.text import split_pieces
from normata.operators.chunking import Law, Read, law_texts
from normata.operators.relations import FAMILIES

LIMIT = 900
CHUNKS = "document_id long, position int, articulo_numero string, titulo string, capitulo string, seccion string, content string"
PIECES = "id long, at int, total int, content string"
MARKERS = "document_id int, chunk_id long, articulo_numero string, extraction_method string, source_text string"


class ChunkLaw:
    """Articles of one law, from its lines in order."""

    kept: dict[bool, dict[str, Read]] = {True: {}, False: {}}  # lines that other laws of the worker held, strict or not

    def __init__(self):
        self.id, self.law = None, None
        self.found: list[tuple] = []

    def eval(self, lines: pa.RecordBatch) -> Iterator[pa.Table]:
        for self.id, own, strict, text in zip(*(lines.column(c).to_pylist() for c in ("id", "own", "strict", "raw_text")), strict=True):
            if self.law is None:
                self.law = Law(strict, own, self.kept[strict])
            self.found += self.law.read(text)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(self.id, *article) for article in (*self.found, *(self.law.finish() if self.law else ()))]
        if rows:
            kinds = (pa.int64(), pa.int32(), *[pa.string()] * 5)
            names = [part.split()[0] for part in CHUNKS.split(", ")]
            yield pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})


class SplitPieces:
    """Pieces of texts, with their number and how many there are."""

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for number, text in zip(texts.column("id").to_pylist(), texts.column("content").to_pylist(), strict=True):
            parts = [] if text is None else split_pieces(text, LIMIT)
            rows += [(number, i, len(parts), p) for i, p in enumerate(parts, 1)]
        ids, at, total, content = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.table({"id": pa.array(ids, pa.int64()), "at": pa.array(at, pa.int32()), "total": pa.array(total, pa.int32()), "content": pa.array(content, pa.string())})


class ExtractMarkers:
    """Markers of all families in texts; one that belongs to several is told for each."""

    def __init__(self):
        self.families = {method: regex.compile(f"(?a){pattern}") for method, pattern in FAMILIES.items()}

    def eval(self, chunks: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for document, chunk, article, text in zip(*(chunks.column(c).to_pylist() for c in ("document_id", "chunk_id", "articulo_numero", "content")), strict=True):
            rows += [(document, chunk, article, method, m[0]) for method, pattern in self.families.items() for m in pattern.finditer(text or "")]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = [part.split()[0] for part in MARKERS.split(", ")]
        yield pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


FUNCTIONS = {"chunk_law": (ChunkLaw, CHUNKS), "split_pieces": (SplitPieces, PIECES), "extract_markers": (ExtractMarkers, MARKERS)}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.arrow_udtf(handler, returnType=schema))


def lines_view(laws: DataFrame, name: str, strict: bool = False) -> None:
    """A view of the lines of laws (id, nombre, raw_text, perhaps in rows by part), for ``chunk_law``; a row holds the lines of a text."""
    law_texts(laws).select("id", "at", "own", F.lit(strict).alias("strict"), "raw_text").createOrReplaceTempView(name)
