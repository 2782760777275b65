"""Calls of the caller's models from inside tasks: embeddings, answers, relevances.

A model is a name and a function of a list of texts that gives a list as long; it is sent to the tasks, so it must be
importable or picklable there, and opens its own connections. Texts go in batches of at most ``size``. A batch for
which a model raises, gives another number of results, or a result that the check refuses, goes to the next
model; a model that failed ``PATIENCE`` batches one after the other is left out for the rest of the task. If no
model is left, the results are null and the last error is told.

Defined results: null texts are not sent and have a null result, no model and no error; empty texts are sent; a null
result for a text is a failure of its batch; equal texts are sent as often as they come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normata.sources.tables import to_reembed

SIZE, PATIENCE, ERROR_CHARS = 64, 3, 4000


@dataclass(frozen=True)
class Model:
    """A model's name, and its function: a list of texts to a list of results."""

    name: str
    call: Callable[[list[str]], Sequence]


def vector_of(dim: int) -> Callable[[object], str | None]:
    """A check that a result is a vector of ``dim`` finite numbers."""

    def check(result: object) -> str | None:
        if len(result) != dim:
            return f"{len(result)} dimensions, {dim} wanted"
        return None if all(map(math.isfinite, result)) else "a component is not finite"

    return check


class Caller:
    """Calls models in their order for batches of texts, in one task."""

    def __init__(self, models: Sequence[Model], check: Callable[[object], str | None] | None = None):
        self.models, self.check = models, check
        self.failed = dict.fromkeys((m.name for m in models), 0)

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(result, model, error) of each text."""
        error = "no model"
        for model in self.models:
            if self.failed[model.name] >= PATIENCE:
                continue
            try:
                results = list(model.call(texts))
                fault = self.fault(texts, results)
            except Exception as raised:
                fault = f"{type(raised).__name__}: {raised}"
            if fault is None:
                self.failed[model.name] = 0
                return [(r, model.name, None) for r in results]
            self.failed[model.name] += 1
            error = f"{model.name}: {fault}"[:ERROR_CHARS]
        return [(None, None, error)] * len(texts)

    def fault(self, texts: list[str], results: list) -> str | None:
        if len(results) != len(texts):
            return f"{len(results)} results for {len(texts)} texts"
        for result in results:
            told = "a result is missing" if result is None else self.check and self.check(result)
            if told:
                return told
        return None


def called(rows: DataFrame, text: str, models: Sequence[Model], kind: T.DataType, check: Callable | None = None, size: int = SIZE) -> DataFrame:
    """``rows`` with ``result`` (of ``kind``), ``model`` and ``error`` of the models' call for the column ``text``."""
    columns = [c for c in rows.columns if c not in ("result", "model", "error")]
    at = columns.index(text)
    schema = T.StructType([*rows.select(*columns).schema.fields, T.StructField("result", kind), T.StructField("model", T.StringType()), T.StructField("error", T.StringType())])
    arrow = {T.DoubleType(): pa.float64(), T.StringType(): pa.string()}.get(kind, pa.list_(pa.float32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(models, check)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            told: list[tuple] = [(None, None, None)] * len(texts)
            for begin in range(0, len(asked), size):
                part = asked[begin : begin + size]
                for i, one in zip(part, caller([texts[i] for i in part]), strict=True):
                    told[i] = one
            results, names, errors = zip(*told, strict=True) if told else ((), (), ())
            more = [pa.array(results, arrow), pa.array(names, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*columns, "result", "model", "error"])

    return rows.select(*columns).mapInArrow(run, schema)


def with_embeddings(rows: DataFrame, text: str, models: Sequence[Model], dim: int, size: int = SIZE) -> DataFrame:
    """``rows`` with ``embedding``, ``embedding_model`` and ``embedding_error``: vectors of ``dim`` dimensions."""
    out = called(rows.drop("embedding", "embedding_model", "embedding_error"), text, models, T.ArrayType(T.FloatType()), vector_of(dim), size)
    return out.withColumnsRenamed({"result": "embedding", "model": "embedding_model", "error": "embedding_error"})


def with_answers(rows: DataFrame, prompt: str, models: Sequence[Model]) -> DataFrame:
    """``rows`` with ``answer``, ``llm_model`` and ``llm_error``, one call for each prompt; a blank answer is a failure."""
    out = called(rows, prompt, models, T.StringType(), lambda answer: None if answer.strip() else "a blank answer", 1)
    return out.withColumnsRenamed({"result": "answer", "model": "llm_model", "error": "llm_error"})


def reembedded(chunks: DataFrame, documents: DataFrame, models: Sequence[Model], dim: int, size: int = SIZE, inactive: bool = False) -> DataFrame:
    """Chunks of :func:`normata.sources.tables.to_reembed` (by the first model's name) with new embeddings.

    A chunk for which every model failed keeps its old vector and model, so the next run asks for it again.
    """
    wanted = to_reembed(chunks, documents, models[0].name, inactive)
    old = wanted.withColumnsRenamed({"embedding": "__old", "embedding_model": "__old_model"})
    new = with_embeddings(old, "content", models, dim, size)
    kept = new.withColumns({"embedding": F.coalesce("embedding", "__old"), "embedding_model": F.coalesce("embedding_model", "__old_model")})
    return kept.select(*chunks.columns, "embedding_error")
