"""Quality classifier: supervised subword embeddings.

Every word gives hashed features: itself and the character n-grams of ``<word>``; a word that repeats
the word before it counts as the one token ``AGAIN`` instead. A document is the mean of its features' learned vectors; a softmax layer over that mean gives the class. Vectors and
layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
documents (``max_train`` of them, whole texts, with ``MAX_FEATURES`` entries in all). Executors count
the sample's features where its texts are, and one task trains on the counts; the driver gets the
trained weights alone. As the layer is linear, a model scores a document from one number per
feature, which is what workers get.

Defined results: null, empty and blank texts have no features and score the bias alone; repeated
documents score alike; words of any length count; columns other than doc_id and text are ignored, but
one with the name of the score is replaced; without labels of both classes the score is the share of
label 1 (0.5 without labels); labels other than 0 and 1 count for nothing; a text of any length is read whole;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.common import pick_labelled, remainder, sample_texts

BUCKETS, DIM, GRAMS = 1 << 16, 12, (3, 4)
#: Labelled documents that a model is fitted on, at most.
MAX_TRAIN = 4000
#: Entries of all their bags, at most: 96 MB where the model is trained.
MAX_FEATURES = 16_000_000
CUT = 0.7
AGAIN = "\x1fagain"
MODULUS, HELD = 4, 2


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    padded = f"<{word}>"
    grams = [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in (f"={word}", *grams)]


def tokens(text: str) -> list[str]:
    """White-space words, with ``AGAIN`` for each that equals its predecessor."""
    words = text.split()
    return [AGAIN if a == b else b for a, b in zip([None, *words], words)]  # noqa: B905


@dataclass
class Model:
    """``weight``: what a feature adds to the logit of label 1 before averaging."""

    weight: np.ndarray
    bias: float


class WordScores(dict):
    """Word -> sum of its features' weights + 1j * number of features, kept for frequent words."""

    LIMIT, LONGEST = 300_000, 64

    def __init__(self, weight: np.ndarray):
        self.weight = weight.tolist()

    def __missing__(self, word: str) -> complex:
        found = features(word)
        value = complex(sum(map(self.weight.__getitem__, found)), len(found))
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def mean(self, text: str | None) -> float:
        total = sum(map(self.__getitem__, tokens(text or "")), 0j)
        return total.real / total.imag if total.imag else 0.0


def bag(text: str | None, seen: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares."""
    counts: Counter[int] = Counter()
    for word, n in Counter(tokens(text or "")).items():
        found = seen.get(word)
        if found is None:
            found = seen.setdefault(word, features(word))
        for f in found:
            counts[f] += n
    index = np.fromiter(counts.keys(), np.uint16, len(counts))
    share = np.fromiter(counts.values(), np.float32, len(counts))
    return index, share / max(share.sum(), 1)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 6, rate: float = 0.6, seed: int = 7) -> Model:
    """Fit vectors and softmax layer by stochastic gradient descent, one document at a time."""
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, offset = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32), np.array([0.0, bias], np.float32)
    steps = epochs * len(bags)
    for step, i in enumerate(np.concatenate([rng.permutation(len(bags)) for _ in range(epochs)])):
        index, weight = bags[i]
        lr = rate * (1 - step / steps)
        hidden = weight @ vectors[index]
        logit = layer @ hidden + offset
        p = np.exp(logit - logit.max())
        error = p / p.sum()
        error[labels[i]] -= 1
        back = error @ layer
        layer -= lr * np.outer(error, hidden)
        offset -= lr * error
        # A document's mean spreads its gradient thinly over its features; the factor undoes that.
        vectors[index] -= (lr * min(len(index), 50)) * weight[:, None] * back[None, :]
    return Model(vectors @ (layer[1] - layer[0]), float(offset[1] - offset[0]))


def count_features(sample: DataFrame) -> DataFrame:
    """(doc_id, label, index, share): the bags of a sample's texts, at most ``BUCKETS`` entries each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t, {}) for t in batch.column("text").to_pylist()]
            packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in zip(*found, strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *packed], ["doc_id", "label", "index", "share"])

    return sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label int, index binary, share binary")


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """A model from at most ``max_train`` labelled rows outside the held-out remainder.

    They are taken in a hash order as long as their bags have ``max_features`` entries at most, which
    bounds the memory of the task that trains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks, room = [], [], max_features
        for batch in batches:
            for label, index, share in zip(*(batch.column(c).to_pylist() for c in ("label", "index", "share")), strict=True):
                room -= len(index) // 2
                if room >= 0:
                    bags.append((np.frombuffer(index, np.uint16), np.frombuffer(share, np.float32)))
                    marks.append(label)
        model = train(bags, marks)
        yield pa.RecordBatch.from_pydict({"weight": pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), "bias": [model.bias]})

    bags = count_features(sample_texts(documents, pick_labelled(labels, "quality", MODULUS, HELD, max_train)))
    one = bags.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")  # bounded by max_train
    found = one.mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(found.weight, "<f4"), found.bias) if found else train([], [])


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with a column ``name`` (0 to 1), at the end if it is new; one pass, no shuffle."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordScores(model.weight)
        for texts in batches:
            logit = np.array([words.mean(t) for t in texts]) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    return documents.withColumn(name, score(F.col("text").cast("string")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(documents.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
