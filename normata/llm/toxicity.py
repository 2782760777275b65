"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility and accented forms, homoglyphs of other scripts, zero-width
characters, and digits or signs that stand for letters in a word, where a 1 may be an i or an l. The
lexicon holds whole words and word beginnings with log-odds weights learned from a bounded sample of
labelled documents (``max_train``), whole texts; terms must occur in several toxic documents and hardly
in others. Exception phrases cover matches that are not meant ill: those given, and pairs of words
around a listed one that the sample has in several documents, none of them toxic. A document's weighted
hits, normalised by its length, and whether it has any, give the score through a logistic curve fitted
on the same sample.

Defined results: null and empty texts have no hit and score as such a document; repeated documents
score alike; overlapping matches in one word count once, by the largest weight; columns other than
doc_id and text are ignored, but one named ``score`` is replaced; without labels of both classes the
score is the share of label 1; labels other than 0 and 1 count for nothing; a text of any length is read whole; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.common import pick_labelled, remainder, sample_texts

# Letters of other scripts that look like Latin ones, and what they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ց": "g", "ո": "n", "ս": "u", "օ": "o",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and signs used for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
ONE_AS_L = LEET | {"1": "l"}
#: Zero-width characters and the soft hyphen.
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a listed word is not meant ill, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "pathetic fallacy")
MAX_TRAIN = 8000
PREFIXES = (4, 5, 6)
MIN_TOXIC, MIN_ODDS, MIN_CLEAN, COMMON = 4, 2.5, 3, 0.05
CUT = 0.7
MODULUS, HELD = 3, 1
WORD = re.compile(r"[^\W\d_]+")
#: Digits and signs before a letter, and digits after one that end a word.
DISGUISED = re.compile(r"[013457@$8!|]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@8]+(?!\w)")
LEET_TABLE, L_TABLE = str.maketrans(LEET), str.maketrans(ONE_AS_L)


def fold_table() -> dict[int, str]:
    """Every letter with a compatibility or base form, by Unicode's rule, and the tables above."""
    table: dict[int, str] = {}
    blocks = ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
    for first, end in blocks:
        for code in range(first, end):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if base and base.isascii() and base != chr(code):
                table[code] = base.lower()
    table.update({ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a.upper()): b for a, b in HOMOGLYPHS.items() if len(a.upper()) == 1})
    table.update({ord(c): "" for c in INVISIBLE} | {code: "" for code in range(0x300, 0x370)})
    return table


FOLD = fold_table()


def fold(text: str | None, table: dict = LEET_TABLE) -> str:
    """Lower-case text with disguises undone."""
    text = (text or "").translate(FOLD).lower()
    return DISGUISED.sub(lambda m: m[0].translate(table), text)


def readings(text: str | None) -> list[str]:
    """The folded text, and if a 1 in a word could be an l, the one that takes it so; both of one length."""
    first = fold(text)
    if "1" not in (text or "").translate(FOLD):
        return [first]
    second = fold(text, L_TABLE)
    return [first] if first == second else [first, second]


def terms(words: set[str]) -> set[str]:
    """Lexicon candidates of a document: its words, and word beginnings marked by ``*``."""
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    """Weighted terms, exception phrases, and the logistic curve over (any hit, hits by length, hits on a logarithmic scale)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.exceptions, self.curve = state
        self.automaton = None

    def build(self) -> object:
        import ahocorasick

        found: dict[str, list] = {}
        for term, weight in self.weights.items():
            found.setdefault(term.rstrip("*"), [0.0, 0.0, False])[term.endswith("*")] = weight
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        machine = ahocorasick.Automaton()
        for key, (word, prefix, exception) in found.items():
            machine.add_word(key, (len(key), word, prefix, exception))
        if found:
            machine.make_automaton()
        return machine

    def hits(self, *texts: str) -> tuple[float, int]:
        """Summed weights of matches outside exception phrases, and how many words matched, in readings of one text."""
        if self.automaton is None:
            self.automaton = self.build()
        if not len(self.automaton):
            return 0.0, 0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for text in texts:
            n = len(text)
            for last, (length, word, prefix, exception) in self.automaton.iter(text):
                first = last - length + 1
                if first and text[first - 1].isalnum():
                    continue
                ends = last + 1 >= n or not text[last + 1].isalpha()
                weight = max(word if ends else 0.0, prefix)
                if weight > best.get(first, 0.0):
                    best[first] = weight
                if exception and ends:
                    excused.append((first, last))
        for a, b in excused:
            for at in [x for x in best if a <= x <= b]:
                del best[at]
        return sum(best.values()), len(best)

    def inputs(self, text: str | None) -> tuple[float, float, float]:
        found = readings(text)
        total, count = self.hits(*found)
        return float(count > 0), total / math.sqrt(1 + len(found[0]) / 6), math.log1p(total)

    def score(self, text: str | None) -> float:
        a, b, c, d = self.curve
        hit, dense, scale = self.inputs(text)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * hit + c * dense + d * scale))))


def logistic(inputs: np.ndarray, labels: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first input is constant."""
    w = np.zeros(inputs.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (inputs.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + penalty
        w = w - np.linalg.solve(hessian, inputs.T @ (p - labels) + penalty @ w)
    return w


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Terms with their log-odds, from the numbers of toxic and other documents that hold them; as many as the sample has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                seen[int(label)].update(terms(set(WORD.findall(fold(text)))))
        keys = [*(seen[0].keys() | seen[1].keys())]
        if keys:
            yield pd.DataFrame({"term": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]})

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return {}
    counts = sample.select("label", "text").mapInPandas(count, "term string, clean long, toxic long")
    odds = F.log((F.col("toxic") + 0.1) / (totals[1] + 0.2)) - F.log((F.col("clean") + 0.1) / (totals[0] + 0.2))
    strong = (
        counts.groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_TOXIC)
        .withColumn("weight", odds)
        .where(F.col("weight") >= MIN_ODDS)
    )
    return {r.term: r.weight for r in strong.select("term", "weight").orderBy("term").collect()}


def learn_exceptions(sample: DataFrame, weights: dict[str, float]) -> list[str]:
    """Pairs of a listed word and a neighbour in ``MIN_CLEAN`` documents or more, none of them toxic.

    The neighbour is no word of every text (``COMMON``), which would excuse the listed word wherever it stands.
    """

    def listed(word: str) -> bool:
        return word in weights or any(f"{word[:n]}*" in weights for n in PREFIXES if len(word) > n)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                words = fold(text).split(" ")
                pairs = {(a, b) for a, b in zip(words, words[1:], strict=False) if a.isalpha() and b.isalpha()}
                found = {(f"{a} {b}", b if listed(a) else a) for a, b in pairs if listed(a) != listed(b)}
                seen[int(label)].update(found | {(w, "") for w in {x for x in words if x.isalpha()}})
        keys = [*(seen[0].keys() | seen[1].keys())]
        if keys:
            rows = [(*k, seen[0][k], seen[1][k]) for k in keys]
            yield pd.DataFrame(rows, columns=["phrase", "other", "clean", "toxic"])

    counted = sample.select("label", "text").mapInPandas(count, "phrase string, other string, clean long, toxic long")
    sums = counted.groupBy("phrase", "other").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    common = sums.where((F.col("other") == "") & (F.col("clean") + F.col("toxic") >= COMMON * sample.count())).select(F.col("phrase").alias("other"))
    mild = sums.where((F.col("other") != "") & (F.col("clean") >= MIN_CLEAN) & (F.col("toxic") == 0)).join(common, "other", "left_anti")
    found = [r.phrase for r in mild.select("phrase").distinct().orderBy("phrase").collect()]
    sums.unpersist()
    return found


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Lexicon:
    """A lexicon and its curve from at most ``max_train`` labelled rows outside the held-out remainder."""
    sample = sample_texts(documents, pick_labelled(labels, "toxic", MODULUS, HELD, max_train)).repartition(8, "doc_id").cache()
    weights = learn_terms(sample)
    lexicon = Lexicon(weights, (*EXCEPTIONS, *learn_exceptions(sample, weights)))

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [lexicon.inputs(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "hit": [r[0] for r in rows], "dense": [r[1] for r in rows], "scale": [r[2] for r in rows]})

    points = sample.select("label", "text").mapInPandas(inputs, "label int, hit double, dense double, scale double").toPandas()
    sample.unpersist()
    points = points.sort_values(["label", "hit", "dense", "scale"])
    share = (points["label"].sum() + 0.5) / (len(points) + 1)
    if points["label"].nunique() < 2:
        lexicon.curve = (math.log(share / (1 - share)), 0.0, 0.0, 0.0)
        return lexicon
    x = np.column_stack([np.ones(len(points)), points["hit"], points["dense"], points["scale"]])
    lexicon.curve = tuple(float(v) for v in logistic(x, points["label"].to_numpy(float)))
    return lexicon


def with_scores(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``documents`` with a column ``score`` (0 to 1) at the end; one pass, no shuffle."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return documents.withColumn("score", score(F.col("text").cast("string")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(spark, documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(documents.select("doc_id", "text"), lexicon).select(
        "doc_id",
        (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
