"""Training corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``, in their order.

Defined results of all stages: an empty table gives no rows; null and empty texts are clean documents of
no words, which pass every filter and are packed as their end token; rows without doc_id are kept and
judged by their text; of rows that are equal in doc_id and text, and of near duplicates, one stays: that of the smallest
doc_id, rows without one last; texts of any length are read whole; other columns pass through,
but names that begin with two underscores are the stages' own, and ``n_sentences`` and ``n_removed`` are
replaced; without labels of both classes the classifier rejects nothing or all by their share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm import decontam, jaccard, packing, quality, spans
from normata.llm.common import materialise

#: Documents whose quality score is below this are rejected.
REJECT = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs, model, "__quality").where(F.col("__quality") >= REJECT).drop("__quality")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def spans_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated sentence runs; one of which nothing is left goes."""
    cut = spans.drop_repeated_spans(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = decontam.find_matches(keyed.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("sentence_spans", spans_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), name)
    return out
