"""Joins of names by containment, by words in order, and by likeness, without comparing every pair.

Containment: an Aho-Corasick automaton over one side's names reads each name of the other side once and tells all
that it holds. The automaton's names are broadcast in blocks of at most ``BLOCK`` characters, whatever their number,
each freed before the next. Words in order: the automaton holds the asked names' words; a name's candidates are
the texts that hold its least frequent word, and only these are matched against its pattern. Likeness: names
whose ratio of matching blocks reaches a bound share pairs of letters; a join on the rarest of these gives the
candidates, counts of shared pairs and letters narrow them, and difflib decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normata.functions.text import fold, like_pattern_of
from normata.sources.scratch import new_folder, stored

#: Characters of the names in one automaton, about.
BLOCK = 4 << 20


def held_names(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text): the distinct pairs of a text (column ``text``) and a key (column ``key``) that it holds, itself included.

    Nulls hold nothing and are held by nothing; the empty key is held by every text.
    """
    spark = keys.sparkSession
    own = stored(keys.select(F.col("key").cast("string")).where("key IS NOT NULL").distinct(), "keys")
    other = stored(texts.select(F.col("text").cast("string")).where("text IS NOT NULL").distinct(), "texts")
    size, empty = own.agg(F.sum(F.length("key") + 1), F.count_if(F.col("key") == "")).first()
    blocks = -(-(size or 0) // BLOCK)
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, blocks)))
    path, schema = new_folder(spark, "held"), "key string, text string"
    if empty:
        other.select(F.lit("").alias("key"), "text").write.mode("append").parquet(path)
    for i in range(blocks):
        block = own.where((F.col("key") != "") & (part == i)).toArrow().column("key").to_pylist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for key in shared.value:
                automaton.add_word(key, key)
            automaton.make_automaton()
            for batch in batches:
                pairs = []
                for text in batch.column(0).to_pylist():
                    pairs += [(key, text) for key in {key for _, key in automaton.iter(text)}] if len(automaton) else []
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)], ["key", "text"])

        other.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path) if blocks or empty else spark.createDataFrame([], schema)


def either_holds(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): the distinct pairs of two names (columns ``left`` and ``right``) of which one holds the other."""
    down = held_names(left.select(F.col("left").alias("key")), right.select(F.col("right").alias("text")))
    up = held_names(right.select(F.col("right").alias("key")), left.select(F.col("left").alias("text")))
    both = down.select(F.col("key").alias("left"), F.col("text").alias("right"))
    return both.unionByName(up.select(F.col("text").alias("left"), F.col("key").alias("right"))).distinct()


def hold_words(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, text): the distinct pairs of a text and a name whose words it holds in order, accents and case apart.

    A name without words is held by every text. Candidates are the texts with the name's least frequent word.
    """
    asked = stored(names.select("name").where("name IS NOT NULL").distinct(), "asked")
    known = stored(texts.select("text").where("text IS NOT NULL").distinct().withColumn("plain", F.lower(fold(F.col("text")))), "known")
    split = F.filter(F.split(F.lower(fold(F.col("name"))), r"\s+"), lambda w: w != "")
    words = asked.select("name", F.explode(F.array_distinct(split)).alias("word"))
    met = held_names(words.select(F.col("word").alias("key")), known.select(F.col("plain").alias("text"))).withColumnsRenamed({"key": "word", "text": "plain"})
    often = met.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = words.join(often, "word", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest"))
    near = least.select("name", F.col("rarest.word").alias("word")).join(met, "word").join(known, "plain")
    fits = near.where(F.ilike("plain", like_pattern_of(F.col("name")))).select("name", "text")
    blank = asked.withColumn("__words", F.size(split)).where("__words = 0")
    every = known.withColumn("__words", F.length("text") * 0)
    return fits.unionByName(blank.join(every, "__words").select("name", "text"))


def letter_pairs(name: Column) -> Column:
    """Pairs of neighbouring letters, each with its number among equal ones: equal sets are equal multisets."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2))))
    numbered = F.transform(pairs, lambda p, i: F.concat(p, (i - F.array_position(pairs, p)).cast("string")))
    return F.when(F.length(name) > 1, numbered).otherwise(F.array().cast("array<string>"))


@F.arrow_udf(T.DoubleType())
def sequence_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratio of matching blocks, as difflib defines it."""
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs], pa.float64())


def least_shared(size: Column, accept: float) -> Column:
    """Pairs of letters that two names of ``size`` letters together share at least, if their ratio is ``accept``.

    Blocks of M letters in all leave ``size - 2 M`` letters out, at least one between two blocks, and a block of n
    letters holds n - 1 pairs. Above 0.8, names for which that is not above zero are equal.
    """
    return F.greatest(F.ceil(size * (1.5 * accept - 1) - 1), F.lit(1))


def alike(names: DataFrame, known: DataFrame, accept: float) -> DataFrame:
    """(a, b, score): pairs of distinct names (column ``a``) and known ones (``b``) with a ratio of at least ``accept``,
    which is above 0.8; equal names have 1."""
    if accept <= 0.8:
        raise ValueError("names with a ratio of 0.8 need not share a pair of letters")
    left = stored(names.select("a").where("a IS NOT NULL").distinct().withColumn("pairs", letter_pairs(F.col("a"))), "names")
    right = stored(known.select("b").where("b IS NOT NULL").distinct().withColumn("pairs", letter_pairs(F.col("b"))), "known")
    often = right.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))

    def rarest(side: DataFrame, name: str) -> DataFrame:
        """The pairs of which any alike name must share one: all but the most frequent that it may share."""
        smallest = F.length(name) * (1 + accept / (2 - accept))
        first = F.size("pairs") - least_shared(smallest, accept) + 1
        each = side.select(name, first.alias("first"), F.explode("pairs").alias("pair")).join(often, "pair", "left")
        order = Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "pair")
        return each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("first")).select(name, "pair")

    near = rarest(left, "a").join(rarest(right, "b"), "pair").select("a", "b").distinct()
    size, smaller = F.length("a") + F.length("b"), F.least(F.length("a"), F.length("b"))
    fitting = near.where((2 * smaller >= accept * size) & (F.col("a") != F.col("b")))
    held = fitting.join(left.withColumnRenamed("pairs", "p"), "a").join(right.withColumnRenamed("pairs", "q"), "b")
    hopeful = held.where(F.size(F.array_intersect("p", "q")) >= least_shared(size, accept)).select("a", "b")
    scored = hopeful.withColumn("score", sequence_ratio("a", "b")).where(F.col("score") >= accept)
    return scored.unionByName(left.select("a").join(right.select("b"), F.col("a") == F.col("b")).withColumn("score", F.lit(1.0)))
