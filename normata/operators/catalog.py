"""Source catalogues: change detection, new laws, alerts, numbering and duplicate gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normata.functions.text import content_key, name_key, not_current_law, url_key
from normata.operators.names import either_holds
from normata.sources.scratch import stored


def detect_updates(documents: DataFrame, catalog: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, nombre, status): how each active document stands to its source's catalogue.

    ``documents``: id, nombre, source_url, source (null: unknown); ``catalog``: nombre, source_url, source.
    Names match when either holds the other, in the same source; two matches are ambiguous.
    """
    entries = catalog.select("source", name_key(F.col("nombre")).alias("entry"), F.col("source_url").alias("entry_url"))
    docs = documents.withColumn("own", name_key(F.col("nombre")))
    pairs = stored(either_holds(docs.select(F.col("own").alias("left")), entries.select(F.col("entry").alias("right"))), "pairs")
    near = pairs.select(F.col("left").alias("own"), F.col("right").alias("entry")).join(entries, "entry")
    met = docs.join(near, ["own", "source"], "left").groupBy("id", "nombre", "source_url", "source").agg(
        F.count("entry").alias("n"), F.count_if(F.col("entry") == F.col("own")).alias("exact"),
        F.min(F.when(F.col("entry") == F.col("own"), F.col("entry_url"))).alias("exact_url"), F.min("entry_url").alias("url"),
    )
    url = F.when(F.col("exact") == 1, F.col("exact_url")).otherwise(F.col("url"))
    same = url_key(F.col("source_url"), aliases) == url_key(url, aliases)
    status = (
        F.when(F.col("source").isNull(), "unknown_source")
        .when(F.col("n") == 0, "sin_match")
        .when((F.col("n") > 1) & (F.col("exact") != 1), "ambiguo")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return met.select("id", "nombre", status.alias("status"))


def new_laws(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue names in force that match no document, one per normal form, the first by name."""
    own = documents.select(name_key(F.col("nombre")).alias("own")).distinct()
    entries = catalog.where(~not_current_law(F.col("nombre"))).withColumn("entry", name_key(F.col("nombre")))
    first = Window.partitionBy("entry").orderBy("nombre")
    once = entries.withColumn("at", F.row_number().over(first)).where("at = 1").select("nombre", "entry")
    known = either_holds(once.select(F.col("entry").alias("left")), own.select(F.col("own").alias("right")))
    return once.join(known.select(F.col("left").alias("entry")).distinct(), "entry", "left_anti").select("nombre")


def newly_listed(current: DataFrame, previous: DataFrame | None) -> DataFrame | None:
    """Names that the previous snapshot lacks; without a snapshot there is no baseline, so None."""
    return None if previous is None else current.select("nombre").join(previous.select("nombre"), "nombre", "left_anti").distinct()


def alert_text(names: DataFrame, shown: int = 8) -> DataFrame:
    """(preview): the first ``shown`` distinct names in order, and how many more there are; only those meet in one row."""
    distinct = names.select("nombre").distinct()
    first = distinct.orderBy("nombre").limit(shown).agg(F.array_sort(F.collect_list("nombre")).alias("names"))
    more = distinct.agg((F.count(F.lit(1)) - shown).alias("more"))
    head = F.array_join("names", ", ")
    return first.join(more).select(F.when(F.col("more") > 0, F.concat(head, F.lit(" y "), F.col("more").cast("string"), F.lit(" mas"))).otherwise(head).alias("preview"))


def numbering_report(chunks: DataFrame) -> DataFrame:
    """Per document: distinct labels, rows without one, labels met twice, range and gaps of the numbers.

    ``gaps``: how many numbers are missing; ``missing``: which, as ranges ``a-b`` in order; ``gap_ratio``: of
    the range, 1 if nothing is numbered.
    """
    number = F.regexp_extract("articulo_numero", r"^(\d+)", 1)
    label = F.when(F.col("articulo_numero") != "", F.col("articulo_numero"))
    base = chunks.select("document_id", label.alias("label"), F.when(number != "", number.cast("int")).alias("number"))
    labels = base.groupBy("document_id", "label").agg(F.first("number").alias("number"), F.count(F.lit(1)).alias("times"))
    named = F.col("label").isNotNull()
    by = labels.groupBy("document_id").agg(
        F.count_if(named).alias("labels"), F.coalesce(F.sum(F.when(~named, F.col("times"))), F.lit(0)).alias("unnumbered"), F.count_if(named & (F.col("times") > 1)).alias("duplicates"),
        F.array_sort(F.collect_set("number")).alias("numbers"), F.min("number").alias("first_number"), F.max("number").alias("last_number"),
    )
    steps = F.zip_with(F.slice("numbers", 1, F.size("numbers") - 1), F.slice("numbers", 2, F.size("numbers")), lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b")))
    several = F.when(F.size("numbers") > 1, F.filter(steps, lambda g: g.a <= g.b)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    missing = F.array_join(F.transform(several, lambda g: F.when(g.a == g.b, g.a.cast("string")).otherwise(F.concat_ws("-", g.a.cast("string"), g.b.cast("string")))), ",")
    span = F.col("last_number") - F.col("first_number") + 1
    gaps = F.coalesce(span - F.size("numbers"), F.lit(0))
    ratio = F.coalesce(F.round(F.try_divide(gaps, span), 6), F.lit(1.0))
    return by.select(
        "document_id", "labels", "unnumbered", "duplicates", "first_number", "last_number", gaps.alias("gaps"), missing.alias("missing"), ratio.alias("gap_ratio")
    )


def duplicate_ratio(new: DataFrame, known: DataFrame, least: int = 60) -> DataFrame:
    """Share of a document's articles whose content key is known, with the document most often met.

    ``new``: document_id, content; ``known``: document_id, content. Short keys count for nothing.
    """
    keys = new.select("document_id", content_key(F.col("content")).alias("key")).where(F.length("key") >= least)
    old = known.select(F.col("document_id").alias("known_id"), content_key(F.col("content")).alias("key")).where(F.length("key") >= least)
    first = old.groupBy("key").agg(F.min("known_id").alias("known_id"))
    met = keys.join(first, "key", "left")
    hits = met.groupBy("document_id", "known_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("known_id", F.when(F.col("known_id").isNotNull(), F.struct(F.col("n"), -F.col("known_id"))))
    total = hits.groupBy("document_id").agg(F.sum("n").alias("keys"), F.sum(F.when(F.col("known_id").isNotNull(), F.col("n")).otherwise(0)).alias("hits"), best.alias("likeliest"))
    return total.withColumn("ratio", F.round(F.try_divide("hits", "keys"), 6))
