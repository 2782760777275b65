"""Amendment markers in chunk texts to dated edges between laws, and questions over those edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normata.functions.text import collapse, entity_key, fold, law_key, matches_name
from normata.operators.names import alike, either_holds, hold_words
from normata.sources.scratch import stored

# The three families of markers, and the words of each that give a marker's type. The second
# takes an accented o, and no line that goes on with the last reform of a whole law.
PARTICIPLE = r"(?i)\([^)]*?(?:DEROGAD|REFORMAD|ADICIONAD)[OA][^)]*\)"
PUBLISHED = r"(?im)(?:\(\s*|^(?<!ULTIMA\s{0,14})[ \t]*)(?:REF[OÓó]RMA|ADICI[OÓó]N|DER[OÓó]GACI[OÓó]N)\s+PUBLICAD[^)]{0,250}\)"
REFLEXIVE = r"(?i)\(\s*SE\s+(?:DEROGA|REFORMA|ADICIONA|ADICONA)\b[^)]*\)"
FAMILIES = {"regex": PARTICIPLE, "regex_publicada": PUBLISHED, "regex_se_verbo": REFLEXIVE}
#: What a text with a marker of the family holds, in capitals: its pattern need not be tried on others.
HELD = {"regex": "AD", "regex_publicada": "PUBLICAD", "regex_se_verbo": "SE"}
KEYWORDS = {
    "regex": r"(?i)(DEROGADO|DEROGADA|REFORMADO|REFORMADA|ADICIONADO|ADICIONADA)",
    "regex_publicada": r"(?i)(REF[OÓó]RMA|ADICI[OÓó]N|DER[OÓó]GACI[OÓó]N)",
    "regex_se_verbo": r"(?i)(DEROGA|REFORMA|ADICIONA|ADICONA)",
}
# The months.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
DATE = r"(?i)(\d{1,2})\s+(?:DEL?\s+)?(ENERO|FEBRERO|MARZO|ABRIL|MAYO|JUNIO|JULIO|AGOSTO|SEPTIEMBRE|SETIEMBRE|OCTUBRE|NOVIEMBRE|DICIEMBRE)\.?\s*(?:DEL?\s+)?(\d{4})"
OTHER_LAW = r"(?i)^.*?POR.*?(?:DE LA (?=LEY|CONSTITUCI[O0]N)|DEL (?=C[O0]DIGO|REGLAMENTO))(.*)$"
OFFICIAL_PAPER = r"(?i),?\s*P\.?\s*O\.?.*$"
OFFICIAL_PAPER_STRICT = r"(?i),?\s*\bP\.\s*O\..*$"
ACCEPT = 0.82


def fold_o(text: Column) -> Column:
    """Folds the one accented letter of the markers, one character for one."""
    return F.translate(text, "Óó", "Oo")


def relation_type(marker: Column, method: Column) -> Column:
    """deroga, reforma or adiciona by the first keyword of the marker's family."""
    word = F.lit("")
    for family, pattern in KEYWORDS.items():
        word = F.when(method == family, F.upper(F.regexp_extract(fold_o(marker), pattern, 1))).otherwise(word)
    return F.when(word.startswith("DEROGA"), "deroga").when(word.startswith("REFORMA"), "reforma").when(word.startswith("ADIC"), "adiciona")


def marker_date(text: Column) -> Column:
    """Spanish date in a marker; null if there is none or it is no day of the calendar."""
    month = F.lower(F.regexp_extract(text, DATE, 2))
    number = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.replace(month, F.lit("setiembre"), F.lit("septiembre"))), F.lit(0))
    day, year = F.regexp_extract(text, DATE, 1), F.regexp_extract(text, DATE, 3)
    return F.concat(year, F.lit("-"), number.cast("string"), F.lit("-"), day).try_cast("date")


def last_reform(text: Column) -> Column:
    """Latest marker date of a whole law text, whatever its accents."""
    found = F.regexp_extract_all(F.upper(fold(text)), F.lit(r"P\.?\s*O\.?[^()]{0,60}?FECHA\s+(\d{1,2}\s+DE\s+[A-Z]+\s+(?:DEL?\s+)?\d{4})"), 1)
    return F.array_max(F.transform(found, marker_date))


def other_law(marker: Column, strict: bool = False) -> Column:
    """Name of another law that a marker says the change is by, up to the official paper's mention."""
    name = F.regexp_replace(F.regexp_extract(marker, OTHER_LAW, 1), OFFICIAL_PAPER_STRICT if strict else OFFICIAL_PAPER, "")
    clean = F.trim(F.regexp_replace(F.trim(name), "^,+|,+$", ""))
    return F.when(clean != "", clean)


def extract_markers(chunks: DataFrame) -> DataFrame:
    """A row per marker: (document_id, chunk_id, articulo_numero, extraction_method, source_text as written).

    A text may be a marker of more than one family and is then told once for each.
    """
    texts = lambda method: F.when(F.upper("content").contains(HELD[method]), F.regexp_extract_all("content", F.lit(FAMILIES[method]), 0))
    found = F.array(*[F.struct(F.lit(method).alias("method"), texts(method).alias("texts")) for method in FAMILIES])
    each = chunks.select("document_id", "chunk_id", "articulo_numero", F.explode(found).alias("f"))
    return each.select("document_id", "chunk_id", "articulo_numero", F.col("f.method").alias("extraction_method"), F.explode("f.texts").alias("source_text"))


def resolve_names(names: DataFrame, documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(name, document_id): the known law most like each distinct name, if alike enough; the first by id on ties.

    Equal names are alike, then names of which one holds the other, then by their ratio of matching blocks.
    """
    asked = stored(names.select("name").distinct().withColumn("a", entity_key(F.col("name"))), "asked")
    known = documents.select(F.col("id").alias("document_id"), entity_key(F.col("nombre")).alias("b"))
    bearers = stored(known.groupBy("b").agg(F.min("document_id").alias("document_id")), "bearers")
    a, b = asked.select("a"), bearers.select("b")
    held = either_holds(a.select(F.col("a").alias("left")), b.select(F.col("b").alias("right"))).select(F.col("left").alias("a"), F.col("right").alias("b"))
    scored = alike(a, b, accept).unionByName(held.where("a <> b").withColumn("score", F.lit(0.95)))
    one = scored.groupBy("a", "b").agg(F.max(F.when(F.col("score") == 0.95, 0.95)).alias("held"), F.max("score").alias("score"))
    told = one.select("a", "b", F.coalesce("held", "score").alias("score")).where(F.col("score") >= accept).join(bearers, "b")
    best = F.min_by("document_id", F.struct(-F.col("score"), "document_id"))
    return asked.join(told.groupBy("a").agg(best.alias("document_id")), "a").select("name", "document_id")


def build_relations(chunks: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """Edges of all markers; a marker that names no other law is a change within its own.

    The markers are found once and stored: their names are resolved first, then all are joined with what the names mean. That is a
    small table, stored too, so that its size is known and rows need not move to it.
    """
    told = extract_markers(chunks).withColumn("text", collapse(F.col("source_text"))).withColumns(
        {"relation_type": relation_type(F.col("source_text"), F.col("extraction_method")), "fecha": marker_date(F.col("text")), "to_law_name_raw": other_law(F.col("text"), strict)}
    )
    rows = stored(told.drop("text"), "markers")
    resolved = stored(resolve_names(rows.where("to_law_name_raw IS NOT NULL").select(F.col("to_law_name_raw").alias("name")), documents), "resolved")
    own = documents.select(F.col("id").alias("document_id"), F.col("nombre").alias("own_name"))
    joined = rows.join(own, "document_id").join(resolved.select(F.col("name").alias("to_law_name_raw"), F.col("document_id").alias("found")), "to_law_name_raw", "left")
    itself = F.col("to_law_name_raw").isNull()
    return joined.select(
        F.col("document_id").alias("from_document_id"), F.col("chunk_id").alias("from_chunk_id"), F.col("articulo_numero").alias("from_articulo"), "relation_type",
        F.when(itself, F.col("document_id")).otherwise(F.col("found")).alias("to_document_id"),
        F.coalesce("to_law_name_raw", "own_name").alias("to_law_name_raw"), "fecha", "source_text", "extraction_method", itself.alias("is_self"),
    )


def extraction_counters(relations: DataFrame) -> DataFrame:
    resolved = F.col("to_document_id").isNotNull()
    return relations.agg(
        F.count_if("is_self").alias("auto_mod"), F.count_if(~F.col("is_self") & resolved).alias("cross_resolved"),
        F.count_if(~F.col("is_self") & ~resolved).alias("cross_unresolved"), F.count_if(F.expr("fecha IS NULL")).alias("skipped_no_date"),
    )


# The phrases of a sentence on a change.
VERBS = {"deroga": "fue derogado", "reforma": "fue reformado", "adiciona": "fue adicionado"}
NO_DATE, NO_ARTICLE, NO_VERB = "en una fecha no especificada en el marcador", "Un articulo (numero no identificado en el marcador)", "tuvo un cambio registrado"
NOT_HELD = " (esa ley no esta en el corpus ingerido actualmente, no se puede mostrar su contenido)"
WITHIN = "mediante una reforma registrada dentro de la misma ley (el marcador no nombra a otra ley distinta)"
SOURCE = '. Marcador original del Periodico Oficial: "'


def long_date(date: Column) -> Column:
    """Spanish long date; a fixed phrase where there is none."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date))
    told = F.concat(F.day(date).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(date).cast("string"))
    return F.coalesce(told, F.lit(NO_DATE))


def sentence() -> Column:
    """One sentence on a change, from an edge joined with its law's name (from_nombre)."""
    article = F.coalesce(F.concat(F.lit("El articulo "), F.col("from_articulo")), F.lit(NO_ARTICLE))
    verb = F.lit(NO_VERB)
    for kind, told in VERBS.items():
        verb = F.when(F.col("relation_type") == kind, told).otherwise(verb)
    unknown = F.when(F.col("to_document_id").isNull(), NOT_HELD).otherwise("")
    actor = F.when(
        F.col("to_document_id") == F.col("from_document_id"),
        WITHIN,
    ).otherwise(F.concat(F.lit("por "), F.col("to_law_name_raw"), unknown))
    return F.concat(
        article, F.lit(" de "), F.col("from_nombre"), F.lit(" "), verb, F.lit(" el "), long_date(F.col("fecha")), F.lit(", "), actor,
        F.lit(SOURCE), F.col("source_text"), F.lit('".'),
    )


def named(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with the name of the law they start from, in force or not."""
    return relations.join(documents.select(F.col("id").alias("from_document_id"), F.col("nombre").alias("from_nombre")), "from_document_id")


def laws_named(documents: DataFrame, name: str) -> DataFrame:
    """Ids of the laws that a name means: its exact bearer if there is just one, else all that hold its words."""
    met = documents.where(matches_name(F.col("nombre"), name))
    exact = met.where(law_key(F.col("nombre")) == law_key(F.lit(name)))
    n = exact.agg(F.count(F.lit(1)).alias("n"))
    flagged = met.join(F.broadcast(n)).withColumn("exact", law_key(F.col("nombre")) == law_key(F.lit(name)))
    return flagged.where((F.col("n") != 1) | F.col("exact")).select("id", "nombre")


def touching(relations: DataFrame, documents: DataFrame, name: str, article: str | None = None) -> DataFrame:
    """Changes of a law (as source or target), or of one of its articles (as source)."""
    ids = laws_named(documents, name).select("id")
    start = named(relations, documents).join(ids.select(F.col("id").alias("from_document_id"), F.lit(True).alias("starts")), "from_document_id", "left")
    if article is not None:
        return start.where("starts").where(F.upper(F.trim("from_articulo")) == article.strip().upper())
    ends = ids.select(F.col("id").alias("to_document_id"), F.lit(True).alias("ends"))
    return start.join(ends, "to_document_id", "left").where("starts OR ends")


def law_history(relations: DataFrame, documents: DataFrame, name: str, article: str | None = None, limit: int = 20) -> DataFrame:
    """The latest changes that :func:`touching` finds."""
    return touching(relations, documents, name, article).orderBy(F.desc_nulls_last("fecha"), "from_chunk_id", "source_text").limit(limit)


def history_total(relations: DataFrame, documents: DataFrame, name: str, article: str | None = None, limit: int = 20) -> DataFrame:
    """(total, omitted): how many changes there are, and how many a history of ``limit`` leaves out."""
    n = F.count(F.lit(1))
    return touching(relations, documents, name, article).agg(n.alias("total"), F.greatest(n - limit, F.lit(0)).alias("omitted"))


def laws_matching(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(at, nombre, document_id): the active laws that each asked name means, with the name's ordinal.

    A name means all laws that hold its words in order, unless just one of several bears it exactly. The
    names are those of one batch of answers and the laws a catalogue.
    """
    asked = names.select("nombre").distinct().withColumn("at", F.row_number().over(Window.orderBy("nombre")))  # a batch of names
    laws = documents.where("is_active").select(F.col("id").alias("document_id"), F.col("nombre").alias("known"))
    words = hold_words(asked.select(F.col("nombre").alias("name")), laws.select(F.col("known").alias("text")))
    met = asked.join(words.select(F.col("name").alias("nombre"), F.col("text").alias("known")), "nombre").join(laws, "known")
    each = Window.partitionBy("nombre")
    exact = law_key(F.col("known")) == law_key(F.col("nombre"))
    told = met.withColumn("exact", exact).withColumns({"n": F.count(F.lit(1)).over(each), "n_exact": F.count_if("exact").over(each)})
    return told.where((F.col("n") == 1) | (F.col("n_exact") != 1) | F.col("exact")).select("at", "nombre", "document_id")


def bulk_history(relations: DataFrame, documents: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """(nombre, articulo, history): up to ``limit`` sentences, latest first, for each asked pair with an article."""
    asked = stored(pairs.select("nombre", "articulo").where("articulo <> ''").distinct(), "asked")
    key = lambda c: F.upper(F.trim(c))
    ids = laws_matching(documents, asked).select("nombre", F.col("document_id").alias("from_document_id"))
    wanted = stored(asked.join(ids, "nombre").withColumn("key", key("articulo")), "wanted")  # its size is known: edges need not move to it
    met = named(relations, documents).withColumn("key", key("from_articulo")).join(wanted, ["from_document_id", "key"])
    order = Window.partitionBy("nombre", "articulo").orderBy(F.desc_nulls_last("fecha"), "from_chunk_id", "source_text")
    latest = met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).withColumn("said", sentence())
    told = latest.groupBy("nombre", "articulo").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x.said).alias("history"))
    return asked.join(told, ["nombre", "articulo"], "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))


def with_history(citations: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations (document_nombre, articulo_numero, more) with ``historial``: the sentences of their article, or none."""
    pairs = citations.select(F.col("document_nombre").alias("nombre"), F.col("articulo_numero").alias("articulo"))
    found = stored(bulk_history(relations, documents, pairs), "histories").select(F.col("nombre").alias("document_nombre"), F.col("articulo").alias("articulo_numero"), F.col("history").alias("historial"))
    return citations.join(found, ["document_nombre", "articulo_numero"], "left").withColumn("historial", F.coalesce("historial", F.array().cast("array<string>")))


def find_article(chunks: DataFrame, documents: DataFrame, law: str, article: str) -> DataFrame:
    """The article's first piece, if the name means one law only; no row if it stays ambiguous."""
    ids = laws_named(documents.where("is_active"), law)
    met = chunks.join(ids.select(F.col("id").alias("document_id"), "nombre"), "document_id").where(F.upper("articulo_numero") == article.upper())
    one = met.agg(F.countDistinct("document_id").alias("laws"))
    return met.join(F.broadcast(one)).where("laws = 1").orderBy("chunk_id").limit(1).drop("laws")


def ambiguous_laws(chunks: DataFrame, documents: DataFrame, law: str, article: str) -> DataFrame:
    """Names of the laws among which a lookup cannot decide, in order; none if it can."""
    ids = laws_named(documents.where("is_active"), law)
    met = chunks.join(ids.select(F.col("id").alias("document_id"), "nombre"), "document_id").where(F.upper("articulo_numero") == article.upper())
    names = met.select("nombre").distinct()
    n = names.agg(F.count(F.lit(1)).alias("n"))
    return names.join(F.broadcast(n)).where("n > 1").select("nombre").orderBy("nombre")


def other_side(relations: DataFrame, documents: DataFrame, law: str) -> DataFrame:
    """Edges that touch a law, each with the law on its other side."""
    rows = named(relations, documents)
    own = F.lower(F.trim("from_nombre")) == law.strip().lower()
    other = F.lower(F.trim("to_law_name_raw")) == law.strip().lower()
    return rows.where(own | other).withColumn("other", F.when(own, F.col("to_law_name_raw")).otherwise(F.col("from_nombre")))


def as_chunks(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges in the form of retrieved chunks; their similarity is no search score, so they pass no threshold."""
    rows = named(relations, documents)
    return rows.select(
        F.coalesce("from_chunk_id", F.lit(-1)).alias("chunk_id"), F.col("from_nombre").alias("document_nombre"), F.col("from_articulo").alias("articulo_numero"),
        sentence().alias("content"), F.lit(1.0).alias("similarity"), F.lit(False).alias("passed_threshold"),
    )
