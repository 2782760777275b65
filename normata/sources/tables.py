"""Reading laws and catalogues, and writing tables with the ingest semantics of the engine."""

from __future__ import annotations

import traceback
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.functions.html import html_rows
from normata.operators.chunking import embedding_pieces, embedding_text, law_articles
from normata.sources.schemas import ALLOWED
from normata.sources.versions import read_versions, write_version

#: What :func:`chunk_rows` gives, and the rows of the log.
CHUNK_ROWS = (
    "document_id long, position int, articulo_numero string, titulo string, capitulo string, seccion string, content string, "
    "chunk_metadata struct<titulo: string, capitulo: string, seccion: string, parte: int, partes_totales: int>, embedding_text string, embedding_model string"
)
LOG = "run string, document_id long, chunks_created long, status string, error_message string, started_at timestamp, completed_at timestamp"


def read_law_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw_text) of processed text files, one law a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"))


def read_binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of source files; extracting text from them needs a PDF library of the caller's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def catalog_by_link(pages: DataFrame) -> DataFrame:
    """(page_id, nombre, source_url) of table rows whose link opens a PDF and whose second cell names the law."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<tr.*?</tr>"), 0)).alias("row"))
    url = F.regexp_extract("row", r"(?i)(?:onclick|href)\s*=\s*[\"'].*?((?:https?:)?//[^\"'\s)]+?\.pdf(?:\?[^\"'\s)]*)?)", 1)
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))
    found = rows.select("page_id", url.alias("source_url"), cells.alias("cells")).where((F.col("source_url") != "") & (F.size("cells") >= 2))
    return found.select("page_id", text(F.col("cells")[1]).alias("nombre"), "source_url")


def catalog_by_onclick(pages: DataFrame) -> DataFrame:
    """(page_id, nombre, source_url): rows that open a PDF by ``onclick``; the second cell names the law."""
    rows = pages.select("page_id", F.explode(html_rows(F.col("html"))).alias("row")).where(F.size("row.cells") >= 2)
    url = F.regexp_extract("row.onclick", "'([^']+)'", 1)
    found = rows.select("page_id", F.col("row.cells")[1]["text"].alias("nombre"), url.alias("source_url"))
    return found.where((F.col("nombre") != "") & F.lower("source_url").rlike(r"\.pdf$|\.pdf\?"))


def catalog_by_row(pages: DataFrame, row_id: str) -> DataFrame:
    """(page_id, nombre, source_url): rows with an id and three cells or more, the second the name, the third a link to a PDF."""
    rows = pages.select("page_id", F.explode(html_rows(F.col("html"))).alias("row")).where((F.col("row.id") == row_id) & (F.size("row.cells") >= 3))
    found = rows.select("page_id", F.col("row.cells")[1]["text"].alias("nombre"), F.col("row.cells")[2]["href"].alias("source_url"))
    return found.where((F.col("nombre") != "") & F.lower("source_url").endswith(".pdf"))


def documents_by_id(documents: DataFrame) -> DataFrame:
    """All documents, in force or not, in the order of their ids."""
    return documents.orderBy("id")


def checked(df: DataFrame) -> DataFrame:
    """``df``, failing on values outside :data:`ALLOWED`, as the tables' constraints would."""
    for column, values in ALLOWED.items():
        if column in df.columns:
            bad = F.col(column).isNotNull() & ~F.col(column).isin(*values)
            df = df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{column} may not be "), F.col(column))).cast("string")).otherwise(F.col(column)))
    return df


def replace_documents(chunks: DataFrame, documents: DataFrame, path: str) -> dict:
    """Put ``chunks`` in place of all chunks of ``documents`` (document_id), those without chunks included."""
    return write_version(chunks, path, "document_id", documents)


def chunk_rows(laws: DataFrame, model: str, limit: int = 900) -> DataFrame:
    """Rows of the chunk table for laws (id, nombre, raw_text, perhaps in rows by part): the pieces of their articles, with the text to embed."""
    each = embedding_pieces(law_articles(laws), limit)
    meta = F.struct("titulo", "capitulo", "seccion", "parte", "partes_totales")
    text = embedding_text(F.col("nombre"), F.col("titulo"), F.col("capitulo"), F.col("articulo_numero"), F.col("content"))
    return each.select(
        "document_id", "position", "articulo_numero", "titulo", "capitulo", "seccion", "content", meta.alias("chunk_metadata"), text.alias("embedding_text"), F.lit(model).alias("embedding_model")
    )


def ingest(spark: SparkSession, laws: DataFrame, chunks_path: str, log_path: str, model: str, replace: bool = True, documents: DataFrame | None = None) -> DataFrame:
    """Write the chunks of ``laws`` (id, nombre, raw_text) and log it: the closing row of each law.

    ``replace``: the laws' old chunks go, also those of a law that has no article any more; else the new ones
    come beside them. All laws of a call succeed or fail together: a failure leaves every old chunk. The log
    gets a row ``running`` for each law, then one ``success`` with the chunks that this call wrote, or one ``failed``
    with the first 4000 characters of the traceback, which is raised. With ``documents`` (id), a law that is not among
    them is a failure.
    """
    ids = laws.select(F.col("id").cast("long").alias("document_id")).distinct()
    run = uuid.uuid4().hex

    def log(status: str, counts: DataFrame, error: str | None = None) -> DataFrame:
        now = F.current_timestamp()
        rows = counts.select(
            F.lit(run).alias("run"), "document_id", "chunks_created", F.lit(status).alias("status"), F.left(F.lit(error).cast("string"), F.lit(4000)).alias("error_message"),
            F.when(F.lit(status == "running"), now).alias("started_at"), F.when(F.lit(status != "running"), now).alias("completed_at"),
        )
        rows.write.mode("append").parquet(log_path)
        return spark.read.schema(LOG).parquet(log_path).where((F.col("run") == run) & (F.col("status") == status))

    nothing = ids.withColumn("chunks_created", F.lit(None).cast("long"))
    log("running", nothing)
    try:
        if documents is not None:
            unknown = ids.join(documents.select(F.col("id").cast("long").alias("document_id")), "document_id", "left_anti").limit(10).collect()
            if unknown:
                raise ValueError("no document " + ", ".join(str(r.document_id) for r in unknown))
        rows = chunk_rows(laws, model)
        made = replace_documents(rows, ids, chunks_path) if replace else write_version(rows, chunks_path, "document_id")
    except Exception:
        log("failed", nothing, traceback.format_exc())
        raise
    files = [f"{chunks_path}/{f}" for f in made["files"]]
    own = spark.read.schema("document_id long").parquet(*files) if files else spark.createDataFrame([], "document_id long")
    written = own.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks_created"))
    return log("success", ids.join(written, "document_id", "left").withColumn("chunks_created", F.coalesce("chunks_created", F.lit(0).cast("long"))))


def read_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunk table that :func:`ingest` writes."""
    return read_versions(spark, path, CHUNK_ROWS, "document_id", version)


def ingestion_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each law and call, as far as it came: ``running`` until its closing row is there."""
    rows = spark.read.schema(LOG).parquet(path)
    ended = F.max(F.when(F.col("status") != "running", F.struct("status", "chunks_created", "error_message", "completed_at"))).alias("end")
    one = rows.groupBy("run", "document_id").agg(ended, F.min("started_at").alias("started_at"))
    return one.select("run", "document_id", F.coalesce("end.status", F.lit("running")).alias("status"), "end.chunks_created", "end.error_message", "started_at", "end.completed_at")


def rebuild_relations(relations: DataFrame, path: str) -> None:
    """Write all edges anew; running it twice gives the same table."""
    checked(relations).write.mode("overwrite").parquet(path)


def upsert_conversations(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` plus the rows of ``new`` whose (platform, chat_id) is not there yet, one each: the earliest."""
    first = Window.partitionBy("platform", "chat_id").orderBy("started_at", "id")
    once = new.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    return known.unionByName(once.join(known, ["platform", "chat_id"], "left_anti").select(known.columns))


def deactivate(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` with those of ``ids`` (id) no longer active."""
    gone = ids.select("id", F.lit(True).alias("__gone")).distinct()
    joined = documents.join(gone, "id", "left")
    return joined.withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone").select(documents.columns)


def count_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """``cache`` with hits (cache_id, at) added to its counters."""
    by = hits.groupBy(F.col("cache_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    joined = cache.join(by, "id", "left")
    return joined.withColumns(
        {"hit_count": (F.col("hit_count") + F.coalesce("__n", F.lit(0))).cast("int"), "last_used_at": F.coalesce("__at", "last_used_at")}
    ).select(cache.columns)


def to_reembed(chunks: DataFrame, documents: DataFrame, model: str, inactive: bool = False) -> DataFrame:
    """Chunks embedded by another model than ``model``, in the order of their ids."""
    laws = documents if inactive else documents.where("is_active")
    return chunks.where(F.col("embedding_model") != model).join(laws.select(F.col("id").alias("document_id")), "document_id", "left_semi").orderBy("id")


def valid_feedback(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback whose message belongs to a web conversation of the same session (chat_id)."""
    web = conversations.where(F.col("platform") == "web").select(F.col("id").alias("conversation_id"), "chat_id")
    own = messages.join(web, "conversation_id").select(F.col("id").alias("message_id"), "chat_id")
    return feedback.join(own, ["message_id", "chat_id"], "left_semi")


def turn_rows(turns: DataFrame) -> DataFrame:
    """Two message rows per turn: the question, then the answer or the error (cut to 4000 characters)."""
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("boolean").alias("found_answer"), F.lit(None).cast("string").alias("error_message")),
        F.struct(
            F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("content"),
            F.when(F.col("error").isNull(), F.col("grounded")).alias("found_answer"), F.left("error", F.lit(4000)).alias("error_message"),
        ),
    )
    return turns.select("conversation_id", "turn", F.posexplode(both).alias("at", "row")).select("conversation_id", (F.col("turn") * 2 + F.col("at")).alias("position"), "row.*")


def load_check(chunks: DataFrame) -> DataFrame:
    """Rows, embedded rows and model per document after a load."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.min("embedding_model").alias("model"))
