"""Queries over laws and their amendments: chunking, markers, history, catalogues, ingest.

Nations stand for laws and lines of orders for their articles, written out with headings, notes and
markers; each order is a law text of its own. What the operators must find is told by the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from normata.functions import tables as T
from normata.operators import catalog as K
from normata.operators import chunking as C
from normata.operators import relations as L
from normata.plans import adapters as A
from normata.plans.texts import ORACLE_SQL as TEXTS
from normata.sources import tables as S
from normata.sources.scratch import new_folder, remove, stored

HEAD = "(El ejecutivo publica la presente)\nArticulo 1.- De un indice.\nPAGINA\n"
TAIL = "T R A N S I T O R I O S\nArticulo 1.- Fuera."


def articles(spark, d):
    return A.build(spark, d, A.ARTICLES, "lineitem")


def nations(spark, d):
    return A.build(spark, d, A.NATION_LAWS, "nation")


def law_texts(spark, d):
    """One text per order: headings before articles 1, 3 and 5, a page number and the law's name among the lines."""
    heading = F.when(F.col("n") == 1, "TITULO PRIMERO\nCAPITULO I\n").when(F.col("n") == 3, "CAPITULO II DISPOSICIONES GENERALES.\n").when(F.col("n") == 5, "TITULO SEGUNDO.\nSECCION UNICA\n").otherwise("")
    body = F.concat(heading, F.col("content"), F.lit("\n12\n"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("LEY "), "law", F.lit("\n"))).otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("body")))), lambda x: x.body), "")
    each = articles(spark, d).groupBy("law").agg(text.alias("text"))
    return each.select(F.col("law").alias("id"), F.concat(F.lit("Ley "), "law").alias("nombre"), F.concat("text", F.lit(TAIL)).alias("raw_text"))


def relations(spark, d):
    return L.build_relations(articles(spark, d).select("document_id", "chunk_id", F.col("label").alias("articulo_numero"), "content"), nations(spark, d))


def edges(spark, d):
    rows = relations(spark, d)
    return rows.select(
        "from_document_id", "from_chunk_id", "from_articulo", "relation_type", "to_document_id", "to_law_name_raw", F.col("fecha").cast("string").alias("fecha"), "source_text", "extraction_method", "is_self"
    )


def chunked(strict):
    return lambda spark, d: C.chunk_laws(law_texts(spark, d), strict)


def started(spark, d):
    texts = law_texts(spark, d).withColumn("raw_text", F.concat(F.lit(HEAD), "raw_text"))
    begun = texts.withColumn("line", C.law_start(F.col("raw_text")))
    return begun.select("id", "line", F.length(C.from_line(F.col("raw_text"), F.col("line"))).alias("chars"))


def whole_laws(spark, d):
    """One text for each document: its articles, from the orders of all laws, a row for each part of it, since a text grows with the tables."""
    return articles(spark, d).select(F.col("document_id").alias("id"), F.concat(F.lit("Ley de NATION_"), "document_id").alias("nombre"), F.col("chunk_id").alias("part"), F.col("content").alias("raw_text"))


def ingested(spark, d):
    """A load of every law into a new folder: what the log tells."""
    folder = new_folder(spark, "ingest")
    out = S.ingest(spark, stored(whole_laws(spark, d), "laws"), f"{folder}/chunks", f"{folder}/log", "m1", documents=nations(spark, d))
    remove(spark, f"{folder}/chunks")
    return out.select("document_id", "chunks_created", "status")


def ingested_again(spark, d):
    """Three loads: all laws; a third of them again, with texts that have no article any more; another third beside what is there."""
    folder = new_folder(spark, "ingest")
    laws = stored(whole_laws(spark, d), "laws")
    load = lambda rows, replace: S.ingest(spark, rows, f"{folder}/chunks", f"{folder}/log", "m1", replace)
    load(laws, True)
    load(laws.where("id % 3 = 0").withColumn("raw_text", F.concat(F.lit("Abrogada: "), "nombre")), True)
    load(laws.where("id % 3 = 1"), False)
    left = S.read_chunks(spark, f"{folder}/chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    log = S.ingestion_log(spark, f"{folder}/log").where("status = 'success'").groupBy("document_id").agg(F.count(F.lit(1)).alias("loads"), F.sum("chunks_created").alias("written"))
    return log.join(left, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))


def texts_read(spark, d):
    """Every law as a text file of its own, read back whole."""
    folder = new_folder(spark, "law_texts")
    parts = whole_laws(spark, d).repartition("id").sortWithinPartitions("id", "part", "raw_text")  # each is written as it comes
    parts.select("id", "raw_text").write.partitionBy("id").text(folder)
    rows = S.read_law_texts(spark, folder)
    return rows.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("int").alias("id"), F.length("raw_text").alias("chars"), F.md5("raw_text").alias("md5"))


def rebuilt(spark, d):
    """The edges, written twice to the same place."""
    path = new_folder(spark, "edges")
    rows = stored(relations(spark, d), "relations")
    for _ in range(2):
        S.rebuild_relations(rows, path)
    return spark.read.parquet(path).groupBy("from_document_id", "relation_type").agg(F.count(F.lit(1)).alias("n"), F.count("fecha").alias("dated"))


def piece_rows(spark, d):
    """Pieces of at most 90 characters, with part and total where an article has several."""
    rows = S.chunk_rows(law_texts(spark, d), "m1", 90)
    return rows.select("document_id", "articulo_numero", F.col("chunk_metadata.parte").alias("parte"), F.col("chunk_metadata.partes_totales").alias("partes_totales"), F.length("content").alias("chars"), (F.length("embedding_text") - F.length("content")).alias("header"))


def bulk(spark, d):
    pairs = articles(spark, d).join(nations(spark, d).select(F.col("id").alias("document_id"), "nombre"), "document_id").select("nombre", F.col("label").alias("articulo"))
    return L.bulk_history(relations(spark, d), nations(spark, d), pairs).select("nombre", "articulo", F.array_join("history", "|").alias("history"))


def enriched(spark, d):
    cited = articles(spark, d).join(nations(spark, d).select(F.col("id").alias("document_id"), "nombre"), "document_id").select("chunk_id", F.col("nombre").alias("document_nombre"), F.col("label").alias("articulo_numero"))
    out = L.with_history(cited, relations(spark, d), nations(spark, d))
    return out.select("chunk_id", F.size("historial").alias("n"), F.length(F.array_join("historial", "|")).alias("chars"))


def reforms(spark, d):
    return law_texts(spark, d).select("id", L.last_reform(F.col("raw_text")).cast("string").alias("last_reform"))


def turns(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    asked = rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("question"), F.when(F.col("turn") % 4 == 0, F.col("text")).alias("answer"), F.when(F.col("turn") % 4 > 0, F.repeat("text", F.lit(100))).alias("error"), (F.col("conv_id") % 2 == 0).alias("grounded"))
    out = S.turn_rows(asked)
    return out.select("conversation_id", "position", "role", F.length("content").alias("chars"), "found_answer", F.length("error_message").alias("error_chars"))


def chunked_in_sql(spark, d):
    """Articles by the table function, in SQL."""
    T.register(spark)
    T.lines_view(law_texts(spark, d), "normata_lines")
    return spark.sql("SELECT * FROM chunk_law(TABLE(normata_lines) PARTITION BY id ORDER BY at)")


def markers_in_sql(spark, d):
    T.register(spark)
    articles(spark, d).createOrReplaceTempView("normata_articles")
    return spark.sql("SELECT * FROM extract_markers(TABLE(SELECT document_id, chunk_id, label AS articulo_numero, content FROM normata_articles))")


def pieces_in_sql(spark, d):
    T.register(spark)
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("normata_texts")
    return spark.sql("""SELECT id AS doc_id, max(total) AS n_pieces, max(length(content)) AS longest, sum(length(content)) AS chars
      FROM split_pieces(TABLE(SELECT doc_id AS id, text AS content FROM normata_texts)) GROUP BY id""")


def catalogue_pages(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    page = F.concat(
        F.lit("<html><table><tr><th colspan=\"8\">LEYES</th></tr><tr onclick=\"abrir('https://h.example/"), key, F.when(F.col("s_suppkey") % 3 == 0, ".doc").when(F.col("s_suppkey") % 3 == 1, ".PDF?v=1").otherwise(".pdf"),
        F.lit("')\"><td>1</td><td> <b>Ley</b> de "), "s_name", F.lit(" </td></tr>\n<tr id=\"fila\"><td>1</td><td>Decreto "), "s_name", F.lit("</td><td><a href=\"/d/"), key, F.when(F.col("s_suppkey") % 2 == 0, ".pdf").otherwise(".html"),
        F.lit("\"><img></a></td></tr><tr id=\"fila\"><td>solo</td><td>dos</td></tr></table></html>"),
    )
    return rows.select(F.col("s_suppkey").alias("page_id"), page.alias("html"))


def marked_catalogues(spark, d):
    """A page for each supplier: references in names and addresses, rows in comments, and tables within cells."""
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    page = F.concat(
        F.lit("<table><!-- <tr onclick=\"x('no.pdf')\"><td>1</td><td>No</td></tr> --><tr title=\"a > b\" onclick=\"abrir(&quot;x&quot;, 'https://h.example/ver.pdf?a=1&amp;k="), key,
        F.lit("')\"><td>1</td><td> Ley &amp; <b>&lt;"), "s_name", F.lit("&gt;</b><!-- > --> </td></tr><tr><td><table><TR ID='fila'><td>1</td><td>Decreto &#233; "), "s_name",
        F.lit("</td><td><table><tr id=\"otra\"><td><a name=\"n\"></a><a href='/d/a&amp;b"), key, F.when(F.col("s_suppkey") % 3 == 0, ".html").otherwise(".PDF"), F.lit("'></a></td></tr></table></td></TR></table></td></tr></table>"),
    )
    return rows.select(F.col("s_suppkey").alias("page_id"), page.alias("html"))


def read_marked(spark, d):
    pages = marked_catalogues(spark, d)
    return S.catalog_by_onclick(pages).withColumn("reader", F.lit("onclick")).unionByName(S.catalog_by_row(pages, "fila").withColumn("reader", F.lit("row")))


def sourced(spark, d):
    return A.build(spark, d, A.SOURCED, "supplier")


def entries(spark, d):
    return A.build(spark, d, A.ENTRIES, "supplier")


def totals(spark, d):
    return L.history_total(relations(spark, d), nations(spark, d), "ley de nation_7")


QUERIES = {
    "chunk_law_sql": chunked_in_sql,
    "extract_markers_sql": markers_in_sql,
    "split_pieces_sql": pieces_in_sql,
    "law_chunks": chunked(False),
    "law_chunks_strict": chunked(True),
    "law_start": started,
    "ingest_log": ingested,
    "ingest_again": ingested_again,
    "ingest_pieces": piece_rows,
    "law_texts_read": texts_read,
    "relations_rebuilt": rebuilt,
    "last_reforms": reforms,
    "relations": edges,
    "relation_counters": lambda s, d: L.extraction_counters(relations(s, d)),
    "law_history": lambda s, d: L.law_history(relations(s, d), nations(s, d), "ley de nation_7").select("from_chunk_id", "relation_type"),
    "article_history": lambda s, d: L.law_history(relations(s, d), nations(s, d), "Ley de NATION_2", " 1-a ").select("from_chunk_id", "relation_type"),
    "history_total": totals,
    "bulk_history": bulk,
    "citation_history": enriched,
    "relation_explorer": lambda s, d: L.other_side(relations(s, d), nations(s, d), "ley de nation_3").select("from_chunk_id", "other"),
    "relation_chunks": lambda s, d: L.as_chunks(relations(s, d), nations(s, d)).groupBy("document_nombre").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")),
    "catalog_updates": lambda s, d: K.detect_updates(sourced(s, d), entries(s, d)).select("id", "status"),
    "catalog_new_laws": lambda s, d: K.new_laws(sourced(s, d), entries(s, d)),
    "catalog_by_onclick": lambda s, d: S.catalog_by_onclick(catalogue_pages(s, d)),
    "catalog_by_row": lambda s, d: S.catalog_by_row(catalogue_pages(s, d), "fila"),
    "catalog_marks": read_marked,
    "turn_rows": turns,
}

ART = f"WITH a AS ({A.oracle(A.ARTICLES, 'lineitem')}), l AS ({A.oracle(A.NATION_LAWS, 'nation')})"
# Which marker an article has, and what it says.
REL = ART + """, r AS (SELECT document_id AS from_document_id, chunk_id AS from_chunk_id, label AS from_articulo, CASE WHEN flag = 'R' THEN 'reforma' WHEN flag = 'A' AND status = 'F' THEN 'adiciona' WHEN flag = 'A' THEN 'deroga' ELSE 'adiciona' END AS relation_type,
    CASE WHEN flag = 'A' AND status <> 'F' THEN CASE WHEN part % 7 > 0 THEN CAST(part % 25 AS INT) END ELSE document_id END AS to_document_id,
    CASE WHEN flag = 'A' AND status <> 'F' THEN CASE WHEN part % 7 > 0 THEN 'LEY DE NATION_' || part % 25 ELSE 'LEY DESCONOCIDA' END ELSE nombre END AS to_law_name_raw,
    CASE WHEN flag <> 'N' THEN CAST(day_of AS VARCHAR) END AS fecha, marker AS source_text, CASE WHEN flag = 'R' OR flag = 'A' AND status <> 'F' THEN 'regex' WHEN flag = 'A' THEN 'regex_publicada' ELSE 'regex_se_verbo' END AS extraction_method,
    NOT (flag = 'A' AND status <> 'F') AS is_self, nombre FROM a JOIN l ON l.id = a.document_id WHERE marker IS NOT NULL)"""
SAID = """, s AS (SELECT *, 'El articulo ' || from_articulo || ' de ' || nombre || ' ' || CASE relation_type WHEN 'reforma' THEN 'fue reformado' WHEN 'deroga' THEN 'fue derogado' ELSE 'fue adicionado' END || ' el '
    || coalesce(day(CAST(fecha AS DATE)) || ' de ' || (['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'])[month(CAST(fecha AS DATE))] || ' de ' || year(CAST(fecha AS DATE)), 'en una fecha no especificada en el marcador') || ', '
    || CASE WHEN to_document_id = from_document_id THEN 'mediante una reforma registrada dentro de la misma ley (el marcador no nombra a otra ley distinta)'
      ELSE 'por ' || to_law_name_raw || CASE WHEN to_document_id IS NULL THEN ' (esa ley no esta en el corpus ingerido actualmente, no se puede mostrar su contenido)' ELSE '' END END
    || '. Marcador original del Periodico Oficial: "' || source_text || '".' AS said FROM r)"""
# A heading keeps what stands below it; the law's name and page numbers go.
CHUNK = """SELECT law AS document_id, {position} AS position, label AS articulo_numero, CASE WHEN n >= 5 THEN 'SEGUNDO' ELSE 'PRIMERO' END AS titulo, CASE WHEN {second} THEN 'II' ELSE 'I' END AS capitulo,
  CASE WHEN n >= 5 THEN 'UNICA' END AS seccion, content{more} AS content FROM a"""
PAIRS = """, p AS (SELECT DISTINCT l.nombre, label AS articulo, document_id FROM a JOIN l ON l.id = a.document_id), h AS (SELECT nombre, from_articulo AS articulo, string_agg(said, '|' ORDER BY o) AS history, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY nombre, from_articulo ORDER BY fecha DESC NULLS LAST, from_chunk_id, source_text) AS o FROM s WHERE from_document_id IN (SELECT id FROM l WHERE is_active)) WHERE o <= 10 GROUP BY 1, 2)"""
ORACLE_SQL = {
    "chunk_law_sql": ART + CHUNK.format(position="CAST(n AS INT)", second="n >= 3", more=""),
    "extract_markers_sql": REL + "SELECT from_document_id AS document_id, from_chunk_id AS chunk_id, from_articulo AS articulo_numero, extraction_method, source_text FROM r",
    "split_pieces_sql": TEXTS["embedding_pieces"],
    "law_chunks": ART + CHUNK.format(position="CAST(n AS INT)", second="n >= 3", more=""),
    # Strict reading takes no heading with a title, which stays with the article before it, and reads on after the transitory heading.
    "law_chunks_strict": ART + CHUNK.format(position="CAST(n AS INT)", second="false", more=" || CASE WHEN n = 2 AND lead(n) OVER (PARTITION BY law ORDER BY n) = 3 THEN chr(10) || 'CAPITULO II DISPOSICIONES GENERALES.' ELSE '' END")
    + " UNION ALL SELECT law, CAST(max(n) + 1 AS INT), '1', CASE WHEN max(n) >= 5 THEN 'SEGUNDO' ELSE 'PRIMERO' END, 'I', CASE WHEN max(n) >= 5 THEN 'UNICA' END, 'Articulo 1.- Fuera.' FROM a GROUP BY 1",
    "law_start": ART + """, t AS (SELECT law AS id, sum(length(content) + 4 + CASE WHEN n = 1 THEN 26 WHEN n = 3 THEN 37 WHEN n = 5 THEN 30 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 5 + length(CAST(law AS VARCHAR)) ELSE 0 END) AS chars,
        bool_or(n = 1 AND part % 5 > 0) AND bool_or(n = 2 AND part % 5 > 0) AS pair, bool_or(n = 2 AND part % 5 > 0) AS two, bool_or(n = 1 AND part % 5 > 0) AS one FROM a GROUP BY 1)
      SELECT id, CASE WHEN pair THEN 3 WHEN two THEN 1 ELSE 0 END AS line, CAST(chars + 43 + CASE WHEN pair THEN 0 WHEN two THEN 34 ELSE 69 END AS INT) AS chars FROM t""",
    "ingest_log": ART + "SELECT CAST(document_id AS BIGINT) AS document_id, count(*) AS chunks_created, 'success' AS status FROM a GROUP BY 1",
    "ingest_again": ART + """SELECT CAST(document_id AS BIGINT) AS document_id, CASE WHEN document_id % 3 = 2 THEN 1 ELSE 2 END AS loads, CAST(count(*) * CASE WHEN document_id % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS written,
      CAST(count(*) * (CASE document_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS chunks FROM a GROUP BY document_id""",
    "ingest_pieces": ART + """, x AS (SELECT *, length(content) > 90 AS cut, 'Ley ' || law || ', Titulo ' || CASE WHEN n >= 5 THEN 'SEGUNDO' ELSE 'PRIMERO' END || ', Capitulo ' || CASE WHEN n >= 3 THEN 'II' ELSE 'I' END || ', Articulo ' || label || ': ' AS head FROM a)
      SELECT law AS document_id, label AS articulo_numero, CASE WHEN cut THEN 1 END AS parte, CASE WHEN cut THEN 2 END AS partes_totales, CAST(length(content) - CASE WHEN cut THEN length(marker) + 1 ELSE 0 END AS INT) AS chars, CAST(length(head) AS INT) AS header FROM x
      UNION ALL SELECT law, label, 2, 2, CAST(length(marker) AS INT), CAST(length(head) AS INT) FROM x WHERE cut""",
    "law_texts_read": ART + """SELECT document_id AS id, CAST(length(t) AS INT) AS chars, md5(t) AS md5 FROM (SELECT document_id, string_agg(content, chr(10) ORDER BY chunk_id, content) || chr(10) AS t FROM a GROUP BY 1)""",
    "relations_rebuilt": REL + "SELECT from_document_id, relation_type, count(*) AS n, count(fecha) AS dated FROM r GROUP BY 1, 2",
    "last_reforms": ART + "SELECT law AS id, max(CAST(day_of AS VARCHAR)) FILTER (WHERE flag = 'R') AS last_reform FROM a GROUP BY 1",
    "relations": REL + "SELECT * EXCLUDE (nombre) FROM r",
    "relation_counters": REL + "SELECT count(*) FILTER (WHERE is_self) AS auto_mod, count(*) FILTER (WHERE NOT is_self AND to_document_id IS NOT NULL) AS cross_resolved, count(*) FILTER (WHERE NOT is_self AND to_document_id IS NULL) AS cross_unresolved, count(*) FILTER (WHERE fecha IS NULL) AS skipped_no_date FROM r",
    "law_history": REL + "SELECT from_chunk_id, relation_type FROM r WHERE from_document_id = 7 OR to_document_id = 7 ORDER BY fecha DESC NULLS LAST, from_chunk_id, source_text LIMIT 20",
    "article_history": REL + "SELECT from_chunk_id, relation_type FROM r WHERE from_document_id = 2 AND from_articulo = '1-A' ORDER BY fecha DESC NULLS LAST, from_chunk_id, source_text LIMIT 20",
    "history_total": REL + "SELECT count(*) AS total, greatest(count(*) - 20, 0) AS omitted FROM r WHERE from_document_id = 7 OR to_document_id = 7",
    "bulk_history": REL + SAID + PAIRS + "SELECT p.nombre, p.articulo, coalesce(history, '') AS history FROM p LEFT JOIN h ON h.nombre = p.nombre AND h.articulo = p.articulo",
    "citation_history": REL + SAID + PAIRS + "SELECT chunk_id, CAST(coalesce(h.n, 0) AS INT) AS n, CAST(coalesce(length(history), 0) AS INT) AS chars FROM a JOIN l ON l.id = a.document_id LEFT JOIN h ON h.nombre = l.nombre AND h.articulo = a.label",
    "relation_explorer": REL + "SELECT from_chunk_id, CASE WHEN from_document_id = 3 THEN to_law_name_raw ELSE nombre END AS other FROM r WHERE from_document_id = 3 OR lower(to_law_name_raw) = 'ley de nation_3'",
    "relation_chunks": REL + SAID + "SELECT nombre AS document_nombre, count(*) AS n, CAST(sum(length(said)) AS BIGINT) AS chars FROM s GROUP BY 1",
    "catalog_updates": """SELECT CAST(s_suppkey AS INT) AS id, CASE WHEN s_suppkey % 7 = 3 THEN 'unknown_source' WHEN s_suppkey % 5 = 0 THEN 'sin_match' WHEN s_suppkey % 5 = 3 THEN 'ambiguo' WHEN s_suppkey % 5 = 2 THEN 'changed' ELSE 'unchanged' END AS status FROM supplier""",
    "catalog_new_laws": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'LEY  NUEVA ' ELSE 'Ley Nueva ' END || s_name || 'X' || s_nationkey AS nombre FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 UNION ALL SELECT 'LEY  NUEVA ' || s_name || 'X' || s_nationkey FROM supplier WHERE s_suppkey % 12 = 0",
    "catalog_by_onclick": "SELECT s_suppkey AS page_id, 'Leyde ' || s_name AS nombre, 'https://h.example/' || s_suppkey || CASE WHEN s_suppkey % 3 = 1 THEN '.PDF?v=1' ELSE '.pdf' END AS source_url FROM supplier WHERE s_suppkey % 3 > 0",
    "catalog_by_row": "SELECT s_suppkey AS page_id, 'Decreto ' || s_name AS nombre, '/d/' || s_suppkey || '.pdf' AS source_url FROM supplier WHERE s_suppkey % 2 = 0",
    "catalog_marks": """SELECT s_suppkey AS page_id, 'Ley &<' || s_name || '>' AS nombre, 'https://h.example/ver.pdf?a=1&k=' || s_suppkey AS source_url, 'onclick' AS reader FROM supplier
      UNION ALL SELECT s_suppkey, 'Decreto é ' || s_name, '/d/a&b' || s_suppkey || '.PDF', 'row' FROM supplier WHERE s_suppkey % 3 > 0""",
    "turn_rows": """SELECT conv_id AS conversation_id, CAST(turn * 2 AS INT) AS position, 'user' AS role, length(text) AS chars, CAST(NULL AS BOOLEAN) AS found_answer, CAST(NULL AS INT) AS error_chars FROM conversations WHERE role = 'user'
      UNION ALL SELECT conv_id, CAST(turn * 2 + 1 AS INT), 'assistant', CASE WHEN turn % 4 = 0 THEN length(text) ELSE 0 END, CASE WHEN turn % 4 = 0 THEN conv_id % 2 = 0 END, CASE WHEN turn % 4 > 0 THEN least(100 * length(text), 4000) END FROM conversations WHERE role = 'user'""",
}
