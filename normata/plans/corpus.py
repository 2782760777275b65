"""Queries over laws: relations and their history, lookups, catalogue changes, gates, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from normata.operators import catalog as K
from normata.operators import models as M
from normata.operators import relations as L
from normata.plans import adapters as A
from normata.sources import tables as S

def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def chunk_table(spark, d):
    return documents(spark, d).select(F.expr("CAST(substring(source, 4) AS INT)").alias("document_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).cast("string").alias("articulo_numero"), F.col("text").alias("content"))


def numbered(spark, d):
    """Articles 0 to 49 of which 13 and some runs have no number, and one law has none at all."""
    label = F.when(F.expr("document_id = 7 OR chunk_id % 50 IN (13, 20, 21, 22)"), "").when(F.expr("chunk_id % 50 = 30"), None).otherwise(F.concat("articulo_numero", F.lit(" BIS")))
    return chunk_table(spark, d).withColumn("articulo_numero", label)


def law_table(spark, d):
    return A.build(spark, d, A.LAWS, "documents")


def pieces_of_laws(spark, d):
    chunks = A.build(spark, d, A.CHUNKS, "documents").join(law_table(spark, d).select("nombre", F.col("id").alias("document_id")), "nombre").drop("nombre")
    return chunks.withColumn("articulo_numero", (F.col("chunk_id") % 7).cast("string"))


def article(spark, d):
    return L.find_article(pieces_of_laws(spark, d), law_table(spark, d), "ley src12", "6").select("chunk_id", "articulo_numero")


def ambiguous(spark, d):
    return L.ambiguous_laws(pieces_of_laws(spark, d), law_table(spark, d), "src1", "6")


def duplicates(spark, d):
    texts = documents(spark, d)
    new = texts.where("doc_id % 2 = 1").select((F.col("doc_id") % 20).alias("document_id"), F.col("text").alias("content"))
    old = texts.where("doc_id % 2 = 0").select((F.col("doc_id") % 20).alias("document_id"), F.col("text").alias("content"))
    return K.duplicate_ratio(new, old).select("document_id", "keys", "hits", "ratio")


def upserted(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("platform"), (F.col("o_custkey") % 300).cast("string").alias("chat_id"), F.col("o_orderdate").alias("started_at")
    )
    return S.upsert_conversations(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")).select("id", "platform", "chat_id")


def hits(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    cache = events.select(F.col("user_id").alias("id")).distinct().select("id", F.lit(1).alias("hit_count"), F.lit(None).cast("timestamp").alias("last_used_at"))
    out = S.count_hits(cache, events.where("event_type = 'click'").select(F.col("user_id").alias("cache_id"), F.col("ts").alias("at")))
    return out.select("id", "hit_count", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss").alias("last_used_at"))


def reembed(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 20 + 1).cast("int").alias("document_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("embedding_model")
    )
    return S.to_reembed(vectors, law_table(spark, d), "m1").select("id")


def measured(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding service: a text's length, and how often it has two letters."""
    return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


def unreachable(texts: list[str]) -> list[list[float]]:
    raise ConnectionError("no such host")


def reembedded(spark, d):
    """New embeddings of the chunks of another model, by the second of three services: the first fails, the second gives them, the third is not asked."""
    old = F.array(F.lit(1.0).cast("float"))
    chunks = chunk_table(spark, d).select(F.col("chunk_id").alias("id"), "document_id", "content", old.alias("embedding"), F.when(F.col("chunk_id") % 4 == 0, "m1").otherwise("m0").alias("embedding_model"))
    services = [M.Model("m1", unreachable), M.Model("m2", measured), M.Model("m3", unreachable)]
    out = M.reembedded(chunks, law_table(spark, d), services, 3)
    return out.select("id", F.transform("embedding", lambda x: x.cast("long")).alias("v"), "embedding_model").select("id", *[F.col("v")[i].alias(f"v{i}") for i in range(3)], "embedding_model")


def deactivated(spark, d):
    return S.deactivate(law_table(spark, d), spark.createDataFrame([(2,), (5,), (99,)], "id int")).select("id", "is_active")


def loaded(spark, d):
    rows = chunk_table(spark, d).select("document_id", F.when(F.col("chunk_id") % 3 > 0, F.array(F.lit(1.0))).alias("embedding"), F.concat(F.lit("m"), (F.col("chunk_id") % 2).cast("string")).alias("embedding_model"))
    return S.load_check(rows)


QUERIES = {
    "article_lookup": article,
    "ambiguous_laws": ambiguous,
    "catalog_newly_listed": lambda s, d: K.newly_listed(documents(s, d).select(F.col("source").alias("nombre")), documents(s, d).where("doc_id % 20 < 17").select(F.col("source").alias("nombre"))),
    "catalog_alert": lambda s, d: K.alert_text(documents(s, d).select(F.col("source").alias("nombre"))),
    "numbering_report": lambda s, d: K.numbering_report(numbered(s, d)),
    "duplicate_ratio": duplicates,
    "upsert_conversations": upserted,
    "cache_hits": hits,
    "reembed_selection": reembed,
    "reembedded": reembedded,
    "soft_delete": deactivated,
    "load_check": loaded,
    "documents_by_id": lambda s, d: S.documents_by_id(law_table(s, d)).select("id", "nombre", "is_active"),
    "law_list": lambda s, d: law_table(s, d).where("is_active").select("id", "nombre").orderBy("nombre"),
    "active_corpus": lambda s, d: A.build(s, d, A.CHUNKS, "documents").join(law_table(s, d).where("is_active").select("nombre"), "nombre").select("chunk_id", "nombre"),
}

LAW_SQL = f"({A.oracle(A.LAWS, 'documents')})"
KEY = "left(trim(regexp_replace(lower(translate(text, '{0}', '{1}')), '[^a-z0-9]+', ' ', 'g')), 250)"


def key_sql() -> str:
    from normata.functions.text import ACCENTED, PLAIN

    return KEY.format(ACCENTED, PLAIN)


ORACLE_SQL = {
    "reembedded": f"""SELECT doc_id AS id, length(text) AS v0, length(text) - length(replace(text, 'e', '')) AS v1, length(text) - length(replace(text, 'a', '')) AS v2, 'm2' AS embedding_model
      FROM documents JOIN {LAW_SQL} l ON l.id = CAST(substring(source, 4) AS INT) WHERE l.is_active AND doc_id % 4 <> 0""",
    "article_lookup": f"SELECT min(doc_id) AS chunk_id, '6' AS articulo_numero FROM documents JOIN {LAW_SQL} l ON l.nombre = 'Ley ' || source WHERE l.is_active AND source = 'src12' AND doc_id % 7 = 6 HAVING count(*) > 0",
    "ambiguous_laws": f"WITH x AS (SELECT DISTINCT nombre FROM documents JOIN {LAW_SQL} l ON l.nombre = 'Ley ' || source WHERE l.is_active AND source ILIKE '%src1%' AND doc_id % 7 = 6) SELECT nombre FROM x WHERE (SELECT count(*) FROM x) > 1",
    "catalog_newly_listed": "SELECT DISTINCT source AS nombre FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 20 < 17)",
    "catalog_alert": "WITH s AS (SELECT DISTINCT source FROM documents), o AS (SELECT source, row_number() OVER (ORDER BY source) AS n FROM s) SELECT string_agg(source, ', ' ORDER BY source) FILTER (WHERE n <= 8) || CASE WHEN count(*) > 8 THEN ' y ' || (count(*) - 8) || ' mas' ELSE '' END AS preview FROM o",
    "numbering_report": """WITH c AS (SELECT CAST(substring(source, 4) AS INT) AS document_id, CASE WHEN substring(source, 4) = '7' OR doc_id % 50 IN (13, 20, 21, 22, 30) THEN NULL ELSE doc_id % 50 END AS a FROM documents),
      n AS (SELECT document_id, a, count(*) AS times FROM c GROUP BY 1, 2), g AS (SELECT document_id, a, lead(a) OVER (PARTITION BY document_id ORDER BY a) AS z FROM n WHERE a IS NOT NULL),
      m AS (SELECT document_id, string_agg(CASE WHEN z - a = 2 THEN CAST(a + 1 AS VARCHAR) ELSE (a + 1) || '-' || (z - 1) END, ',' ORDER BY a) AS missing FROM g WHERE z - a > 1 GROUP BY 1)
      SELECT document_id, count(a) AS labels, CAST(coalesce(sum(times) FILTER (WHERE a IS NULL), 0) AS BIGINT) AS unnumbered, count(*) FILTER (WHERE times > 1 AND a IS NOT NULL) AS duplicates,
        CAST(min(a) AS INT) AS first_number, CAST(max(a) AS INT) AS last_number, CAST(coalesce(max(a) - min(a) + 1 - count(a), 0) AS INT) AS gaps, coalesce(any_value(missing), '') AS missing,
        coalesce(round((max(a) - min(a) + 1 - count(a)) / CAST(max(a) - min(a) + 1 AS DOUBLE), 6), 1.0) AS gap_ratio FROM n LEFT JOIN m USING (document_id) GROUP BY 1""",
    "duplicate_ratio": f"""WITH k AS (SELECT doc_id, doc_id % 20 AS document_id, {key_sql()} AS key FROM documents), o AS (SELECT key FROM k WHERE doc_id % 2 = 0 AND length(key) >= 60 GROUP BY 1)
      SELECT document_id, count(*) AS keys, count(o.key) AS hits, round(count(o.key) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM k LEFT JOIN o ON o.key = k.key WHERE doc_id % 2 = 1 AND length(k.key) >= 60 GROUP BY 1""",
    "upsert_conversations": """WITH r AS (SELECT o_orderkey AS id, lower(substring(o_orderpriority, 3, 20)) AS platform, CAST(o_custkey % 300 AS VARCHAR) AS chat_id, o_orderdate AS t FROM orders),
      k AS (SELECT * FROM r WHERE id % 4 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY platform, chat_id ORDER BY t, id) AS o FROM r WHERE id % 4 <> 0)
      SELECT id, platform, chat_id FROM k UNION ALL SELECT id, platform, chat_id FROM n WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.platform = n.platform AND k.chat_id = n.chat_id)""",
    "cache_hits": """SELECT r.id, CAST(1 + count(e.user_id) AS INT) AS hit_count, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM (SELECT DISTINCT user_id AS id FROM events) r LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e ON e.user_id = r.id GROUP BY 1""",
    "reembed_selection": f"SELECT vec_id AS id FROM embeddings JOIN {LAW_SQL} l ON l.id = vec_id % 20 + 1 WHERE label % 3 <> 1 AND l.is_active",
    "soft_delete": f"SELECT id, is_active AND id NOT IN (2, 5) AS is_active FROM {LAW_SQL} l",
    "load_check": "SELECT CAST(substring(source, 4) AS INT) AS document_id, count(*) AS chunks, count(*) FILTER (WHERE doc_id % 3 > 0) AS embedded, min('m' || doc_id % 2) AS model FROM documents GROUP BY 1",
    "documents_by_id": f"SELECT id, nombre, is_active FROM {LAW_SQL} l ORDER BY id",
    "law_list": f"SELECT id, nombre FROM {LAW_SQL} l WHERE is_active ORDER BY nombre",
    "active_corpus": f"SELECT doc_id AS chunk_id, nombre FROM documents JOIN {LAW_SQL} l ON l.nombre = 'Ley ' || source WHERE is_active",
}
