"""Stand-ins for the engine's tables, built from the given ones by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# conversations(conv_id, turn, role, text) gives turns; the rest is derived from the numbers.
MESSAGES = """
SELECT CAST(conv_id * 100 + turn AS BIGINT) AS id, CAST(conv_id AS BIGINT) AS conversation_id, role, text AS content,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (conv_id % 45) * INTERVAL '1' DAY + turn * INTERVAL '1' MINUTE AS created_at,
  CASE WHEN role <> 'assistant' OR (conv_id + turn) % 7 = 0 THEN NULL ELSE (conv_id + turn) % 7 > 2 END AS found_answer,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN 'timeout' END AS error_message,
  CASE WHEN role <> 'assistant' OR conv_id % 3 = 0 THEN NULL ELSE conv_id % 3 = 1 END AS was_rewritten,
  CASE WHEN role = 'assistant' THEN CAST(length(text) AS INT) END AS response_time_ms,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CAST(length(text) % 97 AS INT) END AS search_time_ms,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CAST(length(text) % 301 AS INT) END AS generation_time_ms,
  CASE WHEN role <> 'assistant' OR conv_id % 11 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN 'model-b' ELSE 'model-a' END AS llm_model,
  CASE WHEN role = 'assistant' THEN CAST(length(text) AS INT) END AS prompt_tokens,
  CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN CAST(turn AS INT) END AS completion_tokens,
  CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN CAST(turn AS INT) END AS aux_prompt_tokens,
  CAST(NULL AS INT) AS aux_completion_tokens,
  role = 'user' AND length(text) % 13 = 0 AS jailbreak_detected,
  CASE WHEN role <> 'assistant' OR conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN '[]' ELSE
    '[{"chunk_id":' || CAST(conv_id AS VARCHAR(20)) || ',"document_nombre":"Ley ' || CAST(conv_id % 13 AS VARCHAR(20)) || '","articulo_numero":"' || CAST(turn % 5 AS VARCHAR(20))
    || '","similarity":0.' || CAST(40 + (conv_id * 7 + turn) % 60 AS VARCHAR(20)) || ',"passed_threshold":' || CASE WHEN conv_id % 6 = 3 THEN 'false' ELSE 'true' END
    || '},{"chunk_id":7,"document_nombre":"Codigo ' || CAST(turn % 3 AS VARCHAR(20)) || '","articulo_numero":"1","similarity":0.55}]' END AS retrieved_chunks,
  CASE WHEN role = 'assistant' AND conv_id % 3 = 1 THEN '{"route":"' || CASE WHEN turn % 4 = 1 THEN 'busqueda' ELSE 'articulo' END || '","intentos":' || CAST(1 + turn % 3 AS VARCHAR(20))
    || ',"self_reflection_triggered":' || CASE WHEN turn % 3 = 2 THEN 'true' ELSE 'false' END || '}' END AS agent_trace
FROM {conversations} WHERE role IN ('user', 'assistant')
"""

CONVERSATIONS = """
SELECT CAST(conv_id AS BIGINT) AS id, CASE WHEN conv_id % 3 = 0 THEN 'telegram' ELSE 'web' END AS platform,
  CAST(conv_id % 37 AS VARCHAR(20)) AS user_id, 'c' || CAST(conv_id AS VARCHAR(20)) AS chat_id
FROM (SELECT DISTINCT conv_id FROM {conversations}) AS c
"""

FEEDBACK = """
SELECT CAST(doc_id AS BIGINT) AS id, CAST((doc_id % 100) * 100 + 1 AS BIGINT) AS message_id, CASE WHEN quality = 1 THEN 'util' ELSE 'no_util' END AS rating,
  'c' || CAST(doc_id % 90 AS VARCHAR(20)) AS chat_id
FROM {labels}
"""

# Sources stand for laws, documents for their chunks, languages for areas of law.
LAWS = """
SELECT CAST(row_number() OVER (ORDER BY source) AS INT) AS id, 'Ley ' || source AS nombre, 'https://a.example/' || source || '.pdf' AS source_url,
  CASE WHEN source LIKE '%7' THEN NULL WHEN source LIKE '%1%' THEN 'civil' ELSE 'penal' END AS area_derecho, source NOT LIKE '%3' AS is_active
FROM (SELECT DISTINCT source FROM {documents} WHERE source IS NOT NULL) AS s
"""

CHUNKS = """
SELECT CAST(doc_id AS BIGINT) AS chunk_id, 'Ley ' || source AS nombre, CAST(doc_id % 50 AS VARCHAR(20)) AS articulo_numero, text AS content FROM {documents}
"""

LOGS = """
SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS document_id, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_id % 9 = 0 THEN event_type END AS error_message, CASE WHEN event_id % 27 = 0 THEN NULL ELSE ts END AS started_at
FROM {events}
"""

RUNS = """
SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 50 = 1 THEN NULL ELSE o_orderdate END AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms FROM {orders}
"""

CASES = """
SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS INT) AS case_id, l_returnflag <> 'R' AS expects_grounded,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linestatus = 'F' END AS actual_grounded, CASE WHEN l_partkey % 9 = 0 THEN '  ' WHEN l_partkey % 9 > 1 THEN 'answer' END AS answer,
  CASE WHEN l_linenumber % 3 = 0 THEN '7' END AS articulo_esperado, CASE WHEN l_suppkey % 8 > 0 THEN 'ley' ELSE '' END AS ley_contains, CASE WHEN l_quantity > 20 THEN 1 END AS found_at,
  l_discount > 0.05 AS alternative, l_tax > 0.06 AS expects_empty_retrieval, CASE WHEN l_quantity > 40 THEN 0 ELSE 3 END AS retrieved, CASE WHEN l_partkey % 2 = 0 THEN 'model-a' END AS llm_model,
  CASE WHEN l_linenumber % 5 = 1 THEN 'tolerate_grounded_true' WHEN l_linenumber % 5 = 2 THEN 'tolerate_missing_position' WHEN l_linenumber % 5 = 3 THEN 'tolerate_grounded_false' END AS limitation_kind,
  CAST(l_quantity AS BIGINT) AS duration_ms
FROM {lineitem}
"""

# Nations stand for laws, lines of orders for their articles, with markers of all families.
NATION_LAWS = """
SELECT CAST(n_nationkey AS INT) AS id, 'Ley de ' || n_name AS nombre, n_regionkey <> 3 AS is_active FROM {nation}
"""

MONTH = "CASE month(l_shipdate) WHEN 1 THEN 'ENERO' WHEN 2 THEN 'FEBRERO' WHEN 3 THEN 'MARZO' WHEN 4 THEN 'ABRIL' WHEN 5 THEN 'MAYO' WHEN 6 THEN 'JUNIO' WHEN 7 THEN 'JULIO' WHEN 8 THEN 'AGOSTO' WHEN 9 THEN 'SEPTIEMBRE' WHEN 10 THEN 'OCTUBRE' WHEN 11 THEN 'NOVIEMBRE' ELSE 'DICIEMBRE' END"
ARTICLES = f"""
SELECT law, n, law * 1000 + n AS chunk_id, CAST(l_suppkey % 25 AS INT) AS document_id, label, l_returnflag AS flag, l_linestatus AS status, l_partkey AS part, day, day_of, marker,
  'Articulo ' || label || '.- La parte ' || CAST(l_partkey AS VARCHAR(20)) || ' se entrega' || chr(10) || 'segun el' || chr(10) || 'articulo 9. de esta ley.' || CASE WHEN marker IS NULL THEN '' ELSE chr(10) || marker END AS content
FROM (SELECT *, CAST(n AS VARCHAR(20)) || CASE WHEN l_partkey % 5 = 0 THEN ' BIS' WHEN l_partkey % 5 = 1 THEN '-A' ELSE '' END AS label,
  CASE WHEN l_returnflag = 'R' THEN '(REFORMADO, P.O. NÚM. 5 DE FECHA ' || day || ')'
    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'ADICIÓN PUBLICADA EN EL P.O. ' || day || ')'
    WHEN l_returnflag = 'A' THEN '(DEROGADA POR EL ARTICULO 2 DE LA ' || CASE WHEN l_partkey % 7 = 0 THEN 'LEY DESCONOCIDA' ELSE 'LEY DE NATION_' || CAST(l_partkey % 25 AS VARCHAR(20)) END || ', P.O. ' || day || ')'
    WHEN l_linestatus = 'F' THEN '(SE ADICONA ESTE ARTICULO, P.O. 31 DE FEBRERO DE 2012)' END AS marker
  FROM (SELECT l_orderkey AS law, l_suppkey, l_partkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS day_of,
    CAST(day(l_shipdate) AS VARCHAR(20)) || ' DE ' || {MONTH} || ' DE ' || CAST(year(l_shipdate) AS VARCHAR(20)) AS day,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {{lineitem}}) AS a) AS b
"""

# Suppliers stand for laws of two sources, and for their entries in the catalogues of these.
SOURCED = """
SELECT CAST(s_suppkey AS INT) AS id, 'Ley de ' || s_name AS nombre, 'https://h.example/Ley%20' || s_name || '.pdf' AS source_url, CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS source
FROM {supplier}
"""
ENTRIES = """
SELECT CASE WHEN s_suppkey % 5 = 3 THEN 'LÉY  DE ' || s_name || ' UNO' ELSE 'LÉY  DE ' || s_name END AS nombre, CASE WHEN s_suppkey % 5 = 2 THEN 'https://h.example/otra.pdf' ELSE 'HTTPS://H.example/Ley ' || s_name || '.pdf' END AS source_url,
  CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM {supplier} WHERE s_suppkey % 5 > 0
UNION ALL SELECT 'LEY DE ' || s_name || ' DOS', 'x', CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END FROM {supplier} WHERE s_suppkey % 5 = 3
UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Ley abrogada ' ELSE 'Ley Nueva ' END || s_name || 'X' || CAST(s_nationkey AS VARCHAR(20)), 'x', 'a' FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'LEY  NUEVA ' || s_name || 'X' || CAST(s_nationkey AS VARCHAR(20)), 'x', 'b' FROM {supplier} WHERE s_suppkey % 4 = 0
"""


def build(spark: SparkSession, sf_dir: str, adapter: str, table: str) -> DataFrame:
    """The adapter's rows over the Parquet table that it names."""
    view = f"normata_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return spark.sql(adapter.replace("{" + table + "}", view))


def oracle(adapter: str, table: str) -> str:
    """The adapter as text of a DuckDB subquery."""
    return adapter.replace("{" + table + "}", table)
