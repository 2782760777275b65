"""Metric queries: usage, quality, performance, guardrails, agent, evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from normata.operators import evaluation as E
from normata.operators import metrics as M
from normata.plans import adapters as A
from normata.sources import tables as S

REFUSAL = "fuera de alcance"


def messages(spark, d):
    return A.build(spark, d, A.MESSAGES, "conversations")


def conversations(spark, d):
    return A.build(spark, d, A.CONVERSATIONS, "conversations")


def feedback(spark, d):
    return A.build(spark, d, A.FEEDBACK, "labels")


def of_messages(f, *more):
    return lambda spark, d: f(messages(spark, d), *more)


def scoped(f, platform):
    return lambda spark, d: f(M.on_platform(messages(spark, d), conversations(spark, d), platform))


def refusals(spark, d):
    rows = messages(spark, d)
    return rows.withColumn("content", F.when(F.col("id") % 10 < 4, REFUSAL).otherwise(F.col("content")))


def histories(spark, d):
    rows = messages(spark, d)
    return M.recent_turns(rows)


def clarified(spark, d):
    rows = messages(spark, d)
    asks = (F.col("role") == "assistant") & (F.col("conversation_id") % 5 == 0)
    return M.needs_rewriting(rows.withColumn("content", F.when(asks, F.concat("content", F.lit(" quiere aclarar?"))).otherwise(F.col("content"))), "aclarar")


def runs(spark, d):
    return A.build(spark, d, A.RUNS, "orders")


def cases(spark, d):
    return A.build(spark, d, A.CASES, "lineitem").withColumn("status", E.verdict())


def latest(spark, d):
    return E.latest_run(runs(spark, d), cases(spark, d)).select("run_id", "case_id", "status")


def coverage(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    parts = spark.read.parquet(f"{d}/part.parquet")
    groups = lines.where("l_linenumber <= 3").join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("group_no"), F.col("p_brand").alias("name")
    )
    found = lines.where("l_quantity > 25").join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("x "), F.upper("p_brand")).alias("document_nombre"))
    return E.coverage(groups, found)


def positions(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = lines.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Ley "), "l_returnflag").alias("document_nombre"), F.col("l_linestatus").alias("articulo_numero"),
        F.when(F.col("l_orderkey") % 4 > 0, "ley r").alias("ley_contains"), F.when(F.col("l_orderkey") % 3 > 0, "F").alias("articulo_esperado"),
        F.when(F.col("l_orderkey") % 5 == 0, "LEY N").alias("alt_ley_contains"), F.array(F.lit("O"), F.lit("X")).alias("alt_articulos"),
    )
    return E.expected_position(rows)


def gates(spark, d):
    turns = messages(spark, d).where("role = 'assistant'").select(
        F.col("id").alias("turn_id"), F.when(F.col("id") % 3 == 0, "articulo").otherwise("busqueda").alias("route"), (F.col("id") % 5 > 0).alias("model_grounded"),
        (F.col("id") % 7 == 0).alias("filler_found"), (F.col("id") % 2).cast("int").alias("attempts"), F.lit(1).alias("max_attempts"),
    )
    got = M.citations(messages(spark, d)).select(F.col("id").alias("turn_id"), F.col("passed_threshold").alias("passed"))
    return E.gates(turns, got)


def token_use(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    calls = lines.select(
        F.col("l_orderkey").alias("turn_id"), (F.col("l_returnflag") == "N").alias("is_generation"), F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens")
    )
    return M.token_use(calls)


def areas(spark, d):
    return M.documents_by_area(A.build(spark, d, A.LAWS, "documents"))


def owned_feedback(spark, d):
    return S.valid_feedback(feedback(spark, d), messages(spark, d), conversations(spark, d)).select("id", "message_id", "rating")


QUERIES = {
    "questions_per_day": of_messages(M.questions_per_day),
    "unique_users_by_platform": lambda s, d: M.unique_users_by_platform(conversations(s, d)),
    "conversations_by_platform": lambda s, d: M.conversations_by_platform(conversations(s, d)),
    "top_laws": of_messages(M.top_laws),
    "top_questions": of_messages(M.top_questions),
    "questions_per_day_telegram": scoped(M.questions_per_day, "telegram"),
    "top_questions_telegram": scoped(M.top_questions, "telegram"),
    "documents_by_area": areas,
    "not_found_rate": of_messages(M.not_found_rate),
    "feedback_ratio": lambda s, d: M.feedback_ratio(feedback(s, d)),
    "feedback_ratio_telegram": lambda s, d: M.feedback_ratio(feedback(s, d), messages(s, d), conversations(s, d), "telegram"),
    "owned_feedback": owned_feedback,
    "top_cited_articles": of_messages(M.top_cited_articles),
    "avg_similarity_grounded": of_messages(M.avg_similarity_grounded),
    "similarity_histogram": of_messages(M.similarity_histogram),
    "grounded_by_rewrite": of_messages(M.grounded_by_rewrite),
    "latency": of_messages(partial(M.latency), "response_time_ms"),
    "latency_breakdown": of_messages(partial(M.latency), "search_time_ms", "generation_time_ms"),
    "usage_by_model": of_messages(M.usage_by_model),
    "primary_vs_fallback": of_messages(M.primary_vs_fallback, "model-a"),
    "tokens_per_day": of_messages(M.tokens_per_day),
    "token_use_per_turn": token_use,
    "recent_ingestion_errors": lambda s, d: M.recent_ingestion_errors(A.build(s, d, A.LOGS, "events")),
    "recent_chat_errors": of_messages(M.recent_chat_errors),
    "system_error_rate": of_messages(M.system_error_rate),
    "out_of_scope_per_day": lambda s, d: M.out_of_scope_per_day(refusals(s, d), REFUSAL),
    "jailbreak_attempts": of_messages(M.jailbreak_attempts),
    "route_distribution": of_messages(M.route_distribution),
    "agent_effort": of_messages(M.agent_effort),
    "recent_turns": histories,
    "last_user_turn": of_messages(M.last_user_turn),
    "needs_rewriting": clarified,
    "out_of_scope_total": lambda s, d: M.out_of_scope_total(refusals(s, d), REFUSAL),
    "golden_run_totals": lambda s, d: E.run_totals(cases(s, d)),
    "golden_latest_run": latest,
    "golden_recent_runs": lambda s, d: E.recent_runs(runs(s, d)).select("id", "duration_ms"),
    "research_coverage": coverage,
    "golden_positions": positions,
    "grounding_gates": gates,
}

MSG = f"WITH m AS ({A.oracle(A.MESSAGES, 'conversations')}), c AS ({A.oracle(A.CONVERSATIONS, 'conversations')}), f AS ({A.oracle(A.FEEDBACK, 'labels')}), "
CITED = """e AS (SELECT id, found_answer, json_extract_string(x, '$.document_nombre') AS ley, json_extract_string(x, '$.articulo_numero') AS articulo,
  CAST(json_extract_string(x, '$.similarity') AS DOUBLE) AS similarity, CAST(json_extract_string(x, '$.passed_threshold') AS BOOLEAN) AS passed
  FROM (SELECT id, found_answer, unnest(CAST(CAST(retrieved_chunks AS JSON) AS JSON[])) AS x FROM m WHERE role = 'assistant' AND retrieved_chunks IS NOT NULL)) """
U, ASSIST = "u AS (SELECT * FROM m WHERE role = 'user') ", "a AS (SELECT * FROM m WHERE role = 'assistant') "
DAY = "strftime(created_at, '%Y-%m-%d')"
CASE_SQL = f"""WITH k AS (SELECT *, CASE limitation_kind
  WHEN 'tolerate_grounded_true' THEN CASE WHEN actual_grounded THEN 'xfailed_known' WHEN answer IS NULL OR trim(answer) = '' THEN 'failed' ELSE 'passed' END
  WHEN 'tolerate_missing_position' THEN CASE WHEN actual_grounded IS NOT true THEN 'failed' WHEN found_at IS NULL THEN 'xfailed_known' ELSE 'passed' END
  WHEN 'tolerate_grounded_false' THEN CASE WHEN actual_grounded IS NOT true THEN 'xfailed_known' WHEN found_at IS NULL AND NOT alternative THEN 'failed' ELSE 'passed' END
  ELSE CASE WHEN actual_grounded IS DISTINCT FROM expects_grounded THEN 'failed'
    WHEN expects_empty_retrieval THEN CASE WHEN retrieved > 0 OR llm_model IS NOT NULL THEN 'failed' ELSE 'passed' END
    WHEN articulo_esperado IS NOT NULL AND ley_contains <> '' AND found_at IS NULL AND NOT alternative THEN 'failed' ELSE 'passed' END
  END AS status FROM ({A.oracle(A.CASES, "lineitem")})) """
QUANTILE = "round(quantile_cont(CAST({0} AS DOUBLE), 0.95), 6)"

ORACLE_SQL = {
    "questions_per_day": MSG + U + f"SELECT {DAY} AS day, count(*) AS count FROM u GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "unique_users_by_platform": MSG + U + "SELECT platform, count(DISTINCT user_id) AS unique_users FROM c GROUP BY 1",
    "conversations_by_platform": MSG + U + "SELECT platform, count(*) AS count FROM c GROUP BY 1",
    "top_laws": MSG + CITED + "SELECT ley, count(*) AS mentions FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_questions": MSG + U + "SELECT content, count(*) AS count FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "questions_per_day_telegram": MSG + U + f"SELECT {DAY} AS day, count(*) AS count FROM u JOIN c ON c.id = u.conversation_id WHERE platform = 'telegram' GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "top_questions_telegram": MSG + U + "SELECT content, count(*) AS count FROM u JOIN c ON c.id = u.conversation_id WHERE platform = 'telegram' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "documents_by_area": f"WITH l AS (SELECT coalesce(area_derecho, 'sin clasificar') AS area, nombre FROM ({A.oracle(A.LAWS, 'documents')}) WHERE is_active) "
    "SELECT area, count(*) AS laws, string_agg(DISTINCT nombre, '; ' ORDER BY nombre) AS names, round(100.0 * count(*) / (SELECT count(*) FROM l), 2) AS percent FROM l GROUP BY 1",
    "not_found_rate": MSG + ASSIST + "SELECT count(*) FILTER (WHERE found_answer = false) AS not_found, count(*) FILTER (WHERE found_answer IS NOT NULL) AS total FROM a",
    "feedback_ratio": MSG + U + "SELECT rating, count(*) AS count FROM f GROUP BY 1",
    "feedback_ratio_telegram": MSG + U + "SELECT rating, count(*) AS count FROM f JOIN m ON m.id = f.message_id JOIN c ON c.id = m.conversation_id WHERE platform = 'telegram' GROUP BY 1",
    "owned_feedback": MSG + U + "SELECT f.id, f.message_id, f.rating FROM f JOIN m ON m.id = f.message_id JOIN c ON c.id = m.conversation_id WHERE platform = 'web' AND c.chat_id = f.chat_id",
    "top_cited_articles": MSG + CITED + "SELECT ley, articulo, count(*) AS count FROM e WHERE found_answer GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10",
    "avg_similarity_grounded": MSG + CITED + "SELECT round(avg(similarity), 6) AS avg_similarity FROM e WHERE found_answer AND passed",
    "similarity_histogram": MSG + CITED + """SELECT b.bucket, count(g.bucket) AS count FROM (VALUES ('0.5-0.6'), ('0.6-0.7'), ('0.7-0.8'), ('0.8-0.9'), ('0.9-1.0')) b(bucket)
      LEFT JOIN (SELECT CASE WHEN similarity < 0.6 THEN '0.5-0.6' WHEN similarity < 0.7 THEN '0.6-0.7' WHEN similarity < 0.8 THEN '0.7-0.8' WHEN similarity < 0.9 THEN '0.8-0.9' ELSE '0.9-1.0' END AS bucket
      FROM e WHERE passed) g ON g.bucket = b.bucket GROUP BY 1""",
    "grounded_by_rewrite": MSG + ASSIST + "SELECT was_rewritten, count(*) FILTER (WHERE found_answer) AS grounded, count(*) AS total FROM a WHERE was_rewritten IS NOT NULL AND found_answer IS NOT NULL GROUP BY 1",
    "latency": MSG + ASSIST + f"SELECT round(avg(response_time_ms), 6) AS response_time_ms_avg, {QUANTILE.format('response_time_ms')} AS response_time_ms_p95 FROM a",
    "latency_breakdown": MSG + ASSIST + f"SELECT round(avg(search_time_ms), 6) AS search_time_ms_avg, {QUANTILE.format('search_time_ms')} AS search_time_ms_p95, "
    f"round(avg(generation_time_ms), 6) AS generation_time_ms_avg, {QUANTILE.format('generation_time_ms')} AS generation_time_ms_p95 FROM a",
    "usage_by_model": MSG + ASSIST + "SELECT llm_model, count(*) AS count FROM a WHERE llm_model IS NOT NULL GROUP BY 1",
    "primary_vs_fallback": MSG + ASSIST + "SELECT count(*) FILTER (WHERE llm_model = 'model-a') AS \"primary\", count(*) FILTER (WHERE llm_model <> 'model-a') AS fallback FROM a",
    "tokens_per_day": MSG + ASSIST + f"""SELECT {DAY} AS day, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
      CAST(sum(aux_prompt_tokens) AS BIGINT) AS aux_prompt_tokens, CAST(sum(aux_completion_tokens) AS BIGINT) AS aux_completion_tokens,
      CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) + coalesce(aux_prompt_tokens, 0) + coalesce(aux_completion_tokens, 0)) AS BIGINT) AS total_tokens
      FROM a GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
    "token_use_per_turn": """SELECT l_orderkey AS turn_id, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS prompt_tokens,
      CAST(sum(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS completion_tokens, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS aux_prompt_tokens,
      CAST(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS aux_completion_tokens FROM lineitem GROUP BY 1""",
    "recent_ingestion_errors": f"SELECT id, document_id, error_message FROM ({A.oracle(A.LOGS, 'events')}) WHERE status = 'failed' ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 20",
    "recent_chat_errors": MSG + ASSIST + "SELECT id, error_message FROM a WHERE found_answer IS NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20",
    "system_error_rate": MSG + ASSIST + "SELECT count(*) FILTER (WHERE found_answer IS NULL) AS errors, count(*) AS total FROM a",
    "out_of_scope_per_day": MSG + ASSIST + f"SELECT {DAY} AS day, count(*) AS count FROM a WHERE id % 10 < 4 GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "jailbreak_attempts": MSG + U + "SELECT count(*) FILTER (WHERE jailbreak_detected) AS attempts FROM m",
    "route_distribution": MSG + U + "SELECT json_extract_string(agent_trace, '$.route') AS route, count(*) AS count FROM m WHERE agent_trace IS NOT NULL GROUP BY 1",
    "agent_effort": MSG + U + """SELECT round(avg(CAST(json_extract_string(agent_trace, '$.intentos') AS INT)), 6) AS avg_intentos,
      count(*) FILTER (WHERE json_extract_string(agent_trace, '$.self_reflection_triggered') = 'true') AS triggered, count(*) AS total FROM m WHERE agent_trace IS NOT NULL""",
    "recent_turns": MSG + U + """SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY back DESC) AS history
      FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back FROM m) WHERE back <= 8 GROUP BY 1""",
    "last_user_turn": MSG + U + "SELECT conversation_id, arg_max(content, id) AS content FROM u GROUP BY 1",
    "needs_rewriting": MSG + U + """SELECT id, prev IS NULL OR prev_role = 'assistant' AND conversation_id % 5 = 0 OR len(regexp_extract_all(content, '\\S+')) <= 6 AS needs_rewriting
      FROM (SELECT id, role, content, conversation_id, lag(id) OVER o AS prev, lag(role) OVER o AS prev_role FROM m WINDOW o AS (PARTITION BY conversation_id ORDER BY id)) WHERE role = 'user'""",
    "out_of_scope_total": MSG + ASSIST + "SELECT count(*) FILTER (WHERE id % 10 < 4) AS total FROM a",
    "golden_run_totals": CASE_SQL + """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'xfailed_known') AS xfailed_known,
      count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM k GROUP BY 1""",
    "golden_latest_run": CASE_SQL + f"SELECT run_id, case_id, status FROM k WHERE run_id = (SELECT id FROM ({A.oracle(A.RUNS, 'orders')}) WHERE started_at IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 1)",
    "golden_recent_runs": f"SELECT id, duration_ms FROM ({A.oracle(A.RUNS, 'orders')}) ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 10",
    "research_coverage": """WITH g AS (SELECT l_orderkey AS case_id, l_linenumber AS group_no, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3),
      r AS (SELECT l_orderkey AS case_id, 'x ' || upper(p_brand) AS document_nombre FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25),
      h AS (SELECT g.case_id, g.group_no, bool_or(coalesce(contains(lower(document_nombre), lower(name)), false)) AS hit FROM g LEFT JOIN r ON g.case_id = r.case_id GROUP BY 1, 2)
      SELECT case_id, round(avg(CAST(hit AS INT)), 6) AS coverage FROM h GROUP BY 1""",
    "golden_positions": """SELECT l_orderkey AS case_id, min(l_linenumber) FILTER (WHERE l_orderkey % 4 > 0 AND l_returnflag = 'R' AND l_orderkey % 3 > 0 AND l_linestatus = 'F') AS found_at,
      bool_or(l_orderkey % 5 = 0 AND l_returnflag = 'N' AND l_linestatus = 'O') AS alternative, count(*) AS retrieved FROM lineitem GROUP BY 1""",
    "grounding_gates": MSG + CITED + """, t AS (SELECT id AS turn_id, id % 3 = 0 AS exact, id % 5 > 0 AS ok, id % 7 = 0 AS filler, id % 2 AS attempts FROM m WHERE role = 'assistant'),
      p AS (SELECT t.*, CASE WHEN exact THEN coalesce(n, 0) > 0 ELSE coalesce(passed, false) END AS "primary" FROM t LEFT JOIN (SELECT id, bool_or(passed) AS passed, count(*) AS n FROM e GROUP BY 1) x ON x.id = t.turn_id)
      SELECT turn_id, "primary", "primary" AND ok AND NOT filler AS grounded, NOT exact AND "primary" AND NOT ("primary" AND ok AND NOT filler) AND attempts < 1 AS retry FROM p""",
}
