"""Schemas of the core tables. Vectors are float arrays; JSON columns stay strings until read."""

DOCUMENTS = "id int, nombre string, tipo string, fecha_publicacion date, fecha_ultima_reforma date, source_url string, area_derecho string, is_active boolean, ingested_at timestamp"
CHUNKS = (
    "id int, document_id int, articulo_numero string, titulo string, capitulo string, seccion string, content string, "
    "chunk_metadata struct<titulo:string,capitulo:string,seccion:string,parte:int,partes_totales:int>, embedding array<float>, created_at timestamp, embedding_model string"
)
RELATIONS = (
    "id int, from_document_id int, from_chunk_id int, from_articulo string, relation_type string, to_document_id int, to_law_name_raw string, "
    "fecha date, source_text string, extraction_method string, created_at timestamp"
)
CONVERSATIONS = "id int, platform string, user_id string, chat_id string, started_at timestamp, last_message_at timestamp"
MESSAGES = (
    "id int, conversation_id int, role string, content string, retrieved_chunks string, llm_model string, response_time_ms int, prompt_tokens int, completion_tokens int, "
    "aux_prompt_tokens int, aux_completion_tokens int, search_time_ms int, generation_time_ms int, found_answer boolean, was_rewritten boolean, jailbreak_detected boolean, "
    "error_message string, grounding_classifier_model string, agent_trace string, created_at timestamp"
)
FEEDBACK = "id int, message_id int, rating string, user_comment string, created_at timestamp"
CACHE = (
    "id int, question_text string, question_embedding array<float>, response_json string, corpus_chunk_count int, corpus_max_chunk_id int, hit_count int, "
    "created_at timestamp, last_used_at timestamp, embedding_model string"
)
INGESTION_LOGS = "id int, document_id int, chunks_created int, status string, error_message string, started_at timestamp, completed_at timestamp"
RUNS = "id int, total int, passed int, xfailed_known int, failed int, duration_ms int, started_at timestamp, completed_at timestamp"
RUN_CASES = (
    "id int, run_id int, pregunta string, articulo_esperado string, respuesta_snippet string, passed boolean, expects_grounded boolean, actual_grounded boolean, posicion_encontrada int"
)
#: Values that a checked column may take.
ALLOWED = {
    "relation_type": ("deroga", "reforma", "adiciona"),
    "extraction_method": ("regex", "regex_publicada", "regex_se_verbo"),
    "role": ("user", "assistant"),
    "rating": ("util", "no_util"),
    "status": ("running", "success", "failed"),
}
