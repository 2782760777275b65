"""Usage, quality, performance, guardrail, agent and evaluation metrics over conversation logs.

Messages carry three-valued flags: ``found_answer`` null means the turn crashed, user rows have null
everywhere. Ties in top lists are broken by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normata.sources.scratch import stored

CHUNKS_SCHEMA = (
    "array<struct<chunk_id:int,document_nombre:string,articulo_numero:string,similarity:double,content:string,passed_threshold:boolean,derogado:boolean>>"
)
DAYS, TOP = 30, 10
BUCKETS = ("0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-1.0")



def count() -> Column:
    return F.count(F.lit(1)).alias("count")


def day() -> Column:
    return F.to_date("created_at").cast("string").alias("day")


def assistant(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "assistant")


def user(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "user")


def on_platform(messages: DataFrame, conversations: DataFrame, platform: str) -> DataFrame:
    ids = conversations.where(F.col("platform") == platform).select(F.col("id").alias("conversation_id"))
    return messages.join(ids, "conversation_id", "left_semi")


def citations(messages: DataFrame) -> DataFrame:
    """One row per cited chunk; rows without citations vanish."""
    parsed = assistant(messages).withColumn("cited", F.from_json("retrieved_chunks", CHUNKS_SCHEMA))
    return parsed.select("id", "found_answer", F.explode("cited").alias("c")).select("id", "found_answer", "c.*")


def per_day(rows: DataFrame, limit: int = DAYS) -> DataFrame:
    return rows.groupBy(day()).agg(count()).orderBy(F.desc("day")).limit(limit)


def top(rows: DataFrame, *keys: str, name: str = "count", limit: int = TOP) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys).limit(limit)


# Usage
def questions_per_day(messages: DataFrame) -> DataFrame:
    return per_day(user(messages))


def unique_users_by_platform(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("platform").agg(F.countDistinct("user_id").alias("unique_users"))


def conversations_by_platform(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("platform").agg(count())


def top_laws(messages: DataFrame) -> DataFrame:
    return top(citations(messages).withColumnRenamed("document_nombre", "ley"), "ley", name="mentions")


def top_questions(messages: DataFrame) -> DataFrame:
    return top(user(messages), "content")


def documents_by_area(documents: DataFrame) -> DataFrame:
    """Active laws per area, each list in order, with the area's share in per cent."""
    active = documents.where("is_active").withColumn("area", F.coalesce("area_derecho", F.lit("sin clasificar")))
    total = active.agg(F.count(F.lit(1)).alias("total"))
    by = active.groupBy("area").agg(F.count(F.lit(1)).alias("laws"), F.array_join(F.array_sort(F.collect_set("nombre")), "; ").alias("names"))
    return by.join(total).select("area", "laws", "names", F.round(100 * F.try_divide("laws", "total"), 2).alias("percent"))


# Quality
def not_found_rate(messages: DataFrame) -> DataFrame:
    return assistant(messages).agg(F.count_if(~F.col("found_answer")).alias("not_found"), F.count("found_answer").alias("total"))


def feedback_ratio(feedback: DataFrame, messages: DataFrame | None = None, conversations: DataFrame | None = None, platform: str | None = None) -> DataFrame:
    rows = feedback
    if platform is not None:
        ids = on_platform(messages, conversations, platform).select(F.col("id").alias("message_id"))
        rows = feedback.join(ids, "message_id", "left_semi")
    return rows.groupBy("rating").agg(count())


def top_cited_articles(messages: DataFrame) -> DataFrame:
    return top(citations(messages).where("found_answer").withColumnRenamed("document_nombre", "ley").withColumnRenamed("articulo_numero", "articulo"), "ley", "articulo")


def avg_similarity_grounded(messages: DataFrame) -> DataFrame:
    passed = citations(messages).where("found_answer AND passed_threshold")
    return passed.agg(F.round(F.avg("similarity"), 6).alias("avg_similarity"))


def similarity_bucket(similarity: Column) -> Column:
    out = F.when(similarity < 0.6, BUCKETS[0])
    for i, name in enumerate(BUCKETS[1:-1], 1):
        out = out.when(similarity < 0.6 + i / 10, name)
    return out.otherwise(BUCKETS[-1])


def similarity_histogram(messages: DataFrame) -> DataFrame:
    """Passed citations by similarity; below 0.5 falls in the first bucket; empty buckets count 0."""
    found = citations(messages).where("passed_threshold").groupBy(similarity_bucket(F.col("similarity")).alias("bucket")).agg(count())
    every = messages.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def grounded_by_rewrite(messages: DataFrame) -> DataFrame:
    rows = assistant(messages).where("was_rewritten IS NOT NULL AND found_answer IS NOT NULL")
    return rows.groupBy("was_rewritten").agg(F.count_if("found_answer").alias("grounded"), F.count(F.lit(1)).alias("total"))


# Performance
def value_at(rows: DataFrame, column: str, rank: int, low: float, high: float, buckets: int = 4096) -> tuple[float, int]:
    """The value of rank ``rank`` (from 0) among a column's non-null values, all from ``low`` to ``high``, and how many are no larger.

    The range that holds it is parted evenly and the parts are counted, until its part has one value only; a pass brings
    ``buckets`` rows at most to the driver, and no aggregate holds the values.
    """
    value, below = F.col(column).cast("double"), 0
    while True:
        width = (high - low) / buckets
        part = F.least(F.floor((value - low) / width), F.lit(buckets - 1)) if width > 0 else F.when(value > low, 1).otherwise(0)
        counted = rows.where(value.between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for found in sorted(counted.collect(), key=lambda r: r.part):
            if rank < below + found.n:
                break
            below += found.n
        if found.low == found.high:
            return found.low, below + found.n
        low, high = found.low, found.high


def quantile(rows: DataFrame, column: str, p: float) -> float | None:
    """The exact quantile, between neighbouring values in proportion; null without values."""
    value = F.col(column).cast("double")
    n, low, high = rows.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n:
        return None
    place = p * (n - 1)
    rank = int(place)
    found, upto = value_at(rows, column, rank, low, high)
    if place == rank or rank + 1 < upto:
        return found
    return found + (place - rank) * (rows.where(value > found).agg(F.min(value)).first()[0] - found)


def latency(messages: DataFrame, *columns: str) -> DataFrame:
    """Mean and exact 95th percentile of each column, nulls left out."""
    rows = stored(assistant(messages).select(*columns), "latencies")
    means = rows.agg(*[F.avg(c) for c in columns]).first()
    values = {}
    for c, mean in zip(columns, means, strict=True):
        values |= {f"{c}_avg": mean, f"{c}_p95": quantile(rows, c, 0.95)}
    one = messages.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{c} double" for c in values))
    return one.select(*[F.round(c, 6).alias(c) for c in values])


def usage_by_model(messages: DataFrame) -> DataFrame:
    return assistant(messages).where("llm_model IS NOT NULL").groupBy("llm_model").agg(count())


def primary_vs_fallback(messages: DataFrame, primary: str) -> DataFrame:
    is_primary = F.col("llm_model") == primary
    return assistant(messages).where("llm_model IS NOT NULL").agg(F.count_if(is_primary).alias("primary"), F.count_if(~is_primary).alias("fallback"))


TOKENS = ("prompt_tokens", "completion_tokens", "aux_prompt_tokens", "aux_completion_tokens")


def tokens_per_day(messages: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in TOKENS]
    total = F.sum(sum((F.coalesce(F.col(c), F.lit(0)) for c in TOKENS[1:]), F.coalesce(F.col(TOKENS[0]), F.lit(0)))).alias("total_tokens")
    return assistant(messages).groupBy(day()).agg(*sums, total).orderBy(F.desc("day")).limit(DAYS)


def recent_ingestion_errors(logs: DataFrame, limit: int = 20) -> DataFrame:
    return logs.where(F.col("status") == "failed").orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(limit).select("id", "document_id", "error_message")


def recent_chat_errors(messages: DataFrame, limit: int = 20) -> DataFrame:
    rows = assistant(messages).where("found_answer IS NULL")
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit).select("id", "error_message")


def system_error_rate(messages: DataFrame) -> DataFrame:
    return assistant(messages).agg(F.count_if(F.expr("found_answer IS NULL")).alias("errors"), F.count(F.lit(1)).alias("total"))


# Guardrails and agent
def out_of_scope_per_day(messages: DataFrame, refusal: str) -> DataFrame:
    return per_day(assistant(messages).where(F.col("content") == refusal))


def out_of_scope_total(messages: DataFrame, refusal: str) -> DataFrame:
    return assistant(messages).agg(F.count_if(F.col("content") == refusal).alias("total"))


def jailbreak_attempts(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count_if("jailbreak_detected").alias("attempts"))


def traced(messages: DataFrame) -> DataFrame:
    return messages.where("agent_trace IS NOT NULL")


def route_distribution(messages: DataFrame) -> DataFrame:
    return traced(messages).groupBy(F.get_json_object("agent_trace", "$.route").alias("route")).agg(count())


def agent_effort(messages: DataFrame) -> DataFrame:
    """Mean number of attempts, and how many turns reflected on themselves."""
    tries = F.get_json_object("agent_trace", "$.intentos").try_cast("int")
    reflected = F.get_json_object("agent_trace", "$.self_reflection_triggered").try_cast("boolean")
    return traced(messages).agg(F.round(F.avg(tries), 6).alias("avg_intentos"), F.count_if(reflected).alias("triggered"), F.count(F.lit(1)).alias("total"))


def recent_turns(messages: DataFrame, limit: int = 8) -> DataFrame:
    """Last turns of each conversation, told in order."""
    from pyspark.sql import Window

    last = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = messages.withColumn("back", F.row_number().over(last)).where(F.col("back") <= limit)
    turn = F.struct("back", F.concat_ws(": ", "role", "content").alias("said"))
    return rows.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(turn))), lambda t: t.said), "\n").alias("history")
    )


def last_user_turn(messages: DataFrame) -> DataFrame:
    return user(messages).groupBy("conversation_id").agg(F.max_by("content", "id").alias("content"))


def needs_rewriting(messages: DataFrame, clarification: str, short: int = 6) -> DataFrame:
    """Whether each user turn should be rewritten before search: a first turn, one of few words, or one that
    follows the assistant's question for clarification, whatever its length."""
    from pyspark.sql import Window

    before = Window.partitionBy("conversation_id").orderBy("id")
    last = messages.withColumn("last", F.lag(F.struct("role", "content")).over(before)).where(F.col("role") == "user")
    n = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda w: w != ""))
    asked = (F.col("last.role") == "assistant") & F.coalesce("last.content", F.lit("")).contains(clarification)
    return last.select("id", (F.col("last").isNull() | asked | (n <= short)).alias("needs_rewriting"))


def token_use(calls: DataFrame) -> DataFrame:
    """Tokens per turn, apart for the generation itself and for auxiliary calls."""
    part = lambda own, c: F.sum(F.when(F.col("is_generation") == own, F.col(c))).alias(("" if own else "aux_") + c)
    return calls.groupBy("turn_id").agg(*[part(own, c) for own in (True, False) for c in ("prompt_tokens", "completion_tokens")])
