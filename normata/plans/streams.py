"""Queries for the keyed checks, in their batch form over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from normata.sources.scratch import new_folder
from normata.streaming import keyed as K
from normata.streaming import limits as L


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def limited(spark, d):
    out = L.rate_limited_batch(events(spark, d), "user_id", "ts", "event_id", rate=3, span=86400.0)
    return out.select("event_id", "accepted")


def buckets(spark, d):
    rows = events(spark, d).withColumn("address", F.col("user_id") % 17)
    return L.two_buckets(rows, "user_id", "address", "ts", "event_id", rate=3, span=86400.0).select("event_id", "accepted")


def reads(spark, d):
    rows = events(spark, d).withColumn("turn", F.col("event_type") == "click")
    return L.cached_reads(rows, "user_id", "ts", "event_id", "turn", 86400.0).select("event_id", "cached")


def streamed(build, *columns):
    """A streaming form over all events as a stream of files, to its end; two events long after the last let the watermark pass them all.

    Each of these comes in a run of its own, however many files hold the events: a second pass gets the last of them when the
    first event is past, and needs the watermark of the second to decide them.
    """

    def query(spark, d):
        K.use_rocksdb(spark)
        rows, folder = events(spark, d), new_folder(spark, "stream")
        rows.write.parquet(f"{folder}/in/1")
        came = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = build(came.withColumn("address", F.col("user_id") % 17).withColumn("turn", F.col("event_type") == "click"))
        last = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
        for i in (1, 2, 3):
            if i > 1:
                last.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(i))).select([F.col(f.name).cast(f.dataType) for f in rows.schema]).write.parquet(f"{folder}/in/{i}")
            run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out").selectExpr(*columns)

    return query


DAY = 86400.0
QUERIES = {
    "rate_limiter_stream": streamed(lambda s: K.limited_stream(s, "user_id", "ts", "event_id", 3, DAY).where("id >= 0"), "id AS event_id", "accepted"),
    "two_buckets_stream": streamed(lambda s: K.two_buckets_stream(s, "user_id", "address", "ts", "event_id", 3, DAY).where("id >= 0"), "id AS event_id", "accepted"),
    "history_cache_stream": streamed(lambda s: K.cached_reads_stream(s, "user_id", "ts", "event_id", "turn", DAY).where("id >= 0"), "id AS event_id", "cached"),
    "alert_cooldown_stream": streamed(lambda s: K.cooled_down_stream(s.where("event_type IN ('error', 'end')"), "event_type", "ts", "event_id").where("event_type <> 'end'"), "event_type", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts"),
    "two_buckets": buckets,
    "history_cache": reads,
    "drop_repeated_updates": lambda s, d: L.drop_repeats_batch(events(s, d), "user_id", "ts", "event_id", 24).select("event_id"),
    "rate_limiter": limited,
    "error_surges": lambda s, d: L.error_surges(events(s, d).where("event_type = 'error'")).select(stamp("window_start"), "errors"),
    "alert_cooldown": lambda s, d: L.cooled_down(events(s, d).where("event_type = 'error'"), "event_type", "ts").select("event_type", stamp("ts")),
    "activity_sessions": lambda s, d: L.sessions(events(s, d)).select("user_id", stamp("began"), "events"),
    "hourly_events": lambda s, d: L.tumbling_counts(events(s, d)).select(stamp("hour"), "event_type", "events"),
}


def fold_sql(key: str, span: str, where: str = "true", out: str = "event_id") -> str:
    """First event of each key, and each one ``span`` or more after the last kept, by recursion."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS o FROM events WHERE {where}),
      k AS (SELECT {key} AS key, o, ts FROM e WHERE o = 1
        UNION ALL SELECT key, o, ts FROM (SELECT k.key, e.o, e.ts, row_number() OVER (PARTITION BY k.key ORDER BY e.o) AS n FROM k JOIN e ON e.{key} = k.key AND e.o > k.o AND e.ts >= k.ts + {span}) WHERE n = 1)
      SELECT {out} FROM e JOIN k ON k.key = e.{key} AND k.o = e.o"""


def limit_sql(name: str, source: str, key: str) -> str:
    """At most three accepted in a day, by recursion over each key's events with the list of those accepted."""
    return f"""{name}_e AS (SELECT event_id, ts, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS o FROM {source}),
      {name} AS (SELECT key, o, event_id, true AS accepted, [ts] AS held FROM {name}_e WHERE o = 1
        UNION ALL SELECT key, o, event_id, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, ts) ELSE f END
        FROM (SELECT e.key, e.o, e.event_id, e.ts, list_filter(k.held, lambda h: e.ts - h <= INTERVAL 1 DAY) AS f FROM {name} k JOIN {name}_e e ON e.key = k.key AND e.o = k.o + 1))"""


FMT = "'%Y-%m-%d %H:%M:%S'"
ORACLE_SQL = {
    "rate_limiter": f"WITH RECURSIVE {limit_sql('a', 'events', 'user_id')} SELECT event_id, accepted FROM a",
    "two_buckets": f"""WITH RECURSIVE {limit_sql('a', 'events', 'user_id')}, passed AS (SELECT e.* FROM events e JOIN a ON a.event_id = e.event_id WHERE accepted), {limit_sql('b', 'passed', 'user_id % 17')}
      SELECT event_id, accepted FROM b UNION ALL SELECT event_id, false FROM a WHERE NOT accepted""",
    "history_cache": """WITH RECURSIVE p AS (SELECT *, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events),
      r AS (SELECT event_id, ts, user_id || '-' || part AS key, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS o FROM p WHERE event_type <> 'click'),
      s AS (SELECT key, o, event_id, false AS cached, ts AS stored FROM r WHERE o = 1
        UNION ALL SELECT r.key, r.o, r.event_id, r.ts - stored < INTERVAL 1 DAY, CASE WHEN r.ts - stored < INTERVAL 1 DAY THEN stored ELSE r.ts END FROM s JOIN r ON r.key = s.key AND r.o = s.o + 1)
      SELECT event_id, cached FROM s""",
    "drop_repeated_updates": fold_sql("user_id", "INTERVAL 24 HOURS"),
    "error_surges": f"""SELECT strftime(w, {FMT}) AS window_start, count(*) AS errors FROM (SELECT unnest([time_bucket(INTERVAL 5 MINUTES, ts), time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES]) AS w
      FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) >= 3""",
    "alert_cooldown": fold_sql("event_type", "INTERVAL 30 MINUTES", "event_type = 'error'", f"event_type, strftime(e.ts, {FMT}) AS ts"),
    "activity_sessions": f"""SELECT user_id, strftime(min(ts), {FMT}) AS began, count(*) AS events FROM (SELECT *, sum(CASE WHEN ts - p < INTERVAL 60 MINUTES THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""",
    "hourly_events": f"SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
ORACLE_SQL |= {f"{name}_stream": ORACLE_SQL[name] for name in ("rate_limiter", "two_buckets", "history_cache", "alert_cooldown")}
