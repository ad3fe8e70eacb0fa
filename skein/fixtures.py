"""The driver's tables as canonical lake relations, in Spark and (for the oracle) as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


NAMES = ("claude", "codex", "omp", "droid", "kimi")


def lake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    t, none = F.col("event_type"), F.lit(None)
    extra = F.when(t == "error", F.concat(F.lit('{"decision":"'), F.when(k % 3 == 0, "block").otherwise("allow"), F.lit('","event":"e","infra":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}")))
    extra = extra.when(F.col("user_id") % 4 == 0, F.concat(F.lit('{"source_stem_hash":"'), F.sha2(F.concat(F.lit("stem-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")), 256), F.lit('"}'))).otherwise("{}")
    one = e.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(t == "error", "hooks").otherwise(_pick(NAMES, F.col("user_id"))).alias("runtime"),
        F.lit("m1").alias("machine"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 10).cast("string")).alias("project"),
        F.when(t == "view", "user").when(t == "click", "assistant").when(t == "purchase", "tool_call").when(t == "signup", "meta").otherwise("hook_decision").alias("event_type"),
        F.concat(t, F.lit(" "), F.col("event_id").cast("string")).alias("text"),
        F.when(t == "purchase", F.concat(F.lit("tool_"), (k % 7).cast("string"))).when(t == "error", F.concat(F.lit("hook_"), (k % 5).cast("string"))).alias("tool_name"),
        F.when(t == "click", F.concat(F.lit("model_"), (k % 3).cast("string"))).alias("model"),
        F.when(t == "click", F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("tokens_in"),
        F.when(t == "click", k).alias("tokens_out"),
        extra.alias("extra"),
    )
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    two = c.select(
        at.alias("ts"),
        _pick(NAMES, F.col("conv_id")).alias("runtime"),
        F.lit("m2").alias("machine"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        none.cast("string").alias("project"),
        F.when(F.col("role") == "system", "meta").otherwise(F.col("role")).alias("event_type"),
        F.col("text"),
        none.cast("string").alias("tool_name"),
        none.cast("string").alias("model"),
        none.cast("long").alias("tokens_in"),
        none.cast("long").alias("tokens_out"),
        F.lit("{}").alias("extra"),
    )
    return one.unionByName(two)


def lake_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aspects for each labelled document, and a later flipped value for every third one."""
    base = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = base.select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("aspect", "v"))
    later = rows.filter("doc_id % 3 = 0").withColumn("v", 1 - F.col("v")).withColumn("late", F.lit(1))
    rows = rows.withColumn("late", F.lit(0)).unionByName(later)
    return rows.select(
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(late, 0, cast(doc_id as int), 0)").alias("ts"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("session_id"),
        _pick(NAMES, F.col("doc_id")).alias("runtime"),
        "aspect",
        F.col("v").cast("string").alias("value"),
        F.lit(None).cast("string").alias("note"),
        F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("model:x").alias("source"),
    )


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term tallies: some ids are the lake's, some only match by the hash of their stem, some not at all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'signup'")
    k, day = F.get_json_object("props", "$.k").cast("long"), F.date_format("ts", "yyyyMMdd")
    user = F.col("user_id").cast("string")
    sid = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("stem-"), user, F.lit("-"), day)).when(F.col("user_id") % 4 == 1, F.concat(F.lit("rollout-"), user)).otherwise(F.concat(F.lit("u"), user, F.lit("-"), day))
    return e.select(sid.alias("sessionId"), F.concat(F.lit("w"), (k % 4).cast("string")).alias("word"), F.when(k % 3 == 0, "strong").when(k % 3 == 1, "moderate").otherwise("mild").alias("severity"), (k % 5 + 1).alias("count"), F.when(k % 10 != 9, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last_seen"))


def index_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index_terms(spark, sf_dir)
    return t.groupBy("sessionId").agg(F.max("last_seen").alias("mtime")).select("sessionId", F.concat(F.lit("/cwd/"), F.length("sessionId").cast("string")).alias("cwd"), "mtime", F.when(F.col("mtime") % 2 == 0, F.col("mtime") + 60).alias("last_activity"))


EVENTS_SQL = """
lake_events AS (
  SELECT ts,
    CASE WHEN event_type='error' THEN 'hooks' ELSE list_extract(['claude','codex','omp','droid','kimi'], CAST(user_id % 5 AS INTEGER)+1) END AS runtime,
    'm1' AS machine,
    'u'||user_id||'-'||strftime(ts,'%Y%m%d') AS session_id,
    '/p/'||(user_id%10) AS project,
    CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'tool_call' WHEN 'signup' THEN 'meta' ELSE 'hook_decision' END AS event_type,
    event_type||' '||event_id AS text,
    CASE event_type WHEN 'purchase' THEN 'tool_'||(k%7) WHEN 'error' THEN 'hook_'||(k%5) END AS tool_name,
    CASE WHEN event_type='click' THEN 'model_'||(k%3) END AS model,
    CASE WHEN event_type='click' THEN CAST(floor(value*100+0.5) AS BIGINT) END AS tokens_in,
    CASE WHEN event_type='click' THEN k END AS tokens_out,
    CASE WHEN event_type='error' THEN '{"decision":"'||CASE WHEN k%3=0 THEN 'block' ELSE 'allow' END||'","event":"e","infra":'||CASE WHEN k%2=0 THEN 'true' ELSE 'false' END||'}'
         WHEN user_id%4=0 THEN '{"source_stem_hash":"'||sha256('stem-'||user_id||'-'||strftime(ts,'%Y%m%d'))||'"}' ELSE '{}' END AS extra
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)
  UNION ALL
  SELECT TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE,
    list_extract(['claude','codex','omp','droid','kimi'], CAST(conv_id % 5 AS INTEGER)+1), 'm2', 'conv-'||conv_id, NULL,
    CASE WHEN role='system' THEN 'meta' ELSE role END, text, NULL, NULL, NULL, NULL, '{}'
  FROM conversations
)"""
LABELS_SQL = """
lake_labels AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + late * INTERVAL 1 DAY + doc_id * INTERVAL 1 MINUTE AS ts, 'doc-'||doc_id AS session_id,
    list_extract(['claude','codex','omp','droid','kimi'], CAST(doc_id % 5 AS INTEGER)+1) AS runtime, aspect, CAST(v AS VARCHAR) AS value,
    CAST(NULL AS VARCHAR) AS note, CASE WHEN doc_id%2=0 THEN 'manual' ELSE 'model:x' END AS source
  FROM (SELECT doc_id, aspect, CASE WHEN late=1 THEN 1-v ELSE v END AS v, late
        FROM (SELECT doc_id, 'quality' AS aspect, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) CROSS JOIN (VALUES (0),(1)) AS l(late)
        WHERE late=0 OR doc_id%3=0)
)"""
INDEX_SQL = """
terms AS (
  SELECT CASE WHEN user_id%4=0 THEN 'stem-'||user_id||'-'||strftime(ts,'%Y%m%d') WHEN user_id%4=1 THEN 'rollout-'||user_id ELSE 'u'||user_id||'-'||strftime(ts,'%Y%m%d') END AS sid,
    'w'||(k%4) AS word, CASE k%3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'mild' END AS severity, k%5+1 AS n,
    CASE WHEN k%10<>9 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS last_seen
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events WHERE event_type='signup')
),
index_sessions AS (
  SELECT sid, '/cwd/'||length(sid) AS cwd, mtime, CASE WHEN mtime%2=0 THEN mtime+60 END AS last_activity FROM (SELECT sid, max(last_seen) AS mtime FROM terms GROUP BY sid)
)"""
SESSIONS_SQL = """
lake_sessions AS (
  SELECT runtime, session_id, max(project) AS project, min(ts) AS first_ts, max(ts) AS last_ts,
    count(*) FILTER (WHERE event_type='user') AS user_msgs, count(*) FILTER (WHERE event_type='assistant') AS assistant_msgs,
    count(*) FILTER (WHERE event_type='tool_call') AS tool_calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
    max(json_extract_string(extra,'$.source_stem_hash')) AS session_alias
  FROM lake_events WHERE session_id IS NOT NULL GROUP BY runtime, session_id
)"""
HOOKS_SQL = """
hook_decisions AS (
  SELECT ts, session_id, project, tool_name AS hook_id, json_extract_string(extra,'$.decision') AS decision, json_extract_string(extra,'$.event') AS hook_event,
    json_extract_string(extra,'$.infra') AS infra, text AS reason
  FROM lake_events WHERE runtime='hooks' AND event_type='hook_decision'
)"""
