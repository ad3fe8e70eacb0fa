"""Queries over the driver's tables and their DuckDB equivalents. Times in results are without a zone (UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as X
from .functions import masking as M
from .operators import export, reads
from .operators import labels as L
from .plans import signals, views

NOW = dt.datetime(2024, 1, 31)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as plain ones, for comparison."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema])


def over_events(f):
    return lambda spark, sf: plain(f(X.lake_events(spark, sf)))


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


E, LB, I, S, H = X.EVENTS_SQL, X.LABELS_SQL, X.INDEX_SQL, X.SESSIONS_SQL, X.HOOKS_SQL
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


# Views
SESSION_COLUMNS = "runtime, session_id, project, first_ts, last_ts, user_msgs, assistant_msgs, tool_calls, tokens_in, tokens_out, session_alias"
add("events_scan", over_events(lambda e: e), sql("SELECT * FROM lake_events", E))
add("sessions", over_events(views.sessions), sql("SELECT * FROM lake_sessions", E, S))
add("tools_daily", over_events(views.tools_daily), sql("SELECT CAST(ts AS DATE) AS day, runtime, tool_name, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM lake_events WHERE event_type='tool_call' AND tool_name IS NOT NULL GROUP BY ALL", E))
add("tokens_daily", over_events(views.tokens_daily), sql("SELECT CAST(ts AS DATE) AS day, runtime, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(DISTINCT session_id) AS sessions FROM lake_events WHERE tokens_in IS NOT NULL OR tokens_out IS NOT NULL GROUP BY ALL", E))
add("hook_decisions", over_events(views.hook_decisions), sql("SELECT * FROM hook_decisions", E, H))
add("blocks_by_hook", over_events(views.blocks_by_hook), sql("SELECT hook_id, count(*) AS blocks, count(DISTINCT session_id) AS sessions, min(ts) AS first_block_ts, max(ts) AS last_block_ts, arg_max(reason, ts) AS last_reason FROM hook_decisions WHERE decision='block' GROUP BY hook_id", E, H))
INTERRUPTED = """
ends AS (
  SELECT runtime, session_id, arg_max(event_type, (ts, event_type, text)) AS stopped_with,
    arg_max(text, (ts, event_type, text)) FILTER (event_type = 'user') AS asked
  FROM lake_events WHERE session_id IS NOT NULL AND event_type IN ('user', 'assistant', 'tool_call') GROUP BY ALL),
interrupted AS (
  SELECT runtime, session_id, project, if(stopped_with = 'user', 'unanswered', 'cut_off_mid_tool') AS stopped_as,
    first_ts, last_ts, user_msgs, assistant_msgs, tool_calls, asked[1:240] AS last_user_text
  FROM ends JOIN lake_sessions USING (runtime, session_id) WHERE stopped_with <> 'assistant')"""
add("interrupted_sessions", over_events(views.interrupted_sessions), sql("SELECT * FROM interrupted", E, S, INTERRUPTED))

# Reads
add("sessions_by_project", over_events(lambda e: reads.sessions(e, "claude", "/P/_", 500)), sql(f"SELECT {SESSION_COLUMNS} FROM lake_sessions WHERE runtime='claude' AND lower(coalesce(project,'')) LIKE '%/p/_%' ORDER BY last_ts DESC NULLS LAST, runtime, session_id LIMIT 500", E, S))
add("interrupted_read", over_events(lambda e: reads.interrupted(e, limit=50)), sql("SELECT * FROM interrupted ORDER BY last_ts DESC NULLS LAST, runtime, session_id LIMIT 50", E, S, INTERRUPTED))
add("events_filter", over_events(lambda e: reads.events_filter(e, "codex", event_type="user", limit=100)), sql("SELECT ts, runtime, session_id, event_type, tool_name, substr(text,1,240) AS text FROM lake_events WHERE runtime='codex' AND event_type='user' ORDER BY ts DESC NULLS LAST, session_id, event_type, text LIMIT 100", E))
add("search_literal", over_events(lambda e: reads.search(e, "CLICK 1", limit=500)), sql("SELECT ts, runtime, session_id, event_type, substr(text,1,240) AS text FROM lake_events WHERE lower(text) LIKE '%click 1%' ESCAPE '!' ORDER BY ts DESC NULLS LAST, session_id, event_type, text LIMIT 500", E))
add("show_conversation", over_events(lambda e: reads.show(e, "conv-3", include="all")), sql("SELECT ts, runtime, event_type, tool_name, text, count(*) OVER () AS matched FROM lake_events WHERE session_id='conv-3' ORDER BY ts, event_type, text LIMIT 2000", E))
add("show_counts", over_events(reads.show_counts), sql("SELECT session_id, event_type, count(*) AS matched FROM lake_events WHERE event_type IN ('user','assistant') GROUP BY ALL", E))
add("stats_window", over_events(lambda e: reads.stats(e, NOW)), sql("SELECT runtime, count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE event_type='user') AS user_msgs, count(*) FILTER (WHERE event_type='assistant') AS assistant_msgs, count(*) FILTER (WHERE event_type='tool_call') AS tool_calls FROM lake_events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY runtime", E))
add("hooks_filter", over_events(lambda e: reads.hooks(e, "block", "hook_2", 200)), sql("SELECT * FROM hook_decisions WHERE decision='block' AND hook_id='hook_2' ORDER BY ts DESC NULLS LAST, session_id, reason LIMIT 200", E, H))
add("first_user_prompt", over_events(reads.first_user_prompts), sql("SELECT runtime, session_id, ts, text AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY runtime, session_id ORDER BY ts, text) AS rn FROM lake_events WHERE event_type='user' AND session_id IS NOT NULL AND length(trim(text))>0) WHERE rn=1", E))


def by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The passthrough: any SQL over the registered views."""
    views.register_views(X.lake_events(spark, sf), X.lake_labels(spark, sf))
    return plain(spark.sql("SELECT s.runtime, count(*) AS n_sessions, sum(s.user_msgs) AS n_user, max(t.calls) AS top_calls FROM sessions s LEFT JOIN (SELECT runtime, max(calls) AS calls FROM tools_daily GROUP BY runtime) t ON t.runtime = s.runtime GROUP BY s.runtime"))


add("sql_passthrough", by_sql, sql("SELECT s.runtime, count(*) AS n_sessions, CAST(sum(s.user_msgs) AS BIGINT) AS n_user, max(t.calls) AS top_calls FROM lake_sessions s LEFT JOIN (SELECT runtime, max(calls) AS calls FROM (SELECT CAST(ts AS DATE) AS d, runtime, tool_name, count(*) AS calls FROM lake_events WHERE event_type='tool_call' AND tool_name IS NOT NULL GROUP BY ALL) GROUP BY runtime) t ON t.runtime=s.runtime GROUP BY s.runtime", E, S))

# Labels
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, aspect ORDER BY ts DESC, source DESC, value DESC) AS rn FROM lake_labels) WHERE rn=1)"
add("labels_history", lambda spark, sf: plain(X.lake_labels(spark, sf)), sql("SELECT * FROM lake_labels", LB))
add("labels_latest", lambda spark, sf: plain(views.latest_labels(X.lake_labels(spark, sf))), sql("SELECT ts, session_id, runtime, aspect, value, note, source FROM latest", LB, LATEST))
add("labels_list", lambda spark, sf: plain(L.latest(X.lake_labels(spark, sf), aspect="toxic", runtime="omp", limit=40)), sql("SELECT ts, session_id, runtime, aspect, value, note, source FROM latest WHERE aspect='toxic' AND runtime='omp' ORDER BY ts DESC, session_id, aspect LIMIT 40", LB, LATEST))
add("label_aspects", lambda spark, sf: L.aspects(X.lake_labels(spark, sf)), sql("SELECT aspect, count(DISTINCT value) AS \"values\", count(*) AS labels, count(DISTINCT session_id) AS sessions FROM latest GROUP BY aspect", LB, LATEST))

# Signals
FRUSTRATION = """,
tallies AS (SELECT sid, sum(n * list_extract([3, 2, 1], CASE WHEN severity = 'strong' THEN 1 WHEN severity = 'moderate' THEN 2 ELSE 3 END)) AS weighted, sum(n) AS hits, count(DISTINCT word) AS words FROM terms GROUP BY sid),
same AS (SELECT sid, l.* FROM tallies JOIN lake_sessions l ON l.session_id = sid UNION SELECT sid, l.* FROM tallies JOIN lake_sessions l ON l.session_alias = sha256(sid)),
joined AS (
  SELECT t.sid AS session_id, CAST(weighted AS BIGINT) AS score, CAST(hits AS BIGINT) AS hits, words, ifnull(m.runtime, if(t.sid LIKE 'rollout-%', 'codex', NULL)) AS runtime,
    m.runtime AS known, m.project AS own, i.cwd, m.first_ts, m.last_ts, m.user_msgs
  FROM tallies t LEFT JOIN same m ON m.sid = t.sid LEFT JOIN index_sessions i ON i.sid = t.sid)
SELECT session_id, CAST(sum(score) AS BIGINT) AS frustration_score, CAST(sum(hits) AS BIGINT) AS term_hits, max(words) AS distinct_terms, runtime, ifnull(own, cwd) AS project, first_ts, last_ts, user_msgs
FROM joined GROUP BY session_id, runtime, known, own, cwd, first_ts, last_ts, user_msgs"""


def signal(f, *tables):
    return lambda spark, sf: plain(f(X.lake_events(spark, sf), *[t(spark, sf) for t in tables]))


add("frustration", signal(signals.frustration, X.index_terms, X.index_sessions), "WITH " + ",".join((E, S, I)) + FRUSTRATION + " ORDER BY frustration_score DESC, session_id, runtime LIMIT 25")
add("frustration_all", signal(lambda e, t, s: signals.frustration(e, t, s, None), X.index_terms, X.index_sessions), "WITH " + ",".join((E, S, I)) + FRUSTRATION)
add("hook_overlap", signal(signals.hook_overlap, X.index_terms), sql("SELECT (SELECT count(*) FROM b) AS hook_blocked_sessions, (SELECT count(*) FROM f) AS frustrated_sessions, (SELECT count(*) FROM b JOIN f USING (session_id)) AS overlap_sessions", E, H, I, "b AS (SELECT DISTINCT session_id FROM hook_decisions WHERE decision='block' AND session_id IS NOT NULL)", "f AS (SELECT DISTINCT sid AS session_id FROM terms)"))
add("hook_daily", signal(signals.hook_daily, X.index_terms), sql("SELECT day, coalesce(hook_blocks,0) AS hook_blocks, coalesce(blocked_sessions,0) AS blocked_sessions, coalesce(frustrated_sessions,0) AS frustrated_sessions, CAST(coalesce(term_hits,0) AS BIGINT) AS term_hits FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS hook_blocks, count(DISTINCT session_id) AS blocked_sessions FROM hook_decisions WHERE decision='block' GROUP BY 1) FULL JOIN (SELECT CAST(make_timestamp(last_seen*1000000) AS DATE) AS day, count(DISTINCT sid) AS frustrated_sessions, sum(n) AS term_hits FROM terms WHERE last_seen IS NOT NULL GROUP BY 1) USING (day) ORDER BY day DESC LIMIT 30", E, H, I))
add("freshness", signal(signals.freshness, X.index_sessions), sql("SELECT 'index' AS source, make_timestamp(max(mtime)*1000000) AS newest_activity, count(*) AS items FROM index_sessions UNION ALL SELECT 'lake:'||runtime, max(ts), count(DISTINCT session_id) FROM lake_events GROUP BY runtime", E, I))
add("freshness_probe", lambda spark, sf: signals.freshness_probe(X.index_sessions(spark, sf), 1706659200), sql("SELECT newest_mtime, newest_activity, items, CASE WHEN m IS NULL THEN 'n/a' WHEN m<60 THEN m||'m' WHEN h<24 THEN h||'h' ELSE CAST(floor(h/24.0+0.5) AS BIGINT)||'d' END AS age FROM (SELECT *, CAST(floor(m/60.0+0.5) AS BIGINT) AS h FROM (SELECT *, CAST(floor((1706659200-newest_activity)/60.0+0.5) AS BIGINT) AS m FROM (SELECT max(mtime) AS newest_mtime, max(coalesce(last_activity,mtime)) AS newest_activity, count(*) AS items FROM index_sessions)))", I))

# Masking: secrets and near misses are made of the document id, as documents hold none of the masked shapes
SECRET_SQL = """
secrets AS (SELECT doc_id, text || ' ' || CASE doc_id % 8
    WHEN 0 THEN 'API_KEY=' || sha256('a'||doc_id)
    WHEN 1 THEN 'é x sk-' || upper(substr(sha256('b'||doc_id),1,12)) || substr(sha256('c'||doc_id),1,12) || ' end'
    WHEN 2 THEN 'run ' || upper(substr(sha256('d'||doc_id),1,30)) || lower(substr(sha256('e'||doc_id),1,30)) || '+/ gh'
    WHEN 3 THEN 'near ' || upper(substr(sha256('f'||doc_id),1,20)) || substr(sha256('g'||doc_id),1,19)
    WHEN 4 THEN 'few ' || repeat('aB1', 20)
    WHEN 5 THEN 'two ' || sha256('h'||doc_id)
    WHEN 6 THEN 'PASS_WORD=short12345 AB=' || sha256('i'||doc_id)
    ELSE 'TOKEN_A=' || sha256('j'||doc_id) || ' ghp-' || sha256('k'||doc_id) END AS text FROM documents)"""


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    def s(prefix: str):
        return F.sha2(F.concat(F.lit(prefix), F.col("doc_id").cast("string")), 256)

    r = F.col("doc_id") % 8
    tail = (
        F.when(r == 0, F.concat(F.lit("API_KEY="), s("a")))
        .when(r == 1, F.concat(F.lit("é x sk-"), F.upper(F.substring(s("b"), 1, 12)), F.substring(s("c"), 1, 12), F.lit(" end")))
        .when(r == 2, F.concat(F.lit("run "), F.upper(F.substring(s("d"), 1, 30)), F.lower(F.substring(s("e"), 1, 30)), F.lit("+/ gh")))
        .when(r == 3, F.concat(F.lit("near "), F.upper(F.substring(s("f"), 1, 20)), F.substring(s("g"), 1, 19)))
        .when(r == 4, F.concat(F.lit("few "), F.lit("aB1" * 20)))
        .when(r == 5, F.concat(F.lit("two "), s("h")))
        .when(r == 6, F.concat(F.lit("PASS_WORD=short12345 AB="), s("i")))
        .otherwise(F.concat(F.lit("TOKEN_A="), s("j"), F.lit(" ghp-"), s("k")))
    )
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat("text", F.lit(" "), tail).alias("text"))


def _mask_sql(kind: str, pattern: str, source: str, target: str) -> str:
    """One class of masking in DuckDB: hits and gaps zipped. Its word boundary is ASCII, so the fixture has no accent before one."""
    p = pattern.replace("'", "''")
    mark = f"'[masked:{kind}:'||length(h)||':'||substr(sha256(h),1,8)||']'"
    if kind == "entropy":
        mark = f"CASE WHEN length(h)>0 AND len(list_distinct(string_split(h,'')))>=16 AND CAST(regexp_matches(h,'[a-z]') AS INT)+CAST(regexp_matches(h,'[A-Z]') AS INT)+CAST(regexp_matches(h,'[0-9]') AS INT)+CAST(regexp_matches(h,'[+/=_-]') AS INT)>=3 THEN {mark} ELSE h END"
    n = f"len(list_filter(hits, lambda h: ({mark}) <> h))"
    return f"{target} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(gaps)+1), lambda i: gaps[i] || coalesce(list_transform(hits, lambda h: {mark})[i], '')), '') AS text, {n} AS n_{kind}" + {"assignment": "", "token": ", n_assignment", "entropy": ", n_assignment, n_token"}[kind] + f" FROM (SELECT *, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM {source}))"


MASKED = [SECRET_SQL, _mask_sql(*M.CLASSES[0], "secrets", "m1"), _mask_sql(*M.CLASSES[1], "m1", "m2"), _mask_sql(*M.CLASSES[2], "m2", "m3")]
add("mask_text", lambda spark, sf: secrets(spark, sf).select("doc_id", M.mask(F.col("text")).alias("text")), sql("SELECT doc_id, text FROM m3", *MASKED))
add("mask_counts", lambda spark, sf: secrets(spark, sf).select(*[F.sum(c).alias(f"n_{k}") for k, c in M.mask_counts(F.col("text")).items()]), sql("SELECT CAST(sum(n_assignment) AS BIGINT) AS n_assignment, CAST(sum(n_token) AS BIGINT) AS n_token, CAST(sum(n_entropy) AS BIGINT) AS n_entropy FROM m3", *MASKED))


def long_texts() -> Column:
    """Each document's text repeated beyond the cap, or its first letter with a character of two units at the cap."""
    text, letter = F.col("text"), F.substring("text", 1, 1)
    repeated = F.repeat(F.concat(text, F.lit(" ")), (F.floor(F.lit(M.CAP) / (F.length(text) + 1)) + 1).cast("int"))
    return F.when(F.col("doc_id") % 3 == 0, repeated).when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(letter, F.lit(M.CAP - 1)), F.lit("😀"), text)).otherwise(F.concat(F.repeat(letter, F.lit(M.CAP - 2)), F.lit("😀"), text))


add(
    "clip_text",
    lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 0").select("doc_id", long_texts().alias("t")).select("doc_id", M.clip(F.col("t")).alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest")),
    "SELECT doc_id, length(c) AS n, sha256(c) AS digest FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(repeat(text || ' ', 65536 // (length(text) + 1) + 1), 1, 65536) WHEN 1 THEN repeat(substr(text,1,1), 65535) ELSE repeat(substr(text,1,1), 65534) || '😀' END AS c FROM documents WHERE length(text) > 0)",
)
add(
    "date_partition",
    lambda spark, sf: plain(X.lake_events(spark, sf)).withColumn("raw", F.when(F.length("text") % 5 == 0, F.concat(F.lit("x"), F.col("ts").cast("string"))).when(F.length("text") % 7 == 0, F.lit("2024-1-05")).otherwise(F.col("ts").cast("string"))).groupBy(M.date_partition(F.col("raw")).alias("date")).agg(F.count("*").alias("n")),
    sql("SELECT CASE WHEN length(text)%5=0 OR length(text)%7=0 THEN 'unknown' ELSE strftime(ts,'%Y-%m-%d') END AS date, count(*) AS n FROM lake_events GROUP BY 1", E),
)


def ts_text():
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")


TS_SQL = "strftime(ts,'%Y-%m-%d %H:%M:%S.%f')"
UUID_SQL = f"substr(sha256(coalesce(runtime,'')||chr(10)||coalesce(session_id,'')||chr(10)||{TS_SQL}||chr(10)||event_type||chr(10)||text||chr(10)||coalesce(tool_name,'')||chr(10)||coalesce(model,'')||chr(10)||extra||chr(10)),1,32)"
add("event_uuid", lambda spark, sf: X.lake_events(spark, sf).select("session_id", ts_text().alias("ts"), M.fingerprint(F.col("runtime"), F.col("session_id"), ts_text(), F.col("event_type"), F.col("text"), F.col("tool_name"), F.col("model"), F.col("extra")).alias("uuid")), sql(f"SELECT session_id, {TS_SQL} AS ts, {UUID_SQL} AS uuid FROM lake_events", E))
add("export_sessions", lambda spark, sf: export.export_rows(X.lake_events(spark, sf).union(X.lake_events(spark, sf).filter("event_type = 'user'")), ts_text()), sql(f"SELECT DISTINCT 1 AS lake_schema, {UUID_SQL} AS uuid, {TS_SQL} AS ts, runtime, session_id, project, event_type, text, tool_name, model, tokens_in, tokens_out, extra, sha256(runtime||chr(10)||session_id) AS session_hash FROM lake_events WHERE event_type IN ('user','assistant','thinking','tool_call','tool_result','meta') AND length(session_id)>0 AND runtime<>'hooks'", E))
