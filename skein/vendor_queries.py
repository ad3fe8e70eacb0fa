"""Queries for the adapters and the lake on disk: vendor lines are built of the driver's tables, so the expected
canonical rows can be said in SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import masking as M
from .operators import compaction, export, lake
from .operators import labels as L
from .plans import signals, views
from .session import shared_dir
from .sources import adapters as A
from .sources import segments as G
from .streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COLUMNS = ("session_id", "ts", "event_type", "text", "tokens_in", "tokens_out")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    return spark.read.parquet(f"{sf}/conversations.parquet").withColumn("at", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("ms", F.unix_millis(at)).withColumn("sid", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))


def obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def lines(df: DataFrame, file: Column, line: Column) -> DataFrame:
    return df.select(file.alias("file"), F.col("turn").cast("long").alias("seq"), line.alias("line"))


ROLE, TEXT = "role", "text"


def claude_lines(df: DataFrame) -> DataFrame:
    said = F.to_json(obj(type="user", timestamp=F.col("at"), sessionId=F.col("sid"), message=obj(role="user", content=F.col(TEXT))))
    answered = F.to_json(obj(type="assistant", timestamp=F.col("at"), sessionId=F.col("sid"), message=obj(role="assistant", content=F.array(obj(type="text", text=F.col(TEXT))), usage=obj(input_tokens=F.col("turn"), output_tokens=F.length(TEXT)))))
    system = F.to_json(obj(type="system", timestamp=F.col("at"), sessionId=F.col("sid"), content=F.col(TEXT)))
    return lines(df, F.concat(F.lit("/c/-p/"), "sid", F.lit(".jsonl")), F.when(F.col(ROLE) == "user", said).when(F.col(ROLE) == "assistant", answered).otherwise(system))


def codex_lines(df: DataFrame) -> DataFrame:
    said = F.to_json(obj(type="event_msg", timestamp=F.col("at"), payload=obj(type="user_message", message=F.col(TEXT))))
    item = F.to_json(obj(type="response_item", timestamp=F.col("at"), payload=obj(type="message", role=F.col(ROLE), content=F.array(obj(type="text", text=F.col(TEXT))))))
    return lines(df, F.concat(F.lit("/x/"), "sid", F.lit(".jsonl")), F.when(F.col(ROLE) == "user", said).otherwise(item))


def message_lines(df: DataFrame, file: Column) -> DataFrame:
    return lines(df, file, F.to_json(obj(type="message", timestamp=F.col("at"), message=obj(role=F.col(ROLE), content=F.array(obj(type="text", text=F.col(TEXT)))))))


def omp_lines(df: DataFrame) -> DataFrame:
    return message_lines(df, F.concat(F.lit("/o/d/2024_"), "sid", F.lit(".jsonl")))


def droid_lines(df: DataFrame) -> DataFrame:
    return message_lines(df, F.concat(F.lit("/d/"), "sid", F.lit(".jsonl")))


def kimi_lines(df: DataFrame) -> DataFrame:
    return lines(df, F.concat(F.lit("/k/wd_a/session_"), F.col("conv_id").cast("string"), F.lit("/agents/main/wire.jsonl")), F.to_json(obj(type="context.append_message", time=F.col("ms"), message=obj(role=F.col(ROLE), content=F.array(obj(type="text", text=F.col(TEXT)))))))


def hook_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = X.lake_events(spark, sf).filter("runtime = 'hooks'")
    line = F.to_json(obj(ts=F.unix_millis(F.col("ts").cast("timestamp")), id=F.col("tool_name"), event="e", decision=F.get_json_object("extra", "$.decision"), reason=F.col("text"), session_id=F.col("session_id"), cwd=F.col("project")))
    return e.select(F.lit("/h/telemetry.jsonl").alias("file"), F.split("text", " ")[1].cast("long").alias("seq"), line.alias("line"))


def adapter(name: str, build, convert) -> None:
    QUERIES[f"adapter_{name}"] = lambda spark, sf: convert(build(talks(spark, sf))).select(*COLUMNS)


AT = "strftime(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z') AS ts"
KIND = "CASE WHEN role='system' THEN 'meta' ELSE role END AS event_type"
NONE = "CAST(NULL AS BIGINT) AS tokens_in, CAST(NULL AS BIGINT) AS tokens_out"
FILLED = "FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"
adapter("claude", claude_lines, A.claude)
ORACLE["adapter_claude"] = f"SELECT 'conv-'||conv_id AS session_id, {AT}, {KIND}, text, CASE WHEN role='assistant' THEN CAST(turn AS BIGINT) END AS tokens_in, CASE WHEN role='assistant' THEN CAST(length(text) AS BIGINT) END AS tokens_out {FILLED}"
adapter("codex", codex_lines, A.codex)
ORACLE["adapter_codex"] = f"SELECT 'conv-'||conv_id AS session_id, {AT}, {KIND}, CASE WHEN role='system' THEN '' ELSE text END AS text, {NONE} {FILLED}"
adapter("omp", omp_lines, A.omp)
adapter("droid", droid_lines, A.droid)
ORACLE["adapter_omp"] = ORACLE["adapter_droid"] = f"SELECT 'conv-'||conv_id AS session_id, {AT}, {KIND}, text, {NONE} FROM conversations"
adapter("kimi", kimi_lines, A.kimi)
ORACLE["adapter_kimi"] = f"SELECT 'session_'||conv_id AS session_id, {AT}, role AS event_type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, {NONE} {FILLED} AND role IN ('user','assistant')"
QUERIES["adapter_hooks_legacy"] = lambda spark, sf: A.hooks_legacy(hook_lines(spark, sf)).select("session_id", "project", "ts", "text", "tool_name", F.get_json_object("extra", "$.decision").alias("decision"))
ORACLE["adapter_hooks_legacy"] = "WITH " + X.EVENTS_SQL + "," + X.HOOKS_SQL + " SELECT session_id, project, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' AS ts, reason AS text, hook_id AS tool_name, decision FROM hook_decisions"


def canonical_events(spark: SparkSession, sf: str) -> DataFrame:
    """Codex lines through the masking boundary, with a secret in every user text."""
    df = talks(spark, sf).withColumn("text", F.concat("text", F.lit(" KEY_A="), F.sha2("sid", 256)))
    out = lake.canonical(A.codex(codex_lines(df)), "codex", "m1")
    return out.select("ts", "runtime", "machine", "session_id", "event_type", "text", F.get_json_object("extra", "$.source_stem_hash").alias("stem"), "date")


QUERIES["canonical_events"] = canonical_events
ORACLE["canonical_events"] = f"SELECT {AT}, 'codex' AS runtime, 'm1' AS machine, 'conv-'||conv_id AS session_id, {KIND}, CASE WHEN role='system' THEN '' ELSE text||' [masked:assignment:70:'||substr(sha256('KEY_A='||sha256('conv-'||conv_id)),1,8)||']' END AS text, sha256('conv-'||conv_id) AS stem, strftime(TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE,'%Y-%m-%d') AS date FROM conversations"


def mask_extra(spark: SparkSession, sf: str) -> DataFrame:
    secret = F.concat(F.lit("API_KEY="), F.sha2(F.col("doc_id").cast("string"), 256))
    text = F.concat(F.lit('{"k":"'), secret, F.lit('","n":{"a":{"b":{"c":"deep","d":{"e":1}}}},"l":[1,null,"x"]}'))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", M.mask_extra(text).alias("extra"))


QUERIES["mask_extra"] = mask_extra
ORACLE["mask_extra"] = """SELECT doc_id, '{"k":"[masked:assignment:72:'||substr(sha256('API_KEY='||sha256(CAST(doc_id AS VARCHAR))),1,8)||']","n":{"a":{"b":{"c":"deep","d":null}}},"l":[1,null,"x"]}' AS extra FROM documents"""


def hook_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Four segments for each day; those of every third day carry a wrong digest."""
    number = F.split("text", " ")[1].cast("long")
    e = X.lake_events(spark, sf).filter("runtime = 'hooks'").withColumns({"day": F.date_format("ts", "yyyyMMdd"), "part": number % 4})
    one = obj(ts=F.unix_millis(F.col("ts").cast("timestamp")), id=F.col("tool_name"), decision=F.get_json_object("extra", "$.decision"), reason=F.col("text"), session_id=F.col("session_id"))
    days = e.groupBy("day", "part").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), one.alias("event")))).alias("events"))
    name = F.concat("day", F.lit("-"), F.col("part").cast("string"))
    head = F.to_json(obj(kind="segment_open", protocol=G.PROTOCOL, segmentId=name, createdAt=F.lit(1704067200000), producerId="p", invocationId="i", source=obj(producer="hooks-rotator")))
    frames = F.transform("events", lambda x, i: F.to_json(obj(kind="event", sequence=i, event=x["event"])))
    payload = F.concat(F.array_join(F.concat(F.array(head), frames), "\n"), F.lit("\n"))
    digest = F.when(F.col("day").cast("int") % 3 == 0, "0").otherwise(F.sha2(payload, 256))
    foot = F.to_json(obj(kind="segment_close", protocol=G.PROTOCOL, segmentId=name, eventCount=F.size("events"), payloadSha256=digest))
    files = days.select(F.concat(F.lit("/q/segment-"), name, F.lit(".jsonl")).alias("file"), F.concat(payload, foot, F.lit("\n")).alias("content"))
    return G.segment_events(G.validated(files)).select("session_id", "ts", "text", "tool_name", F.get_json_object("extra", "$.decision").alias("decision"), F.get_json_object("extra", "$.sequence").cast("long").alias("sequence"))


QUERIES["hook_segments"] = hook_segments
ORACLE["hook_segments"] = "WITH " + X.EVENTS_SQL + " SELECT session_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' AS ts, text, tool_name, json_extract_string(extra,'$.decision') AS decision, row_number() OVER (PARTITION BY strftime(ts,'%Y%m%d'), CAST(string_split(text,' ')[2] AS BIGINT) % 4 ORDER BY CAST(string_split(text,' ')[2] AS BIGINT)) - 1 AS sequence FROM lake_events WHERE runtime='hooks' AND CAST(strftime(ts,'%Y%m%d') AS INT) % 3 <> 0"


def new_lake(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"


def stored(events: DataFrame) -> DataFrame:
    """As the lake keeps events: times as texts, and the date they are stored under."""
    rows = events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return rows.withColumn("date", M.date_partition(F.col("ts")))


def mirrored(spark: SparkSession, path: str) -> DataFrame:
    rows = compaction.read_mirror(spark, path)
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "runtime", "session_id", "event_type", "text", "tokens_in", F.col("date").cast("string").alias("date"))


def compact_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The lake written as NDJSON, compacted, and read from the mirror."""
    path = new_lake(spark)
    lake.append(stored(X.lake_events(spark, sf)), path)
    compaction.compact(spark, path)
    return mirrored(spark, path)


QUERIES["compact_roundtrip"] = compact_roundtrip
ORACLE["compact_roundtrip"] = "WITH " + X.EVENTS_SQL + " SELECT ts, runtime, session_id, event_type, text, tokens_in, strftime(ts,'%Y-%m-%d') AS date FROM lake_events"


def compact_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Two runtimes, compacted; then the others and some more of the first, compacted again: only what changed is rewritten."""
    path, events = new_lake(spark), stored(X.lake_events(spark, sf))
    first = F.col("runtime").isin("codex", "hooks") & (F.col("date") < "2024-01-15")
    lake.append(events.filter(first), path)
    compaction.compact(spark, path)
    lake.append(events.filter(~first), path)
    compaction.compact(spark, path)
    return mirrored(spark, path)


QUERIES["compact_changed"] = compact_changed
ORACLE["compact_changed"] = ORACLE["compact_roundtrip"]


def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """A literal search that reads the mirror's files with all its trigrams."""
    path = new_lake(spark)
    lake.append(stored(X.lake_events(spark, sf)), path)
    compaction.compact(spark, path, index=True)
    return compaction.search(spark, path, "CLICK 12", limit=500).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


QUERIES["search_indexed"] = search_indexed
ORACLE["search_indexed"] = "WITH " + X.EVENTS_SQL + " SELECT ts, runtime, session_id, event_type, substr(text,1,240) AS text FROM lake_events WHERE contains(lower(text), 'click 12') ORDER BY ts DESC NULLS LAST, session_id, event_type, text LIMIT 500"


def partition_report(spark: SparkSession, sf: str) -> DataFrame:
    """By runtime: dates with stored events, and whether each of their files holds bytes."""
    path = new_lake(spark)
    lake.append(stored(X.lake_events(spark, sf)), path)
    dates = compaction.sources(spark, path).groupBy("runtime").agg(F.count("*").alias("dates"))
    files = lake.partition_report(spark, path)
    return files.join(dates, "runtime").select("runtime", "dates", (F.col("parts") >= F.col("dates")).alias("each_has_files"), (F.col("bytes") > 0).alias("filled"))


QUERIES["partition_report"] = partition_report
ORACLE["partition_report"] = "WITH " + X.EVENTS_SQL + " SELECT runtime, count(DISTINCT CAST(ts AS DATE)) AS dates, true AS each_has_files, true AS filled FROM lake_events GROUP BY runtime"


def export_log(spark: SparkSession, sf: str) -> DataFrame:
    """A live export: batches that overlap are appended to its log, one of them twice, half of them folded."""
    path, events = f"{new_lake(spark)}/export", X.lake_events(spark, sf).filter("event_type <> 'hook_decision'")
    events = events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    part = F.pmod(F.xxhash64("session_id"), F.lit(3))
    export.append_export(events.filter(part == 0), path, "0")
    export.append_export(events.filter(part <= 1), path, "1")
    export.append_export(events.filter(part <= 1), path, "1")
    export.fold_export(spark, path)
    export.append_export(events.filter(part >= 1), path, "2")
    return export.read_export(spark, path).drop("shard", "lake_schema")


QUERIES["export_log"] = export_log
TS_SQL = "strftime(ts,'%Y-%m-%d %H:%M:%S.%f')"
ORACLE["export_log"] = "WITH " + X.EVENTS_SQL + f""" SELECT DISTINCT substr(sha256(concat_ws(chr(10), runtime, session_id, {TS_SQL}, event_type, text, coalesce(tool_name,''), coalesce(model,''), extra) || chr(10)),1,32) AS uuid,
  {TS_SQL} AS ts, runtime, session_id, project, event_type, text, tool_name, model, tokens_in, tokens_out, extra, sha256(runtime||chr(10)||session_id) AS session_hash FROM lake_events WHERE runtime<>'hooks'"""


def labels_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as lines of JSON, read back; the latest of each session and aspect."""
    path = new_lake(spark)
    X.lake_labels(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.json(f"{path}/labels")
    return L.latest(lake.read_labels(spark, path), limit=500).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "session_id", "runtime", "aspect", "value", "note", "source")


QUERIES["labels_stored"] = labels_stored
ORACLE["labels_stored"] = "WITH " + X.LABELS_SQL + " SELECT ts, session_id, runtime, aspect, value, note, source FROM (SELECT *, row_number() OVER (PARTITION BY session_id, aspect ORDER BY ts DESC, source DESC, value DESC) AS rn FROM lake_labels) WHERE rn=1 ORDER BY ts DESC, session_id, aspect LIMIT 500"


def transcripts(spark: SparkSession, sf: str) -> str:
    """Codex transcripts of all conversations, 8 files of many sessions each: a line that opens a session, one that sets its
    model, then its turns. Returns their glob."""
    path, t = f"{new_lake(spark)}/sources", talks(spark, sf)
    opened = t.groupBy("conv_id", "sid").agg(F.min("at").alias("at"))
    meta = opened.select("conv_id", F.lit(-2).alias("turn"), F.to_json(obj(timestamp=F.col("at"), type="session_meta", payload=obj(id=F.col("sid"), cwd=F.concat(F.lit("/w/"), "sid")))).alias("line"))
    model = opened.select("conv_id", F.lit(-1).alias("turn"), F.to_json(obj(timestamp=F.col("at"), type="turn_context", payload=obj(model=F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))))).alias("line"))
    said = codex_lines(t.withColumn("conv", F.col("conv_id"))).select(F.regexp_extract("file", r"conv-(\d+)", 1).cast("long").alias("conv_id"), F.col("seq").alias("turn"), "line")
    rows = said.unionByName(meta).unionByName(model).withColumn("part", F.col("conv_id") % 8)
    rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "line").write.partitionBy("part").text(path)
    return f"{path.removeprefix('file://').removeprefix('file:')}/part=*/*.txt"


SESSION_EVENTS = f"""SELECT 'conv-'||conv_id AS session_id, '/w/conv-'||conv_id AS project, {AT}, {KIND}, CASE WHEN role='system' THEN '' ELSE text END AS text,
  CASE WHEN role='assistant' THEN 'm'||(conv_id % 3) END AS model {FILLED}
  UNION ALL SELECT 'conv-'||conv_id, '/w/conv-'||conv_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + min(turn) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z'), 'meta', '', NULL FROM conversations GROUP BY conv_id"""


def as_said(spark: SparkSession, path: str) -> DataFrame:
    rows = lake.read_events(spark, path)
    return rows.select("session_id", "project", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), "event_type", "text", "model")


def rebuild_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild that reads every file in many ranges and carries sessions, projects and models across them."""
    path = new_lake(spark)
    lake.rebuild(spark, {"codex": transcripts(spark, sf)}, path, "m1", split=1 << 15)
    return as_said(spark, path)


QUERIES["rebuild_ranges"] = rebuild_ranges
ORACLE["rebuild_ranges"] = SESSION_EVENTS


def stream_stateful(spark: SparkSession, sf: str) -> DataFrame:
    """A stream whose state carries sessions, projects and models from batch to batch, each of so many bytes a file."""
    path, source = new_lake(spark), transcripts(spark, sf)
    bytes_ = spark.read.format("binaryFile").load(source).agg(F.max("length")).first()[0]
    live.start(spark, "codex", source, path, "m1", max_bytes=bytes_ // 2 + 1, available_now=True).awaitTermination(600)
    return as_said(spark, path)


QUERIES["stream_stateful"] = stream_stateful
ORACLE["stream_stateful"] = SESSION_EVENTS


def signals_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL over the signal views and the lake's views."""
    events = X.lake_events(spark, sf)
    views.register_views(events)
    signals.register_signals(events, X.index_terms(spark, sf), X.index_sessions(spark, sf))
    return spark.sql("SELECT d.day, d.hook_blocks, d.term_hits, count(t.tool_name) AS tools FROM hook_daily d LEFT JOIN tools_daily t ON t.day = d.day GROUP BY d.day, d.hook_blocks, d.term_hits")


QUERIES["signals_sql"] = signals_sql
DAILY = """daily AS (SELECT day, coalesce(hook_blocks,0) AS hook_blocks, coalesce(blocked_sessions,0) AS blocked_sessions, coalesce(frustrated_sessions,0) AS frustrated_sessions, CAST(coalesce(term_hits,0) AS BIGINT) AS term_hits
  FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS hook_blocks, count(DISTINCT session_id) AS blocked_sessions FROM hook_decisions WHERE decision='block' GROUP BY 1)
  FULL JOIN (SELECT CAST(make_timestamp(last_seen*1000000) AS DATE) AS day, count(DISTINCT sid) AS frustrated_sessions, sum(n) AS term_hits FROM terms WHERE last_seen IS NOT NULL GROUP BY 1) USING (day) ORDER BY day DESC LIMIT 30)"""
ORACLE["signals_sql"] = f"WITH {X.EVENTS_SQL},{X.HOOKS_SQL},{X.INDEX_SQL},{DAILY}, tools AS (SELECT DISTINCT CAST(ts AS DATE) AS day, runtime, tool_name FROM lake_events WHERE event_type='tool_call' AND tool_name IS NOT NULL) SELECT d.day, d.hook_blocks, d.term_hits, count(t.tool_name) AS tools FROM daily d LEFT JOIN tools t ON t.day=d.day GROUP BY ALL"
QUERIES["signals_report"] = lambda spark, sf: signals.report(X.lake_events(spark, sf), X.index_terms(spark, sf), X.index_sessions(spark, sf), "daily", 7)
ORACLE["signals_report"] = f"WITH {X.EVENTS_SQL},{X.HOOKS_SQL},{X.INDEX_SQL},{DAILY} SELECT * FROM daily ORDER BY day DESC LIMIT 7"


# Blocks, calls and registers: what the plain messages above do not hold. Turns are numbered from 0 in each conversation.
def claude_block_lines(df: DataFrame) -> DataFrame:
    """Thinking, a text and a tool call with usage; a tool's result and a text; the session on the first line, times on even ones."""
    t, number = F.col(TEXT), F.col("turn").cast("int")
    called = obj(type="tool_use", id=F.concat("sid", F.lit("-"), number.cast("string")), name=F.concat(F.lit("T"), (number % 3).cast("string")), input=obj(n=number))
    blocks = lambda *parts: F.transform(F.array(*map(F.to_json, parts)), F.parse_json)
    answer = obj(role="assistant", model="m", content=blocks(obj(type="thinking", thinking=F.concat(F.lit("why "), t)), obj(type="text", text=t), called), usage=obj(input_tokens=number, cache_read_input_tokens=1, output_tokens=F.length(t)))
    asked = obj(role="user", content=blocks(obj(type="tool_result", tool_use_id="x", content=t), obj(type="text", text=F.concat(F.lit("next "), t))))
    head = {"timestamp": F.when(number % 2 == 0, F.col("at")), "sessionId": F.when(number == 0, F.concat(F.lit("of-"), "sid"))}
    line = F.when(F.col(ROLE) == "assistant", F.to_json(obj(type="assistant", message=answer, **head))).when(F.col(ROLE) == "user", F.to_json(obj(type="user", message=asked, **head))).otherwise(F.to_json(obj(type="system", content=t, **head)))
    return lines(df, F.concat(F.lit("/c/-p/"), "sid", F.lit(".jsonl")), line)


QUERIES["adapter_claude_blocks"] = lambda spark, sf: A.claude(claude_block_lines(talks(spark, sf))).select(*COLUMNS, "tool_name", "model")
EVEN = "strftime(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + (turn - turn % 2) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z') AS ts"
ORACLE["adapter_claude_blocks"] = f"""
WITH t AS (SELECT 'of-conv-'||conv_id AS session_id, {EVEN}, role, text, turn, regexp_replace(text, '\\s+$', '', 'g') AS cut FROM conversations),
e AS (
  SELECT session_id, ts, 'thinking' AS event_type, 'why '||text AS text, turn + 1 AS tokens_in, length(text) AS tokens_out, NULL AS tool_name, 'm' AS model FROM t WHERE role='assistant'
  UNION ALL SELECT session_id, ts, 'assistant', text, NULL, NULL, NULL, 'm' FROM t WHERE role='assistant' AND trim(text, ' '||chr(9)||chr(10)||chr(13)) <> ''
  UNION ALL SELECT session_id, ts, 'tool_call', '{{"n":'||turn||'}}', NULL, NULL, 'T'||(turn % 3), 'm' FROM t WHERE role='assistant'
  UNION ALL SELECT session_id, ts, 'tool_result', text, NULL, NULL, NULL, NULL FROM t WHERE role='user'
  UNION ALL SELECT session_id, ts, 'user', 'next '||cut, NULL, NULL, NULL, NULL FROM t WHERE role='user'
  UNION ALL SELECT session_id, ts, 'meta', text, NULL, NULL, NULL, NULL FROM t WHERE role='system')
SELECT session_id, ts, event_type, text, CAST(tokens_in AS BIGINT) AS tokens_in, CAST(tokens_out AS BIGINT) AS tokens_out, tool_name, model FROM e"""


def kimi_call_lines(df: DataFrame) -> DataFrame:
    """Calls on even turns and results on odd ones, two of each to an id; every fifth conversation asks for a call that is not there."""
    n = F.col("turn").cast("int")
    call = F.concat(F.lit("c"), F.floor(n / 4).cast("string"))
    made = obj(type="tool.call", toolCallId=call, name=F.concat(F.lit("tool"), (n % 3).cast("string")), args=obj(n=n))
    got = obj(type="tool.result", toolCallId=F.when(F.col("conv_id") % 5 == 0, "none").otherwise(call), result=obj(output=F.col(TEXT)))
    event = lambda e: F.to_json(obj(type="context.append_loop_event", time=F.col("ms"), event=e))
    return lines(df, F.concat(F.lit("/k/wd_a/session_"), F.col("conv_id").cast("string"), F.lit("/agents/main/wire.jsonl")), F.when(n % 2 == 0, event(made)).otherwise(event(got)))


QUERIES["adapter_kimi_calls"] = lambda spark, sf: A.kimi(kimi_call_lines(talks(spark, sf))).select("session_id", "ts", "event_type", "text", "tool_name")
ORACLE["adapter_kimi_calls"] = f"""
SELECT 'session_'||conv_id AS session_id, {AT}, CASE WHEN turn % 2 = 0 THEN 'tool_call' ELSE 'tool_result' END AS event_type, CASE WHEN turn % 2 = 0 THEN '{{"n":'||turn||'}}' ELSE text END AS text,
  CASE WHEN turn % 2 = 0 THEN 'tool'||(turn % 3) WHEN conv_id % 5 <> 0 THEN 'tool'||((turn - 1) % 3) END AS tool_name FROM conversations"""


def omp_held_lines(df: DataFrame) -> DataFrame:
    """Two messages before the line that opens the session, the first without a time; then a change of model."""
    own = obj(role=F.col(ROLE), content=F.col(TEXT), usage=obj(input=F.col("turn"), output=2))
    n = F.col("turn").cast("long")
    said = df.select("conv_id", (n * 10).alias("turn"), F.to_json(obj(type="message", timestamp=F.when(n > 0, F.col("at")), message=own)).alias("line"))
    opened = df.filter("turn = 0")
    session = opened.select("conv_id", F.lit(15).cast("long").alias("turn"), F.to_json(obj(type="session", id=F.concat(F.lit("S"), "sid"), cwd="/w", timestamp=F.col("at"))).alias("line"))
    model = opened.select("conv_id", F.lit(16).cast("long").alias("turn"), F.to_json(obj(type="model_change", model="m1")).alias("line"))
    rows = said.unionByName(session).unionByName(model)
    return lines(rows, F.concat(F.lit("/o/d/2024_conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")), F.col("line"))


QUERIES["adapter_omp_held"] = lambda spark, sf: A.omp(omp_held_lines(talks(spark, sf))).select(*COLUMNS, "project", "model")
ORACLE["adapter_omp_held"] = f"""
WITH t AS (SELECT conv_id, turn, role, text, {AT} FROM conversations),
e AS (
  SELECT conv_id, ts, {KIND}, text, CASE WHEN role='assistant' THEN turn END AS tokens_in, CASE WHEN role='assistant' THEN 2 END AS tokens_out, CASE WHEN role='assistant' AND turn > 1 THEN 'm1' END AS model FROM t
  UNION ALL SELECT conv_id, ts, 'meta', '', NULL, NULL, NULL FROM t WHERE turn = 0
  UNION ALL SELECT conv_id, ts, 'meta', '', NULL, NULL, 'm1' FROM t WHERE turn = 0)
SELECT 'Sconv-'||conv_id AS session_id, ts, event_type, text, CAST(tokens_in AS BIGINT) AS tokens_in, CAST(tokens_out AS BIGINT) AS tokens_out, '/w' AS project, model FROM e"""
