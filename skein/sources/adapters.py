"""Vendor adapters: each reads lines (file, seq, line) one by one into what they say and what they set (see records.said), and
names how that is carried on: by windows in a batch (records.carry), by state in a stream (streaming.state)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records as R
from .records import CARRIED, event, extra, filled, is_object, is_true, items, number, one, text


@dataclass(frozen=True)
class Adapter:
    """read: lines to records.said; timed: lines before the first time set nothing; held: events wait for a release; calls: results
    take the name of their call; alone: lines take nothing from others. Called with lines, it returns their raw events; with
    `split`, files are carried in ranges of as many bytes."""

    read: Callable[[DataFrame], DataFrame]
    timed: bool = False
    held: bool = False
    calls: bool = False
    alone: bool = False

    def __call__(self, lines: DataFrame, sessions: DataFrame | None = None, split: int = 0) -> DataFrame:
        said = self.read(lines)
        return R.alone(said) if self.alone else with_projects(R.carry(said, self.timed, self.held, self.calls, split), sessions)


def with_projects(raw: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """sessions: (session_id, project), see discovery.kimi_projects."""
    if sessions is None:
        return raw
    names = raw.columns
    return raw.drop("project").join(sessions.select("session_id", "project"), "session_id", "left").select(*names)


def _name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def _stem(file: Column) -> Column:
    return F.regexp_replace(_name(file), r"(?<=.)\.[^.]*$", "")


def _texts(blocks: Column, image: bool = False) -> Column:
    """The text blocks (and a mark for images) joined by newlines."""
    is_text = lambda b: (text(b, "$.type") == "text") & text(b, "$.text").isNotNull()
    out = F.transform(blocks, lambda b: F.when(is_text(b), text(b, "$.text")).when((text(b, "$.type") == "image") & F.lit(image), "[image]"))
    return F.array_join(F.filter(out, lambda x: x.isNotNull()), "\n")


def read_claude(lines: DataFrame) -> DataFrame:
    df = R.objects(lines)
    v = F.col("v")
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    home = F.when(folder.startswith("-"), F.translate(folder, "-", "/"))
    side = F.when(is_true(v, "$.isSidechain"), True)
    meta = is_true(v, "$.isMeta")
    said = F.when(meta, "meta").otherwise("user")
    flags = extra(("sidechain", side), ("kind", F.when(meta, "injected")))
    blocks = F.filter(items(v, "$.message.content"), lambda b: is_object(b, "$"))

    def tool_result(b: Column) -> Column:
        body = F.coalesce(text(b, "$.content"), _texts(items(b, "$.content"), True), F.lit(""))
        path = F.when(body.contains("<persisted-output>"), R.strip(F.regexp_extract(body, r"saved to: ([^\n]*)", 1)))
        more = extra(("tool_use_id", filled(b, "$.tool_use_id")), ("is_error", F.when(is_true(b, "$.is_error"), True)), ("result_file", F.when(path != "", path)))
        return event("tool_result", body, more=R.joined(flags, more))

    asked = R.strip(_texts(blocks, True))
    user = (
        F.when(R.kind(v, "$.message.content") == "STRING", F.when(~R.blank(text(v, "$.message.content")), one(event(said, text(v, "$.message.content"), more=flags))))
        .when(blocks.isNotNull(), F.concat(F.transform(F.filter(blocks, lambda b: text(b, "$.type") == "tool_result"), tool_result), F.when(asked != "", one(event(said, asked, more=flags))).otherwise(R.no_events())))
    )
    model, sides = filled(v, "$.message.model"), extra(("sidechain", side))

    def spoken(b: Column, i: Column) -> Column:
        t = text(b, "$.type")
        path = F.concat(F.lit("$.message.content["), i.cast("string"), F.lit("].input"))
        args = F.when(R.kind(b, "$.input") == "STRING", F.to_json(R.part(b, "$.input"))).otherwise(F.coalesce(F.call_function("get_json_object", F.col("line"), path), F.when(R.kind(b, "$.input") == "VOID", "null")))
        return (
            F.when((t == "text") & ~R.blank(text(b, "$.text")), event("assistant", text(b, "$.text"), model=model, more=sides))
            .when((t == "thinking") & ~R.blank(text(b, "$.thinking")), event("thinking", text(b, "$.thinking"), model=model, more=sides))
            .when(t == "tool_use", event("tool_call", args, tool_name=filled(b, "$.name"), model=model, more=R.joined(sides, extra(("tool_use_id", filled(b, "$.id"))))))
        )

    whole = text(v, "$.message.content")
    answer = F.when(whole.isNotNull(), F.when(~R.blank(whole), one(event("assistant", whole, model=model, more=sides)))).otherwise(R.kept(F.transform(items(v, "$.message.content"), spoken)))
    answer = F.coalesce(answer, R.no_events())
    raw, made, read, out = (number(v, f"$.message.usage.{k}") for k in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    spent = is_object(v, "$.message.usage") & F.coalesce(raw, made, read, out).isNotNull()
    total = zero(raw) + zero(made) + zero(read)
    counts = extra(("input_non_cached_tokens", zero(raw)), ("cache_creation_tokens", zero(made)), ("cache_read_tokens", zero(read)))
    first = F.get(answer, 0)
    charged = first.withField("tokens_in", total).withField("tokens_out", out).withField("extra", R.joined(first["extra"], counts))
    assistant = F.when(~spent, answer).when(F.size(answer) > 0, F.concat(one(charged), F.slice(answer, F.lit(2), F.size(answer)))).otherwise(one(event("meta", "", model=model, tokens_in=total, tokens_out=out, more=R.joined(extra(("kind", F.lit("usage"))), counts))))
    t = text(v, "$.type")
    events = (
        F.when((t == "user") & (text(v, "$.message.role") == "user"), user)
        .when((t == "assistant") & is_object(v, "$.message"), assistant)
        .when(t == "system", one(event("meta", F.coalesce(filled(v, "$.content"), filled(v, "$.stopReason")), more=extra(("kind", F.lit("system")), ("subtype", filled(v, "$.subtype"))))))
        .when((t == "summary") & filled(v, "$.summary").isNotNull(), one(event("meta", filled(v, "$.summary"), more=extra(("kind", F.lit("summary"))))))
    )
    return R.said(df, events, ts=filled(v, "$.timestamp"), session_id=filled(v, "$.sessionId"), project=filled(v, "$.cwd"), base=(_stem(F.col("file")), home))


def read_codex(lines: DataFrame) -> DataFrame:
    df = R.objects(lines)
    v, p = F.col("v"), "$.payload"
    t, sub = text(v, "$.type"), filled(v, f"{p}.type")
    opens, turn = t == "session_meta", t == "turn_context"
    stem = _stem(F.col("file"))
    uuid = F.regexp_extract(stem, r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    model = F.lit(CARRIED)
    said = lambda blocks: F.array_join(F.filter(F.transform(blocks, lambda b: text(b, "$.text")), lambda x: ~R.blank(x)), "\n")
    zero = lambda k: F.coalesce(number(v, f"{p}.info.last_token_usage.{k}"), F.lit(0).cast("long"))
    total, cached, out, thought = (zero(k) for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"))
    counted = event("meta", "", model=model, tokens_in=total, tokens_out=out + thought, more=extra(("kind", F.lit("token_count")), ("input_non_cached_tokens", F.greatest(total - cached, F.lit(0))), ("cache_creation_tokens", F.lit(0)), ("cache_read_tokens", cached)))
    message = F.when(sub == "user_message", one(event("user", filled(v, f"{p}.message")))).when((sub == "token_count") & is_object(v, f"{p}.info.last_token_usage") & (total + out + thought != 0), one(counted))

    raw = F.get_json_object("line", f"{p}.output")
    shown = text(v, f"{p}.output")
    inner = F.try_parse_json(F.when(R.strip(shown).startswith("{") & shown.contains('"output"'), R.strip(shown)))
    output = F.coalesce(text(inner, "$.output"), shown, F.when(is_object(v, f"{p}.output"), F.coalesce(text(v, f"{p}.output.output"), text(v, f"{p}.output.content"), raw)), F.when(R.kind(v, f"{p}.output").startswith("ARRAY"), raw), F.lit(""))
    called = extra(("kind", sub), ("call_id", filled(v, f"{p}.call_id")))
    action = F.when(R.kind(v, f"{p}.action") == "STRING", F.to_json(R.part(v, f"{p}.action"))).otherwise(F.get_json_object("line", f"{p}.action"))
    args = F.coalesce(filled(v, f"{p}.arguments"), filled(v, f"{p}.input"), action, F.lit(""))
    thinking, spoken, role = said(items(v, f"{p}.summary")), said(items(v, f"{p}.content")), filled(v, f"{p}.role")
    item = (
        F.when(sub == "message", F.when(role == "assistant", F.when(F.coalesce(spoken, F.lit("")) != "", one(event("assistant", spoken, model=model)))).when(role != "user", one(event("meta", "", more=extra(("kind", F.lit("system_prompt")), ("role", role))))))
        .when(sub == "reasoning", F.when(F.coalesce(thinking, F.lit("")) != "", one(event("thinking", thinking, model=model))))
        .when(sub.endswith("_call_output"), one(event("tool_result", output, more=called)))
        .when(sub.endswith("_call"), one(event("tool_call", args, tool_name=F.coalesce(filled(v, f"{p}.name"), sub), model=model, more=called)))
    )
    opened = event("meta", "", more=extra(("kind", F.lit("session_meta")), ("originator", filled(v, f"{p}.originator")), ("cli_version", filled(v, f"{p}.cli_version")), ("source", filled(v, f"{p}.source"))))
    events = F.when(opens, one(opened)).when(t == "event_msg", message).when(t == "response_item", item).when(t == "compacted", one(event("meta", filled(v, f"{p}.message"), more=extra(("kind", F.lit("compacted"))))))
    there = is_object(v, p)
    set_ = lambda condition, path: F.when(there & condition, filled(v, path))
    return R.said(df, F.when(there, events), ts=filled(v, "$.timestamp"), session_id=set_(opens, f"{p}.id"), project=set_(opens | turn, f"{p}.cwd"), model=set_(turn, f"{p}.model"), base=(F.coalesce(F.when(uuid != "", uuid), stem), None))


def _js(v: Column, path: str) -> Column:
    """A value as a script would print it."""
    k = R.kind(v, path)
    return F.when(k.isNull(), "undefined").when(k == "VOID", "null").when(k.startswith("OBJECT"), "[object Object]").otherwise(F.try_variant_get(v, path, "string"))


def _text_of(v: Column, path: str) -> Column:
    """A string, or the texts of an array's items, joined."""
    return F.coalesce(text(v, path), F.array_join(F.filter(F.transform(items(v, path), lambda b: F.coalesce(F.when(R.kind(b, "$") == "STRING", F.try_variant_get(b, "$", "string")), text(b, "$.text"))), lambda x: x.isNotNull()), "\n"), F.lit(""))


def _dialogue(v: Column, call: str, result: str | None, other: str, tagged: bool) -> Column:
    """Events of a message's blocks: adjacent texts are one event, every other block its own."""
    role = F.coalesce(text(v, "$.message.role"), F.lit("unknown"))
    said = F.when(role.isin("user", "assistant"), role).otherwise("meta")
    note = F.when(said == "meta", extra(("kind", F.lit("message")), ("role", role))).otherwise("{}")

    def add(events: Column, b: Column) -> Column:
        t = text(b, "$.type")
        body = F.coalesce(text(b, "$.text"), F.lit(""))
        last = F.get(events, F.size(events) - 1)
        goes_on = F.coalesce(last["tool_name"] == "\x00", F.lit(False))  # marks an open text until the end
        opened = event(said, body, tool_name=F.lit("\x00"), more=note)
        texts = F.when(goes_on, F.concat(F.slice(events, F.lit(1), F.size(events) - 1), one(last.withField("text", F.concat(last["text"], F.lit("\n"), body))))).otherwise(F.concat(events, one(opened)))
        made = F.when(t == "thinking", event("thinking", text(b, "$.thinking"))).when(t == call, event("tool_call", "", tool_name=text(b, "$.name"), more=extra(("call_id", R.present(b, "$.id")))))
        if result:
            made = made.when(t == result, event("tool_result", _text_of(b, "$.content"), more=extra(("call_id", R.present(b, "$.tool_use_id")))))
        made = made.otherwise(event("meta", "", more=extra(("kind", F.lit("block")), (other, _js(b, "$.type")))))
        return F.when(~is_object(b, "$"), events).when(t == "text", texts).otherwise(F.concat(events, one(made)))

    blocks = items(v, "$.message.content")
    many = F.aggregate(blocks, R.no_events(), add)
    many = F.transform(many, lambda e: F.when(e["tool_name"] == "\x00", e.withField("tool_name", F.lit(None).cast("string"))).otherwise(e))
    single = one(event(said, _text_of(v, "$.message.content"), more=note))
    return F.when(~is_object(v, "$.message"), one(event("meta", "", more=extra(("kind", F.lit("message")))))).when(blocks.isNotNull(), many).otherwise(single)


def read_omp(lines: DataFrame) -> DataFrame:
    df = R.objects(lines)
    v = F.col("v")
    t = F.coalesce(text(v, "$.type"), F.lit(""))
    stamp_bad = R.kind(v, "$.timestamp").rlike("^(BIGINT|DECIMAL|DOUBLE|INT|TINYINT|SMALLINT)") & R.epoch(v, "$.timestamp").isNull()
    df = df.filter(~F.coalesce(stamp_bad, F.lit(False)))
    stamp = F.coalesce(text(v, "$.timestamp"), R.epoch(v, "$.timestamp"), text(v, "$.updatedAt"))
    stem = _stem(F.col("file"))
    named = F.when(stem.contains("_"), F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)).otherwise(stem)
    model = F.lit(CARRIED)
    role = text(v, "$.message.role")
    result = event("tool_result", _text_of(v, "$.message.content"), tool_name=text(v, "$.message.toolName"), more=extra(("call_id", R.present(v, "$.message.toolCallId")), ("is_error", F.when(is_true(v, "$.message.isError"), True))))
    talk = _dialogue(v, "toolCall", None, "omp_block", True)
    by = F.coalesce(text(v, "$.message.model"), model)
    use = lambda k: F.when(is_object(v, "$.message.usage"), number(v, f"$.message.usage.{k}"))
    answered = F.transform(talk, lambda e, i: e.withField("model", by).withField("tokens_in", F.when(i == 0, use("input"))).withField("tokens_out", F.when(i == 0, use("output"))))
    message = F.when(role == "toolResult", one(result)).when((role == "assistant") & is_object(v, "$.message"), answered).otherwise(talk)
    k = ("kind", t)
    events = (
        F.when(t == "session", one(event("meta", "", more=extra(k, ("version", R.present(v, "$.version"))))))
        .when(t == "message", message)
        .when(t.isin("title", "title_change"), one(event("meta", text(v, "$.title"), more=extra(k))))
        .when(t == "model_change", one(event("meta", "", model=model, more=extra(k))))
        .when(t == "thinking_level_change", one(event("meta", "", more=extra(k, ("level", R.present(v, "$.thinkingLevel"))))))
        .when(t == "compaction", one(event("meta", text(v, "$.summary"), more=extra(k, ("tokens_before", R.present(v, "$.tokensBefore")), ("first_kept_entry", R.present(v, "$.firstKeptEntryId"))))))
        .when(t.isin("custom_message", "custom"), one(event("meta", _text_of(v, "$.content"), more=extra(k, ("custom_type", R.present(v, "$.customType"))))))
        .otherwise(one(event("meta", "", more=extra(("kind", F.lit("unknown")), ("omp_type", _js(v, "$.type"))))))
    )
    opens = t == "session"
    return R.said(df, events, ts=stamp, session_id=F.when(opens, filled(v, "$.id")), project=F.when(opens, filled(v, "$.cwd")), model=F.when(t == "model_change", text(v, "$.model")), release=opens, base=(named, None))


def read_droid(lines: DataFrame) -> DataFrame:
    """Transcripts (files not named *.settings.json)."""
    df = R.objects(lines.filter(~F.col("file").endswith(".settings.json")))
    v = F.col("v")
    t = F.coalesce(text(v, "$.type"), F.lit(""))
    stamp_bad = R.kind(v, "$.timestamp").rlike("^(BIGINT|DECIMAL|DOUBLE|INT|TINYINT|SMALLINT)") & R.epoch(v, "$.timestamp").isNull()
    df = df.filter(~F.coalesce(stamp_bad, F.lit(False)))
    stamp, begins = F.coalesce(text(v, "$.timestamp"), R.epoch(v, "$.timestamp")), t == "session_start"
    k = ("kind", t)
    events = (
        F.when(begins, one(event("meta", F.coalesce(filled(v, "$.sessionTitle"), text(v, "$.title")), more=extra(k, ("version", R.present(v, "$.version"))))))
        .when(t == "message", _dialogue(v, "tool_use", "tool_result", "droid_block", True))
        .when(t == "todo_state", one(event("meta", "", more=extra(k, ("todo_count", F.coalesce(F.size(items(v, "$.todos.todos")), F.lit(0)))))))
        .when(t == "compaction_state", one(event("meta", text(v, "$.summaryText"), more=extra(k))))
        .otherwise(one(event("meta", "", more=extra(("kind", F.lit("unknown")), ("droid_type", _js(v, "$.type"))))))
    )
    return R.said(df, events, ts=stamp, session_id=F.when(begins, filled(v, "$.id")), project=F.when(begins, filled(v, "$.cwd")), release=stamp.isNotNull(), base=(_stem(F.col("file")), None))


def droid_settings(files: DataFrame) -> DataFrame:
    """Sidecars, each a whole file (file, content): one event of token totals if it has a lock time."""
    df = R.objects(files.select("file", F.lit(0).cast("long").alias("seq"), F.col("content").alias("line")))
    v = F.col("v")
    df = df.withColumn("ts", text(v, "$.providerLockTimestamp")).filter("ts is not null").withColumn("session_id", F.regexp_replace(_name(F.col("file")), r"\.settings\.json$", "")).withColumn("project", F.lit(None).cast("string"))
    use = lambda k: F.when(is_object(v, "$.tokenUsage"), number(v, f"$.tokenUsage.{k}"))
    return R.exploded(df.withColumns({"model": F.lit(None).cast("string"), "called": F.lit(None).cast("string")}).withColumn("events", one(event("meta", "", tokens_in=use("inputTokens"), tokens_out=use("outputTokens"), more=extra(("kind", F.lit("settings")), ("provider", F.coalesce(R.present(v, "$.apiProviderLock"), R.present(v, "$.providerLock"))))))))


def read_kimi(lines: DataFrame) -> DataFrame:
    df = R.objects(lines)
    v = F.col("v")
    t = F.coalesce(text(v, "$.type"), F.lit(""))
    folder = F.regexp_extract("file", r"(session_[^/]+)/agents/main/[^/]+$", 1)
    model = F.lit(CARRIED)
    e = text(v, "$.event.type")
    loop = t == "context.append_loop_event"
    calls, results = loop & (e == "tool.call"), loop & (e == "tool.result")
    call_id = F.when(calls, F.coalesce(filled(v, "$.event.toolCallId"), filled(v, "$.event.uuid"))).when(results, F.coalesce(filled(v, "$.event.toolCallId"), filled(v, "$.event.parentUuid")))
    raw = F.get_json_object("line", "$.event.args")
    args = F.when(R.kind(v, "$.event.args") == "STRING", F.to_json(R.part(v, "$.event.args"))).when(R.kind(v, "$.event.args") == "VOID", "null").otherwise(raw)
    bad = R.kind(v, "$.event.result.isError")
    truthy = is_true(v, "$.event.result.isError") | F.coalesce(bad.startswith("OBJECT") | bad.startswith("ARRAY"), F.lit(False)) | filled(v, "$.event.result.isError").isNotNull() | F.coalesce(number(v, "$.event.result.isError") != 0, F.lit(False))
    spoken, thought = filled(v, "$.event.part.text"), filled(v, "$.event.part.think")
    part = text(v, "$.event.part.type")
    looped = (
        F.when((e == "content.part") & (part == "text") & spoken.isNotNull(), one(event("assistant", spoken, model=model)))
        .when((e == "content.part") & (part == "think") & thought.isNotNull(), one(event("thinking", thought, model=model)))
        .when(e == "tool.call", one(event("tool_call", F.coalesce(args, filled(v, "$.event.description")), tool_name=filled(v, "$.event.name"), model=model, more=extra(("tool_use_id", call_id)))))
        .when(e == "tool.result", one(event("tool_result", F.coalesce(text(v, "$.event.result.output"), text(v, "$.event.result")), tool_name=F.lit(CARRIED), more=extra(("tool_use_id", call_id), ("is_error", F.when(truthy, True))))))
    )
    role, origin = filled(v, "$.message.role"), filled(v, "$.message.origin.kind")
    body = R.strip(F.coalesce(text(v, "$.message.content"), _texts(items(v, "$.message.content")), F.lit("")))
    turn = F.when(body != "", F.when((role == "user") & (origin != "user"), one(event("meta", body, more=extra(("kind", F.lit("injected")), ("origin", origin))))).when(role.isin("user", "assistant"), one(event(role, body))))
    zero = lambda k: F.coalesce(F.when(is_object(v, "$.usage"), number(v, f"$.usage.{k}")), F.lit(0).cast("long"))
    fresh, read, made, out = (zero(k) for k in ("inputOther", "inputCacheRead", "inputCacheCreation", "output"))
    usage = F.when((text(v, "$.usageScope") == "turn") & (fresh + read + made + out != 0), one(event("meta", "", model=model, tokens_in=fresh + read + made, tokens_out=out, more=extra(("kind", F.lit("usage")), ("input_non_cached_tokens", fresh), ("cache_creation_tokens", made), ("cache_read_tokens", read)))))
    events = (
        F.when(loop, looped)
        .when(t == "context.append_message", turn)
        .when(t == "usage.record", usage)
        .when(t == "metadata", one(event("meta", "", more=extra(("kind", F.lit("metadata")), ("protocol", filled(v, "$.protocol_version")), ("app", filled(v, "$.app_version"))))))
        .when(t == "config.update", one(event("meta", "", more=extra(("kind", F.lit("config")), ("profile", filled(v, "$.profileName"))))))
        .when((t == "context.apply_compaction") & filled(v, "$.summary").isNotNull(), one(event("meta", filled(v, "$.summary"), more=extra(("kind", F.lit("compaction"))))))
        .when(t == "turn.cancel", one(event("meta", "", more=extra(("kind", F.lit("turn.cancel"))))))
    )
    stamp = F.coalesce(R.epoch(v, "$.time"), R.epoch(v, "$.created_at"))
    return R.said(df, events, ts=stamp, model=F.when(t == "usage.record", filled(v, "$.model")), call_id=call_id, call_name=F.when(calls, filled(v, "$.event.name")), base=(F.when(folder != "", folder).otherwise(_stem(F.col("file"))), None))


PICKED = ("event", "decision", "tool", "code", "ms", "timedOut", "infra")


HOOK_KEYS = ("ts", "id", "reason", "session_id", "sessionId", "session", "project", "cwd", *PICKED)


def read_hooks(lines: DataFrame) -> DataFrame:
    """Lines are on their own: each has its time, session and project, or has none. A line is read once, into its known keys."""
    keys = F.from_json("line", ", ".join(f"`{k}` variant" for k in HOOK_KEYS))
    df = lines.withColumn("j", keys).filter(F.col("line").rlike(r"^\s*\{") & F.col("j").isNotNull() & F.try_parse_json("line").isNotNull())
    value = lambda k: F.col(f"j.{k}")
    there = lambda k: F.when(F.schema_of_variant(value(k)) != "VOID", value(k))
    is_text = lambda k: F.schema_of_variant(value(k)) == "STRING"
    as_text = lambda k: F.when(is_text(k), F.try_variant_get(value(k), "$", "string"))
    shown = lambda k: F.when(is_text(k), F.try_variant_get(value(k), "$", "string")).otherwise(F.to_json(there(k)))
    df = df.withColumns({"stamp": F.coalesce(filled(value("ts"), "$"), R.epoch(value("ts"), "$"))}).filter("stamp is not null")
    made = event("hook_decision", as_text("reason"), tool_name=as_text("id"), more=extra(*[(k, there(k)) for k in PICKED]))
    return R.said(df, one(made), ts=F.col("stamp"), base=(F.coalesce(*map(shown, ("session_id", "sessionId", "session"))), F.coalesce(*map(shown, ("project", "cwd")))))


claude, codex, omp = Adapter(read_claude), Adapter(read_codex, timed=True), Adapter(read_omp, held=True)
droid, kimi, hooks_legacy = Adapter(read_droid, held=True), Adapter(read_kimi, timed=True, calls=True), Adapter(read_hooks, alone=True)
ADAPTERS = {"claude": claude, "codex": codex, "omp": omp, "droid": droid, "kimi": kimi, "hooks": hooks_legacy}
