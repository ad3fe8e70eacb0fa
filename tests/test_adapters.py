"""Hand-written lines for every vendor, one for each rule."""

import json

from skein.sources import adapters as A

T = "2024-01-01T00:00:00Z"
COLUMNS = ("seq", "pos", "ts", "session_id", "project", "event_type", "text", "tool_name", "model", "tokens_in", "tokens_out")


def run(spark, adapter, records, file):
    rows = [(file, i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
    out = adapter(spark.createDataFrame(rows, "file string, seq long, line string")).orderBy("seq", "pos").collect()
    return [(*[r[c] for c in COLUMNS[:2]], r.session_id, r.project, r.event_type, r.text, r.tool_name, r.model, r.tokens_in, r.tokens_out, json.loads(r.extra)) for r in out], [r.ts for r in out]


def test_claude(spark):
    records = [
        "", "[1]", "bad {", '"scalar"',
        {"type": "user", "message": {"role": "user", "content": "before the first time"}},
        {"type": "user", "timestamp": T, "sessionId": "s1", "cwd": "/w", "message": {"role": "user", "content": "hi"}},
        {"type": "user", "message": {"role": "user", "content": "  "}},
        {"type": "user", "message": {"role": "assistant", "content": "x"}},
        {"type": "user", "isMeta": True, "isSidechain": True, "message": {"role": "user", "content": [{"type": "text", "text": " a "}, {"type": "image"}, {"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "<persisted-output>\nsaved to: /x/y.txt\nz"}]}, 7]}},
        {"type": "assistant", "message": {"model": "m1", "content": [{"type": "thinking", "thinking": " "}, {"type": "text", "text": "yo"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"z": 1, "a": "b c"}}], "usage": {"input_tokens": 3, "cache_read_input_tokens": 4, "output_tokens": 5}}},
        {"type": "assistant", "message": {"content": [], "usage": {"output_tokens": 5}}},
        {"type": "assistant", "message": {"content": "plain"}},
        {"type": "system", "subtype": "x", "stopReason": "c"}, {"type": "summary", "summary": "S"}, {"type": "summary"}, {"type": "other"},
    ]
    got, ts = run(spark, A.claude, records, "/home/.claude/projects/-a-b/id9.jsonl")
    flags = {"sidechain": True, "kind": "injected"}
    assert got == [
        (5, 0, "s1", "/w", "user", "hi", None, None, None, None, {}),
        (8, 0, "s1", "/w", "tool_result", "<persisted-output>\nsaved to: /x/y.txt\nz", None, None, None, None, flags | {"tool_use_id": "t1", "is_error": True, "result_file": "/x/y.txt"}),
        (8, 1, "s1", "/w", "meta", "a \n[image]", None, None, None, None, flags),
        (9, 0, "s1", "/w", "assistant", "yo", None, "m1", 7, 5, {"input_non_cached_tokens": 3, "cache_creation_tokens": 0, "cache_read_tokens": 4}),
        (9, 1, "s1", "/w", "tool_call", '{"z":1,"a":"b c"}', "Bash", "m1", None, None, {"tool_use_id": "t1"}),
        (10, 0, "s1", "/w", "meta", "", None, None, 0, 5, {"kind": "usage", "input_non_cached_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0}),
        (11, 0, "s1", "/w", "assistant", "plain", None, None, None, None, {}),
        (12, 0, "s1", "/w", "meta", "c", None, None, None, None, {"kind": "system", "subtype": "x"}),
        (13, 0, "s1", "/w", "meta", "S", None, None, None, None, {"kind": "summary"}),
    ]
    assert set(ts) == {T}
    got, _ = run(spark, A.claude, [{"type": "summary", "timestamp": T, "summary": "S"}], "/home/.claude/projects/-a-b/id9.jsonl")
    assert got[0][2:4] == ("id9", "/a/b")


def test_codex(spark):
    p = lambda t, **x: {"type": t, "payload": x}
    records = [
        p("event_msg", type="user_message", message="no time yet"),
        {"timestamp": T} | p("session_meta", id="i1", cwd="/c", originator="o"),
        p("turn_context", model="gm", cwd="/d"),
        p("event_msg", type="user_message", message="q"),
        p("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2, "reasoning_output_tokens": 1}}),
        p("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 0}}),
        p("response_item", type="message", role="user", content=[{"text": "dup"}]),
        p("response_item", type="message", role="assistant", content=[{"text": "A"}, {"text": " "}, {"text": "B"}]),
        p("response_item", type="message", role="developer", content=[]),
        p("response_item", type="reasoning", summary=[{"text": "th"}]),
        p("response_item", type="function_call", name="sh", arguments='{"x":1}', call_id="c1"),
        p("response_item", type="local_shell_call", action={"b": 1, "a": 2}),
        p("response_item", type="function_call_output", call_id="c1", output='{"output":"done"}'),
        p("response_item", type="function_call_output", output='{not json "output"'),
        p("response_item", type="custom_call_output", output={"k": [1, 2]}),
        p("compacted", message="m"),
        {"type": "compacted"},
    ]
    got, _ = run(spark, A.codex, records, "/s/rollout-2024-0F0e0d0c-1111-2222-3333-444455556666.jsonl")
    assert [(r[0], r[4], r[5], r[6], r[7], r[8], r[9], r[10]) for r in got] == [
        (1, "meta", "", None, None, None, None, {"kind": "session_meta", "originator": "o"}),
        (3, "user", "q", None, None, None, None, {}),
        (4, "meta", "", None, "gm", 10, 3, {"kind": "token_count", "input_non_cached_tokens": 6, "cache_creation_tokens": 0, "cache_read_tokens": 4}),
        (7, "assistant", "A\nB", None, "gm", None, None, {}),
        (8, "meta", "", None, None, None, None, {"kind": "system_prompt", "role": "developer"}),
        (9, "thinking", "th", None, "gm", None, None, {}),
        (10, "tool_call", '{"x":1}', "sh", "gm", None, None, {"kind": "function_call", "call_id": "c1"}),
        (11, "tool_call", '{"b":1,"a":2}', "local_shell_call", "gm", None, None, {"kind": "local_shell_call"}),
        (12, "tool_result", "done", None, None, None, None, {"kind": "function_call_output", "call_id": "c1"}),
        (13, "tool_result", '{not json "output"', None, None, None, None, {"kind": "function_call_output"}),
        (14, "tool_result", '{"k":[1,2]}', None, None, None, None, {"kind": "custom_call_output"}),
        (15, "meta", "m", None, None, None, None, {"kind": "compacted"}),
    ]
    assert got[0][2:4] == ("i1", "/c") and got[1][2:4] == ("i1", "/d")
    got, _ = run(spark, A.codex, [{"timestamp": T} | p("compacted", message="m")], "/s/rollout-2024-0F0e0d0c-1111-2222-3333-444455556666.jsonl")
    assert got[0][2] == "0F0e0d0c-1111-2222-3333-444455556666"


def test_omp(spark):
    message = lambda role, content, **x: {"type": "message", "message": {"role": role, "content": content} | x}
    records = [
        {"type": "title", "title": "early"},
        {"timestamp": 1704067200000} | message("assistant", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "toolCall", "id": "c", "name": "n"}, {"type": "text", "text": "c"}, {"type": "odd"}], model="mm", usage={"input": 7, "output": 8}),
        {"type": "session", "id": "S", "cwd": "/p", "version": 2},
        message("toolResult", [{"type": "text", "text": "r"}], toolName="n", toolCallId="c", isError=True),
        {"type": "weird"},
        message("system", "x"),
        {"type": "model_change", "model": "k"},
        message("assistant", "y"),
    ]
    got, ts = run(spark, A.omp, records, "/o/d/2024_early.jsonl")
    assert [(r[0], r[1], *r[4:]) for r in got] == [
        (0, 0, "meta", "early", None, None, None, None, {"kind": "title"}),
        (1, 0, "assistant", "a\nb", None, "mm", 7, 8, {}),
        (1, 1, "tool_call", "", "n", "mm", None, None, {"call_id": "c"}),
        (1, 2, "assistant", "c", None, "mm", None, None, {}),
        (1, 3, "meta", "", None, "mm", None, None, {"kind": "block", "omp_block": "odd"}),
        (2, 0, "meta", "", None, None, None, None, {"kind": "session", "version": 2}),
        (3, 0, "tool_result", "r", "n", None, None, None, {"call_id": "c", "is_error": True}),
        (4, 0, "meta", "", None, None, None, None, {"kind": "unknown", "omp_type": "weird"}),
        (5, 0, "meta", "x", None, None, None, None, {"kind": "message", "role": "system"}),
        (6, 0, "meta", "", None, "k", None, None, {"kind": "model_change"}),
        (7, 0, "assistant", "y", None, "k", None, None, {}),
    ]
    assert {r[2:4] for r in got} == {("S", "/p")} and set(ts) == {"2024-01-01T00:00:00.000Z"}
    got, _ = run(spark, A.omp, [{"type": "title", "title": "never stamped"}], "/o/d/2024_x.jsonl")
    assert got == []
    got, _ = run(spark, A.omp, [*[{"type": "title", "title": str(i), "updatedAt": T} for i in range(66)], {"type": "session", "id": "late"}, {"type": "title", "title": "z"}], "/o/d/2024_x_y.jsonl")
    assert [r[2] for r in got] == ["x_y"] * 66 + ["late"] * 2  # released before the session record came


def test_droid(spark):
    message = lambda role, content, **x: x | {"type": "message", "message": {"role": role, "content": content}}
    records = [
        {"type": "session_start", "id": "D", "cwd": "/q", "title": "t"},
        message("user", [{"type": "text", "text": "a"}, {"type": "tool_result", "tool_use_id": "u", "content": "res"}, {"type": "text", "text": "b"}], timestamp=T),
        {"type": "todo_state", "todos": {"todos": [1, 2]}},
        {"type": "compaction_state", "summaryText": "cs"},
        {"type": None},
        {"type": "message"},
    ]
    got, ts = run(spark, A.droid, records, "/d/u.jsonl")
    assert [(r[0], *r[4:7], r[10]) for r in got] == [
        (0, "meta", "t", None, {"kind": "session_start"}),
        (1, "user", "a", None, {}),
        (1, "tool_result", "res", None, {"call_id": "u"}),
        (1, "user", "b", None, {}),
        (2, "meta", "", None, {"kind": "todo_state", "todo_count": 2}),
        (3, "meta", "cs", None, {"kind": "compaction_state"}),
        (4, "meta", "", None, {"kind": "unknown", "droid_type": "null"}),
        (5, "meta", "", None, {"kind": "message"}),
    ]
    assert set(ts) == {T}
    files = spark.createDataFrame([("/d/u.settings.json", json.dumps({"providerLockTimestamp": T, "providerLock": "p", "tokenUsage": {"inputTokens": 5, "outputTokens": 6}}, indent=1)), ("/d/v.settings.json", "{}")], "file string, content string")
    rows = A.droid_settings(files).collect()
    assert [(r.session_id, r.ts, r.tokens_in, r.tokens_out, json.loads(r.extra)) for r in rows] == [("u", T, 5, 6, {"kind": "settings", "provider": "p"})]


def test_kimi(spark):
    loop = lambda **e: {"type": "context.append_loop_event", "event": e}
    records = [
        {"type": "turn.cancel"},
        {"type": "metadata", "time": 1704067200123, "protocol_version": "1"},
        {"type": "usage.record", "model": "k2", "usageScope": "session", "usage": {"output": 9}},
        {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": " hey "}]}},
        {"type": "context.append_message", "message": {"role": "user", "content": "inj", "origin": {"kind": "hook"}}},
        loop(type="tool.result", toolCallId="x", result="early"),
        loop(type="tool.call", toolCallId="x", name="Read", args={"q": 1}),
        loop(type="tool.result", toolCallId="x", result={"output": "o", "isError": 1}),
        loop(type="tool.call", uuid="y", name="Do", description="d"),
        loop(type="content.part", part={"type": "think", "think": "hm"}),
        {"type": "usage.record", "usageScope": "turn", "usage": {"inputOther": 1, "inputCacheRead": 2, "output": 3}},
        {"type": "config.update", "profileName": "p", "systemPrompt": "secret"},
        {"type": "context.apply_compaction", "summary": "s"},
    ]
    got, _ = run(spark, A.kimi, records, "/k/wd_a/session_9/agents/main/wire.jsonl")
    assert [(r[0], *r[4:]) for r in got] == [
        (1, "meta", "", None, None, None, None, {"kind": "metadata", "protocol": "1"}),
        (3, "user", "hey", None, None, None, None, {}),
        (4, "meta", "inj", None, None, None, None, {"kind": "injected", "origin": "hook"}),
        (5, "tool_result", "early", None, None, None, None, {"tool_use_id": "x"}),
        (6, "tool_call", '{"q":1}', "Read", "k2", None, None, {"tool_use_id": "x"}),
        (7, "tool_result", "o", "Read", None, None, None, {"tool_use_id": "x", "is_error": True}),
        (8, "tool_call", "d", "Do", "k2", None, None, {"tool_use_id": "y"}),
        (9, "thinking", "hm", None, "k2", None, None, {}),
        (10, "meta", "", None, "k2", 3, 3, {"kind": "usage", "input_non_cached_tokens": 1, "cache_creation_tokens": 0, "cache_read_tokens": 2}),
        (11, "meta", "", None, None, None, None, {"kind": "config", "profile": "p"}),
        (12, "meta", "s", None, None, None, None, {"kind": "compaction"}),
    ]
    assert {r[2] for r in got} == {"session_9"}


def test_hooks_legacy(spark):
    records = [{"ts": 1704067200000, "event": "e", "id": "h", "decision": "block", "ms": 3, "infra": False, "code": None, "reason": "r", "session_id": "s", "cwd": "/z"}, {"ts": "", "id": "x"}, {"id": "x"}, {"ts": T, "session": 5}]
    got, ts = run(spark, A.hooks_legacy, records, "/h/telemetry.jsonl")
    assert [(r[0], *r[2:7], r[10]) for r in got] == [(0, "s", "/z", "hook_decision", "r", "h", {"event": "e", "decision": "block", "ms": 3, "infra": False}), (3, "5", None, "hook_decision", "", None, {})]
    assert ts == ["2024-01-01T00:00:00.000Z", T]


def test_generated_code_compiles(spark):
    """No adapter's expressions outgrow a compiled method: without the fallback, a failure to compile is an error."""
    from skein import vendor_queries

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("claude", "codex", "kimi", "hooks_legacy"):
            vendor_queries.QUERIES[f"adapter_{name}"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
