"""Masking properties, segments, ingest, export, labels, reads and the stream."""

import datetime as dt
import hashlib
import json
import os
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, StringStartsWith

from skein.functions import masking as M
from skein.operators import compaction, export, files, labels, lake, reads, status, tallies
from skein.plans import signals, views
from skein.schema import LakeError
from skein.sources import discovery, segments
from skein.sources.sqlite import SqliteSource
from skein.streaming import live, store, tail

ALPHABET = ["A", "K_EY=", "sk-", "é", "😀", " ", "=", "-", "_", "x" * 7, "aB3" * 6, "Zq9+" * 10, "\n", "TOKEN=", "0123456789abcdef"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
def test_mask_value_is_idempotent(text):
    once = M.mask_value(text)
    assert M.mask_value(once) == once


def test_mask_equals_model(spark):
    random.seed(1)
    texts = ["".join(random.choices(ALPHABET, k=random.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(M.mask(F.col("t"))).collect()]
    assert got == [M.mask_value(t) for t in texts] and sum(a != b for a, b in zip(got, texts)) > 300
    counts = df.select(*[F.sum(c) for c in M.mask_counts(F.col("t")).values()]).first()
    assert list(counts) == [sum(t.count(f"[masked:{k}:") for t in got) for k in ("assignment", "token", "entropy")]


def test_clip(spark):
    cases = ["", "abc", "x" * 10, "x" * 7 + "😀y", "x" * 8, "😀" * 6]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in cases], "t string").select(M.clip(F.col("t"), 8)).collect()]
    assert got == ["", "abc", "x" * 8, "x" * 7, "x" * 8, "😀" * 4]


def test_mask_extra(spark):
    secret = "KEY_A=" + "abcdefgh12345678"
    value = {"k": [secret, {"b": {"c": {"too": "deep"}}}], secret: 1, "n": None, "u": "é"}
    got = [json.loads(r[0]) for r in spark.createDataFrame([(json.dumps(value),), ("[1]",), (None,), ("bad",)], "x string").select(M.mask_extra(F.col("x"))).collect()]
    hit = f"[masked:assignment:{len(secret)}:{hashlib.sha256(secret.encode()).hexdigest()[:8]}]"
    assert got == [{"k": [hit, {"b": {"c": None}}], secret: 1, "n": None, "u": "é"}, {}, {}, {}]


def segment(name="s1", events=2, **wrong):
    head = {"kind": "segment_open", "protocol": segments.PROTOCOL, "segmentId": name, "createdAt": 1704067200000, "producerId": "p", "invocationId": "i", "source": {"producer": "hooks-rotator"}}
    frames = [{"kind": "event", "sequence": i + wrong.get("shift", 0), "event": {"ts": 1704067200000 + i if i != wrong.get("untimed") else "soon", "id": f"h{i}", "decision": "block", "reason": "", "text": "why", "session_id": "s"}} for i in range(events)]
    payload = "".join(json.dumps(x) + "\n" for x in [head, *frames])
    foot = {"kind": "segment_close", "protocol": segments.PROTOCOL, "segmentId": name, "eventCount": wrong.get("count", events), "payloadSha256": wrong.get("digest", hashlib.sha256(payload.encode()).hexdigest())}
    return payload + json.dumps(foot) + wrong.get("end", "\n")


def test_segments(spark):
    rows = [("/q/segment-s1.jsonl", segment()), ("/q/segment-x.jsonl", segment()), ("/q/segment-s2.jsonl", segment("s2", shift=1)), ("/q/segment-s3.jsonl", segment("s3", digest="0")), ("/q/segment-s4.jsonl", segment("s4", count=9)), ("/q/segment-s5.jsonl", segment("s5", end="")), ("/q/segment-s6.jsonl", segment("s6", 0)), ("/q/segment-s7.jsonl", segment("s7", 3, untimed=1)), ("/q/segment-s8.jsonl", "junk")]
    df = segments.validated(spark.createDataFrame(rows, "file string, content string"))
    assert {r.file[11:-6] for r in df.collect() if r.valid} == {"s1", "s6", "s7"}
    events = segments.segment_events(df).orderBy("file", "seq").collect()
    assert [(r.file[11:-6], r.seq, r.ts, r.text, r.tool_name) for r in events] == [("s1", 0, "2024-01-01T00:00:00.000Z", "why", "h0"), ("s1", 1, "2024-01-01T00:00:00.001Z", "why", "h1"), ("s7", 0, "2024-01-01T00:00:00.000Z", "why", "h0"), ("s7", 2, "2024-01-01T00:00:00.002Z", "why", "h2")]
    extra = json.loads(events[0].extra)
    assert len(extra) == 19 and extra["decision"] == "block" and extra["code"] is None and extra["segment_id"] == "s1" and extra["sequence"] == 0
    commits = spark.createDataFrame([("s1", hashlib.sha256(segment().encode()).hexdigest())], "segment_id string, source_sha256 string")
    assert {r.segment_id for r in segments.unpublished(df, commits).collect()} == {"s6", "s7"}
    with pytest.raises(LakeError):
        segments.unpublished(df, spark.createDataFrame([("s1", "other")], "segment_id string, source_sha256 string"))


def codex_lines(n, session="i1"):
    yield {"timestamp": "2024-01-02T03:04:05Z", "type": "session_meta", "payload": {"id": session, "cwd": "/c"}}
    yield {"type": "turn_context", "payload": {"model": "gm"}}
    for i in range(n):
        yield {"timestamp": f"2024-01-0{2 + i % 3}T03:04:{i:02d}Z", "type": "event_msg", "payload": {"type": "user_message", "message": f"question {i} KEY_A=abcdefgh12345678"}}
        yield {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": f"answer {i}"}]}}


def write(path, records, mode="w"):
    with open(path, mode, encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def plain(df):
    return sorted(tuple(str(r[c]) for c in ("ts", "runtime", "session_id", "project", "event_type", "text", "model", "extra", "date")) for r in df.collect())


def test_batch_round_trip(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "lake")
    src.mkdir()
    assert lake.read_events(spark, out).count() == 0
    write(src / "rollout-a.jsonl", codex_lines(4))
    lake.rebuild(spark, {"codex": f"{src}/*.jsonl"}, out, "m")
    with pytest.raises(LakeError):
        lake.rebuild(spark, {"codex": f"{src}/*.jsonl"}, out, "m")
    events = lake.read_events(spark, out)
    assert events.count() == 9 and "KEY_A=" not in "".join(r.text for r in events.collect())
    assert {r.date.isoformat() if hasattr(r.date, "isoformat") else r.date for r in events.select("date").distinct().collect()} == {"2024-01-02", "2024-01-03", "2024-01-04"}
    part = next((tmp_path / "lake/events").rglob("*.json"))
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)  # else the reader refuses what was not written by Spark
    with open(part, "a", encoding="utf-8") as f:
        f.write('{"ts":"soon","session_id":"i1","event_type":"meta","text":"odd time"}\n{"ts":"2024')
    rows = lake.read_events(spark, out).collect()
    assert len(rows) == 10 and [r.ts for r in rows if r.text == "odd time"] == [None]
    compaction.compact(spark, out)
    assert plain(compaction.read_mirror(spark, out)) == plain(lake.read_events(spark, out))
    assert lake.partition_report(spark, out).first().parts >= 3
    assert lake.clean(spark, out, "parquet") == [f"{out}/parquet"] and lake.clean(spark, out, "all", True) and lake.clean(spark, out) == []
    export.write_export(events, f"{out}/export")
    full = sorted(r.uuid for r in spark.read.json(f"{out}/export").collect())
    assert len(full) == 9
    export.merge_export(events.limit(3), f"{out}/export")
    assert sorted(r.uuid for r in spark.read.json(f"{out}/export").collect()) == full


@pytest.fixture()
def few(spark):
    """Few partitions of state: starting a query costs more than these rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def follow(spark, runtime, source, out, **more):
    return live.start(spark, runtime, str(source), out, "m", available_now=True, **more).awaitTermination(120)


def test_stream_equals_rebuild(spark, few, tmp_path):
    src, out, again = tmp_path / "src", str(tmp_path / "live"), str(tmp_path / "again")
    src.mkdir()
    text = "".join(json.dumps(r) + "\n" for r in codex_lines(6))
    random.seed(2)
    cuts = sorted(random.sample(range(len(text)), 2))
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        with open(src / "rollout-a.jsonl", "a", encoding="utf-8") as f:
            f.write(text[a:b])
        follow(spark, "codex", f"{src}/*.jsonl", out, export=True)
    write(src / "rollout-b.jsonl", codex_lines(2, "i2"))
    follow(spark, "codex", f"{src}/*.jsonl", out, export=True)
    follow(spark, "codex", f"{src}/*.jsonl", out, export=True)  # nothing new
    counts = lake.rebuild(spark, {"codex": f"{src}/*.jsonl"}, again, "m")
    assert counts["codex"]["events"] == 18 and counts["codex"]["masked"] == 8
    assert plain(lake.read_events(spark, out)) == plain(lake.read_events(spark, again)) and len(plain(lake.read_events(spark, out))) == 18
    assert [(r.runtime, r.events, r.masked) for r in tallies.tallies(spark, out).collect()] == [("codex", 18, 8)]
    exported = export.read_export(spark, f"{out}/export")
    assert exported.count() == 18 and exported.select("uuid").distinct().count() == 18
    (src / "rollout-a.jsonl").write_text("short\n")
    with pytest.raises(Exception, match="rewritten|shrank"):
        follow(spark, "codex", f"{src}/*.jsonl", out)


def test_batches_read_what_was_appended(spark, few, tmp_path):
    """Lines of a batch are the new ones, its bytes those between its offsets, and max_lines ends it."""
    file, out = tmp_path / "rollout-a.jsonl", str(tmp_path / "lake")
    records = list(codex_lines(600))
    write(file, records[:100])
    reader = dict(runtime="codex", source=str(file), path=out, machine="m")
    query = live.start(spark, **reader).queries[0]
    try:
        query.processAllAvailable()
        sizes = [file.stat().st_size]
        for a, b in ((100, 103), (103, 160)):
            write(file, records[a:b], "a")
            sizes.append(file.stat().st_size)
            query.processAllAvailable()
        sources = [json.loads(p.json)["sources"][0] for p in query.recentProgress if p.numInputRows]
        seen = [(x["numInputRows"], x["startOffset"] or {}, x["endOffset"]) for x in sources]
    finally:
        query.stop()
    at = lambda offset: offset.get(str(file), {"at": 0})["at"]
    assert [(n, at(a), at(b)) for n, a, b in seen] == [(100, 0, sizes[0]), (3, sizes[0], sizes[1]), (57, sizes[1], sizes[2])]
    write(file, records[160:], "a")
    write(tmp_path / "rollout-b.jsonl", codex_lines(300, "i2"))
    query = live.start(spark, **reader | {"source": f"{tmp_path}/rollout-*.jsonl"}, max_lines=512).queries[0]
    try:
        query.processAllAvailable()
        counts = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()
    assert sum(counts) == len(records) - 160 + 602 and max(counts) == 512 and len(counts) == 4
    lake.rebuild(spark, {"codex": f"{tmp_path}/rollout-*.jsonl"}, str(tmp_path / "again"), "m")
    assert plain(lake.read_events(spark, out)) == plain(lake.read_events(spark, str(tmp_path / "again")))


def test_rewritten_sources_are_refused(spark, few, tmp_path):
    file = tmp_path / "rollout-a.jsonl"
    write(file, codex_lines(4))
    text, out = file.read_text(), str(tmp_path / "lake")
    follow(spark, "codex", file, out)
    was = tail.offsets(spark, f"{out}/checkpoints/codex")[0][str(file)]
    assert was["at"] == len(text.encode())
    changes = {"same size": text.replace("question 1", "question X"), "grown": text.replace("question 1", "question X") + "{}\n", "shorter": text[:-40]}
    for name, new in changes.items():
        file.write_text(new)
        os.utime(file, ns=(was["time"] + 10**9, was["time"] + 10**9))
        with pytest.raises(ValueError, match="rewritten|shrank"):
            tail.verify(str(file), was, store.stat(str(file)))
        with pytest.raises(Exception, match="rewritten|shrank"):
            follow(spark, "codex", file, out)
    file.write_text(text + json.dumps(list(codex_lines(1))[2]) + "\n")
    follow(spark, "codex", file, out)
    assert lake.read_events(spark, out).count() == 10


@pytest.mark.parametrize("runtime", ["claude", "codex", "omp", "droid", "kimi"])
def test_ranges_of_long_files_carry_registers(spark, few, tmp_path, runtime):
    """A file read in many ranges gives the rows of one read whole."""
    rows = {"claude": claude_lines, "codex": lambda: codex_lines(40), "omp": lambda: omp_lines(90), "droid": lambda: droid_lines(90), "kimi": kimi_calls}[runtime]
    spark.dataSource.register(tail.TailSource)
    for variant in range(3):
        records = list(rows())
        if variant:
            random.seed(variant)
            random.shuffle(records)  # registers late or never set, releases late
        write(tmp_path / f"a_{variant}.jsonl", records)
    path = f"{tmp_path}/*.jsonl"
    got = [sorted(map(str, lake.parsed(spark, path, runtime, split=step).collect())) for step in (1 << 20, 200)]
    assert got[0] == got[1] and len(got[0]) >= 14
    assert spark.read.format("tail").option("path", path).option("split", "200").load().rdd.getNumPartitions() > 8


def omp_lines(n=4):
    yield {"type": "message", "timestamp": "2024-01-02T00:00:01Z", "message": {"role": "user", "content": "before the session"}}
    yield {"type": "session", "id": "S", "cwd": "/p", "timestamp": "2024-01-02T00:00:02Z"}
    yield {"type": "model_change", "model": "m1"}
    for i in range(n):
        yield {"type": "message", "timestamp": f"2024-01-02T00:01:0{i % 10}Z", "message": {"role": "assistant" if i % 3 else "user", "content": f"later {i}", "usage": {"input": i, "output": 2}}}


def droid_lines(n=4):
    yield {"type": "message", "message": {"role": "user", "content": "no time yet"}}
    yield {"type": "session_start", "id": "D", "cwd": "/q", "title": "t"}
    for i in range(n):
        yield {"type": "message", "timestamp": f"2024-01-02T00:01:0{i % 10}Z", "message": {"role": "user", "content": f"said {i}"}}


def kimi_lines():
    for i in range(5):
        yield {"type": "context.append_message", "time": 1704153600000 + i, "message": {"role": "user", "origin": {"kind": "user"}, "content": f"hello {i}"}}


def kimi_calls():
    """Calls and their results, some of them of one id, and models that change."""
    for i in range(40):
        event = {"type": "tool.call", "toolCallId": f"c{i % 7}", "name": f"tool{i % 3}", "args": {"n": i}} if i % 2 else {"type": "tool.result", "toolCallId": f"c{(i + 2) % 7}", "result": {"output": f"out {i}"}}
        yield {"type": "context.append_loop_event", "event": event} | ({"time": 1704153600000 + i} if i % 5 else {})
        if i % 9 == 0:
            yield {"type": "usage.record", "model": f"k{i}", "usageScope": "turn", "usage": {"inputOther": i + 1, "output": 1}}


def hook_lines():
    return ({"ts": f"2024-01-02T00:00:{i:02d}Z", "session": "h", "id": "x", "decision": "block"} for i in range(12))


def claude_lines():
    for i in range(5):
        yield {"type": "user", "sessionId": "C" if i else None, "cwd": "/c" if i % 2 else None, "timestamp": f"2024-01-02T00:00:0{i}Z", "message": {"role": "user", "content": f"line {i}"}}


@pytest.mark.parametrize("runtime", ["claude", "omp", "droid", "kimi", "calls", "hooks"])
def test_stream_equals_rebuild_for_runtimes(spark, few, tmp_path, runtime):
    """Random cuts, within lines too: events that wait for a session get it, and are written once."""
    rows = {"claude": claude_lines, "omp": omp_lines, "droid": droid_lines, "kimi": kimi_lines, "calls": kimi_calls, "hooks": hook_lines}[runtime]()
    calls, runtime = runtime == "calls", runtime.replace("calls", "kimi")
    folder = tmp_path / "src" / ("session_k/agents/main" if runtime == "kimi" else "-p")
    folder.mkdir(parents=True)
    file, index = folder / ("wire.jsonl" if runtime == "kimi" else "a.jsonl"), tmp_path / "session_index.jsonl"
    index.write_text(json.dumps({"sessionId": "session_k", "workDir": "/k"}) + "\n")
    if runtime == "droid":
        (folder / "a.settings.json").write_text(json.dumps({"providerLockTimestamp": "2024-01-02T09:00:00Z", "tokenUsage": {"inputTokens": 7, "outputTokens": 9}}))
    out, again = str(tmp_path / "live"), str(tmp_path / "again")
    text = "".join(json.dumps(r) + "\n" for r in rows)
    random.seed(runtime)
    cuts = [text.index("\n") + 1, random.randrange(text.index("\n") + 2, len(text))]
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        with open(file, "a", encoding="utf-8") as f:
            f.write(text[a:b])
        live.start(spark, runtime, str(file), out, "m", available_now=True, kimi_index=str(index)).awaitTermination(120)
    lake.rebuild(spark, {runtime: str(file)}, again, "m", kimi_index=str(index))
    got = lake.read_events(spark, again)
    assert plain(lake.read_events(spark, out)) == plain(got) and got.count() >= 5
    if runtime == "kimi":
        assert {r.project for r in got.collect()} == {"/k"}
    if calls:
        named = {(r.text, r.tool_name) for r in got.collect() if r.event_type == "tool_result" and r.tool_name}
        assert len(named) > 10 and {r.model for r in got.collect()} > {"k9", "k27"}
    if runtime == "omp":
        assert {r.model for r in got.collect()} == {"m1", None}
        assert {(r.session_id, r.project) for r in got.collect()} == {("S", "/p")}
    if runtime == "droid":
        assert [(r.tokens_in, r.tokens_out) for r in got.collect() if r.tokens_in] == [(7, 9)]


def test_droid_settings_are_snapshots(spark, few, tmp_path):
    """Settings that change alone, move to another day, lose their lock, have no transcript, or go: as in a rebuild each time."""
    src, out = tmp_path / "src", str(tmp_path / "lake")
    src.mkdir()
    write(src / "a.jsonl", droid_lines())

    def settings(name, day, tokens):
        lock = {"providerLockTimestamp": f"2024-01-0{day}T09:00:00Z"} if day else {}
        (src / f"{name}.settings.json").write_text(json.dumps({**lock, "tokenUsage": {"inputTokens": tokens, "outputTokens": 1}}))

    steps = [lambda: settings("a", 2, 7), lambda: settings("a", 2, 99), lambda: settings("a", 3, 99), lambda: settings("alone", 2, 5), lambda: settings("a", 0, 1), lambda: settings("a", 4, 11), lambda: (src / "alone.settings.json").unlink(), lambda: write(src / "a.jsonl", list(droid_lines())[:1], "a")]
    want = [{7}, {99}, {99}, {5, 99}, {5}, {5, 11}, {11}, {11}]
    for i, (step, tokens) in enumerate(zip(steps, want, strict=True)):
        step()
        follow(spark, "droid", f"{src}/*.jsonl", out)
        lake.rebuild(spark, {"droid": f"{src}/*.jsonl"}, str(tmp_path / f"again{i}"), "m")
        got = plain(lake.read_events(spark, out))
        assert got == plain(lake.read_events(spark, str(tmp_path / f"again{i}"))), i
        assert {r.tokens_in for r in lake.read_events(spark, out).collect()} - {None} == tokens


def test_many_sidecars_in_batches(spark, few, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "lake")
    src.mkdir()
    for i in range(9):
        (src / f"s{i}.settings.json").write_text(json.dumps({"providerLockTimestamp": f"2024-01-0{1 + i % 3}T09:00:00Z", "tokenUsage": {"inputTokens": i}}))
    reader = tail.SnapshotSource({"path": f"{src}/*.json", "max_files": "4"}).streamReader(None)
    offsets = [reader.initialOffset()]
    for _ in range(4):
        offsets.append(json.loads(json.dumps(reader.latestOffset())))
    parts = [[p.file for p in reader.partitions(a, b) if p.file] for a, b in zip(offsets, offsets[1:])]
    assert [len(p) for p in parts] == [4, 4, 1, 0] and len({f for p in parts for f in p}) == 9
    write(src / "a.jsonl", droid_lines())
    follow(spark, "droid", f"{src}/*.jsonl", out)
    assert sorted(r.tokens_in for r in lake.read_events(spark, out).collect() if r.tokens_in is not None) == list(range(9))


def test_masking_is_bound_once(spark):
    """Each class's pattern is read three times at most, not once for each use of the text."""
    plan = spark.range(1).select(M.clip(M.mask(F.col("id").cast("string"))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3 and plan.count("split(") <= 8


def test_tail_lines(tmp_path):
    file = tmp_path / "f"
    file.write_bytes(b"one\r\n\ntw\xffo\nopen")
    span = tail.Span(str(file), 0, tail.last_newline(str(file), 0, 16))
    assert [(at, x) for _, at, x in tail.lines_of(span)] == [(0, "one"), (5, ""), (6, "tw�o")]
    for step in range(1, 12):  # every line in the range where it begins, once
        assert [x[1:] for a in range(0, 11, step) for x in tail.lines_of(tail.Span(str(file), a, min(a + step, 11)))] == [(0, "one"), (5, ""), (6, "tw�o")]
    assert [tail.after_lines(str(file), 0, 15, n) for n in (1, 2, 3, 4)] == [(5, 1), (6, 2), (11, 3), (11, 3)]


def test_store_of_uris(spark, tmp_path):
    """Globs, reads and streams of URIs give what plain paths give."""
    mock, *_ = store.resolved("mock:/a")
    for name in ("a/b/x.jsonl", "a/b/c/y.jsonl", "a/z.json"):
        mock.create_dir(name.rpartition("/")[0], recursive=True)
        with mock.open_output_stream(name) as f:
            f.write(b"one\ntwo")
    found = lambda g: sorted(x.path for x in store.listed(mock, g))
    assert found("a/*/*.jsonl") == ["a/b/x.jsonl"] and found("a/**/*.json*") == ["a/b/c/y.jsonl", "a/b/x.jsonl", "a/z.json"] and found("a/z.json") == ["a/z.json"] and found("no/*") == []
    with mock.open_input_file("a/b/x.jsonl") as f:
        assert list(store.lines(f, 0)) == [(0, b"one\n"), (4, b"two")]
    src, out, again = tmp_path / "s p", str(tmp_path / "lake"), str(tmp_path / "again")
    src.mkdir()
    write(src / "rollout-a.jsonl", codex_lines(3))
    write(src / "rollout-b.jsonl", codex_lines(2, "i2"))
    path = f"file://{str(tmp_path)}/s*/rollout-*.jsonl"
    assert [store.stat(f) for f in store.matching(path)] == [store.stat(f) for f in store.matching(f"{tmp_path}/s*/*.jsonl")]
    follow(spark, "codex", path, out)
    lake.rebuild(spark, {"codex": path}, again, "m", split=150)
    assert plain(lake.read_events(spark, out)) == plain(lake.read_events(spark, again)) and lake.read_events(spark, out).count() == 12


def test_long_lines_in_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHUNK", 3)
    file = tmp_path / "f"
    file.write_bytes(b"a\n" + b"b" * 20 + b"\n\ncc\nopen")
    with store.opened(str(file)) as f:
        assert [(at, len(x)) for at, x in store.lines(f, 0)] == [(0, 2), (2, 21), (23, 1), (24, 3), (27, 4)]


def test_labels(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i, (value, source) in enumerate([(" good ", "manual"), ("bad", "model:x/y")]):
        labels.append(f"{tmp_path}/labels", labels.record("s", " Quality ", value, "codex", None, source, now + dt.timedelta(days=i)))
    df = lake.read_labels(spark, str(tmp_path))
    assert [(r.aspect, r.value) for r in labels.latest(df).collect()] == [("quality", "bad")]
    assert [tuple(r) for r in labels.aspects(df).collect()] == [("quality", 1, 1, 1)]
    for bad in (("", "a", "b"), ("s", " ", "b"), ("s", "a", "")):
        with pytest.raises(LakeError):
            labels.record(*bad)
    with pytest.raises(LakeError):
        labels.record("s", "a", "b", source="robot")
    events = spark.createDataFrame([("codex", "s"), ("omp", "s"), ("omp", "t")], "runtime string, session_id string")
    assert labels.session_runtime(events, "t") == "omp" and labels.session_runtime(events, "s", "codex") == "codex"
    for s in ("s", "none"):
        with pytest.raises(LakeError):
            labels.session_runtime(events, s)


def test_read_arguments(spark):
    events = spark.createDataFrame([], "ts timestamp, runtime string, session_id string, project string, event_type string, text string, tool_name string, model string, extra string, tokens_in long, tokens_out long")
    for call in (lambda: reads.sessions(events, "gemini"), lambda: reads.sessions(events, limit=0), lambda: reads.sessions(events, limit=501), lambda: reads.events_filter(events, event_type="odd"), lambda: reads.search(events, ""), lambda: reads.show(events, "s", include=","), lambda: reads.show(events, "s", include="odd"), lambda: reads.stats(events, dt.datetime(2024, 1, 1), 0), lambda: reads.hooks(events, limit=True)):
        with pytest.raises(LakeError):
            call()
    assert reads.included(" tool_call,USER,user ") == ("tool_call", "user") and len(reads.included("all")) == 7
    assert reads.title_from("x <goal>old one two</goal> <goal> fix the login page </goal>") == "fix the login page" and reads.title_from("<goal/>") is None
    for bad in ("nothing", "<goal>two words</goal>"):
        with pytest.raises(LakeError):
            reads.title_from(bad)
    views.register_views(events)
    with pytest.raises(ValueError):
        views.register_views(events, overrides={"sessions": "select 1"})


def test_project_pattern_backslash(spark):
    rows = [("codex", r"a\b", "s1"), ("codex", "axb", "s2")]
    events = spark.createDataFrame(rows, "runtime string, project string, session_id string").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("ts", "timestamp"), ("event_type", "string"), ("text", "string"), ("extra", "string"), ("tokens_in", "long"), ("tokens_out", "long"))])
    assert {r.session_id for r in reads.sessions(events, project="A\\B").collect()} == {"s1"}
    assert {r.session_id for r in reads.sessions(events, project="a_b").collect()} == {"s1", "s2"}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "index.db")
    rows = [("a", None, 1.5, 2), ("b", "/x", None, None)] + [(f"s{i}", f"/p/{i % 7}", i / 2, i) for i in range(100)]
    with sqlite3.connect(path) as db:
        db.execute("create table sessions(sessionId text, cwd text, mtime real, n integer)")
        db.executemany("insert into sessions values (?,?,?,?)", rows)
        db.execute("create table keyed(k text primary key, n integer) without rowid")
        db.execute("insert into keyed values ('x', 1), ('y', 2)")
        db.execute("create table empty(k text)")
    spark.dataSource.register(SqliteSource)
    read = lambda table, push="false": spark.read.format("sqlite").option("path", path).option("table", table).option("pushdown", push).load()
    assert sorted(map(tuple, read("sessions").collect()), key=str) == sorted(rows, key=str)
    assert read("sessions").rdd.getNumPartitions() == 8 and read("keyed").count() == 2 and read("empty").count() == 0
    asked = ["n > 90", "n >= 90 and cwd = '/p/6'", "cwd is null", "n is not null and mtime <= 3", "sessionId in ('a', 's7')", "sessionId like 's1%'", "mtime = 1.5", "n < 2 or n = 50"]
    plainly = [sorted(map(tuple, read("sessions").filter(x).collect()), key=str) for x in asked]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [sorted(map(tuple, read("sessions", "true").filter(x).collect()), key=str) for x in asked] == plainly and all(plainly)
        plan = [read("sessions", push).filter("n > 90")._jdf.queryExecution().executedPlan().toString() for push in ("false", "true")]
        assert "Filter" in plan[0] and "n#" in plan[0].split("Filter")[1].split("\n")[0] and "> 90" not in plan[1].split("BatchScan")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    source = SqliteSource({"path": path, "table": "sessions", "pushdown": "true"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([GreaterThan(("n",), 90), StringStartsWith(("cwd",), "/p")]))
    assert [type(f) for f in left] == [StringStartsWith]
    assert sorted(r[3] for p in reader.partitions() for r in reader.read(p)) == list(range(91, 100))


def test_one_batch_verb_at_a_time(spark, tmp_path):
    out = str(tmp_path / "lake")
    with files.locked(spark, out, "compact"):
        for verb in (lambda: files.locked(spark, out, "export").__enter__(), lambda: compaction.compact(spark, out), lambda: lake.rebuild(spark, {}, out, "m")):
            with pytest.raises(LakeError, match="locked by compact"):
                verb()
    with files.locked(spark, out, "rebuild", hours=-1), files.locked(spark, out, "compact"):  # the first one has expired
        assert files.read_json(spark, f"{out}/.lock")["verb"] == "compact"
    assert not files.exists(spark, f"{out}/.lock")


def test_compaction_rewrites_what_changed(spark, tmp_path):
    src, out = tmp_path / "rollout-a.jsonl", str(tmp_path / "lake")
    write(src, codex_lines(6))
    lake.ingest(spark, {"codex": str(src)}, out, "m")
    assert compaction.compact(spark, out, index=True) == {"written": 3, "removed": 0, "left": 0}
    there = lambda: {str(p): p.stat().st_mtime_ns for folder in ("parquet", "trigrams") for p in (tmp_path / "lake" / folder).rglob("*.parquet")}
    before = there()
    assert compaction.compact(spark, out, index=True) == {"written": 0, "removed": 0, "left": 3} and there() == before
    lake.append(lake.stored_events(spark, out).drop("batch").filter("date = '2024-01-03'").withColumn("text", F.lit("added needle here")).limit(1), out)
    assert compaction.compact(spark, out, index=True) == {"written": 1, "removed": 0, "left": 2}
    same = {p for p, t in there().items() if before.get(p) == t}
    assert all("2024-01-03" not in p for p in same) and len(same) == len([p for p in before if "2024-01-03" not in p])
    assert plain(compaction.read_mirror(spark, out)) == plain(lake.read_events(spark, out))
    # a search reads the files that have all trigrams, and finds what a scan finds
    events = lake.read_events(spark, out)
    for literal in ("NEEDLE", "answer 4", "question", "no such text", "er", "%", "[masked:assignment"):
        assert compaction.search(spark, out, literal).collect() == reads.search(events, literal).collect()
    assert len(compaction.candidates(spark, out, "needle")) == 1 < len(compaction.candidates(spark, out, "question")) and compaction.candidates(spark, out, "no such text") == [] and compaction.candidates(spark, out, "er") is None
    files.delete(spark, f"{out}/events/runtime=codex/date=2024-01-02")
    assert compaction.compact(spark, out, index=True) == {"written": 0, "removed": 1, "left": 2}
    assert plain(compaction.read_mirror(spark, out)) == plain(lake.read_events(spark, out))
    busy = compaction.compact  # a busy day is several files
    lake.append(lake.stored_events(spark, out).drop("batch").filter("date = '2024-01-03'").crossJoin(spark.range(60).toDF("i")).withColumn("session_id", F.concat("session_id", "i")).drop("i"), out)
    busy(spark, out, target=1000)
    assert len(list((tmp_path / "lake/parquet/runtime=codex/date=2024-01-03").glob("*.parquet"))) > 2


def test_live_export_writes_its_batch(spark, tmp_path):
    src, out = tmp_path / "rollout-a.jsonl", str(tmp_path / "lake")
    write(src, codex_lines(30))
    lake.ingest(spark, {"codex": str(src)}, out, "m")
    events = lake.stored_events(spark, out)
    full = {r.uuid for r in export.export_rows(events).collect()}
    export.write_export(events, f"{out}/export")
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / "lake" / folder).rglob("*.*") if p.is_file())
    whole = size("export")
    export.append_export(events.limit(2), f"{out}/export", "codex-1")
    export.append_export(events.limit(2), f"{out}/export", "codex-1")  # repeated
    assert size("export") == whole and 0 < size("export.log") < whole
    export.append_export(events.limit(1).withColumn("text", F.lit("new")), f"{out}/export", "codex-2")
    got = export.read_export(spark, f"{out}/export")
    assert got.count() == len(full) + 1
    assert export.fold_export(spark, f"{out}/export") == 2 and export.fold_export(spark, f"{out}/export") == 0
    assert sorted(map(str, spark.read.schema(export.ROW).json(f"{out}/export").collect())) == sorted(map(str, export.read_export(spark, f"{out}/export").collect())) and export.read_export(spark, f"{out}/export").count() == len(full) + 1


def test_a_log_of_an_export_is_written_dense(spark, tmp_path):
    src, out = tmp_path / "rollout-a.jsonl", str(tmp_path / "lake")
    write(src, codex_lines(30))
    lake.ingest(spark, {"codex": str(src)}, out, "m")
    export.append_export(lake.stored_events(spark, out), f"{out}/export", "codex-1")
    written = list((tmp_path / "lake" / "export.log").rglob("part-*"))
    assert written and all(p.name.endswith(".zstd.parquet") for p in written)


def test_signal_views_and_reports(spark):
    events = spark.createDataFrame([], "ts timestamp, runtime string, session_id string, project string, event_type string, text string, tool_name string, model string, extra string, tokens_in long, tokens_out long")
    terms = spark.createDataFrame([("s", "w", "strong", 2, 1704067200)], "sessionId string, word string, severity string, count long, last_seen long")
    index = spark.createDataFrame([("s", "/c", 1704067200, None)], "sessionId string, cwd string, mtime long, last_activity long")
    for bad in (dict(name="weekly"), dict(limit=0), dict(limit=501)):
        with pytest.raises(LakeError):
            signals.report(events, terms, index, **bad)
    assert [signals.report(events, terms, index, name).count() for name in signals.REPORTS] == [1, 1, 1, 1]
    signals.register_signals(events, terms, index)
    assert spark.sql("SELECT f.frustration_score, d.term_hits, w.source FROM frustration f, hook_daily d, freshness w, index_sessions i WHERE i.sessionId = f.session_id").first() == (6, 2, "index")


def test_publish_segments(spark, tmp_path):
    (tmp_path / "q").mkdir()
    out = str(tmp_path / "lake")
    for name, text in (("s1", segment()), ("s2", segment("s2", digest="0"))):
        (tmp_path / "q" / f"segment-{name}.jsonl").write_text(text)
    assert live.publish_segments(spark, str(tmp_path / "q"), out, "m") == 1
    assert live.publish_segments(spark, str(tmp_path / "q"), out, "m") == 0
    (tmp_path / "q" / "segment-s3.jsonl").write_text(segment("s3", 3))
    assert live.publish_segments(spark, str(tmp_path / "q"), out, "m") == 1
    rows = lake.read_events(spark, out).collect()
    assert len(rows) == 5 and {r.runtime for r in rows} == {"hooks"}
    (tmp_path / "q" / "segment-s1.jsonl").write_text(segment("s1", 1))
    with pytest.raises(LakeError):
        live.publish_segments(spark, str(tmp_path / "q"), out, "m")


def test_one_lake_of_all_writers(spark, few, tmp_path):
    """Batch ingest, a stream and published segments in one lake, read and compacted together."""
    out = str(tmp_path / "lake")
    for name, text in (("a", list(codex_lines(2))), ("b", list(codex_lines(3, "i2")))):
        write(tmp_path / f"rollout-{name}.jsonl", text)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "segment-s1.jsonl").write_text(segment())
    lake.ingest(spark, {"codex": f"{tmp_path}/rollout-a.jsonl"}, out, "m")
    follow(spark, "codex", tmp_path / "rollout-b.jsonl", out)
    assert live.publish_segments(spark, str(tmp_path / "q"), out, "m") == 1
    rows = lake.read_events(spark, out)
    assert rows.count() == 5 + 7 + 2 and {r.session_id for r in rows.collect()} == {"i1", "i2", "s"}
    compaction.compact(spark, out)
    assert plain(compaction.read_mirror(spark, out)) == plain(rows)


def test_discovery_and_status(spark, tmp_path):
    home, out = tmp_path / "home", str(tmp_path / "lake")
    day = home / ".codex/sessions/2024/01/02"
    day.mkdir(parents=True)
    write(day / "rollout-a.jsonl", codex_lines(2))
    assert discovery.inventory(str(home))["codex"]["files"] == 1 and not discovery.inventory(str(home))["kimi"]["available"]
    live.start(spark, "codex", discovery.source("codex", str(home)), out, "m", available_now=True).awaitTermination(120)
    report = status.status(spark, out)
    assert report["stream"]["codex"]["state"] == "healthy" and report["stream"]["codex"]["bytes"] == (day / "rollout-a.jsonl").stat().st_size
    assert report["partitions"][0]["runtime"] == "codex"
    assert not [c for c in status.doctor(spark, out, str(home)) if c[1] == "error"]
    index = tmp_path / "session_index.jsonl"
    index.write_text('{"sessionId":"session_1","workDir":"/old"}\n{bad\n{"sessionId":"session_1","workDir":"/new"}\n')
    assert [tuple(r) for r in discovery.kimi_projects(spark, str(index)).collect()] == [("session_1", "/new")]


def test_pieces_are_tasks_of_their_own(spark, tmp_path):
    """Each piece of a busy day is one task's work and one file: no two meet in a task by their hashes."""
    path = str(tmp_path / "lake")
    rows = spark.range(4000).select(F.lit("2024-01-01T00:00:00.000000Z").alias("ts"), F.lit("codex").alias("runtime"), F.lit("m").alias("machine"), F.concat(F.lit("s"), "id").alias("session_id"), F.lit("user").alias("event_type"), F.lit("t").alias("text"), F.lit("2024-01-01").alias("date"))
    lake.append(rows, path)
    size = compaction.sources(spark, path).first().bytes
    compaction.compact(spark, path, target=size // (compaction.SHRINKS * 16) + 1)
    assert len(list((tmp_path / "lake/parquet").rglob("*.parquet"))) == 16
    assert compaction.read_mirror(spark, path).select("session_id").distinct().count() == 4000


def test_small_ranges_are_few_tasks(tmp_path):
    """The partitions of a batch do not grow in number with its bytes, and have each line once."""
    text = "".join(f"line {i}\n" for i in range(20000))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("x\n")
    batch = tail._Batch({"path": f"{tmp_path}/*.jsonl", "split": "64"})
    parts = batch.partitions()
    assert len(parts) <= tail.TASKS + 2
    got = [line for p in parts for _, _, line in batch.read(p)]
    assert got == [*text.splitlines(), "x"]


def test_a_micro_batch_of_a_file_is_bounded(tmp_path, monkeypatch):
    """However many bytes are allowed, a file gives a task no more than it can sort; the stream still reads all of it."""
    monkeypatch.setattr(tail, "LARGEST", 1000)
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" for i in range(1000)))
    stream, was, got = tail._Stream({"path": f"{tmp_path}/*.jsonl", "max_bytes": "1000000"}), {}, []
    while (now := stream.latestOffset()) != was:
        part = [line for p in stream.partitions(was, now) for _, _, line in stream.read(p)]
        assert 0 < sum(len(x) + 1 for x in part) <= 1000
        got, was = got + part, now
    assert got == [f"line {i}" for i in range(1000)]
