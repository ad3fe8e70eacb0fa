"""Closed hook segments: immutable files of a header, event frames in sequence, and a footer with a digest.

A segment is one row (file, content). Its validity is a set of boolean columns; a valid segment's frames become raw
events. What has been published is kept in a commits table by segment id, so a replay of the same bytes is a no-op and
other bytes under a published id are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records as R
from .records import extra, filled, is_object, is_true, number, text

PROTOCOL = "hooks-telemetry-segment-v1"


def read_segments(spark, path: str) -> DataFrame:
    """(file, content) of every segment file under a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def validated(segments: DataFrame) -> DataFrame:
    """(file, segment_id, created_at, event_count, payload_sha256, source_sha256, frames, valid and each check)."""
    rows = F.split(F.expr("substring(content, 1, length(content) - 1)"), "\n", -1)
    df = segments.withColumn("rows", rows).withColumn("n", F.size("rows"))
    df = df.withColumn("head", F.try_parse_json(F.get("rows", 0))).withColumn("foot", F.try_parse_json(F.get("rows", F.col("n") - 1)))
    df = df.withColumn("frames", F.transform(F.slice("rows", F.lit(2), F.greatest(F.col("n") - 2, F.lit(0))), lambda x: F.try_parse_json(x)))
    head, foot, n = F.col("head"), F.col("foot"), F.col("n") - 2
    payload = F.concat(F.array_join(F.slice("rows", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), "\n"), F.lit("\n"))
    df = df.withColumn("segment_id", filled(head, "$.segmentId")).withColumn("payload_sha256", F.sha2(payload, 256))
    in_order = F.forall("frames", lambda f: F.coalesce((text(f, "$.kind") == "event") & is_object(f, "$.event"), F.lit(False)))
    numbers = F.transform("frames", lambda f: number(f, "$.sequence"))
    checks = {
        "ends_with_newline": F.col("content").endswith("\n") & (F.col("n") >= 2),
        "header_ok": (text(head, "$.kind") == "segment_open") & (text(head, "$.protocol") == PROTOCOL) & number(head, "$.createdAt").isNotNull() & filled(head, "$.producerId").isNotNull() & filled(head, "$.invocationId").isNotNull() & (text(head, "$.source.producer") == "hooks-rotator"),
        "name_ok": F.substring_index("file", "/", -1) == F.concat(F.lit("segment-"), F.col("segment_id"), F.lit(".jsonl")),
        "frames_ok": in_order & (numbers == F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))),
        "footer_ok": (text(foot, "$.kind") == "segment_close") & (text(foot, "$.protocol") == PROTOCOL) & (text(foot, "$.segmentId") == F.col("segment_id")) & (number(foot, "$.eventCount") == n),
        "digest_ok": text(foot, "$.payloadSha256") == F.col("payload_sha256"),
    }
    for name, check in checks.items():
        df = df.withColumn(name, F.coalesce(check, F.lit(False)))
    valid = F.lit(True)
    for name in checks:
        valid = valid & F.col(name)
    return df.select("file", "segment_id", number(head, "$.createdAt").alias("created_at"), n.cast("long").alias("event_count"), "payload_sha256", F.sha2("content", 256).alias("source_sha256"), "frames", valid.alias("valid"), *checks)


def _truthy(e: Column, path: str) -> Column:
    """The value unless a script would take it for false."""
    false = (R.kind(e, path) == "VOID") | (text(e, path) == "") | (number(e, path) == 0) | ((R.kind(e, path) == "BOOLEAN") & ~is_true(e, path))
    return F.when(~F.coalesce(false, F.lit(False)), R.part(e, path))


def segment_events(segments: DataFrame) -> DataFrame:
    """Raw events of the valid segments among validated(...); frames without a usable time are skipped."""
    df = segments.filter("valid").select("file", "segment_id", "created_at", F.posexplode("frames").alias("seq", "f"))
    e = R.part(F.col("f"), "$.event")
    word = R.strip(text(e, "$.ts"))  # the frame's time as a script's Number() reads it
    millis = F.when(R.kind(e, "$.ts") == "VOID", 0).when(R.kind(e, "$.ts") == "BOOLEAN", is_true(e, "$.ts").cast("long")).when(word == "", 0).otherwise(F.expr("null"))
    ts = F.coalesce(R.epoch(e, "$.ts"), R.iso(F.coalesce(millis, F.try_to_number(F.when(word.rlike(r"^[0-9]{1,15}$"), word), F.lit("999999999999999"))).cast("long")))
    any_value = lambda k: R.present(e, f"$.{k}")
    fields: list[tuple[str, Column]] = [
        ("source_type", _truthy(e, "$.type")), ("hook_id", _truthy(e, "$.id")), ("decision", _truthy(e, "$.decision")), ("code", any_value("code")), ("timed_out", is_true(e, "$.timedOut")),
        ("infra", _truthy(e, "$.infra")), ("source", _truthy(e, "$.source")), ("episode_id", _truthy(e, "$.episode_id")), ("adaptive_state_persisted", is_true(e, "$.adaptiveStatePersisted")),
        ("causal_episode_persisted", is_true(e, "$.causalEpisodePersisted")), ("segment_created_at", F.col("created_at")), ("segment_id", F.col("segment_id")), ("sequence", F.col("seq")),
        ("payload_ts", any_value("payloadTs")), ("payload", any_value("payload")), ("meta", any_value("meta")), ("label", _truthy(e, "$.label")), ("repair_kind", _truthy(e, "$.kind")), ("evidence", _truthy(e, "$.evidence")),
    ]
    # every key is there, also with null
    more = F.to_json(F.struct(*[c.alias(k) for k, c in fields]), {"ignoreNullFields": "false"})
    out = df.select("file", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("pos"), ts.alias("ts"), filled(e, "$.session_id").alias("session_id"), filled(e, "$.project").alias("project"), F.lit("hook_decision").alias("event_type"), F.coalesce(filled(e, "$.reason"), filled(e, "$.text"), F.lit("")).alias("text"), filled(e, "$.id").alias("tool_name"), *[F.lit(None).cast(t).alias(c) for c, t in (("model", "string"), ("tokens_in", "long"), ("tokens_out", "long"))], more.alias("extra"))
    return out.filter("ts is not null")


def unpublished(segments: DataFrame, commits: DataFrame) -> DataFrame:
    """Valid segments that commits (segment_id, source_sha256) lacks; other bytes under a published id raise."""
    known = commits.select("segment_id", F.col("source_sha256").alias("published"))
    df = segments.filter("valid").join(known, "segment_id", "left")
    clash = df.filter("published <> source_sha256").select("segment_id").limit(1).collect()
    if clash:
        from ..schema import LakeError

        raise LakeError(f"segment {clash[0][0]} was published with other bytes")
    return df.filter("published is null").drop("published")
