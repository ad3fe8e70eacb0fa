"""The lake's views over canonical events, as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame) -> DataFrame:
    """A row for each (runtime, session): identity, span, message mix and summed counters."""
    kind = F.col("event_type")
    return (
        events.filter("session_id is not null")
        .groupBy("runtime", "session_id")
        .agg(
            F.max("project").alias("project"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count_if(kind == "user").alias("user_msgs"),
            F.count_if(kind == "assistant").alias("assistant_msgs"),
            F.count_if(kind == "tool_call").alias("tool_calls"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.max(F.get_json_object("extra", "$.source_stem_hash")).alias("session_alias"),
        )
    )


def tools_daily(events: DataFrame) -> DataFrame:
    calls = events.filter("event_type = 'tool_call' and tool_name is not null")
    return calls.groupBy(F.to_date("ts").alias("day"), "runtime", "tool_name").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"))


def tokens_daily(events: DataFrame) -> DataFrame:
    used = events.filter("tokens_in is not null or tokens_out is not null")
    return used.groupBy(F.to_date("ts").alias("day"), "runtime", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_distinct("session_id").alias("sessions"))


def hook_decisions(events: DataFrame) -> DataFrame:
    field = lambda k: F.get_json_object("extra", f"$.{k}")
    return events.filter("runtime = 'hooks' and event_type = 'hook_decision'").select(
        "ts", "session_id", "project", F.col("tool_name").alias("hook_id"), field("decision").alias("decision"), field("event").alias("hook_event"), field("infra").alias("infra"), F.col("text").alias("reason")
    )


def blocks_by_hook(events: DataFrame) -> DataFrame:
    blocks = hook_decisions(events).filter("decision = 'block'")
    last = F.max_by(F.when(F.col("reason").isNotNull(), F.col("reason")), F.when(F.col("reason").isNotNull(), F.struct("ts", "reason")))
    return blocks.groupBy("hook_id").agg(F.count("*").alias("blocks"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_block_ts"), F.max("ts").alias("last_block_ts"), last.alias("last_reason"))


def interrupted_sessions(events: DataFrame) -> DataFrame:
    """Sessions whose last turn has no answer. One aggregation instead of two ranked scans and two joins: the last turn
    and the last user text are aggregates by the order (ts, event type, text), which also settles equal times."""
    kind = F.col("event_type")
    turn = kind.isin("user", "assistant", "tool_call")
    order = F.struct("ts", "event_type", "text")
    found = (
        events.filter("session_id is not null")
        .groupBy("runtime", "session_id")
        .agg(
            F.max("project").alias("project"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count_if(kind == "user").alias("user_msgs"),
            F.count_if(kind == "assistant").alias("assistant_msgs"),
            F.count_if(kind == "tool_call").alias("tool_calls"),
            F.max(F.when(turn, order)).alias("tail"),
            F.max(F.when(kind == "user", order)).alias("request"),
        )
        .filter("tail.event_type <> 'assistant'")
    )
    stopped = F.when(F.col("tail.event_type") == "user", "unanswered").otherwise("cut_off_mid_tool")
    return found.select("runtime", "session_id", "project", stopped.alias("stopped_as"), "first_ts", "last_ts", "user_msgs", "assistant_msgs", "tool_calls", F.substring("request.text", 1, 240).alias("last_user_text"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The latest assignment of each (session, aspect); runtime does not count. Equal times: the higher source, then value."""
    latest = Window.partitionBy("session_id", "aspect").orderBy(F.desc_nulls_last("ts"), F.desc("source"), F.desc("value"))
    return labels.withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1").drop("__rank")


def label_aspects(labels: DataFrame) -> DataFrame:
    return latest_labels(labels).groupBy("aspect").agg(F.count_distinct("value").alias("values"), F.count("*").alias("labels"), F.count_distinct("session_id").alias("sessions"))


VIEWS = {"sessions": sessions, "tools_daily": tools_daily, "tokens_daily": tokens_daily, "hook_decisions": hook_decisions, "blocks_by_hook": blocks_by_hook, "interrupted_sessions": interrupted_sessions}


def register_views(events: DataFrame, labels: DataFrame | None = None, overrides: dict[str, str] | None = None) -> None:
    """Temporary views for SQL users: events, labels and the views above; overrides: SQL text by view name instead, for
    every view or none."""
    spark = events.sparkSession
    events.createOrReplaceTempView("events")
    if labels is not None:
        labels.createOrReplaceTempView("labels")
    if overrides is not None:
        if set(overrides) != set(VIEWS):
            raise ValueError(f"overrides must hold exactly {sorted(VIEWS)}")
        for name, text in overrides.items():
            spark.sql(text).createOrReplaceTempView(name)
    else:
        for name, view in VIEWS.items():
            view(events).createOrReplaceTempView(name)
