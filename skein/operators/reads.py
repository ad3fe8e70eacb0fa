"""Bounded reads over the lake; each returns a DataFrame and validates what it is asked."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import views
from ..schema import EVENT_TYPES, LakeError, check_limit, check_runtime

LIMIT, MOST = 20, 500
SHOW, SHOW_MOST = 2000, 50000
DAYS, DAYS_MOST = 7, 500
EXCERPT = 240
CONVERSATION = ("user", "assistant")


def _project(df: DataFrame, pattern: str | None) -> DataFrame:
    """Case-insensitive LIKE %pattern%, its wildcards alive; a backslash is an ordinary character."""
    if pattern is None:
        return df
    like = "%" + pattern.lower().replace("\\", "\\\\") + "%"
    return df.filter(F.lower(F.coalesce("project", F.lit(""))).like(like))


def sessions(events: DataFrame, runtime: str | None = None, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    check_limit(limit, MOST)
    df = events if check_runtime(runtime) is None else events.filter(F.col("runtime") == runtime)  # before the aggregation: prunes partitions
    return _project(views.sessions(df), project).orderBy(F.desc_nulls_last("last_ts"), "runtime", "session_id").limit(limit)


def interrupted(events: DataFrame, runtime: str | None = None, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    check_limit(limit, MOST)
    df = events if check_runtime(runtime) is None else events.filter(F.col("runtime") == runtime)
    return _project(views.interrupted_sessions(df), project).orderBy(F.desc_nulls_last("last_ts"), "runtime", "session_id").limit(limit)


def events_filter(events: DataFrame, runtime: str | None = None, session: str | None = None, event_type: str | None = None, limit: int = LIMIT) -> DataFrame:
    check_limit(limit, MOST)
    check_runtime(runtime)
    if event_type is not None and event_type not in EVENT_TYPES:
        raise LakeError(f"unknown event type {event_type!r}")
    for column, value in (("runtime", runtime), ("session_id", session), ("event_type", event_type)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events.select("ts", "runtime", "session_id", "event_type", "tool_name", F.substring("text", 1, EXCERPT).alias("text")).orderBy(F.desc_nulls_last("ts"), "session_id", "event_type", "text").limit(limit)


def search(events: DataFrame, literal: str, runtime: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Events whose text holds the literal, case aside."""
    check_limit(limit, MOST)
    if not literal:
        raise LakeError("search needs a text")
    if check_runtime(runtime) is not None:
        events = events.filter(F.col("runtime") == runtime)
    found = events.filter(F.contains(F.lower("text"), F.lower(F.lit(literal))))
    return found.select("ts", "runtime", "session_id", "event_type", F.substring("text", 1, EXCERPT).alias("text")).orderBy(F.desc_nulls_last("ts"), "session_id", "event_type", "text").limit(limit)


def included(include: str | None) -> tuple[str, ...]:
    """Event types of a conversation: user and assistant, or those named (comma separated, in that order), or all."""
    if include is None:
        return CONVERSATION
    names = list(dict.fromkeys(x.strip().lower() for x in include.split(",") if x.strip()))
    if not names:
        raise LakeError("include needs at least one event type or 'all'")
    if "all" in names:
        return EVENT_TYPES
    if bad := [x for x in names if x not in EVENT_TYPES]:
        raise LakeError(f"unknown event type {bad[0]!r}; one of {', '.join(EVENT_TYPES)}, all")
    return tuple(names)


def show(events: DataFrame, session: str, runtime: str | None = None, include: str | None = None, limit: int = SHOW) -> DataFrame:
    """A conversation in order, with the number of all its matching events: one scan."""
    from pyspark.sql import Window

    check_limit(limit, SHOW_MOST)
    events = events.filter((F.col("session_id") == session) & F.col("event_type").isin(*included(include)))
    if check_runtime(runtime) is not None:
        events = events.filter(F.col("runtime") == runtime)
    out = events.withColumn("matched", F.count("*").over(Window.partitionBy("session_id")))
    return out.select("ts", "runtime", "event_type", "tool_name", "text", "matched").orderBy(F.asc_nulls_last("ts"), "event_type", "text").limit(limit)


def show_counts(events: DataFrame) -> DataFrame:
    """Conversation events of every session, by event type."""
    return events.filter(F.col("event_type").isin(*CONVERSATION)).groupBy("session_id", "event_type").agg(F.count("*").alias("matched"))


def stats(events: DataFrame, now: dt.datetime, days: int = DAYS) -> DataFrame:
    """Volumes by runtime in the days before `now`."""
    check_limit(days, DAYS_MOST, "days")
    cutoff = now - dt.timedelta(days=days)
    if "date" in events.columns:  # the partition's text date may be off by the time zone's day; 'unknown' sorts above
        events = events.filter(F.col("date") >= str(cutoff.date() - dt.timedelta(days=1)))
    kind = F.col("event_type")
    return (
        events.filter(F.col("ts") >= F.lit(cutoff).cast(events.schema["ts"].dataType))
        .groupBy("runtime")
        .agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_if(kind == "user").alias("user_msgs"), F.count_if(kind == "assistant").alias("assistant_msgs"), F.count_if(kind == "tool_call").alias("tool_calls"))
        .orderBy(F.desc("events"), "runtime")
    )


def hooks(events: DataFrame, decision: str | None = None, hook: str | None = None, limit: int = LIMIT) -> DataFrame:
    check_limit(limit, MOST)
    df = views.hook_decisions(events)
    for column, value in (("decision", decision), ("hook_id", hook)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(F.desc_nulls_last("ts"), "session_id", "reason").limit(limit)


def first_user_prompts(events: DataFrame) -> DataFrame:
    """The first non-blank user text of each session."""
    asked = events.filter("event_type = 'user' and session_id is not null and length(trim(text)) > 0")
    first = F.min(F.struct("ts", "text"))
    return asked.groupBy("runtime", "session_id").agg(first.alias("f")).select("runtime", "session_id", F.col("f.ts").alias("ts"), F.col("f.text").alias("prompt"))


def title_from(answer: str) -> str | None:
    """The title in a model's last <goal> tag: 3 to 12 words, 100 characters at most; None for an empty one."""
    last = re.findall(r"<goal\s*/>|<goal>(?:(?!<goal>).)*?</goal>", answer or "", re.S)
    if not last:
        raise LakeError("the answer has no goal tag")
    title = "" if last[-1].endswith("/>") else last[-1][len("<goal>") : -len("</goal>")].strip()
    if not title:
        return None
    if not 3 <= len(title.split()) <= 12 or len(title) > 100:
        raise LakeError("a title has 3 to 12 words and 100 characters at most")
    return title
