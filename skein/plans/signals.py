"""Signals across sources: the lake's sessions and hooks against an external index of conversations and terms.

Index tables: index_sessions(sessionId, cwd, mtime, last_activity) and terms(sessionId, word, severity, count,
last_seen), times in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LakeError, check_limit
from . import views


def frustration(events: DataFrame, terms: DataFrame, index_sessions: DataFrame, limit: int | None = 25) -> DataFrame:
    """Weighted term tallies with the lake session that has the same id, or whose alias is the id's hash.

    The either-or join becomes an equi-join on tagged keys: every lake session offers its id and its alias, every term
    session asks with its id and its hash; matched pairs are made distinct and joined back, unmatched ids stay.
    """
    lake = views.sessions(events)
    weight = F.when(F.col("severity") == "strong", 3).when(F.col("severity") == "moderate", 2).otherwise(1)
    tally = terms.groupBy("sessionId").agg(F.sum(F.col("count") * weight).alias("frustration_score"), F.sum("count").alias("term_hits"), F.count_distinct("word").alias("distinct_terms"))
    offered = lake.select(F.explode(F.array(F.concat(F.lit("i:"), "session_id"), F.concat(F.lit("h:"), "session_alias"))).alias("key"), "runtime", "session_id").filter("key is not null")
    asked = tally.select("sessionId", F.explode(F.array(F.concat(F.lit("i:"), "sessionId"), F.concat(F.lit("h:"), F.sha2("sessionId", 256)))).alias("key"))
    pairs = asked.join(offered, "key").select("sessionId", "runtime", "session_id").distinct()
    matched = pairs.join(lake.drop("session_alias"), ["runtime", "session_id"]).select("sessionId", "runtime", "project", "first_ts", "last_ts", "user_msgs")
    out = tally.join(index_sessions.select("sessionId", "cwd"), "sessionId", "left").join(matched, "sessionId", "left")
    out = out.groupBy("sessionId", "runtime", "project", "cwd", "first_ts", "last_ts", "user_msgs").agg(*[F.sum(c).alias(c) for c in ("frustration_score", "term_hits")], F.max("distinct_terms").alias("distinct_terms"))
    out = out.select(
        F.col("sessionId").alias("session_id"),
        "frustration_score",
        "term_hits",
        "distinct_terms",
        F.coalesce("runtime", F.when(F.col("sessionId").startswith("rollout-"), "codex")).alias("runtime"),
        F.coalesce("project", "cwd").alias("project"),
        "first_ts",
        "last_ts",
        "user_msgs",
    )
    return out.orderBy(F.desc("frustration_score"), "session_id", "runtime").limit(limit) if limit else out


def hook_overlap(events: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: sessions that hooks blocked, sessions with terms, and both."""
    blocked = views.hook_decisions(events).filter("decision = 'block' and session_id is not null").select("session_id").distinct()
    annoyed = terms.select(F.col("sessionId").alias("session_id")).distinct()
    both = blocked.withColumn("b", F.lit(1)).join(annoyed.withColumn("f", F.lit(1)), "session_id", "full")
    return both.agg(F.count("b").alias("hook_blocked_sessions"), F.count("f").alias("frustrated_sessions"), F.count(F.expr("b + f")).alias("overlap_sessions"))


def hook_daily(events: DataFrame, terms: DataFrame, limit: int | None = 30) -> DataFrame:
    """Blocks and terms by day, days of either side."""
    blocks = views.hook_decisions(events).filter("decision = 'block'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("hook_blocks"), F.count_distinct("session_id").alias("blocked_sessions"))
    days = terms.filter("last_seen is not null").groupBy(F.to_date(F.timestamp_seconds("last_seen")).alias("day")).agg(F.count_distinct("sessionId").alias("frustrated_sessions"), F.sum("count").alias("term_hits"))
    names = ("hook_blocks", "blocked_sessions", "frustrated_sessions", "term_hits")
    out = blocks.join(days, "day", "full").select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    return out.orderBy(F.desc_nulls_last("day")).limit(limit) if limit else out


def freshness(events: DataFrame, index_sessions: DataFrame) -> DataFrame:
    """Newest activity of the index against that of each runtime."""
    index = index_sessions.agg(F.lit("index").alias("source"), F.timestamp_seconds(F.max("mtime")).alias("newest_activity"), F.count("*").alias("items"))
    lake = events.groupBy("runtime").agg(F.max("ts").alias("newest_activity"), F.count_distinct("session_id").alias("items")).select(F.concat(F.lit("lake:"), "runtime").alias("source"), "newest_activity", "items")
    return index.unionByName(lake).orderBy(F.desc_nulls_last("newest_activity"), "source")


def freshness_probe(index_sessions: DataFrame, now_s: int) -> DataFrame:
    """Newest times and size of the index, with the age of the newest activity in rounded minutes, hours or days."""
    found = index_sessions.agg(F.max("mtime").alias("newest_mtime"), F.max(F.coalesce("last_activity", "mtime")).alias("newest_activity"), F.count("*").alias("items"))
    rounded = lambda x: F.floor(x + 0.5)
    minutes = rounded((F.lit(now_s) - F.col("newest_activity")) / 60)
    hours = rounded(minutes / 60)
    unit = lambda x, u: F.concat(x.cast("string"), F.lit(u))
    age = F.when(minutes.isNull(), "n/a").when(minutes < 60, unit(minutes, "m")).when(hours < 24, unit(hours, "h")).otherwise(unit(rounded(hours / 24), "d"))
    return found.withColumn("age", age)


REPORTS = ("frustration", "overlap", "daily", "freshness")


def report(events: DataFrame, terms: DataFrame, index_sessions: DataFrame, name: str = "freshness", limit: int = 20) -> DataFrame:
    """One of the reports, with a bounded number of rows; frustration and daily have bounds of their own, 25 and 30."""
    check_limit(limit, 500)
    if name not in REPORTS:
        raise LakeError(f"the report must be one of {', '.join(REPORTS)}, not {name!r}")
    found = {"frustration": lambda: frustration(events, terms, index_sessions), "overlap": lambda: hook_overlap(events, terms), "daily": lambda: hook_daily(events, terms), "freshness": lambda: freshness(events, index_sessions)}
    return found[name]().limit(limit)


def register_signals(events: DataFrame, terms: DataFrame, index_sessions: DataFrame) -> None:
    """Temporary views for SQL users, beside those of views.register_views: the index's tables and the four reports."""
    index_sessions.createOrReplaceTempView("index_sessions")
    terms.createOrReplaceTempView("index_terms")
    frustration(events, terms, index_sessions).createOrReplaceTempView("frustration")
    hook_overlap(events, terms).createOrReplaceTempView("hook_overlap")
    hook_daily(events, terms).createOrReplaceTempView("hook_daily")
    freshness(events, index_sessions).createOrReplaceTempView("freshness")
