"""The per-session export: conversation events with stable ids, once each, in order.

A live export is a log of batches beside the sorted shards: a batch writes its own rows and nothing else, readers make ids
distinct over both, and folding rewrites the shards that the log touches once for many batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as M
from . import files

SCHEMA_VERSION = 1
ROW = "lake_schema int, uuid string, ts string, runtime string, session_id string, project string, event_type string, text string, tool_name string, model string, tokens_in long, tokens_out long, extra string, session_hash string, shard string"
CONVERSATION = ("user", "assistant", "thinking", "tool_call", "tool_result", "meta")


def accepted(events: DataFrame) -> DataFrame:
    """Conversation events with a session and a time, of any runtime but hooks."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return events.filter(F.col("event_type").isin(*CONVERSATION) & filled("session_id") & filled(F.col("ts").cast("string")) & (F.col("runtime") != "hooks"))


def export_rows(events: DataFrame, ts_text=None) -> DataFrame:
    """13 fields and the session's hash; a repeated id keeps one row."""
    ts = F.col("ts").cast("string") if ts_text is None else ts_text
    extra = F.when(F.length(F.coalesce("extra", F.lit(""))) > 0, F.col("extra")).otherwise("{}")
    key = M.fingerprint(F.col("runtime"), F.col("session_id"), ts, F.col("event_type"), F.col("text"), F.col("tool_name"), F.col("model"), extra)
    return (
        accepted(events)
        .select(F.lit(SCHEMA_VERSION).alias("lake_schema"), key.alias("uuid"), ts.alias("ts"), "runtime", "session_id", "project", "event_type", "text", "tool_name", "model", "tokens_in", "tokens_out", extra.alias("extra"), M.session_hash(F.col("runtime"), F.col("session_id")).alias("session_hash"))
        .dropDuplicates(["uuid"])
    )


def write_export(events: DataFrame, path: str) -> None:
    """A full rebuild: one shuffle by session, each session's rows in order of time text and id, in a folder of its hash's prefix."""
    sharded(events).repartition("shard", "session_hash").sortWithinPartitions("shard", "session_hash", "ts", "uuid").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").json(path)
    files.delete(events.sparkSession, log_of(path))


def sharded(events: DataFrame) -> DataFrame:
    return export_rows(events).withColumn("shard", F.substring("session_hash", 1, 2))


def log_of(path: str) -> str:
    return f"{path.rstrip('/')}.log"


def append_export(batch: DataFrame, path: str, name: str) -> None:
    """A batch into the log of a live export, replaced if it is repeated; its cost is that of its own rows."""
    sharded(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{log_of(path)}/batch={name}")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an export, those of its log included, each id once."""
    out = spark.createDataFrame([], ROW)
    if files.exists(spark, path):
        out = out.unionByName(spark.read.schema(ROW).json(path))
    if files.exists(spark, log_of(path)):
        out = out.unionByName(spark.read.schema(ROW).parquet(log_of(path)).select(*out.columns))
    return out.dropDuplicates(["uuid"])


def fold_export(spark: SparkSession, path: str) -> int:
    """The log's batches into the sorted shards; returns how many. A repeat after a failure folds the same rows again."""
    fs, place = files.place(spark, log_of(path))
    batches = [s.getPath().toString() for s in fs.listStatus(place)] if fs.exists(place) else []
    if batches:
        _merge(spark.read.schema(ROW).parquet(*batches), path)
        for batch in batches:
            files.delete(spark, batch)
    return len(batches)


def merge_export(batch: DataFrame, path: str) -> None:
    """A batch into the shards of an export at once."""
    _merge(sharded(batch), path)


def _merge(new: DataFrame, path: str) -> None:
    """Only the shards that the new rows touch are read, united, made distinct and replaced."""
    spark = new.sparkSession
    rows = new.select(*[f.strip().split(" ")[0] for f in ROW.split(",")])
    if files.exists(spark, path):
        old = spark.read.schema(ROW).json(path)
        rows = old.join(rows.select("shard").distinct(), "shard", "left_semi").select(*rows.columns).unionByName(rows)
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"  # the shards being replaced are also read: stage first
    rows.dropDuplicates(["uuid"]).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.schema(ROW).parquet(stage)
    ordered = staged.repartition("shard", "session_hash").sortWithinPartitions("shard", "session_hash", "ts", "uuid")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(path)
    files.delete(spark, stage)
