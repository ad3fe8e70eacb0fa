"""Live ingest: tail the sources, parse, mask, append, in micro-batches that can be repeated.

A micro-batch reads the bytes that were appended and nothing else: registers, held events and the names of calls are the
stream's state (see state), kept and rolled back by Spark with its offsets. So the stream equals a rebuild, but for events
that a file never releases: a rebuild lets them go, a stream waits. Each batch writes its own `batch=` partitions, replaced
when it is repeated. Droid's settings are a stream of snapshots beside that of its transcripts: each file has partitions of
its own, and a changed or removed file's earlier row is taken back.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import masking as M
from ..operators import export as X
from ..operators import files, tallies
from ..operators.lake import canonical, stored_events
from ..sources.adapters import ADAPTERS, droid_settings, with_projects
from ..sources.discovery import kimi_sessions, sidecar_path
from . import state
from .tail import SnapshotSource, TailSource, offsets


FOLD = 64  # batches of a live export's log that are folded into its shards at once


class Following:
    """The queries that follow a runtime, as one."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self, timeout: float | None = None) -> bool:
        until = None if timeout is None else time.monotonic() + timeout
        done = True
        for query in self.queries:
            if until is None:
                query.awaitTermination()
            else:
                done &= bool(query.awaitTermination(max(1, int(until - time.monotonic()))))
        return done

    def processAllAvailable(self) -> None:
        for query in self.queries:
            query.processAllAvailable()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _write(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runtime", "date", "batch").json(f"{path}/events")


def _started(reader, name: str, convert, batch, spark: SparkSession, path: str, limited: bool, available_now: bool) -> StreamingQuery:
    checkpoint = f"{path}/checkpoints/{name}"
    known = offsets(spark, checkpoint)
    lines = reader.option("known", json.dumps(known[0] if known else {})).load()
    writer = convert(lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now and not limited:
        return writer.trigger(availableNow=True).start()
    query = writer.trigger(processingTime="0 seconds" if available_now else "1 second").start()
    if available_now:  # a limited source has more than one batch available
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def start(spark: SparkSession, runtime: str, source: str, path: str, machine: str, max_bytes: int = 0, max_lines: int = 0, export: bool = False, available_now: bool = False, kimi_index: str | None = None) -> Following:
    """Follows one runtime's files (a glob); its checkpoints are under the lake. max_bytes a file and max_lines over all files limit
    a micro-batch. With available_now, it ends when all that is there has been read."""
    spark.dataSource.register(TailSource)
    spark.dataSource.register(SnapshotSource)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    adapter = ADAPTERS[runtime]

    def batch(raw: DataFrame, number: int) -> None:
        session = raw.sparkSession
        sessions = kimi_sessions(session, kimi_index) if runtime == "kimi" else None
        events = canonical(with_projects(raw, sessions), runtime, machine, keep={"batch": F.lit(f"{number:09d}")})
        tally = tallies.Tally(runtime)
        _write(tally.watch(events), path)
        tally.save(session, path, f"{number:09d}")
        if export:
            stored = stored_events(session, path).filter((F.col("runtime") == runtime) & (F.col("batch") == f"{number:09d}"))
            X.append_export(stored, f"{path}/export", f"{runtime}-{number:09d}")
            if number % FOLD == FOLD - 1:
                X.fold_export(session, f"{path}/export")

    def settings(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        name = F.concat(F.lit("settings-"), F.md5("file"))
        files = files.persist()
        try:
            changed = [r.name for r in files.select(name.alias("name")).distinct().collect()]  # max_files at most
            if not changed:
                return
            raw = droid_settings(files.filter("content is not null"))
            _write(canonical(raw, "droid", machine, keep={"batch": name}), path)
            dates = raw.select(M.date_partition(F.col("ts")).alias("date"), name.alias("name")).distinct().collect()
        finally:
            files.unpersist()
        kept = {(f"date={r.date}", f"batch={r.name}") for r in dates}
        pattern = session._jvm.org.apache.hadoop.fs.Path(f"{path}/events/runtime=droid/date=*/batch={{{','.join(changed)}}}")
        fs = pattern.getFileSystem(session._jsc.hadoopConfiguration())
        for found in fs.globStatus(pattern) or []:
            place = found.getPath()
            if (place.getParent().getName(), place.getName()) not in kept:
                fs.delete(place, True)

    reader = spark.readStream.format("tail").option("path", source)
    for key, value in (("max_bytes", max_bytes), ("max_lines", max_lines)):
        reader = reader.option(key, str(value)) if value else reader
    queries = [_started(reader, runtime, lambda lines: state.carried(lines, adapter), batch, spark, path, bool(max_bytes or max_lines), available_now)]
    if runtime == "droid":
        files = spark.readStream.format("snapshots").option("path", sidecar_path(source))
        queries.append(_started(files, "droid-settings", lambda rows: rows, settings, spark, path, True, available_now))
    return Following(queries)


def publish_segments(spark: SparkSession, segments: str, path: str, machine: str) -> int:
    """The valid hook segments of a folder that the commits table lacks: their events first, then their commits, so a
    repeat after a failure in between replaces the same partitions. Returns how many were published."""
    from ..sources import segments as G

    commits = f"{path}/segment_commits"
    schema = "segment_id string, source_sha256 string, event_count long"
    known = spark.read.schema(schema).parquet(commits) if files.exists(spark, commits) else spark.createDataFrame([], schema)
    new = G.unpublished(G.validated(G.read_segments(spark, segments)), known).dropDuplicates(["segment_id"])
    done = new.select("segment_id", "source_sha256", "event_count")
    count = done.count()
    if count:
        segment = F.concat(F.lit("segment-"), F.get_json_object("extra", "$.segment_id"))
        _write(canonical(G.segment_events(new), "hooks", machine, aliased=False, keep={"batch": segment}), path)
        done.write.mode("append").parquet(commits)
    return count
