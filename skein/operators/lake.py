"""The lake on disk: reading, batch ingest, rebuild and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as M
from ..schema import RUNTIMES, STORED_EVENT, STORED_LABEL, LakeError, check_runtime
from ..sources.adapters import ADAPTERS, droid_settings
from ..sources.discovery import kimi_sessions, sidecars
from ..streaming import store, tail
from . import files, tallies

CORRUPT = "_corrupt"


def canonical(raw: DataFrame, runtime: str, machine: str, aliased: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """Raw events as canonical ones: text masked, then clipped (so the cut shortens no secret below its pattern), string
    values of extra masked, an empty type read as meta, the source's stem hash added, and the date partition; keep: further
    columns of the raw events."""
    check_runtime(runtime)
    extra = M.mask_extra(F.col("extra"))
    if aliased:
        alias = F.concat(F.lit('"source_stem_hash":"'), F.sha2(M.file_stem(F.col("file")), 256), F.lit('"}'))
        extra = F.concat(F.when(extra == "{}", "{").otherwise(F.concat(F.substring(extra, F.lit(1), F.length(extra) - 1), F.lit(","))), alias)
    return raw.select(
        "ts",
        F.lit(runtime).alias("runtime"),
        F.lit(machine).alias("machine"),
        "session_id",
        "project",
        F.when(F.coalesce("event_type", F.lit("")) == "", "meta").otherwise(F.col("event_type")).alias("event_type"),
        M.clip(M.mask(F.coalesce("text", F.lit("")))).alias("text"),
        "tool_name",
        "model",
        "tokens_in",
        "tokens_out",
        extra.alias("extra"),
        M.date_partition(F.coalesce("ts", F.lit(""))).alias("date"),
        *[c.alias(name) for name, c in (keep or {}).items()],
    )


def append(events: DataFrame, path: str) -> None:
    """To runtime= and date= partitions of NDJSON, beside the batches of streams: all of a lake's files are as deep, or Spark could
    not tell its partitions."""
    events.withColumn("batch", F.lit("appended")).write.mode("append").partitionBy("runtime", "date", "batch").json(f"{path}/events")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Pinned columns; a torn line goes, a row whose time cannot be read stays without one."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("filename", F.lit(None).cast("string"))
    df = spark.read.schema(schema.add(CORRUPT, "string") if CORRUPT not in schema.names else schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    ts: Column = F.try_to_timestamp("ts")
    names = [c for c in schema.names if c != CORRUPT]
    whole = F.col(CORRUPT).isNull() & (F.length(F.coalesce("session_id", F.lit(""))) >= 0)  # Spark wants a second column beside the corrupt one
    return df.filter(whole).select(*[ts.alias("ts") if c == "ts" else F.col(c) for c in names], *(["date"] if "date" in df.columns else []), F.col("_metadata.file_path").alias("filename"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    import copy

    return _read(spark, f"{path}/events", copy.deepcopy(STORED_EVENT))


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """What the stream has stored, as it is on disk: times as texts, with the partitions runtime, date and batch."""
    import copy

    schema = copy.deepcopy(STORED_EVENT)
    for name in ("runtime", "date", "batch"):
        schema = schema if name in schema.names else schema.add(name, "string")
    return spark.read.schema(schema).json(f"{path}/events")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    import copy

    return _read(spark, f"{path}/labels", copy.deepcopy(STORED_LABEL))


def parsed(spark: SparkSession, source: str, runtime: str, kimi_index: str | None = None, split: int = tail.SPLIT) -> DataFrame:
    """The raw events of a runtime's files (a glob); kimi_index: its session index, which has the projects. Files are read in
    partitions of `split` bytes; if some are longer, registers are carried in ranges of as many."""
    lines = spark.read.format("tail").option("path", source).option("split", str(split)).load()
    longest = max((store.stat(f).size for f in store.matching(source)), default=0)
    sessions = kimi_sessions(spark, kimi_index) if runtime == "kimi" else None
    return ADAPTERS[runtime](lines, sessions, split if longest > split else 0)


def ingest(spark: SparkSession, sources: dict[str, str], path: str, machine: str, kimi_index: str | None = None, split: int = tail.SPLIT) -> dict[str, dict[str, int]]:
    """All complete lines of the sources (a glob by runtime) into the lake, and the settings beside droid's transcripts. Returns
    each runtime's tally: events, masked places, sessions."""
    spark.dataSource.register(tail.TailSource)
    out = {}
    for runtime in RUNTIMES:
        if runtime in sources:
            raw = parsed(spark, sources[runtime], runtime, kimi_index, split)
            if runtime == "droid":
                raw = raw.unionByName(droid_settings(sidecars(spark, sources[runtime])))
            tally = tallies.Tally(runtime)
            append(tally.watch(canonical(raw, runtime, machine)), path)
            out[runtime] = tally.counts()
    return out


def rebuild(spark: SparkSession, sources: dict[str, str], target: str, machine: str, kimi_index: str | None = None, split: int = tail.SPLIT) -> dict[str, dict[str, int]]:
    """A replay into an empty root, by the transforms of the stream; returns the tallies."""
    if unknown := set(sources) - set(RUNTIMES):
        raise LakeError(f"unknown runtimes {sorted(unknown)}")
    with files.locked(spark, target, "rebuild"):
        if files.exists(spark, f"{target}/events"):
            raise LakeError(f"{target} is not empty")
        return ingest(spark, sources, target, machine, kimi_index, split)


def clean(spark: SparkSession, path: str, what: str = "all", apply: bool = False) -> list[str]:
    """The derived folders that exist (parquet, export); removed only with apply."""
    names = {"parquet": ["parquet", "trigrams"], "export": ["export", "export.log"], "all": ["parquet", "trigrams", "export", "export.log"]}.get(what)
    if names is None:
        raise LakeError(f"clean takes parquet, export or all, not {what!r}")
    found = [f"{path}/{n}" for n in names if files.exists(spark, f"{path}/{n}")]
    for folder in found if apply else []:
        files.delete(spark, folder)
    return found


def partition_report(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by runtime."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/events").select("path", "length")
    return found.filter(F.col("path").rlike(r"\.(nd)?json$")).groupBy(F.regexp_extract("path", r"/runtime=([^/]+)/", 1).alias("runtime")).agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"))
