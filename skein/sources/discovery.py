"""Where the vendors keep their files: a glob for each runtime under a home folder, and what is there."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import store
from . import records as R

# The vendors' layouts, relative to the home folder.
LAYOUT = {
    "claude": (".claude/projects/*/*.jsonl",),
    "codex": (".codex/sessions/*/*/*/rollout-*.jsonl",),
    "omp": (".omp/agent/sessions/*/*.jsonl",),
    "droid": (".factory/sessions/*.jsonl", ".factory/sessions/*/*.jsonl"),
    "kimi": (".kimi-code/sessions/wd_*/session_*/agents/main/wire.jsonl",),
    "hooks": (".claude/hooks/telemetry.prev.jsonl", ".claude/hooks/telemetry.jsonl"),
}
SIDECAR = (".jsonl", ".settings.json")  # a transcript's name ends in the first, that of its settings in the second
INDEX = ".kimi-code/session_index.jsonl"


def source(runtime: str, home: str) -> str:
    """The tail source's path option for a runtime."""
    return ",".join(os.path.join(home, p) for p in LAYOUT[runtime])


def inventory(home: str) -> dict[str, dict]:
    """For each runtime: whether it has files, how many, and their bytes."""
    out = {}
    for runtime, patterns in LAYOUT.items():
        files = [f for p in patterns for f in glob.glob(os.path.join(home, p)) if os.path.isfile(f)]
        out[runtime] = {"available": bool(files), "files": len(files), "bytes": sum(map(os.path.getsize, files))}
    return out


def sidecar_path(source: str) -> str:
    """The paths of the settings that belong to a source's transcripts, as a path option."""
    return ",".join(p.removesuffix(SIDECAR[0]) + SIDECAR[1] for p in source.split(",") if p.endswith(SIDECAR[0]))


def sidecars(spark: SparkSession, source: str) -> DataFrame:
    """(file, content) of the settings beside the transcripts of a source (globs, or files, separated by commas)."""
    names = [p for p in sidecar_path(source).split(",") if p and store.matching(p)]
    if not names:
        return spark.createDataFrame([], "file string, content string")
    return spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")).distinct()


def kimi_sessions(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The projects of a session index that may not be there."""
    return kimi_projects(spark, path) if path and store.matching(path) else None


def kimi_projects(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, project) of a session index (a text file of JSON lines); the last line of a session wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    v = F.col("v")
    df = R.objects(lines).select("seq", R.text(v, "$.sessionId").alias("session_id"), R.text(v, "$.workDir").alias("project")).filter("session_id is not null and project is not null")
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return df.withColumn("n", F.row_number().over(last)).filter("n = 1").select("session_id", "project")
