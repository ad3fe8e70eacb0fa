"""Reports on a lake: places, stream progress and a health check, as plain dicts."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from ..sources import discovery
from . import lake, tallies


def paths(path: str) -> dict[str, str]:
    return {name: f"{path}/{name}" for name in ("events", "labels", "parquet", "export", "checkpoints")}


def stream_status(path: str) -> dict[str, dict]:
    """For each runtime with a checkpoint: absent, healthy (with its last batch and consumed bytes) or invalid."""
    out = {}
    base = f"{path}/checkpoints"
    for runtime in sorted(os.listdir(base)) if os.path.isdir(base) else []:
        offsets = f"{base}/{runtime}/offsets"
        batches = sorted((int(x) for x in os.listdir(offsets) if x.isdigit())) if os.path.isdir(offsets) else []
        if not batches:
            out[runtime] = {"state": "absent"}
            continue
        try:
            with open(f"{offsets}/{batches[-1]}", encoding="utf-8") as f:
                consumed = json.loads(f.read().strip().split("\n")[-1])
            out[runtime] = {"state": "healthy", "batch": batches[-1], "files": len(consumed), "bytes": sum(x.get("at", x.get("size", 0)) for x in consumed.values())}
        except (ValueError, AttributeError, TypeError) as e:
            out[runtime] = {"state": "invalid", "why": str(e)}
    return out


def status(spark: SparkSession, path: str) -> dict:
    report = [r.asDict() for r in lake.partition_report(spark, path).orderBy("runtime").collect()] if os.path.isdir(f"{path}/events") else []
    counted = [r.asDict() for r in tallies.tallies(spark, path).orderBy("runtime").collect()]
    return {"paths": paths(path), "partitions": report, "stream": stream_status(path), "tallies": counted}


def doctor(spark: SparkSession, path: str, home: str) -> list[tuple[str, str, str]]:
    """(check, level, detail): ok, warning or error."""
    out = [("lake", "ok" if os.path.isdir(path) else "error", path)]
    for runtime, found in discovery.inventory(home).items():
        out.append((f"source {runtime}", "ok" if found["available"] else "warning", f"{found['files']} files"))
    for runtime, found in stream_status(path).items():
        out.append((f"stream {runtime}", "error" if found["state"] == "invalid" else "ok", found["state"]))
    out.append(("time zone", "ok" if spark.conf.get("spark.sql.session.timeZone") == "UTC" else "error", spark.conf.get("spark.sql.session.timeZone")))
    return out
