"""Labels: an append-only log, validated when written; the latest assignment wins when read."""

from __future__ import annotations

import datetime as dt
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import views
from ..schema import LakeError, check_limit, check_runtime

SOURCE = re.compile(r"(manual|human|model|brama)(:[A-Za-z0-9._/-]+)?")


def record(session_id: str, aspect: str, value: str, runtime: str | None = None, note: str | None = None, source: str = "manual", now: dt.datetime | None = None) -> dict:
    """A validated label: aspect trimmed and in lower case, value trimmed."""
    aspect, value = (aspect or "").strip().lower(), (value or "").strip()
    if not session_id or not aspect or not value:
        raise LakeError("a label needs a session, an aspect and a value")
    if not SOURCE.fullmatch(source or ""):
        raise LakeError(f"bad label source {source!r}")
    now = now or dt.datetime.now(dt.timezone.utc)
    return {"ts": now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z", "session_id": session_id, "runtime": check_runtime(runtime), "aspect": aspect, "value": value, "note": note, "source": source}


def session_runtime(events: DataFrame, session_id: str, runtime: str | None = None) -> str:
    """The one runtime that has the session."""
    found = [r[0] for r in events.filter(F.col("session_id") == session_id).select("runtime").distinct().limit(8).collect()]
    if runtime is not None:
        found = [x for x in found if x == check_runtime(runtime)]
    if not found:
        raise LakeError(f"no session {session_id!r}")
    if len(found) > 1:
        raise LakeError(f"session {session_id!r} is in {', '.join(sorted(found))}: name the runtime")
    return found[0]


def append(path: str, label: dict) -> None:
    """One line to the log of its month, synced."""
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"labels-{label['ts'][:7]}.ndjson"), "a", encoding="utf-8") as f:
        f.write(json.dumps(label, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def latest(labels: DataFrame, session: str | None = None, aspect: str | None = None, value: str | None = None, runtime: str | None = None, limit: int = 20) -> DataFrame:
    """Latest assignments; session, aspect and runtime filter before the ranking (so a runtime can change the winner), the value after."""
    check_limit(limit, 500)
    check_runtime(runtime)
    for column, x in (("session_id", session), ("aspect", aspect), ("runtime", runtime)):
        if x is not None:
            labels = labels.filter(F.col(column) == x)
    out = views.latest_labels(labels)
    if value is not None:
        out = out.filter(F.col("value") == value)
    return out.orderBy(F.desc_nulls_last("ts"), "session_id", "aspect").limit(limit)


def aspects(labels: DataFrame) -> DataFrame:
    return views.label_aspects(labels).orderBy(F.desc("labels"), "aspect")
