"""The canonical event and label schemas, and their validation."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
RUNTIMES = ("claude", "codex", "omp", "droid", "kimi", "hooks")
EVENT_TYPES = ("user", "assistant", "thinking", "tool_call", "tool_result", "meta", "hook_decision")

EVENT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.StringType()) for c in ("runtime", "machine", "session_id", "project", "event_type", "text", "tool_name", "model")],
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("extra", T.StringType()),
    ]
)
#: As stored: ts is the source's text.
STORED_EVENT = T.StructType([T.StructField("ts", T.StringType()), *EVENT.fields[1:]])
LABEL = T.StructType([T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in ("session_id", "runtime", "aspect", "value", "note", "source")]])
STORED_LABEL = T.StructType([T.StructField("ts", T.StringType()), *LABEL.fields[1:]])


class LakeError(Exception):
    """A request or a file that the lake refuses."""


def check_runtime(runtime: str | None) -> str | None:
    if runtime is not None and runtime not in RUNTIMES:
        raise LakeError(f"unknown runtime {runtime!r}; one of {', '.join(RUNTIMES)}")
    return runtime


def check_limit(value: int, most: int, name: str = "limit") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise LakeError(f"{name} must be a whole number from 1 to {most}, not {value!r}")
    return value
