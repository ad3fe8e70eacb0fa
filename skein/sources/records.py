"""Helpers for vendor records: JSON as VARIANT, typed fields, registers that carry forward, events as arrays.

Input of every adapter: lines (file, seq, line), seq ascending within the file. Output: raw events (file, seq, pos, ts,
session_id, project, event_type, text, tool_name, model, tokens_in, tokens_out, extra), ts as the source's text. What a
line says is read from that line alone (said); what it takes from earlier lines, its file's registers, is carried on
afterwards, in a batch by windows over the file (carry) and in a stream by state. All of the batch is Catalyst.

The windows of a long file can be cut into ranges of bytes, each the work of a task: registers are carried inside every range
at once, then the last ones of the ranges from range to range, a row each, and what came in is joined to each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "struct<event_type:string,text:string,tool_name:string,model:string,tokens_in:bigint,tokens_out:bigint,extra:string>"
HELD = 64  # events that wait for a release at most
CARRIED = "\x01"  # in an event: the register's value


def objects(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as the variant `v`."""
    v = F.try_parse_json(F.col("line"))
    return lines.withColumn("v", v).filter(F.schema_of_variant("v").startswith("OBJECT"))


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """Spark's name of the type at a path; null where there is nothing."""
    return F.schema_of_variant(part(v, path))


def text(v: Column, path: str) -> Column:
    """A string field, or null."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    """A string field that is not empty, or null."""
    x = text(v, path)
    return F.when(x != "", x)


def number(v: Column, path: str) -> Column:
    """A finite number as a whole one, or null."""
    x = F.when(kind(v, path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), F.try_variant_get(v, path, "double"))
    return F.when(x.between(-9.2e18, 9.2e18), x.cast("long"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce((kind(v, path) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def present(v: Column, path: str) -> Column:
    """Any value but null, as a variant."""
    return F.when(kind(v, path) != "VOID", part(v, path))


def items(v: Column, path: str) -> Column:
    """The elements of an array, or null."""
    return F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def iso(millis: Column) -> Column:
    """Epoch milliseconds as UTC text."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch(v: Column, path: str) -> Column:
    x = number(v, path)
    return F.when(F.abs(x) < 8_000_000_000_000_000, iso(x))


def extra(*fields: tuple[str, Column]) -> Column:
    """A JSON object of the fields that are not null, in order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields])) if fields else F.lit("{}")


def joined(a: Column, b: Column) -> Column:
    """The fields of two JSON objects, one after the other."""
    return F.when(a == "{}", b).when(b == "{}", a).otherwise(F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substring(b, F.lit(2), F.length(b))))


def event(event_type, body, tool_name=None, model=None, tokens_in=None, tokens_out=None, more=None) -> Column:
    none = F.lit(None)
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [as_column(event_type), F.coalesce(as_column(body), F.lit("")), tool_name if tool_name is not None else none, model if model is not None else none, tokens_in if tokens_in is not None else none, tokens_out if tokens_out is not None else none, more if more is not None else F.lit("{}")]
    return F.struct(*[v.alias(n) for v, n in zip(values, ("event_type", "text", "tool_name", "model", "tokens_in", "tokens_out", "extra"), strict=True)]).cast(EVENT)


def one(e: Column) -> Column:
    return F.array(e)


def no_events() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def kept(events: Column) -> Column:
    return F.filter(events, lambda e: e.isNotNull())


def said(df: DataFrame, events: Column, ts: Column, session_id: Column | None = None, project: Column | None = None, model: Column | None = None, call_id: Column | None = None, call_name: Column | None = None, release: Column | None = None, base: tuple[Column | None, Column | None] = (None, None)) -> DataFrame:
    """A row for each line: its events, the registers that it sets (null: as before), whether it releases held events, the call
    that it names or asks for, and the session and project of the path. In events, CARRIED stands for the register."""
    cast = lambda x, kind="string": (F.lit(None) if x is None else x).cast(kind)
    sets = F.struct(cast(ts).alias("ts"), cast(session_id).alias("session_id"), cast(project).alias("project"), cast(model).alias("model"))
    call = F.struct(cast(call_id).alias("id"), cast(call_name).alias("name"))
    return df.select("file", "seq", sets.alias("sets"), call.alias("call"), F.coalesce(cast(release, "boolean"), F.lit(False)).alias("release"), F.struct(cast(base[0]).alias("session_id"), cast(base[1]).alias("project")).alias("base"), events.alias("events"))


def exploded(df: DataFrame) -> DataFrame:
    """A row for each event of `events`, with the registers in place of CARRIED."""
    rows = df.select("file", "seq", "ts", "session_id", "project", F.col("model").alias("carried_model"), "called", F.posexplode("events").alias("pos", "e"))
    put = lambda field, register: F.when(F.col(f"e.{field}") == CARRIED, F.col(register)).otherwise(F.col(f"e.{field}")).alias(field)
    return rows.select("file", "seq", "pos", "ts", "session_id", "project", "e.event_type", "e.text", put("tool_name", "called"), put("model", "carried_model"), "e.tokens_in", "e.tokens_out", "e.extra")


def alone(lines: DataFrame) -> DataFrame:
    """The raw events of lines that take nothing from others."""
    none = F.lit(None).cast("string")
    return exploded(lines.filter("sets.ts is not null").select("file", "seq", "sets.ts", "base.session_id", "base.project", none.alias("model"), none.alias("called"), "events"))


def carry(lines: DataFrame, timed: bool, held: bool, calls: bool, split: int = 0) -> DataFrame:
    """The raw events of what lines say (see said), by windows over each file, or over ranges of `split` bytes of it.

    timed: lines before the first time set nothing. held: events are held until the first line that releases them or more
    than HELD wait; then they take the session of that line, and its project and time where they have none; at the end of a
    file without a release, all are let go. calls: a result takes the last name that was set for its call. Events without a
    time are dropped.
    """
    names = ("session_id", "project", "model")
    if split:
        here = ["file", "range"]
        lines = lines.withColumn("range", F.floor(F.col("seq") / split))
    else:
        here = ["file"]
    inside = Window.partitionBy(*here).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda x: F.last(x, ignorenulls=True).over(inside)
    df = lines.withColumn("ts", last(F.col("sets.ts")))
    # registers as if the time was known before this range; and, where that matters, as if it was not
    df = df.withColumns({x: last(F.col(f"sets.{x}")) for x in names} | ({f"late_{x}": last(F.when(F.col("ts").isNotNull(), F.col(f"sets.{x}"))) for x in names} if timed else {}))
    waiting = F.sum(F.coalesce(F.size("events"), F.lit(0))).over(inside)
    df = df.withColumn("waiting", waiting) if held else df
    if split:
        ends = ["ts", *names, *([f"late_{x}" for x in names] if timed else []), *(["waiting"] if held else [])]
        ranges = df.groupBy(*here).agg(F.max_by(F.struct(*ends), "seq").alias("end")).select(*here, "end.*")
        before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        came = lambda x: F.last(x, ignorenulls=True).over(before)
        ranges = ranges.withColumn("in_ts", came(F.col("ts")))
        left = {x: F.when(F.col("in_ts").isNotNull(), F.col(x)).otherwise(F.col(f"late_{x}")) if timed else F.col(x) for x in names}
        ranges = ranges.withColumns({f"in_{x}": came(left[x]) for x in names} | ({"in_waiting": F.coalesce(F.sum("waiting").over(before), F.lit(0))} if held else {}))
        df = df.join(ranges.select(*here, "in_ts", *[f"in_{x}" for x in names], *(["in_waiting"] if held else [])), here)
        if held:
            df = df.withColumn("waiting", F.col("waiting") + F.col("in_waiting"))
        known = F.col("in_ts").isNotNull()
        df = df.withColumns({x: F.coalesce(F.when(known, F.col(x)).otherwise(F.col(f"late_{x}")) if timed else F.col(x), F.col(f"in_{x}")) for x in names})
        df = df.withColumn("ts", F.coalesce("ts", "in_ts"))
    elif timed:
        df = df.withColumns({x: F.col(f"late_{x}") for x in names})
    df = df.withColumns({"session_id": F.coalesce("session_id", "base.session_id"), "project": F.coalesce("project", "base.project")})
    own = F.coalesce("call.id", F.concat(F.lit("\0"), F.col("seq").cast("string")))  # a group of its own for a line without a call
    asked = Window.partitionBy("file", own).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("called", F.last(F.when(F.col("ts").isNotNull(), F.col("call.name")), ignorenulls=True).over(asked) if calls else F.lit(None).cast("string"))
    if held:
        opens = F.col("release") | (F.col("waiting") > HELD)
        at = F.struct("seq", "session_id", "project", "ts")
        opened = df.groupBy("file").agg(F.min_by(F.when(opens, at), F.when(opens, F.col("seq"))).alias("open"), F.max_by(at, "seq").alias("end")).select("file", F.coalesce("open", "end").alias("at"))
        df = df.join(opened, "file")
        early = F.col("seq") <= F.col("at.seq")
        df = df.withColumns({"session_id": F.when(early, F.col("at.session_id")).otherwise(F.col("session_id")), "project": F.when(early, F.coalesce("project", "at.project")).otherwise(F.col("project")), "ts": F.when(early, F.coalesce("ts", "at.ts")).otherwise(F.col("ts"))})
    return exploded(df.filter("ts is not null"))
