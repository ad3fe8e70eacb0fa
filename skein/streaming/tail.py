"""Data sources for files that others write: `tail` for growing text files, `snapshots` for small ones that are replaced.

tail: complete lines with their byte offsets, as a batch or as a stream. Options: `path` (a glob, or several separated by
commas), `split` (bytes of a batch's partitions), and for a stream `max_bytes` a file and `max_lines` over all files in a
micro-batch. The stream's offset has the consumed bytes of every file and what the file was like then: its size, its time,
and digests of the first and the last bytes that were consumed. A file that shrank, changed at the same size, or whose
consumed bytes are others now is refused: what was stored no longer follows from it. An unterminated last line waits.
Long files are several partitions of a batch: a line belongs to the range in which it begins.

snapshots: (file, content), the whole of every file that is new or changed; content is null for one that is gone. Options: `path`,
and `max_files` in a micro-batch. The offset has the size and time of every file, so the latest content wins.

Both take `known`, the offset that a restarted stream goes on from (see offsets), as Spark asks a source for its newest
offset without saying where it stands. The paths must be on a file system that driver and executors share.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", "/logs/*.jsonl").load()     # file, seq (byte offset), line
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import store

SCHEMA = "file string, seq long, line string"
STEP = 1 << 16
SPLIT = 64 << 20  # bytes of a partition of a batch
TASKS = 256  # so many partitions are enough: with more bytes than they have, partitions grow up to SPLIT
STREAMED = 8 << 20  # of a micro-batch's
LARGEST = 16 << 20  # bytes of a file in a micro-batch of a stream with max_bytes, however many these are: a task sorts a file's lines
EDGE = 4096  # bytes at each end of what was consumed that are remembered by their digest
MAX_FILES = 1000


@dataclass
class Span(InputPartition):
    file: str
    begin: int
    end: int


@dataclass
class Spans(InputPartition):
    """Spans of several files, read by one task."""

    spans: list[Span]


def packed(spans: list[Span], step: int) -> list[Spans]:
    """Neighbouring spans together, up to `step` bytes: many small files are few tasks."""
    out, size = [], 0
    for span in spans:
        if not out or size + span.end - span.begin > step:
            out.append(Spans([]))
            size = 0
        out[-1].spans.append(span)
        size += span.end - span.begin + STEP  # opening a file costs as much as some bytes
    return out or [Spans([])]


def last_newline(file: str, begin: int, end: int) -> int:
    """The place after the last newline in [begin, end), or begin."""
    with store.opened(file) as f:
        at = end
        while at > begin:
            start = max(begin, at - STEP)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return begin


def after_lines(file: str, begin: int, end: int, lines: int) -> tuple[int, int]:
    """The place after so many lines from begin on, or after the last one before end; and how many they are."""
    found, place = 0, begin
    with store.opened(file) as f:
        f.seek(begin)
        at = begin
        while at < end and found < lines:
            chunk = f.read(min(STEP, end - at))
            if not chunk:
                break
            here = chunk.count(b"\n")
            if found + here <= lines:
                found += here
                last = chunk.rfind(b"\n")
                place = at + last + 1 if last >= 0 else place
            else:
                cut = -1
                for _ in range(lines - found):
                    cut = chunk.index(b"\n", cut + 1)
                return at + cut + 1, lines
            at += len(chunk)
    return place, found


def lines_of(span: Span) -> Iterator[tuple]:
    """The lines that begin in the span, with their offsets; a carriage return before the newline goes, bad bytes are replaced."""
    with store.opened(span.file) as f:
        for at, raw in store.lines(f, max(0, span.begin - 1)):  # a line that begins before the span is another one's
            if at >= span.end:
                break
            if at >= span.begin:
                yield span.file, at, raw.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


def digest(file: str, begin: int, end: int) -> str:
    with store.opened(file) as f:
        f.seek(begin)
        return hashlib.sha256(f.read(end - begin)).hexdigest()[:32]


def consumed(file: str, at: int, seen: store.Seen) -> dict:
    """The offset of a file of which the first `at` bytes were consumed."""
    return {"at": at, "size": seen.size, "time": seen.time, "head": digest(file, 0, min(at, EDGE)), "tail": digest(file, max(0, at - EDGE), at)}


def verify(file: str, was: dict, seen: store.Seen) -> None:
    """Raises unless the file still begins with what was consumed of it."""
    if seen.size < max(was["at"], was["size"]):
        raise ValueError(f"{file} shrank from {was['size']} to {seen.size} bytes; rebuild the lake from what is there")
    if seen.size == was["size"] and seen.time != was["time"] and was["at"] >= seen.size:
        raise ValueError(f"{file} was rewritten without an append; rebuild the lake from what is there")
    if seen.time != was["time"] or seen.size != was["size"]:
        at = was["at"]
        if (digest(file, 0, min(at, EDGE)), digest(file, max(0, at - EDGE), at)) != (was["head"], was["tail"]):
            raise ValueError(f"{file} was rewritten: the bytes before {at} are others now; rebuild the lake from what is there")


def offsets(spark: SparkSession, checkpoint: str) -> list[dict]:
    """The last logged offset of each source of a query's checkpoint, read through Spark's file systems; none for a new query."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    batches = [int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()]
    if not batches:
        return []
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, str(max(batches))))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [json.loads(x) if x != "-" else {} for x in text.strip().split("\n")[2:]]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Spans]:
        out, ends = [], {f: last_newline(f, 0, store.stat(f).size) for f in store.matching(self.options["path"])}
        split = int(self.options.get("split", SPLIT))
        step = max(split, min(SPLIT, sum(ends.values()) // TASKS))
        for f, end in ends.items():
            out += [Span(f, a, min(a + step, end)) for a in range(0, end, step)]
        return packed(out, step)

    def read(self, partition: Spans) -> Iterator[tuple]:
        for span in partition.spans:
            yield from lines_of(span)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.most, self.lines = min(int(options.get("max_bytes", 0)), LARGEST), int(options.get("max_lines", 0))
        self.known: dict[str, dict] = json.loads(options.get("known", "{}"))
        self.turn = ""  # the file that used up the lines: the next one comes first

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Aligned to newlines; no further than the limits beyond the last planned end of each file."""
        left, files = self.lines, store.matching(self.options["path"])
        for file in [f for f in files if f > self.turn] + [f for f in files if f <= self.turn]:
            seen, was = store.stat(file), self.known.get(file)
            if was:
                verify(file, was, seen)
                if (seen.size, seen.time) == (was["size"], was["time"]) and was["at"] == seen.size:
                    continue
            size, begin = seen.size, was["at"] if was else 0
            end = last_newline(file, begin, min(size, begin + self.most) if self.most else size)
            if end == begin and self.most and size > begin:  # a line longer than the limit
                end = after_lines(file, begin, size, 1)[0]
            if self.lines:
                if not left:
                    continue
                end, count = after_lines(file, begin, end, left)
                left -= count
                self.turn = file if not left else self.turn
            if end > begin or not was:
                self.known[file] = consumed(file, end, seen)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, {"at": 0})["at"]
            if self.known.get(file, {"at": 0})["at"] <= stop["at"]:
                self.known[file] = stop
            if stop["at"] < begin or store.stat(file).size < stop["at"]:
                raise ValueError(f"{file} was rewritten: {begin} bytes consumed, {store.stat(file).size} there")
            if stop["at"] > begin:
                out.append(Span(file, begin, stop["at"]))
        return packed(out, STREAMED)

    def read(self, partition: Spans) -> Iterator[tuple]:
        for span in partition.spans:
            yield from lines_of(span)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


class _Snapshots(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.most = options, int(options.get("max_files", MAX_FILES))
        self.known: dict[str, dict] = json.loads(options.get("known", "{}"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        there = {}
        for f in store.matching(self.options["path"]):
            seen = store.stat(f)
            there[f] = {"size": seen.size, "time": seen.time}
        there |= {f: {"gone": True} for f in self.known if f not in there}
        changed = [f for f in sorted(there) if there[f] != self.known.get(f)]
        self.known |= {f: there[f] for f in changed[: self.most]}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.known = end | {f: x for f, x in self.known.items() if f not in end}
        files = [f for f, x in sorted(end.items()) if start.get(f) != x and not (f not in start and x.get("gone"))]
        return [Span(f, 0, 0) for f in files] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.file:
            try:
                with store.opened(partition.file) as f:
                    yield partition.file, f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                yield partition.file, None


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "file string, content string"

    def streamReader(self, schema) -> _Snapshots:
        return _Snapshots(dict(self.options))
