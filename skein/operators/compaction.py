"""The Parquet mirror of a lake, kept up to date by what changed.

A manifest beside the mirror has a fingerprint of every partition's source files (their paths, sizes and times, summed, so their
order does not matter). A compaction lists the sources as a Spark job, rewrites the partitions whose fingerprint is new, takes
away those without sources, and leaves all others untouched. A partition is packed into as many files as its bytes need, dealt
by a hash of the session, so a busy day is many tasks' work and a quiet one a single file.

The trigram index has a row for each trigram of a mirror file's texts, lower-cased; a literal search reads the files that have all
trigrams of the literal and checks the texts there, so it returns what a scan does.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT
from . import files, lake

TARGET = 128 << 20  # bytes of source for each file of the mirror
SHRINKS = 4  # times that NDJSON is larger than Parquet, for the number of files
BUCKETS = 64  # of the index's trigrams


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(runtime, date, files, bytes, print) of each partition of the lake."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/events").select("path", "length", "modificationTime").filter(F.col("path").rlike(r"\.(nd)?json$"))
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    print_ = F.sum(F.xxhash64("path", "length", F.unix_millis("modificationTime")).cast("decimal(38,0)")).cast("string")
    return found.groupBy(part("runtime"), part("date")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), print_.alias("print"))


def compact(spark: SparkSession, path: str, target: int = TARGET, index: bool = False) -> dict[str, int]:
    """Brings the mirror up to date; returns how many partitions were written, removed and left. index: the trigram index, too."""
    with files.locked(spark, path, "compact"):
        mirror, manifest = f"{path}/parquet", f"{path}/parquet/_manifest.json"
        known = {(r["runtime"], r["date"]): r for r in files.read_json(spark, manifest)} if files.exists(spark, manifest) else {}
        if not known and files.exists(spark, mirror):  # of unknown origin
            files.delete(spark, mirror)
        now = {(r.runtime, r.date): r.asDict() for r in sources(spark, path).collect()}  # a row for each runtime and day
        new = {k: r for k, r in now.items() if known.get(k, {}).get("print") != r["print"]}
        gone = [k for k in known if k not in now]
        if new:
            _write(spark, path, mirror, list(new.values()), target)
        for runtime, date in gone:
            for folder in (mirror, f"{path}/trigrams"):
                files.delete(spark, f"{folder}/runtime={runtime}/date={date}")
        if new or gone:
            files.write_json(spark, manifest, list(now.values()))
        if index:
            indexed = f"{path}/trigrams/_manifest.json"
            had = {(r["runtime"], r["date"]): r["print"] for r in files.read_json(spark, indexed)} if files.exists(spark, indexed) else {}
            stale = [r for k, r in now.items() if had.get(k) != r["print"]]
            if stale:
                _index(spark, path, stale)
            if stale or gone:
                files.write_json(spark, indexed, list(now.values()))
        return {"written": len(new), "removed": len(gone), "left": len(now) - len(new)}


def _of(parts: list[dict]):
    """A filter on partitions, which prunes the files to be read."""
    days: dict[str, list[str]] = {}
    for r in parts:
        days.setdefault(r["runtime"], []).append(r["date"])
    return reduce(lambda a, b: a | b, [(F.col("runtime") == runtime) & F.col("date").isin(*dates) for runtime, dates in days.items()])


def _write(spark: SparkSession, path: str, mirror: str, parts: list[dict], target: int) -> None:
    """Each piece of a partition is a task of its own: hashes of their names would put several together in one."""
    events = lake.read_events(spark, path).drop("filename").withColumn("date", F.col("date").cast("string")).filter(_of(parts))
    pieces = [max(1, -(-r["bytes"] // (target * SHRINKS))) for r in parts]
    firsts = [0, *accumulate(pieces)]
    sizes = spark.createDataFrame([(r["runtime"], r["date"], n, first) for r, n, first in zip(parts, pieces, firsts)], "runtime string, date string, pieces long, first long")
    dealt = events.join(F.broadcast(sizes), ["runtime", "date"]).withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("session_id", F.col("ts").cast("date")), F.col("pieces"))).cast("int"))
    dealt.repartitionById(firsts[-1], "piece").select(*EVENT.names, "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runtime", "date").parquet(mirror)


def _index(spark: SparkSession, path: str, parts: list[dict]) -> None:
    mirror = spark.read.parquet(f"{path}/parquet").withColumn("date", F.col("date").cast("string")).filter(_of(parts))
    rows = mirror.select("runtime", "date", F.regexp_extract(F.col("_metadata.file_path"), r"/parquet/(.*)$", 1).alias("file"), F.lower("text").alias("t"))

    def grams(batches):
        found: dict[tuple, set[str]] = {}
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    found.setdefault(tuple(key), set()).update(map("".join, zip(text, text[1:], text[2:])))
        for (runtime, date, file), texts in found.items():
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([runtime] * n, [date] * n, [file] * n, list(texts))], ["runtime", "date", "file", "gram"])

    out = rows.mapInArrow(grams, "runtime string, date string, file string, gram string").distinct()
    out = out.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    out.repartition("runtime", "date").sortWithinPartitions("runtime", "date", "bucket", "gram").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runtime", "date").parquet(f"{path}/trigrams")


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parquet")


def candidates(spark: SparkSession, path: str, literal: str, runtime: str | None = None) -> list[str] | None:
    """The mirror's files whose texts have every trigram of the literal; None if it is too short to ask for."""
    small = spark.range(1).select(F.lower(F.lit(literal)).alias("t")).first().t
    grams = sorted({small[i : i + 3] for i in range(len(small) - 2)})
    if not grams:
        return None
    rows = spark.read.parquet(f"{path}/trigrams")
    rows = rows.filter(F.col("gram").isin(*grams)) if runtime is None else rows.filter(F.col("gram").isin(*grams) & (F.col("runtime") == runtime))
    full = rows.groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return sorted(f"{path}/parquet/{r.file}" for r in full.select("file").collect())  # names of files, as a scan lists them


def search(spark: SparkSession, path: str, literal: str, runtime: str | None = None, limit: int = 20) -> DataFrame:
    """reads.search over the mirror, by way of the trigram index."""
    from . import reads

    found = candidates(spark, path, literal, runtime)
    events = read_mirror(spark, path)
    if found is not None:
        events = spark.read.schema(events.schema).option("basePath", f"{path}/parquet").parquet(*found) if found else events.limit(0)
    return reads.search(events, literal, runtime, limit)
