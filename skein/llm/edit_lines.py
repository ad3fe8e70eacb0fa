"""Line dedup by a segment-partition edit join.

Lines match within `EDITS` edits. A line is cut into EDITS + 1 even segments; of two lines that match, the longer holds
some segment of the shorter unchanged, at a place that the number and the length of the segments narrow down. So each
line is indexed under (length, segment number, segment) and probes for every length from its own down to EDITS less.
Candidates are verified by a banded bit-parallel edit distance. Classes are the connected components of the matches and
of equal lines; the first line of a class (by document id, then position, then the text's hash) stays, the others go.

Scale: each task emits the keys of its different lines; the index's leaders (one row a key, pre-aggregated) meet the
probes in one join whose skewed keys Spark splits; only members of buckets that two lines share are written. Lines are
known by a 64-bit hash (two different ones of n share one with a probability of n^2 / 2^65).

Defined results: a null text has no lines, an empty one has one empty line; lines under `least` characters without
the spaces around them always stay, those under `fuzzy` characters match equal ones only (both are parameters; with
least=0 and fuzzy=0 all lines of more characters than edits are compared); rows that share their
id and text count as one and keep or lose the same lines, rows that share an id (or have none) but not their text are
apart; a null id comes before others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written
from .links import across, components, ordered

EDITS = 2
LEAST, FUZZY = 10, 24
SEEN = 200_000  # lines that a task remembers, to emit a repeated one once


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments of n characters; the last ones are the longer."""
    size, more = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        length = size + (i >= parts - more)
        out.append((at, length))
        at += length
    return out


def plan(n: int, edits: int, least: int) -> tuple[list, list]:
    """For lines of n characters: (start, end, seed) of the segments to index, and of further substrings to probe."""
    index, probe = [], []
    for less in range(edits + 1):
        if n - less < least:
            break
        for i, (start, length) in enumerate(segments(n - less, edits + 1)):
            seed = (n - less) * (edits + 1) + i
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                a = start + shift
                if 0 <= a <= n - length:
                    (index if less == shift == 0 else probe).append((a, a + length, seed))
    return index, probe


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k at most: differences of neighbouring rows as bits, in a band of 2k + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    head = 0
    while head < len(b) and a[head : head + 32] == b[head : head + 32]:
        head += 32
    a, b = a[head:], b[head:]
    if not b:
        return len(a) <= k
    m, n, width = len(a), len(b), 2 * k + 1
    full, rows = (1 << width) - 1, {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << (i + k)
    up, down, score = ((1 << k) - 1) << (k + 1), (1 << (k + 1)) - 1, 0
    for j, c in enumerate(b):
        same = rows.get(c, 0) >> j & full
        up, down = up >> 1 | 1 << (width - 1), down >> 1
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | ~(diagonal | up), diagonal & up
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal & full
        score += not diagonal >> k & 1
        if score - (m - n) > k:
            return False
    for r in range(k + 1, k + 1 + m - n):
        score += (up >> r & 1) - (down >> r & 1)
    return score <= k


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hash, pos, id, line): every line of every text, with its hash and that of its text."""
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text"))
    lines = texts.select("doc", "hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc", "hash", "pos", F.xxhash64("line").alias("id"), "line")


def keys(lines: DataFrame, edits: int, fuzzy: int, indexed_only: bool) -> DataFrame:
    """(key, id, indexed) of lines (id, line)."""

    def make():
        plans: dict = {}
        seen: set = set()

        def f(batch: pa.RecordBatch) -> dict:
            out, ids, counts, flags = [], [], [], []
            for node, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                n = len(line)
                if n not in plans:
                    index, probe = plan(n, edits, max(fuzzy, edits + 1))
                    plans[n] = (index if indexed_only else index + probe), [1] * len(index) + ([] if indexed_only else [0] * len(probe))
                cuts, marks = plans[n]
                digest = xxhash.xxh3_64_intdigest
                out += [digest(line[a:b], seed) for a, b, seed in cuts] if line.isascii() else [digest(line[a:b].encode(), seed) for a, b, seed in cuts]
                flags += marks
                ids.append(node)
                counts.append(len(cuts))
            return {"key": np.array(out, np.uint64).view(np.int64), "id": np.repeat(np.array(ids, np.int64), counts), "indexed": np.array(flags, bool)}

        return f

    return map_rows(lines, "key long, id long, indexed boolean", make)


def near(x: list[bytes], y: list[bytes], edits: int = EDITS) -> np.ndarray:
    a, b = [v.decode() for v in x], [v.decode() for v in y]
    return np.array([[within(s, t, edits) for t in b] for s in a], bool).reshape(len(a), len(b))


def matches(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    def make():
        def f(batch: pa.RecordBatch) -> dict:
            ok = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            return {"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)}

        return f

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return map_rows(both, "a long, b long", make)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, fuzzy: int = FUZZY) -> DataFrame:
    """(id, root) of the different lines that match another one; equal lines share their id."""
    lines = line_rows(docs, id_col, text_col).select("id", "line").filter(F.length("line") >= fuzzy)
    # the key's leader is its lowest indexed line; any line of the key is its match or not a match of this key's leader
    lead = written(keys(lines, edits, fuzzy, True).groupBy("key").agg(F.min("id").alias("leader")), "leaders")  # so that Spark can split both sides of the join
    used = written(keys(lines, edits, fuzzy, False).join(lead, "key").filter("id <> leader").select("key", "id", "leader"), "members").distinct()
    pairs = ordered(used.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    need = used.select("id").union(used.select("leader")).distinct()
    texts = written(lines.join(need, "id", "left_semi").dropDuplicates(["id"]), "lines")
    first = written(matches(pairs, texts, edits), "links")
    roots = components(first)
    members = used.select("key", "id").union(used.select("key", F.col("leader").alias("id"))).distinct()
    members = members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    pairs, links = across(members, lambda ids: texts.join(ids, "id", "left_semi").select("id", F.encode("line", "utf-8").alias("data")), lambda x, y: near(x, y, edits))
    more = written(matches(pairs, texts, edits).union(links), "links")
    return roots if more.isEmpty() else components(first.union(more))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, fuzzy: int = FUZZY, least: int = LEAST) -> DataFrame:
    """(doc, hash, pos, first_doc, first_pos) of every line that goes, with the first line of its class; hash: of the text, as ids may repeat or lack."""
    roots = line_classes(docs, id_col, text_col, edits, fuzzy)
    place = F.struct("doc", "pos", "hash")
    lines = line_rows(docs, id_col, text_col).filter(F.length(F.trim("line")) >= least).select("doc", "hash", "pos", "id")
    by_line = lines.groupBy("id").agg(F.min(place).alias("at"), F.max(place).alias("to"))
    by_line = by_line.join(roots, "id", "left").filter("root is not null or not at <=> to").select("id", F.coalesce("root", "id").alias("root"), "at")
    by_line = written(by_line, "repeated")
    firsts = by_line.groupBy("root").agg(F.min("at").alias("first"))
    known = by_line.join(firsts, "root").select("id", "first")
    return lines.join(known, "id").filter(~place.eqNullSafe(F.col("first"))).select("doc", "hash", "pos", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, fuzzy: int = FUZZY, least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_duplicates, duplicates) for each row; duplicates: (pos, first_doc, first_pos) by pos."""
    gone = duplicate_lines(docs, id_col, text_col, edits, fuzzy, least).distinct().groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("pos", "first_doc", "first_pos"))).alias("duplicates"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"), F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n", -1)), F.lit(0)).alias("lines"))
    rows = rows.withColumn("lines", F.when(F.col("lines") < 0, 0).otherwise(F.col("lines")).cast("long"))
    out = rows.join(gone, rows["id"].eqNullSafe(gone["doc"]) & (rows["own"] == gone["hash"]), "left")
    return out.select(F.col("id").alias(id_col), F.col("lines").alias("n_lines"), F.coalesce(F.size("duplicates"), F.lit(0)).cast("long").alias("n_duplicates"), F.coalesce("duplicates", F.array().cast(gone.schema["duplicates"].dataType)).alias("duplicates"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, fuzzy: int = FUZZY, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, without the lines that go; a text that loses all its lines becomes empty."""
    gone = duplicate_lines(docs, id_col, text_col, edits, fuzzy, least).groupBy("doc", "hash").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"doc": "__doc", "hash": "__hash"})
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    kept = F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(F.array_contains("__gone", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull()), "\n")
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["__doc"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__hash"]), "left")
    return out.select(*[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns])
