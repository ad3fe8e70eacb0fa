"""Byte-level BPE encoding and decoding with a given rank file; the vocabulary is never trained here.

Long texts are cut into overlapping chunks, which are rows of their own and are pre-tokenised in parallel. A chunk's
first boundaries may be wrong, as it starts anywhere; from the first boundary that it shares with its predecessor on,
both agree, since a match of the pattern depends only on the text from its start on. There the chunks are stitched.
The pieces are then merged by rank (each distinct piece once in a task) and the ids decoded by joining raw bytes.
Texts of one chunk stay in their task: no shuffle.

Defined results: a null text counts as empty (no ids); an empty table gives no rows; ids may repeat; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

CHUNK, OVERLAP = 32768, 1024  # characters
CACHE = 300_000  # distinct pieces that a task remembers


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Pieces(dict):
    """From a pre-token to its ids as text; what is missing is merged when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out = " ".join(map(str, merge(piece.encode("utf-8", "surrogatepass"), self.ranks)))
        return out


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of the lowest rank is merged, leftmost first, while there is one."""
    if raw in ranks:
        return [ranks[raw]]
    if len(raw) > 200:
        return _merge_long(raw, ranks)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, with a heap over a linked list, for pieces of any length."""
    from heapq import heapify, heappop, heappush

    n = len(raw)
    end, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or (j := after[i]) < 0 or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) >= 0 and (rank := ranks.get(raw[a : end[b]])) is not None:
                heappush(heap, (rank, a, end[b]))
    return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def boundaries(pattern: regex.Pattern, text: str, begin: int, last: bool) -> list[int]:
    """Where the pre-tokens of a chunk end, in the text; those that more text could change are left out."""
    out = [begin + m.end() for m in pattern.finditer(text)]
    if not last:  # the final match may go on, and white space before it may be dealt otherwise
        safe = begin + len(text) - 1
        while out and out[-1] >= safe:
            out.pop()
        if out:
            out.pop()
    return out


def stitch(text: str, chunks: list[list[int]], pattern: regex.Pattern) -> list[int]:
    """The boundaries of the whole text from those of its chunks, in order."""
    out = list(chunks[0])
    for more in chunks[1:]:
        at = out[-1] if out else 0
        known = set(out[bisect_left(out, more[0]) :]) if more else set()
        same = next((k for k, x in enumerate(more) if x in known), None)
        if same is not None:
            del out[bisect_left(out, more[same]) :]
            out += more[same:]
            continue
        # no agreement inside the overlap: go on from the last sure boundary until one is found
        pending, found = set(more), False
        for m in pattern.finditer(text, at):
            if m.end() in pending:
                out += more[bisect_left(more, m.end()) :]
                found = True
                break
            out.append(m.end())
        if not found:
            return out
    at = out[-1] if out else 0
    return out + [m.end() for m in pattern.finditer(text, at)] if at < len(text) else out


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids as decimal text if with_ids, ids_sha256, decoded_sha256) for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    long = F.length("t") > chunk
    short = docs.filter(~long).withColumn("ends", F.lit(None).cast("array<array<int>>"))

    # long texts: a row for each chunk, dealt over the cluster; then the boundaries, not the texts' chunks, meet
    keyed = docs.filter(long).withColumn("k", F.xxhash64("id", "t")).withColumn("k2", F.md5("t"))
    cuts = keyed.select("k", "k2", F.length("t").alias("n"), "t").dropDuplicates(["k", "k2"]).select("k", "k2", "n", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("begin"))
    cuts = cuts.select("k", "k2", "begin", ((F.col("begin") + chunk + overlap) >= F.col("n")).alias("last"), F.expr(f"substring(t, begin + 1, {chunk + overlap})").alias("part")).repartition("k", "begin")

    def make_ends():
        compiled = regex.compile(pattern)

        def f(batch: pa.RecordBatch) -> dict:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            return {"k": batch.column(0), "k2": batch.column(1), "begin": batch.column(2), "ends": [boundaries(compiled, part, begin, last) for begin, last, part in rows]}

        return f

    ends = map_rows(cuts, "k long, k2 string, begin int, ends array<int>", make_ends)
    ends = ends.groupBy("k", "k2").agg(F.transform(F.array_sort(F.collect_list(F.struct("begin", "ends"))), lambda x: x["ends"]).alias("ends"))
    stitched = keyed.join(ends, ["k", "k2"]).select("id", "t", "ends")

    schema = f"`{id_col}` {kind}, n_tokens long, {'ids string, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"

    def make():
        compiled, ranks = regex.compile(pattern), load_ranks(ranks_path)
        pieces, raw = Pieces(ranks), {str(rank): token for token, rank in ranks.items()}

        def f(batch: pa.RecordBatch) -> dict:
            out = {id_col: batch.column(0), "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for text, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if chunks is None:
                    found = compiled.findall(text)
                else:
                    cut = stitch(text, chunks, compiled)
                    found = [text[a:b] for a, b in zip([0, *cut], cut, strict=False)]
                ids = " ".join(map(pieces.__getitem__, found))
                tokens = ids.split(" ") if ids else []
                decoded = b"".join(map(raw.__getitem__, tokens))
                out["n_tokens"].append(len(tokens))
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return f

    one = map_rows(short, schema, make)
    return one.unionByName(map_rows(stitched, schema, make))


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the bytes of each row's ids, joined; what is not UTF-8 is replaced. Null ids decode to an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        raw = {str(rank): token for token, rank in load_ranks(ranks_path).items()}

        def f(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(0), "text": [b"".join(map(raw.__getitem__, ids.split(" ") if ids else [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]}

        return f

    return map_rows(df.select(F.col(id_col), F.col(ids_col)), f"`{id_col}` {kind}, text string", make)
