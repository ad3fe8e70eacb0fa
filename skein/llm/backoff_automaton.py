"""Language-model scoring with a weighted backoff automaton.

States are histories that the training texts hold: two words, one word (or the begin of a text), and none. Arcs are the
n-grams of the training texts, each however rare: from a state, a token leads along its arc to the state of the last
two words, with the log10 of its smoothed probability. Where a state has no arc for a token, its failure arc leads to
the history without its first word, from two words to one, to none, and there to the state of unknown words, one event.
A text is scored in one traversal from left to right, which carries the state and adds up weights.

Smoothing is hierarchical: a history h of n occurrences gives a token the probability (count + K p) / (n + K), where p
is that of the shorter history; K / (n + K) is the weight of the failure arc. The last level is Witten-Bell's: known
words share N / (N + V), the unknown event has V / (N + V). So in every state the probabilities of the known words, the
end and the unknown event sum to one.

Scale: all n-grams up to three words are counted, and nothing of them leaves Spark's rows. Texts are packed into blocks
of bounded size. Each block hands on its different n-grams once, as sorted codes with their counts in its training
texts; the codes of a slice of the code space meet in a group, whose size is bounded by the number of slices (an n-gram
is there once a block, so a frequent one is no hot key), and the total of each goes back to the block, in the order of
its codes. Blocks then meet their totals in a cogroup. Codes are hashes cut to 24 bits more than the corpus has bytes
(64 at most), so that an n-gram is taken for another one with a probability below 2^-24 at any size up to a terabyte.

Defined results: a null text is empty (one token, the end); a null id counts as learned from where the condition is
null; without any training row every token is the unknown event with probability one; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .order_minhash import mixed

ORDERS = 3
K2, K3 = 500.0, 2.0  # how many occurrences of a history the shorter history is worth (chosen by held-out likelihood)
BLOCK = 12_000_000  # bytes of a block of texts
SLICE = 16_000_000  # bytes of text for each slice of the code space
CACHE = 400_000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)  # stand for no word
FACTOR = np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def tokens(raw: bytes) -> list[bytes]:
    """A-Z in lower case; bytes.split cuts at exactly \\x20 and \\x09 to \\x0D."""
    return raw.lower().split()


def blocks(docs: DataFrame, learned: Column, id_col: str, text_col: str, block: int) -> DataFrame:
    """(block, doc, size, learn, t): neighbouring texts, packed; size: bytes of each text; learn: whether it is learned from."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        number, held, size = 0, ([], [], [], []), 0
        press = zstandard.ZstdCompressor(level=3).compress

        def row():
            nonlocal number
            number += 1
            key = (TaskContext.get().partitionId() << 32) + number
            ids, sizes, learn, raw = held
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int64())), pa.array([learn], pa.list_(pa.bool_())), pa.array([press(b"".join(raw))], pa.binary())],
                ["block", "doc", "size", "learn", "t"],
            )

        for batch in batches:
            begin = 0
            for i, (learn, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = text.encode()
                held[1].append(len(raw))
                held[2].append(learn)
                held[3].append(raw)
                size += len(raw) + 1
                if size > block:
                    held[0].append(batch.column(0).slice(begin, i + 1 - begin))
                    yield row()
                    begin, held, size = i + 1, ([], [], [], []), 0
            if begin < batch.num_rows:
                held[0].append(batch.column(0).slice(begin))
        if held[1]:
            yield row()

    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(learned, F.lit(True)).alias("learn"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, f"block long, doc array<{kind}>, size array<long>, learn array<boolean>, t binary")


class Grams:
    """The n-grams of a block: its different codes of each order, and where they occur."""

    def __init__(self, sizes: list[int], packed: bytes, hashes: Hashes, bits: int):
        raw, at, parts, counts = zstandard.decompress(packed), 0, [], []
        for size in sizes:
            words = tokens(raw[at : at + size])
            at += size
            parts += [BEGIN, *map(hashes.__getitem__, words), END]
            counts.append(len(words) + 2)
        x = np.array(parts, np.uint64)
        del parts
        self.starts = np.cumsum([0, *counts])[:-1]
        begins = np.zeros(len(x), bool)
        begins[self.starts] = True
        self.at = [np.flatnonzero(~begins)]  # the tokens
        self.at += [self.at[0], self.at[0][~begins[self.at[0] - 1]]]  # those with a history of one, of two words
        self.size, self.begins = len(x), begins
        shift = np.uint64(64 - bits)
        two = np.zeros_like(x)
        two[1:] = mixed(x[:-1] * FACTOR + x[1:])
        three = mixed(two[self.at[2] - 1] * FACTOR + x[self.at[2]])
        self.codes, self.inverse = zip(*(np.unique(c >> shift, return_inverse=True) for c in (mixed(x[self.at[0]]), two[self.at[1]], three)), strict=True)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(z: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(z), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def totals(held: DataFrame, slices: int, bits: int) -> DataFrame:
    """(block, gram, slice, totals, kinds, tokens): the counts in all training texts of each block's n-grams, in the order of their codes; the different ones of a slice and their sum in one of its rows."""

    def ask(batches):
        hashes = Hashes()
        bounds = np.array([-((-k << bits) // slices) for k in range(1, slices)], np.uint64)
        for batch in batches:
            for number, sizes, learn, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                grams = Grams(sizes, t, hashes, bits)
                learned = np.repeat(np.array(learn), np.diff([*grams.starts, grams.size]))
                for gram in range(ORDERS):
                    codes = grams.codes[gram]
                    counts = np.bincount(grams.inverse[gram], learned[grams.at[gram]], len(codes))
                    cuts = [0, *np.searchsorted(codes, bounds).tolist(), len(codes)]
                    found = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([gram] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array([pack(np.diff(codes[a:b], prepend=np.uint64(0))) for _, a, b in found], pa.binary()), pa.array([pack(counts[a:b]) for _, a, b in found], pa.binary())],
                        ["gram", "slice", "block", "codes", "counts"],
                    )

    def add(rows: pa.Table) -> pa.Table:
        codes = [np.cumsum(unpack(z), dtype=np.uint64) for z in rows.column("codes").to_pylist()]
        ends = np.cumsum([len(c) for c in codes])
        different, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        del codes
        total = np.bincount(inverse, np.concatenate([unpack(z) for z in rows.column("counts").to_pylist()]).astype(float), len(different)).astype(np.int64)
        size, rest = len(ends), [0] * (len(ends) - 1)
        return pa.table({"block": rows.column("block"), "gram": rows.column("gram"), "slice": rows.column("slice"), "totals": pa.array([pack(total[inverse[a:b]]) for a, b in zip([0, *ends], ends)], pa.binary()), "kinds": pa.array([int((total > 0).sum()), *rest][:size], pa.int64()), "tokens": pa.array([int(total.sum()), *rest][:size], pa.int64())})

    asked = held.select("block", "size", "learn", "t").mapInArrow(ask, "gram int, slice int, block long, codes binary, counts binary")
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a slice is much work for its bytes
    return asked.repartition(tasks, "gram", "slice").groupBy("gram", "slice").applyInArrow(add, "block long, gram int, slice int, totals binary, kinds long, tokens long")


def traverse(word: np.ndarray, history: list[np.ndarray], arc: list[np.ndarray], n: int, v: int) -> np.ndarray:
    """The weight of each step: from the longest history that has occurrences, along the token's arc if it has one, else by
    failure to the shorter history. word: the token's count; history, arc: occurrences of the histories of one and two
    words before it and of the n-grams that they make with it (0: no such state or arc)."""
    out = np.log10(np.where(word > 0, word, v) / (n + v)) if n else np.zeros(len(word))
    for count, gram, worth in zip(history, arc, (K2, K3), strict=True):
        fail = np.log10(worth / (count + worth))  # 0 where there is no such state
        out = np.where(gram > 0, np.log10((gram + worth * 10.0**out) / (count + worth)), fail + out)
    return out


def scores(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row; those where `learned` is not false are learned from."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = written(blocks(docs, learned, id_col, text_col, block), "blocks")
    size, ends = held.agg(F.coalesce(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("learn", lambda x: x))), F.lit(0))).first()
    slices = int(size) // SLICE + 1
    bits = min(64, int(size + 2).bit_length() + 24)
    found = written(totals(held, slices, bits), "totals")
    n, v = found.filter("gram = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def answer(texts: pa.Table, rows: pa.Table) -> pa.Table:
        grams = Grams(texts.column("size")[0].as_py(), texts.column("t")[0].as_py(), Hashes(), bits)
        order = sorted(zip(rows.column("gram").to_pylist(), rows.column("slice").to_pylist(), rows.column("totals").to_pylist(), strict=True))
        count = []
        for gram in range(ORDERS):
            x = np.zeros(grams.size)
            parts = [unpack(z) for k, _, z in order if k == gram]
            if parts:
                x[grams.at[gram]] = np.concatenate(parts)[grams.inverse[gram]]
            count.append(x)
        at, states = grams.at[0], np.where(grams.begins, ends, count[0])
        two = np.where(grams.begins[at - 1], 0, count[1][at - 1])  # occurrences of the two words before
        weight = traverse(count[0][at], [states[at - 1], two], [count[1][at], count[2][at]], n, v)
        first = grams.starts - np.arange(len(grams.starts))
        return pa.table(
            {
                id_col: texts.column("doc").combine_chunks().flatten(),
                "n_tokens": pa.array(np.diff([*first, len(at)]), pa.int64()),
                "n_known": pa.array(np.add.reduceat((count[0][at] > 0).astype(np.int64), first), pa.int64()),
                "train_tokens": pa.array([n] * len(first), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10((count[0][at] + 1) / (n + v + 1)), first), pa.float64()),
                "score": pa.array(np.add.reduceat(weight, first), pa.float64()),
            }
        )

    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(answer, schema)
