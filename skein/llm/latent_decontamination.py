"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of `PASSAGE` words at most, weighted by TF-IDF (document frequencies over all
documents), and reduced by a randomised singular value decomposition, of rank `RANK` or half the number of passages at
most, whose products with the matrix run as Spark jobs: first of the benchmark's passages, then, from that space on, of all
passages of all documents too, so that words which occur together there are near. Stretches of documents, half as long again as the passage, are projected into the
same latent space; those whose cosine with the passage reaches a share of the passage's own are candidates. The
candidates are looked for where an inverted index has two of the passage's rarest quarter of words and two more, which
whatever counts below must hold, so this loses none. A candidate counts if the longest common subsequence of words covers most of the item's passage, or half of it while
the passage's rarest words, which carry its answer, are there too (a paraphrase).

Scale: one pass over the documents for frequencies, in a fixed number of cells, for all of the benchmark; and two passes
(the product, the search) for each block of `BLOCK` items and `LETTERS` characters, whose vocabulary and matrices have a bounded
size (about 80 MB). Nothing of the documents is shuffled but counts.

Defined results: null texts match nothing, nor do items under `LEAST` words; words are compared without case and
ASCII marks separate them; equal items are reported each; repeated documents are reported each; a null doc id stays.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chained_passages import hashed, hashed_all
from .common import map_rows, text_of

PASSAGE, LEAST = 64, 8
RANK, POWER = 96, 1
TOGETHER = 1 << 11  # words of rows that are multiplied at once
BLOCK, LETTERS = 4096, 1_200_000
COSINE = 0.4  # of the passage's cosine with itself in the latent space
CELLS, SLICE = 1 << 20, 1 << 17  # cells that words' frequencies are counted in; of them a group adds up
COVERED, PARAPHRASED, ANSWER = 0.75, 0.5, 3
SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case as UTF-8: what white space and ASCII marks separate."""
    return (text or "").lower().encode().translate(SPACED).split()


def numbers(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Each word's number in the vocabulary, -1 if it has none."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents words occur, by the cell of the word's hash, and how many documents there are."""

    def run(batches):
        n, seen = 0, np.zeros(CELLS, np.int64)
        for batch in batches:
            for h in hashed_all([b" ".join(words_of(t)) for t in batch.column(0).to_pylist()]):
                seen[cells(h)] += 1  # once a cell, however often it is there
                n += 1
        parts = np.split(seen, CELLS // SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in parts], pa.binary()), pa.array([n] * len(parts), pa.int64())], ["slice", "seen", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in t.column("seen").to_pylist():
            total += np.frombuffer(zstandard.decompress(x), np.int64)
        return pa.table({"slice": t.column("slice")[:1], "seen": pa.array([zstandard.compress(total.tobytes())]), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    schema = "slice int, seen binary, n long"
    got = docs.select(text_of(text_col).alias("t")).mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect()  # CELLS numbers
    out = np.zeros((CELLS // SLICE, SLICE), np.int64)
    for r in got:
        out[r.slice] = np.frombuffer(zstandard.decompress(r.seen), np.int64)
    return out.ravel(), got[0].n if got else 0


Flat = tuple[np.ndarray, np.ndarray, np.ndarray]  # of some rows: ids, weights, numbers of the rows they are of


def listed(batch: pa.RecordBatch) -> Iterator[Flat]:
    """Rows that are lists of ids and of weights."""
    n = batch.column(0).value_lengths().to_numpy()
    yield batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)


def passages_of(vocabulary: dict[bytes, int], idf: np.ndarray, batch: pa.RecordBatch) -> Iterator[Flat]:
    """Rows of texts: a row for each passage with LEAST words of the vocabulary, weighted by TF-IDF."""
    for text in batch.column(0).to_pylist():
        ids = numbers(text, vocabulary)
        row = np.arange(len(ids)) // PASSAGE
        ids, row = ids[ids >= 0], row[ids >= 0]
        enough = np.bincount(row)[row] >= LEAST if len(row) else np.zeros(0, bool)
        yield ids[enough], idf[ids[enough]], row[enough]


def together(parts: Iterator[Flat]) -> Iterator[Flat]:
    """Rows by about TOGETHER words: many short texts at once, a long one in parts of whole rows."""
    held, size, before = [], 0, 0
    for ids, weights, row in parts:
        begin = 0
        while begin < len(ids):
            end = int(np.searchsorted(row, row[min(len(row), begin + TOGETHER) - 1], "right"))
            held.append((ids[begin:end], weights[begin:end], row[begin:end] - row[begin] + before))
            before, size, begin = held[-1][2][-1] + 1, size + end - begin, end
            if size >= TOGETHER:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size, before = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def randomised_svd(rows: DataFrame, features: int, rank: int, power: int = POWER, seed: int = 1, read: Callable[[pa.RecordBatch], Iterator[Flat]] = listed, start: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis (features x rank) of the leading right singular space of the sparse rows that `read` finds in
    batches of `rows` (by itself, lists of ids and weights); start: a basis to begin with instead of a random one.

    Each product A'(A V) is a Spark job: tasks sum over their rows, the sums of a slice of features meet in a group.
    """
    slices = max(1, features // 256)  # a group adds up a slice of every task
    basis = np.random.default_rng(seed).standard_normal((features, rank)).astype(np.float32) if start is None else start
    for _ in range(power + 1):
        shared = rows.sparkSession.sparkContext.broadcast((np.linalg.qr(basis)[0].astype(np.float32), read))

        def run(batches, shared=shared):
            v, read = shared.value
            total = np.zeros(v.shape, np.float32)
            for ids, weights, row in together(x for batch in batches for x in read(batch)):
                at, column = np.unique(ids, return_inverse=True)
                shape = int(row[-1]) + 1, len(at)
                m = np.bincount(row * len(at) + column, weights, shape[0] * shape[1]).reshape(shape).astype(np.float32)
                total[at] += m.T @ (m @ v[at])
            parts = np.array_split(total, slices)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "sums"])

        def add(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, np.float32) for x in t.column("sums").to_pylist()], axis=0, dtype=np.float32)
            return pa.table({"slice": t.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        schema = "slice int, sums binary"
        got = rows.mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect()  # features x rank numbers
        basis = np.concatenate([np.frombuffer(r.sums, np.float32) for r in sorted(got, key=lambda r: r.slice)]).reshape(features, rank) if got else basis
    return np.linalg.qr(basis)[0].astype(np.float32)


class Index:
    """A block of the benchmark, ready to search a text with."""

    def __init__(self, items: list, passages: list[tuple[int, np.ndarray]], vocabulary: dict[bytes, int], idf: np.ndarray, basis: np.ndarray):
        self.items, self.passages, self.vocabulary, self.idf = items, passages, vocabulary, idf
        self.basis = basis * idf[:, None]  # what a word adds to a latent vector
        norms = []
        for _, ids in passages:
            at, n = np.unique(ids, return_counts=True)
            norms.append(math.sqrt(float(((n * idf[at]) ** 2).sum())) or 1.0)
        self.latent = np.array([self.basis[ids].sum(axis=0) for _, ids in passages], np.float32) / np.array(norms, np.float32)[:, None]
        self.own = np.minimum(1.0, (self.latent**2).sum(axis=1))
        self.latent /= np.maximum(self.own, 1e-6)[:, None]  # so that a passage's product with itself is 1
        # the rarest words of a passage that COVERED allows to lack, and two more: of a text that covers it two are there,
        # and of a paraphrase two of the answer's, which are among them
        anchors = sorted({(w, p) for p, (_, ids) in enumerate(passages) for w in sorted(ids.tolist(), key=lambda i: (-idf[i], i))[: len(ids) - math.ceil(COVERED * len(ids)) + 2]})
        self.anchored = np.array([p for _, p in anchors], np.int64)
        self.first = np.searchsorted([w for w, _ in anchors], np.arange(len(vocabulary) + 1))
        self.width = np.array([stretch(len(ids)) for _, ids in passages], np.int64)
        self.answers = [set(sorted(set(ids.tolist()), key=lambda i: (-idf[i], i))[:ANSWER]) for _, ids in passages]

    def regions(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(passage, bucket) where two anchors of the passage may be within a stretch of it: in a bucket and the ones beside it."""
        at = np.flatnonzero(ids >= 0)
        low, n = self.first[ids[at]], self.first[ids[at] + 1] - self.first[ids[at]]
        found = self.anchored[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        key, count = np.unique((found << 32) + np.repeat(at, n) // self.width[found], return_counts=True)
        if not len(key):
            return []
        near = np.r_[False, key[1:] == key[:-1] + 1]
        total = count + np.where(near, np.r_[0, count[:-1]], 0) + np.r_[np.where(near, count, 0)[1:], 0]
        return [(k >> 32, k & 0xFFFFFFFF) for k in key[total > 1].tolist()]

    def search(self, ids: np.ndarray) -> dict[int, tuple[float, float, int, int]]:
        """From item to (share covered, cosine, begin, end in words) of its best match in a text."""
        n, out = len(ids), {}
        for p, k in self.regions(ids):
            (item, words), width = self.passages[p], int(self.width[p])
            begin, end = max(0, (k - 1) * width), min(n, (k + 2) * width)
            here = ids[begin:end]
            known = here[here >= 0]
            # the cosine of stretches with the passage: words that the benchmark lacks say nothing, and would weigh more in a larger corpus
            product, energy = np.zeros(len(here) + 1), np.zeros(len(here) + 1)
            product[1:][here >= 0], energy[1:][here >= 0] = self.basis[known] @ self.latent[p], self.idf[known] ** 2
            product, energy = np.cumsum(product), np.cumsum(energy)
            a = np.arange(0, max(1, len(here) - width + len(words) // 4 + 1), max(1, len(words) // 4))
            b = np.minimum(a + width, len(here))
            cosine = float(((product[b] - product[a]) / np.sqrt(np.maximum(energy[b] - energy[a], 1e-9))).max())
            if cosine < COSINE:
                continue
            region = set(here.tolist())
            there = sum(w in region for w in words.tolist()) / len(words)  # no subsequence covers more
            if there < (PARAPHRASED if len(self.answers[p] & region) * 2 > len(self.answers[p]) else COVERED):
                continue
            share, x, y = covered(words, here)
            answered = len(self.answers[p] & set(here[x:y].tolist())) * 2 > len(self.answers[p])
            if share >= COVERED or share >= PARAPHRASED and answered:
                found = (share, cosine, begin + x, begin + y)
                if item not in out or found > out[item]:
                    out[item] = found
        return out


def stretch(n: int) -> int:
    """The width of text that a passage of n words is looked for in."""
    return n + max(4, n // 2)


def covered(words: np.ndarray, region: np.ndarray) -> tuple[float, int, int]:
    """The longest common subsequence as a share of words, over the best stretch of the region about as long as words."""
    width = stretch(len(words))
    rows: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        rows[w] = rows.get(w, 0) | 1 << i
    full, best, found = (1 << len(words)) - 1, 0, (0, 0)
    places = region.tolist()
    for a in range(0, max(1, len(places) - width + len(words) // 4 + 1), max(1, len(words) // 4)):
        state = full  # zeros mark where the subsequence grows
        for w in places[a : a + width]:
            hit = rows.get(w)
            if hit:
                both = state & hit
                state = ((state + both) | (state - both)) & full
        size = len(words) - state.bit_count()
        if size > best:
            best, found = size, (a, min(len(places), a + width))
    return best / len(words), *found


def build(docs: DataFrame, items: list, text_col: str, df: np.ndarray, n: int) -> Index | None:
    """An index of the items [(item id, text)] of one block; df, n: frequencies()."""
    vocabulary: dict[bytes, int] = {}
    passages = []
    for k, (_, text) in enumerate(items):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        if len(ids) >= LEAST:
            for a in range(0, max(1, len(ids) - PASSAGE // 2), PASSAGE // 2) if len(ids) > PASSAGE else (0,):
                passages.append((k, ids[a : a + PASSAGE]))
    if not passages:
        return None
    idf = np.maximum(np.log((1 + n) / (1 + df[cells(hashed(b" ".join(vocabulary)))])), 0.05).astype(np.float32)
    spark = docs.sparkSession
    rank, read = max(1, min(RANK, len(passages) // 2, len(vocabulary) // 2)), partial(passages_of, vocabulary, idf)
    own = spark.createDataFrame([(t or "",) for _, t in items], "t string")
    basis = randomised_svd(own, len(vocabulary), rank, read=read)
    basis = randomised_svd(docs.select(text_of(text_col).alias("t")).union(own), len(vocabulary), rank, power=0, read=read, start=basis)
    return Index(items, passages, vocabulary, idf, basis)


def blocks(benchmark: DataFrame, item_col: str, item_text_col: str):
    """The benchmark's items, about BLOCK items and LETTERS characters at a time at most."""
    src = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t"))
    count, letters = src.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    many = max(-(-count // BLOCK), -(-letters // LETTERS)) if count else 0
    for k in range(many):
        yield [(r.item, r.t) for r in src.filter(F.pmod(F.coalesce(F.xxhash64("item", "t"), F.lit(0)), F.lit(many)) == k).sort("item", "t").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, share, cosine, begin_word, end_word) for every document and benchmark item that it holds."""
    kind, ikind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {ikind}, share double, cosine double, begin_word long, end_word long"
    out, df = None, None
    for items in blocks(benchmark, item_col, item_text_col):
        df = df or frequencies(docs, text_col)
        index = build(docs, items, text_col, *df)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            index = shared.value
            known = index.vocabulary

            def f(batch: pa.RecordBatch) -> dict:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc, index.items[k][0], *hit) for k, hit in sorted(index.search(numbers(text, known)).items())]
                return {c: [r[i] for r in rows] for i, c in enumerate((id_col, item_col, "share", "cosine", "begin_word", "end_word"))}

            return f

        part = map_rows(docs.select(F.col(id_col), text_of(text_col).alias("__text")), schema, make)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    every, df = docs, None  # frequencies are of all documents, and a block's pass does not repeat those before it
    for items in blocks(benchmark, item_col, item_text_col):
        df = df or frequencies(every, text_col)
        index = build(every, items, text_col, *df)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            known = shared.value.vocabulary
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
                yield batch.filter(pa.array([not shared.value.search(numbers(t or "", known)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, StructType(docs.schema.fields))
    return docs
