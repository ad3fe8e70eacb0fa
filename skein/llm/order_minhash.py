"""Near-duplicate documents by order MinHash.

K-mers are five-word shingles labelled with their occurrence. Each of `SKETCHES` sketches keeps the `PICKED` k-mers of
the lowest hashes in the order of the text; equal sketches make candidates. A one-permutation MinHash of 64 bins drops
candidates that are far from alike; the rest are verified on their whole texts: a banded alignment of the words gives
the shingles that both share in order, and two texts are linked if these (or, where parts have moved, the plain
shingle sets) have a Jaccard similarity of `THRESHOLD` or more. Classes are the connected components.

Texts are the nodes: exact copies collapse first, under a 64-bit hash (two different texts of n share one with a
probability of n^2 / 2^65). At 0.8, three of ordered k-mers agree with 0.49, so 20 sketches miss a pair with 2e-6.

Defined results: a null text counts as empty; words are what white space separates, in lower case; texts under five
words are one shingle, so they are linked only if their words are equal; all texts without words are one class; ids
may be null or repeat: the class id is the lowest non-null id of the class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, packed, text_of, unpacked, written
from .links import across, components, leaders, ordered

WORDS, THRESHOLD = 5, 0.8
SKETCHES, PICKED, BINS = 20, 3, 64
LOOSE = 0.5  # of the 64 bins; at a similarity of 0.8 fewer agree with a probability below 1e-7
CACHE = 300_000
SLICE = 2048
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: list[str], hashes: Hashes) -> np.ndarray:
    """A hash for each run of five words; for the whole text if it has fewer."""
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    k = min(WORDS, len(h))
    out = np.zeros(max(1, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - k + 1 + i]
    return mixed(out)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each k-mer with its occurrence number mixed in."""
    order = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[order][1:] == x[order][:-1])
    if not len(same):
        return x
    run = np.zeros(len(x), np.int64)
    starts = np.r_[True, x[order][1:] != x[order][:-1]]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(x)), 0))
    run[order] = np.arange(len(x)) - first
    return np.where(run, mixed(x + run.astype(np.uint64) * MIX), x)


def sketch(x: np.ndarray) -> np.ndarray:
    """A key for each sketch: its k-mers of the lowest hashes, in the order of the text."""
    n = min(PICKED, len(x))
    at = np.argpartition(x * FACTORS, n - 1, axis=1)[:, :n] if len(x) > n else np.tile(np.arange(n), (SKETCHES, 1))
    at.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64)
    for i in range(n):
        out = mixed(out * MIX + x[at[:, i]])
    return out.astype(np.int64)


def one_permutation(x: np.ndarray) -> bytes:
    """The lowest hash of each of 64 bins, as 16 bits; 0 where a bin is empty."""
    y = np.sort((x << np.uint64(58)) | (x >> np.uint64(6)))
    first = np.searchsorted(y, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    ok = first < len(y)
    value = y[np.minimum(first, len(y) - 1)]
    ok &= (value >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64)
    return np.where(ok, (value >> np.uint64(13) & np.uint64(0xFFFF)) | np.uint64(1), 0).astype(np.uint16).tobytes()


def near(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which pairs of shingle sets (8 bytes a shingle) have the similarity; shared shingles are counted by products of
    slices of the sets' incidence matrices."""
    a, b = [np.frombuffer(v, np.uint64) for v in x], [np.frombuffer(v, np.uint64) for v in y]
    na, nb = np.array([len(v) for v in a], np.float32), np.array([len(v) for v in b], np.float32)
    ca, cb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ca, cb)
    (ka, ra), (kb, rb) = ((np.searchsorted(both, c), np.repeat(np.arange(len(v)), n.astype(int))) for c, v, n in ((ca, a, na), (cb, b, nb)))
    (ka, ra), (kb, rb) = ((k[ok], r[ok]) for c, k, r in ((ca, ka, ra), (cb, kb, rb)) for ok in [np.isin(c, both)])
    shared = np.zeros((len(a), len(b)), np.float32)
    order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, ra, kb, rb = ka[order_a], ra[order_a], kb[order_b], rb[order_b]
    for begin in range(0, len(both), SLICE):
        u, v = np.zeros((len(a), SLICE), np.float32), np.zeros((len(b), SLICE), np.float32)
        s, e = np.searchsorted(ka, (begin, begin + SLICE))
        u[ra[s:e], ka[s:e] - begin] = 1
        s, e = np.searchsorted(kb, (begin, begin + SLICE))
        v[rb[s:e], kb[s:e] - begin] = 1
        shared += u @ v.T
    return shared >= THRESHOLD * (na[:, None] + nb[None, :] - shared) - 1e-3


def runs(a: list, b: list, most: int) -> list[int] | None:
    """Lengths of the runs of equal words in a shortest edit script of a and b with at most `most` insertions and
    deletions; None if there is none. Furthest-reaching points in a band of diagonals that widens with each edit."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    if head == n == m:
        return [n]
    far, trace = {1: head}, []
    first = True
    for d in range(most + 1):
        trace.append({})
        for k in range(-min(d, m) + (d - min(d, m)) % 2, min(d, n) + 1, 2):
            if first:
                x = head
            elif k == -d or k != d and far.get(k - 1, -1) < far.get(k + 1, -1):
                x = far.get(k + 1, -1)
            else:
                x = far.get(k - 1, -1) + 1
            y, begin = x - k, x
            if x < 0 or y < 0 or x > n or y > m:
                continue
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            far[k] = x
            trace[d][k] = (begin, x)
            if x >= n and y >= m:
                out = []
                for e in range(d, -1, -1):
                    begin, end = trace[e][k]
                    out.append(end - (0 if e == 0 else begin))
                    if e == 0:
                        break
                    down, up = trace[e - 1].get(k + 1), trace[e - 1].get(k - 1)
                    k = k + 1 if down and down[1] == begin else k - 1 if up else k + 1
                return out
        first = False
    return None


def alike(a: str, b: str) -> bool:
    """Whether two texts share shingles at the threshold, in order (by alignment) or as sets."""
    wa, wb = a.lower().split(), b.lower().split()
    if len(wa) < WORDS or len(wb) < WORDS:
        return wa == wb
    na, nb = len(wa) - WORDS + 1, len(wb) - WORDS + 1
    need = THRESHOLD * (na + nb) / (1 + THRESHOLD)
    if min(na, nb) < need:
        set_only = True
    else:
        set_only = False
        found = runs(wa, wb, min(64, max(4, (na + nb) // 5)))  # wider bands are left to the sets
        if found and sum(max(0, r - WORDS + 1) for r in found) >= need:
            return True
    sa, sb = ({tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} for w in (wa, wb))
    if set_only and min(len(sa), len(sb)) < THRESHOLD * max(len(sa), len(sb)):
        return False
    both = len(sa & sb)
    return both >= THRESHOLD * (len(sa) + len(sb) - both)


def sketches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, keys, data) for each different text: its hash, sketch keys and one-permutation sketch."""

    def make():
        hashes = Hashes()

        def f(batch: pa.RecordBatch) -> dict:
            out = {"id": [], "keys": [], "data": []}
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                if words:
                    x = labelled(shingles(words, hashes))
                    out["id"].append(node)
                    out["keys"].append(sketch(x))
                    out["data"].append(one_permutation(x))
                else:
                    out["id"].append(node)
                    out["keys"].append(np.full(1, -1))
                    out["data"].append(bytes(2 * BINS))
            return out

        return f

    src = docs.select(text_of(text_col).alias("t")).select(F.xxhash64("t").alias("id"), "t")
    return map_rows(src, "id long, keys array<long>, data binary", make).dropDuplicates(["id"])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, data) of packed texts (id, t): the different shingles' hashes."""

    def make():
        hashes = Hashes()

        def f(batch: pa.RecordBatch) -> dict:
            words = [unpacked(t).lower().split() for t in batch.column(1).to_pylist()]
            return {"id": batch.column(0), "data": [np.unique(shingles(w, hashes)).tobytes() if w else b"" for w in words]}

        return f

    return map_rows(texts.select("id", "t"), "id long, data binary", make)


def verified(pairs: DataFrame, sk: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike: first by sketch, then on their packed texts (id, t)."""

    def make_loose():
        def f(batch: pa.RecordBatch) -> dict:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 3))
            filled = (x > 0) | (y > 0)
            ok = pa.array(((x == y) & filled).sum(axis=1) >= LOOSE * filled.sum(axis=1))
            return {"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)}

        return f

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            ok = pa.array([alike(unpacked(x), unpacked(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            return {"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)}

        return f

    data = sk.select("id", "data")
    both = pairs.join(data.toDF("a", "da"), "a").join(data.toDF("b", "db"), "b").select("a", "b", "da", "db")
    loose = map_rows(both, "a long, b long", make_loose)
    both = loose.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return map_rows(both, "a long, b long", make)


def near_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, root) of the texts, by hash, that are like another one."""
    sk = written(sketches(docs, text_col), "sketches")
    members = sk.select("id", F.explode("keys").alias("key"))
    members = written(members.join(leaders(members), "key").select("key", "id", "leader"), "members")
    texts = packed(docs.select(text_of(text_col).alias("t")).select(F.xxhash64("t").alias("id"), "t"), "t").join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    texts = written(texts, "texts")
    first = written(verified(ordered(members.select(F.col("leader").alias("a"), F.col("id").alias("b"))), sk, texts), "links")
    roots = components(first)
    again = members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    pairs, links = across(again, lambda ids: shingle_sets(texts.join(ids, "id", "left_semi")), near)
    more = written(verified(pairs, sk, texts).union(links), "links")
    return roots if more.isEmpty() else components(first.union(more))


def rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, root) for every row."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_of(text_col)).alias("id"))
    return rows.join(near_classes(docs, text_col), "id", "left").select("doc", "id", F.coalesce("root", "id").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) for every row: class_id is the lowest id of its class of near copies."""
    rows = rooted(docs, id_col, text_col)
    found = rows.groupBy("root").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(found, "root").select(F.col("doc").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each class of near copies: that of the lowest id, null last."""
    best = rooted(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "id")).alias("best"), F.count("*").alias("n"))
    best = best.select(F.col("best.doc").alias("__doc"), F.col("best.id").alias("__id"))
    out = docs.withColumn("__node", F.xxhash64(text_of(text_col))).join(best, (F.col("__node") == F.col("__id")) & F.col(id_col).eqNullSafe(F.col("__doc")))
    same = docs.select(F.xxhash64(id_col).alias("a"), F.xxhash64(text_of(text_col)).alias("b")).groupBy("a", "b").count().filter("count > 1")
    if not same.isEmpty():  # rows that share id and text, as a whole text's shuffle is not worth its cost without any
        out = out.dropDuplicates(["__node"])
    return out.select(*[docs[c] for c in docs.columns])
