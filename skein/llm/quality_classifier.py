"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text: hashed uni- and bigrams of words (lower-cased cores) and of word shapes (case, digits, trailing
marks), each weighted by its share of the text. Learning: all labelled rows, dealt by hash to learners of about
`LEARNER` rows each (`SHARDS` at least), whose weights are averaged, slice by slice in groups; texts are packed before
they are joined to their labels. Scoring is a sparse dot
product with the weights, whose size is fixed (2**BITS floats, 1 MB), so they are broadcast to the tasks; no shuffle.

Defined results: a null or empty text has no feature and scores by the bias alone; words are what white space
separates; repeated rows score alike; labels that are null are not learned from, of
several labels or texts of an id the lowest ones are; without labels all scores are 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, packed, text_of, unpacked

BITS = 18
LEARNER, SHARDS, EPOCHS = 2048, 4, 3
SLICES = 16  # of the weights, that groups add up
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
MASK = np.uint64(2**BITS - 1)
SCALE = 12.0  # a text's features sum to this
CACHE = 300_000


class Words(dict):
    """From a word to its two hashes: of its core in lower case and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip("".join(c for c in set(word) if not c.isalnum()))
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        short = [c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1] or c not in "Aa0"]
        self[word] = out = (xxhash.xxh3_64_intdigest(core.lower()), xxhash.xxh3_64_intdigest("".join(short)[:12], 7))
        return out


def features(text: str, words: Words) -> np.ndarray:
    """Indices of the hashed n-grams of a text, repeats included."""
    found = text.split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.array(list(map(words.__getitem__, found)), np.uint64)
    a = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]  # wraps
    a ^= a >> np.uint64(29)
    h = np.concatenate([h, a])
    h[:, 1] ^= h[:, 1] >> np.uint64(17)
    return (h & MASK).astype(np.int64).ravel()


def weighted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different indices and their values, with the bias."""
    at, count = np.unique(ids, return_counts=True)
    return np.append(at, 2**BITS), np.append(count * (SCALE / max(1, len(ids))), 1.0)


class Ftrl:
    """Follow the regularised leader, proximal, a rate for each coordinate."""

    def __init__(self):
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def learned_from(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, label): the labelled rows with packed texts. Labels are never broadcast, so small and large inputs are joined alike."""
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return packed(texts, "t").join(chosen.hint("merge"), "id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The averaged weights (with the bias last). labels: id and 0/1 of the rows that may be learned from."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    shards = max(SHARDS, -(-chosen.count() // LEARNER))
    rows = learned_from(docs, chosen, id_col, text_col).repartition(shards, F.pmod(F.xxhash64("id"), F.lit(shards)))

    def run(batches):
        words, model, found = Words(), Ftrl(), {}
        for batch in batches:
            for i, z, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = unpacked(z)
                if i not in found or t < found[i][0]:
                    found[i] = t, y
        learned = [(*weighted(features(t, words)), y) for _, (t, y) in sorted(found.items(), key=lambda x: (xxhash.xxh3_64_intdigest(str(x[0])), str(x[0])))]
        for _ in range(EPOCHS):
            for row in learned:
                model.learn(*row)
        if learned:
            parts = np.array_split(model.weights(np.arange(2**BITS + 1)) * len(learned), SLICES)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "n": pa.array([len(learned)] * SLICES, pa.int64()), "w": pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in sorted(t.column("w").to_pylist())], axis=0, dtype=np.float64) / sum(t.column("n").to_pylist())
        return pa.table({"slice": t.column("slice")[:1], "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    got = rows.select("id", "t", "label").mapInArrow(run, "slice int, n long, w binary").groupBy("slice").applyInArrow(add, "slice int, w binary").collect()  # SLICES rows, 1 MB
    if not got:
        return np.zeros(2**BITS + 1, np.float32)
    return np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(got, key=lambda r: r.slice)])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, and the columns in keep): the probability of label 1 for each row."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w, words = shared.value, Words()

        def f(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column(0).to_pylist():
                ids = features(text, words)
                out.append(float(w[ids].sum()) * SCALE / max(1, len(ids)) + float(w[-1]))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))
            return {c: batch.column(i + 1) for i, c in enumerate((id_col, *keep))} | {"score": p}

        return f

    return map_rows(docs.select(text_of(text_col).alias("__text"), id_col, *keep), f"{fields}, score double", make)


def accept(docs: DataFrame, weights: np.ndarray, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, words = shared.value, Words()
        for batch in batches:
            raw = []
            for text in batch.column(batch.schema.names.index(text_col)).to_pylist():
                ids = features(text or "", words)
                raw.append(float(w[ids].sum()) * SCALE / max(1, len(ids)) + float(w[-1]))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(np.array(raw), -30, 30))) >= least))

    return docs.mapInArrow(run, docs.schema)
