import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from skein.llm import backoff_automaton as B
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF, SF01, docs


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_table(spark):
    texts = pd.read_parquet(f"{SF01}/documents.parquet")
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in zip(texts.doc_id, texts.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    counts = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op7_backoff_automaton"](spark, SF01).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, ws in toks.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert (got.score < 0).all()
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum() and (h.score > h.base_score).mean() > 0.5


class Slow:
    """The automaton as tables of states, arcs and failure arcs, walked a token at a time."""

    def __init__(self, rows):
        self.counts = [Counter(), Counter(), Counter()]
        for r in rows:
            r = ["<s>", *r, "</s>"]
            self.counts[0].update(r[1:])
            self.counts[1].update(zip(r, r[1:]))
            self.counts[2].update(zip(r, r[1:], r[2:]))
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        self.seen = {(): self.n, **{(w,): c for w, c in self.counts[0].items()}, ("<s>",): len(rows)} | {h: c for h, c in self.counts[1].items() if h[1] != "</s>"}
        self.arcs = {(): {w: math.log10(c / (self.n + self.v)) for w, c in self.counts[0].items()}}
        self.fail = {}
        for length, worth in ((1, B.K2), (2, B.K3)):
            for gram, c in self.counts[length].items():
                h, w = gram[:-1], gram[-1]
                self.arcs.setdefault(h, {})[w] = math.log10((c + worth * 10 ** self.step(h[1:], w)[0]) / (self.seen[h] + worth))
            self.fail |= {h: math.log10(worth / (c + worth)) for h, c in self.seen.items() if len(h) == length}

    def step(self, state, w):
        total = 0.0
        while True:
            if state and state not in self.seen:
                state = state[1:]
            elif w in self.arcs.get(state, ()):
                return total + self.arcs[state][w], (*state, w)[-2:]
            elif not state:
                return total + (math.log10(self.v / (self.n + self.v)) if self.n else 0.0), (w,)
            else:
                total += self.fail[state]
                state = state[1:]

    def score(self, row):
        state, total = ("<s>",), 0.0
        for w in [*row, "</s>"]:
            weight, state = self.step(state, w)
            total += weight
        return total


@pytest.mark.parametrize("block", [20_000, B.BLOCK])
def test_table_equals_automaton(spark, block):
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    rows = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in zip(texts.doc_id, texts.text)}
    slow = Slow([r for i, r in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    got = B.scores(spark.read.parquet(f"{SF}/documents.parquet"), held(7, 2), block=block).collect() if block < B.BLOCK else QUERIES["op7_backoff_automaton"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert math.isclose(r.score, slow.score(rows[r.doc_id]), rel_tol=1e-9)


def held(modulus, remainder):
    return ~(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder)


def test_probabilities_sum_to_one():
    slow = Slow(["a b a c".split(), "b a c c".split(), "a a".split(), []])
    for state in [(), ("<s>",), ("a",), ("c", "c"), ("a", "c"), ("<s>", "a"), ("z",), ("z", "b")]:
        mass = sum(10 ** slow.step(state, w)[0] for w in (*slow.counts[0], "never seen"))
        assert math.isclose(mass, 1, rel_tol=1e-12)
        for w in (*slow.counts[0], "never seen"):  # the vectorised steps are the same
            h = state[-1:]
            word, one, two = slow.counts[0][w], slow.seen.get(h, 0) if h else 0, slow.seen.get(state, 0) if len(state) == 2 else 0
            grams = [slow.counts[1][(*h, w)] if h else 0, slow.counts[2][(*state, w)] if len(state) == 2 else 0]
            step = B.traverse(*(np.array([x], float) for x in (word,)), [np.array([one]), np.array([two])], [np.array([g]) for g in grams], slow.n, slow.v)
            assert math.isclose(step[0], slow.step(state, w)[0], rel_tol=1e-9)


@pytest.mark.parametrize("block", [40, B.BLOCK])
def test_awkward(spark, block):
    df = docs(spark, AWKWARD)
    got = B.scores(df, F.col("doc_id") != 4, block=block).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 1 and by[4].n_tokens == 4 and by[4].score == by[5].score and by[6].n_tokens == 30001
    r = B.scores(docs(spark, [(1, "new words")]), F.lit(False)).collect()[0]
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert B.scores(docs(spark, []), F.lit(True)).count() == 0


def test_slices(spark, monkeypatch):
    """Many slices give what one gives."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, B.scores(df, held(7, 2)).collect()))
    monkeypatch.setattr(B, "SLICE", 20_000)
    many = sorted(map(tuple, B.scores(df, held(7, 2), block=50_000).collect()))
    assert [x[:4] for x in one] == [x[:4] for x in many] and np.allclose([x[4:] for x in one], [x[4:] for x in many], rtol=1e-9)
