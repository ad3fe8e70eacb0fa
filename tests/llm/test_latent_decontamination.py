import random

import numpy as np
import pandas as pd

from skein.llm import latent_decontamination as L
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF01, docs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j], keep)
            last = keep
    return row[-1]


def test_table_equals_brute_force(spark):
    """Every document that holds an item's words in a row is found, and no document that shares few runs of it."""
    texts, items = pd.read_parquet(f"{SF01}/documents.parquet"), pd.read_parquet(f"{SF01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_latent_decontamination"](spark, SF01).collect()}
    whole, some = set(), set()
    for i, t in zip(texts.doc_id, texts.text):
        w = L.words_of(t)
        grams = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for j, item in zip(items.item_id, items.text):
            v = L.words_of(item)
            if len(v) >= L.LEAST:
                share = np.mean([tuple(v[k : k + 4]) in grams for k in range(len(v) - 3)])
                whole |= {(i, j)} if share >= 0.9 else set()
                some |= {(i, j)} if share >= 0.3 else set()
    assert len(whole) > 15 and whole <= got <= some


def test_paraphrases(spark):
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 9))) for _ in range(3000)]
    common = vocabulary[:40]
    text = lambda n: [random.choice(common) if random.random() < 0.4 else random.choice(vocabulary) for _ in range(n)]
    items = [(k, text(random.randint(16, 120))) for k in range(60)]
    rows, planted = [], set()
    for i in range(300):
        w = text(random.randint(50, 400))
        if i % 5 == 0:
            k, item = random.choice(items)
            change = random.choice([0, 0.1, 0.25])
            new = [random.choice(vocabulary) if random.random() < change else x for x in item]
            at = random.randrange(len(w))
            w[at:at] = new
            planted.add(i)
        rows.append((i, " ".join(w)))
    benchmark = spark.createDataFrame([(k, " ".join(w).upper() + ".") for k, w in items], "item_id long, text string")
    found = {r.doc_id for r in L.leaks(docs(spark, rows), benchmark).collect()}
    assert not found - planted and len(found & planted) >= 0.9 * len(planted)
    left = L.decontaminate(docs(spark, rows), benchmark)
    assert left.columns == docs(spark, rows).columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - found


def test_covered_is_a_common_subsequence():
    random.seed(12)
    for _ in range(300):
        a, b = (np.array(random.choices(range(6), k=random.randint(8, 20)), np.int32) for _ in range(2))
        share, x, y = L.covered(a, b)
        width = len(a) + max(4, len(a) // 2)
        assert 0 <= x <= y <= len(b) and round(share * len(a)) == lcs(a.tolist(), b[x:y].tolist())
        if len(b) <= width:
            assert round(share * len(a)) == lcs(a.tolist(), b.tolist())


def test_svd(spark):
    rng = np.random.default_rng(3)
    low = rng.standard_normal((50, 6)) @ rng.standard_normal((6, 30))
    rows = spark.createDataFrame([(list(range(30)), [float(x) for x in r]) for r in low], "ids array<int>, weights array<double>").repartition(4)
    basis = L.randomised_svd(rows, 30, 6)
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-4)
    assert np.linalg.norm(low - low @ basis @ basis.T) < 1e-3 * np.linalg.norm(low)


def test_blocks_and_awkward(spark, monkeypatch):
    items = [(1, None), (2, ""), (3, "too short"), (4, "wörd " * 40), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (None, "k l m n o p q r s t u v")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*AWKWARD, (20, "x y z a b c d e f g h i j x y z"), (21, "k l m n o p q r s t u v")]
    for size in (512, 2):
        monkeypatch.setattr(L, "BLOCK", size)
        got = {(r.doc_id, r.item_id) for r in L.leaks(docs(spark, rows), benchmark).collect()}
        assert got == {(6, 4), (20, 5), (21, None)}
    assert L.leaks(docs(spark, []), benchmark).count() == 0
    assert L.leaks(docs(spark, rows), benchmark.limit(0)).count() == 0


def test_many_changed_words_equal_brute_force(spark):
    """Items with up to half of their words replaced: what the checks accept anywhere in a text, the search finds."""
    random.seed(18)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 9))) for _ in range(3000)]
    unknown = lambda: "".join(random.choices("qrstuvwxyz", k=8))
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(16, 60)))) for k in range(200)]
    rows = []
    for i in range(240):
        w = random.choices(vocabulary, k=random.randint(50, 400))
        item = random.choice(items)[1].split()
        change = random.choice([0.2, 0.3, 0.4, 0.5])
        at = random.randrange(len(w))
        w[at:at] = [unknown() if random.random() < change else x for x in item]
        rows.append((i, " ".join(w)))
    df = docs(spark, rows)
    got = {(r.doc_id, r.item_id) for r in L.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    index = L.build(df, items, "text", *L.frequencies(df, "text"))
    assert index.basis.shape[1] <= len(index.passages) // 2  # a reduction
    want = set()
    for i, text in rows:
        ids = L.numbers(text, index.vocabulary)
        for p, (item, words) in enumerate(index.passages):
            if np.isin(words, ids).mean() >= L.PARAPHRASED:
                share, x, y = L.covered(words, ids)
                answered = len(index.answers[p] & set(ids[x:y].tolist())) * 2 > len(index.answers[p])
                if share >= L.COVERED or share >= L.PARAPHRASED and answered:
                    want.add((i, item))
    print(len(want), len(got), len(got & want))
    assert len(want) > 120 and len(got & want) >= 0.95 * len(want) and not got - want


def test_frequencies_equal_brute_force(spark):
    """Documents are counted once a word, whatever their white space, marks and length; words are hashed by arrays, not one by one."""
    random.seed(22)
    vocabulary = ["wörd", "_", "x" * 300, *("".join(random.choices("abcdefghijklmnop", k=5)) for _ in range(400))]
    texts = [" \t".join(random.choices(vocabulary, k=random.choice([0, 1, 30, 500]))) + random.choice([" ", "", "\n,;", "\x0b.\x0c"]) for _ in range(300)]
    seen, n = L.frequencies(docs(spark, [*enumerate(texts), (-1, None), (-2, " ".join(vocabulary * 40))]), "text")
    words = [set(L.words_of(t)) for t in (*texts, " ".join(vocabulary))]
    every = sorted(set().union(*words))
    at = L.cells(L.hashed(b" ".join(every)))
    assert n == len(texts) + 2 and len(set(at.tolist())) > len(every) - 3
    for w, cell in zip(every, at.tolist()):
        same = {v for v, c in zip(every, at.tolist()) if c == cell}
        assert seen[cell] == sum(bool(same & one) for one in words), w
    assert seen.sum() == sum(seen[c] for c in set(at.tolist()))


def test_all_passages_shape_the_space(spark, monkeypatch):
    """The basis is that of the passages of all documents and items, however they are dealt and batched."""
    random.seed(21)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=5)) for _ in range(60)]
    rows = [(i, " ".join(random.choices(vocabulary[: 10 + i % 50], k=random.choice([0, 5, 70, 300])))) for i in range(200)]
    items = [(k, " ".join(random.choices(vocabulary, k=40))) for k in range(20)]
    df = docs(spark, rows)
    frequencies = L.frequencies(df, "text")
    index = L.build(df.repartition(7), items, "text", *frequencies)
    matrix = []
    for _, text in rows + items:
        ids = L.numbers(text, index.vocabulary)
        for a in range(0, len(ids), L.PASSAGE):
            known = [x for x in ids[a : a + L.PASSAGE] if x >= 0]
            if len(known) >= L.LEAST:
                matrix.append(np.bincount(known, minlength=len(index.vocabulary)) * index.idf)
    a = np.array(matrix)
    start = np.linalg.qr(np.random.default_rng(1).standard_normal((a.shape[1], index.basis.shape[1])).astype(np.float32))[0]
    own = a[-len(items) :]  # an item is one passage here
    for _ in range(L.POWER + 1):
        start = np.linalg.qr(own.T @ (own @ start))[0]
    want = np.linalg.qr(a.T @ (a @ start))[0]
    got = index.basis / index.idf[:, None]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)
    monkeypatch.setattr(L, "TOGETHER", 100)
    again = L.build(df, items, "text", *frequencies).basis / index.idf[:, None]
    assert np.allclose(got @ got.T, again @ again.T, atol=1e-3)
