import random

import pandas as pd
import pytest

from skein.llm import links, order_minhash
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF01, docs


def lcs_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j], keep)
            last = keep
    return row[-1]


def test_runs_are_a_shortest_script():
    random.seed(5)
    for _ in range(400):
        a, b = random.choices("abcd", k=random.randint(0, 14)), random.choices("abcd", k=random.randint(0, 14))
        if random.random() < 0.5:
            b = a[:]
            for _ in range(random.randint(0, 3)):
                b.insert(random.randint(0, len(b)), "z")
        got = order_minhash.runs(a, b, 40)
        common = lcs_words(a, b)
        assert sum(got) == common, (a, b, got)
        edits = len(a) + len(b) - 2 * common
        assert (order_minhash.runs(a, b, edits - 1) is None) if edits else True


def brute(rows):
    """Classes by comparing all pairs that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    index = {}
    for t in texts:
        w = t.lower().split()
        for s in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}:
            index.setdefault(s, []).append(t)
    done = set()
    for group in index.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    if find(a) != find(b) and order_minhash.alike(a, b):
                        root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        if i is not None:
            c = find(t or "")
            low[c] = min(low.get(c, i), i)
    return sorted((str(i), low.get(find(t or ""))) for i, t in rows)


def test_classes_equal_brute_force(spark):
    texts = pd.read_parquet(f"{SF01}/documents.parquet")
    got = sorted((str(r.doc_id), r.class_id) for r in QUERIES["op5_order_minhash"](spark, SF01).collect())
    assert got == brute(list(zip(texts.doc_id.tolist(), texts.text)))


def test_awkward(spark):
    got = order_minhash.classes(docs(spark, AWKWARD)).collect()
    assert sorted((str(r.doc_id), r.class_id) for r in got) == brute(AWKWARD)
    assert order_minhash.classes(docs(spark, [])).count() == 0


def test_hot_groups(spark):
    """A large group of near copies, and a large group that shares a passage without being alike."""
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(100)]
    rows = []
    for i in range(90):
        w = base[:]
        w[random.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    for i in range(100, 220):
        rows.append((i, " ".join(passage + [word() for _ in range(60)])))
    near = [*passage, *[word() for _ in range(60)]]
    rows += [(300, " ".join(near)), (301, " ".join([*near[:-2], word(), word()]))]
    got = sorted((str(r.doc_id), r.class_id) for r in order_minhash.classes(docs(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(3, 1), (2, 3), (9, 8), (8, 7), (5, 5), (7, 9)], [(i, i * 7 % 101) for i in range(1, 101)]])
def test_components(spark, edges):
    got = {r.id: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    assert set(got) == set(root)
    assert len({(got[x], find(x)) for x in root}) == len({find(x) for x in root}) == len(set(got.values()))


def test_near_is_exact():
    import numpy as np

    random.seed(15)
    sets = [np.unique(np.array(random.sample(range(60), random.randint(1, 50)), np.uint64)) for _ in range(40)]
    got = order_minhash.near([x.tobytes() for x in sets[:25]], [x.tobytes() for x in sets[15:]])
    for i, a in enumerate(sets[:25]):
        for j, b in enumerate(sets[15:]):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert got[i, j] == (both >= 0.8 * (len(a) + len(b) - both) - 1e-9)
