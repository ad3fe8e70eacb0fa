import random

import pandas as pd
import pytest

from skein.llm import edit_lines as E
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF, docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(line, n):
    for _ in range(n if line else 0):
        i, kind = random.randrange(max(1, len(line))), random.randrange(3)
        line = line[:i] + (random.choice("xyzé") if kind else "") + line[i + (kind != 1) :]
    return line


def test_within_equals_edit_distance():
    random.seed(7)
    for _ in range(3000):
        a = "".join(random.choices("ab", k=random.randint(0, 12)))
        b = edited(a, random.randint(0, 4)) if a and random.random() < 0.7 else "".join(random.choices("ab", k=random.randint(0, 12)))
        for k in (1, 2, 3):
            assert E.within(a, b, k) == (distance(a, b) <= k), (a, b, k)
    long = "".join(random.choices("abcdefgh", k=400))
    for n in range(6):
        b = edited(long, n)
        assert E.within(long, b, 2) == (distance(long, b) <= 2)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segments_lose_no_match(edits):
    random.seed(8)
    for _ in range(1500):
        a = "".join(random.choices("abc", k=random.randint(24, 40)))
        b = edited(a, random.randint(0, edits))
        if min(len(a), len(b)) < E.FUZZY or distance(a, b) > edits:
            continue
        short, long = sorted((a, b), key=len)
        index = {(short[x:y], s) for x, y, s in E.plan(len(short), edits, E.FUZZY)[0]}
        probes = {(long[x:y], s) for part in E.plan(len(long), edits, E.FUZZY) for x, y, s in part}
        assert index & probes


def brute(rows, edits=2):
    """(doc, pos) of the lines that stay."""
    seen, lines = {}, []
    for i, t in rows:
        if t is not None:
            for pos, line in enumerate(t.split("\n")):
                lines.append(((i is not None, i or 0), pos, line))
    texts = sorted({x for _, _, x in lines if len(x.strip(" ")) >= E.LEAST})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    fuzzy = [t for t in texts if len(t) >= E.FUZZY]
    for i, a in enumerate(fuzzy):
        for b in fuzzy[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and find(a) != find(b) and E.within(a, b, edits):
                root[find(a)] = find(b)
    for doc, pos, line in lines:
        if line in root:
            c = find(line)
            seen[c] = min(seen.get(c, (doc, pos)), (doc, pos))
    return [(doc, pos, line) for doc, pos, line in lines if line not in root or seen[find(line)] == (doc, pos)]


def kept(rows, edits=2):
    out = {}
    for doc, _, line in brute(list(dict.fromkeys(rows)), edits):
        out.setdefault(doc, []).append(line)
    return sorted((str(i), "\n".join(out.get((i is not None, i or 0), [])) if t is not None else None) for i, t in dict.fromkeys(rows))


def test_table_equals_brute_force(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    rows = list(zip(texts.doc_id.tolist(), texts.text))
    got = sorted((str(r.doc_id), r.text) for r in E.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == kept(rows)
    n = {}
    for doc, _, _ in brute(rows):
        n[doc[1]] = n.get(doc[1], 0) + 1
    for r in QUERIES["op1_edit_lines"](spark, SF).collect():
        assert r.n_lines - r.n_duplicates == n.get(r.doc_id, 0) and len(r.duplicates) == r.n_duplicates


def test_near_lines_and_hot_bucket(spark):
    random.seed(9)
    base = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(i, "unique start " + str(random.random()) + "\n" + edited(base, 2)) for i in range(60)]
    rows += [(100 + i, base[:20] + "".join(random.choices("qrst", k=39))) for i in range(50)]
    chain = "a line that changes a little bit by bit 0000000000"
    rows += [(200 + i, chain[: -i - 1] + "1" * (i + 1)) for i in range(8)]
    got = sorted((str(r.doc_id), r.text) for r in E.dedup_lines(docs(spark, rows)).collect())
    assert got == kept(rows)


def test_awkward(spark):
    rows = [*AWKWARD, (9, "short\n\n\nshort\n" + "x" * 50 + "\n" + "x" * 49)]
    got = E.dedup_lines(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns and got.count() == len(rows)
    assert sorted({(str(r.doc_id), r.text) for r in got.collect()}, key=str) == sorted(kept(rows), key=str)
    assert E.dedup_lines(docs(spark, [])).count() == 0
    report = {r.doc_id: r for r in E.dedup_report(docs(spark, rows)).collect()}
    assert (report[1].n_lines, report[2].n_lines, report[7].n_duplicates, report[9].n_duplicates) == (0, 1, 4, 1)


@pytest.mark.parametrize("doc", [None, 7])
def test_rows_without_an_id_of_their_own(spark, doc):
    """Rows that share an id, or have none, lose their own repeated lines only, and one of them keeps a line that both begin with."""
    line = [f"line number {k} that no other text has {k * 7919}" for k in range(8)]
    shared, again = "a line that some texts hold at other places", "a line that two texts hold at the same place"
    rows = [(doc, "\n".join([line[0], shared, line[1]])), (doc, "\n".join([line[2], line[3], shared])), (doc, "\n".join([line[4], line[5], line[6]])), (doc, again + "\n" + line[7]), (doc, again)]
    got = sorted(r.text for r in E.dedup_lines(docs(spark, rows)).collect())
    lines = [x for t in got for x in t.split("\n")]
    assert len(got) == 5 and all(lines.count(x) == 1 for x in [*line, shared, again])
    assert sum(r.n_duplicates for r in E.dedup_report(docs(spark, rows)).collect()) == 2
