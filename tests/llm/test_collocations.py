"""Phrases against SQL over the whole table, and against a brute force over tiny shards, slices and batches."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import collocations as C
from skein.llm.queries import ORACLE_SQL, QUERIES

from .helpers import AWKWARD, SF01, docs

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, most=3, top=2000, percent=50):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, most + 1) for i in range(len(words) - m + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(100 * b >= percent * a for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op11_collocations"])
    rows = sorted(tuple(dict(zip(want.columns, r))[c] for c in COLUMNS) for r in want.fetchall())
    df = QUERIES["op11_collocations"](spark, SF01)
    assert df.columns == COLUMNS and dict(df.dtypes)["rank"] == "bigint" and got(df) == rows and len(rows) > 200


@pytest.fixture()
def tiny(monkeypatch):
    monkeypatch.setattr(C, "SHARD", 900)
    monkeypatch.setattr(C, "SLICE", 700)
    monkeypatch.setattr(C, "BATCH", 16)


def texts(seed, n=160):
    random.seed(seed)
    words = ["a", "A", "b", "über", "Über", "c", "d\x00", "e\x1c", "\x85", "漢"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? "]
    return [(random.choice(["en", "en", "en", "de", None]), "".join(random.choice(words) + random.choice(gaps) for _ in range(random.randint(0, 60)))) for _ in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.withColumns({k: F.lit("x") for k in ("shard", "words", "f", "a", "k", "rank", "n", "phrase", "size")})


@pytest.mark.parametrize("least,most,top,percent", [(10, 3, 2000, 50), (3, 5, 2000, 30), (2, 2, 7, 50), (1, 4, 50, 101)])
def test_equals_brute_force(spark, tiny, least, most, top, percent):
    rows = texts(least)
    rows += [("en", "over and over and over and over"), ("en", "x x x x x x x x x x x x"), ("fr", "un deux " * 500), (None, None), ("es", ""), ("es", ".,;")] + rows[:9]
    assert got(C.collocations(frame(spark, rows).repartition(3), least=least, most=most, top=top, percent=percent)) == brute(rows, least, most, top, percent)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14 + 7
    rows = [("en", 1, "p", big + 5), ("en", 1, "q", big + 11), ("en", 2, "p q", big), ("en", 1, "s", 2 * big), ("en", 2, "q s", big - 1), ("en", 3, "p q s", big - 9)]
    found = {r.phrase: r for r in C.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()}
    f = {p: n for _, _, p, n in rows}
    assert found["p q"].score == 1000000 * big * big // (f["p"] * f["q"]) == 999999
    cuts = [1000000 * f["p q s"] ** 2 // (f["p"] * f["q s"]), 1000000 * f["p q s"] ** 2 // (f["p q"] * f["s"])]
    assert (found["p q s"].score, found["p q s"].k) == min(zip(cuts, (1, 2)))


def test_bitmaps():
    rng = np.random.default_rng(1)
    owner = np.sort(rng.integers(0, 5, 400))
    place = np.concatenate([np.sort(rng.choice(1000, (owner == k).sum(), replace=False)) for k in range(5)])
    maps = C.Bitmaps.of(owner, place)
    back = maps.places()
    assert (back[0] == owner).all() and (back[1] == place).all() and (maps.popcounts(5) == np.bincount(owner)).all()
    moved = sorted(zip(*(x.tolist() for x in maps.shifted().places())))
    assert moved == sorted(zip(owner.tolist(), (place + 1).tolist()))


def test_awkward(spark):
    rows = [("en", t) for _, t in AWKWARD]
    assert got(C.collocations(docs(spark, AWKWARD), least=2)) == brute(rows, least=2)
    assert got(C.collocations(docs(spark, []))) == []
    assert got(C.collocations(docs(spark, [(1, None), (2, ""), (3, ",")]))) == []
