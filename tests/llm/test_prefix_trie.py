"""The trie against its SQL, a brute force over prefix tuples, and shapes that would not scale if exploded whole."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from skein.llm import prefix_trie
from skein.llm.queries import ORACLE_SQL, QUERIES

from .helpers import SF01

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit("x") for k in ("depth", "digest", "n", "skip", "head", "part", "path", "i")})


def brute(rows, rebuild=True):
    """Conversations as tuples of turns, every prefix a key; sums over all nodes that begin with a key."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role or "", digest, text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        convs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
        ends[convs[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, found in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(found) - 1) * len(key[-1][1]) if key else 0
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def build(spark, rows):
    c = F.col("conv_id")
    return prefix_trie.trie(table(spark, rows), c - c % 100, F.crc32(c.cast("string")) % 6, most=5)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF01}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op13_prefix_trie"])
    rows = sorted(tuple(dict(zip(want.columns, r))[c] for c in COLUMNS) for r in want.fetchall())
    df = QUERIES["op13_prefix_trie"](spark, SF01)
    assert df.columns == COLUMNS and got(df) == rows and len(rows) > 300


def test_equals_brute_force(spark):
    random.seed(5)
    rows = []
    for c in random.sample(range(1, 900), 250):
        for turn in random.sample([None, *range(12)], random.randint(0, 9)):
            rows.append((c, turn, random.choice(["user", "assistant", None, ""]), random.choice(["a", "bb", "", None, "ccc é"])))
    rows += [(100, None, "user", "a"), (100, 1, None, None)] + [(c, t, "user", "hot") for c in range(5000, 5200) for t in range(3)]
    rows += rows[:40]  # repeated rows are turns too
    rows += [(None, 1, "user", "nobody")]
    random.shuffle(rows)
    assert got(build(spark, rows)) == brute(rows)
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows, rebuild=False)


def test_long_and_comb_shaped(spark, monkeypatch):
    """A conversation of 300 turns and others that leave it at each of 60 depths; sums cross blocks of depths."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(1000, t, "user", f"t{t % 7}") for t in range(300)]
    for k in range(60):
        rows += [(1001 + k, t, "user", f"t{t % 7}") for t in range(k * 5)] + [(1001 + k, k * 5, "user", "leaves")]
    rows += [(c, 0, "user", "one") for c in range(2000, 2020)]
    want = brute(rows, rebuild=False)
    assert got(prefix_trie.trie(table(spark, rows))) == want
    assert max(r[5] for r in want) == 62


def test_paths_bound_the_rows(spark):
    """Paths above a node are few: members halve from one to the next."""
    rows = [(c, d, "user", str(c >> d & 1)) for c in range(256) for d in range(8)]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows, rebuild=False)


def test_nothing(spark):
    assert got(prefix_trie.trie(table(spark, []))) == []
    assert got(prefix_trie.trie(table(spark, [(None, 1, "user", "x")]))) == []
    assert got(build(spark, [(7, None, None, None)])) == brute([(7, None, None, None)])
