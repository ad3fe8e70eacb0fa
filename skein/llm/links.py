"""Links between members of buckets, and connected components, without all pairs of a bucket.

Round one compares each member with its bucket's leader (the lowest id). What then still has members of different
components in one bucket is compared across components: small buckets by a join; large ones in blocks, each pair of
blocks in a task of its own that returns no more links than join its components. Pairs inside a component add nothing;
so the components are those of all pairs, and no row is made for a pair of a large bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SMALL = 16  # members of a bucket that a join compares
BLOCK = 64  # least members of a block of a large bucket; blocks grow as the root of the bucket


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (a, b): root is some id of its component, the same for all. Each round hooks every id to its lowest neighbour, follows the hooks once, and contracts; a round at least halves what has links."""
    edges, maps = written(ordered(edges), "edges"), []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("root"))
        above = hook.select(F.col("id").alias("root"), F.col("root").alias("top"))
        hook = written(hook.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "hooks")
        maps.append(hook)
        to_a, to_b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        edges = written(ordered(edges.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0]
    for more in maps[1:]:
        out = out.join(more.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return written(out, "roots") if len(maps) > 1 else out


def leaders(members: DataFrame) -> DataFrame:
    """(key, leader, n) of the buckets of two or more in (key, id); a row for each member at most."""
    return members.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")


def joining(hit: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the true places (i, j) of a matrix, as many as join the components x[i] and y[j]."""
    root: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := root.get(r, r)) != r:
            root[r] = root.get(up, up)
            r = up
        return r

    out = []
    i, j = np.nonzero(hit & (x[:, None] != y[None, :]))
    _, first = np.unique(np.stack([x[i], y[j]]), axis=1, return_index=True)
    for k in np.sort(first).tolist():
        a, b = find(int(x[i[k]])), find(int(y[j[k]]))
        if a != b:
            root[a] = b
            out.append((int(i[k]), int(j[k])))
    return out


def across(members: DataFrame, payload: Callable[[DataFrame], DataFrame], near: Callable[[list, list], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """From members (key, id, root): pairs (a, b) of different components in small buckets, still to be verified, and
    verified links (a, b) from large ones.

    payload(ids) gives (id, data binary) for the ids in large buckets; near(x, y) tells from two lists of such data
    which pairs are alike, as a boolean matrix.
    """
    mixed = members.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).filter("r1 <> r2").select("key", "n")
    left = written(members.join(mixed, "key"), "mixed")
    small = left.filter(f"n <= {SMALL}")
    x, y = small.select("key", F.col("id").alias("a"), F.col("root").alias("ra")), small.select("key", F.col("id").alias("b"), F.col("root").alias("rb"))
    pairs = ordered(x.join(y, "key").filter("a < b and ra <> rb").select("a", "b"))

    large = left.filter(f"n > {SMALL}").withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), 8 * F.sqrt("n"))).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    large = large.join(payload(large.select("id").distinct()), "id")
    dealt = large.select("key", "id", "root", "data", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "data", "own")

    def compare(rows: pa.Table) -> pa.Table:
        own, ids, roots = (rows.column(c).to_numpy() for c in ("own", "id", "root"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        one, two = (np.flatnonzero(own == k) for k in (i, j))
        links: list = []
        if len(one) and len(two):
            data = rows.column("data").to_pylist()
            hit = near([data[k] for k in one], [data[k] for k in two])
            links = joining(hit, roots[one], roots[two])
        return pa.table({"a": pa.array([ids[one[p]] for p, _ in links], pa.int64()), "b": pa.array([ids[two[q]] for _, q in links], pa.int64())})

    # a block is few bytes and much work: without a number of its own, the partitions would be coalesced by their bytes
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs, ordered(dealt.repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))
