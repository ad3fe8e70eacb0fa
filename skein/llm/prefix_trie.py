"""A prefix trie of conversations by chained digests.

The digest of a prefix is the SHA-256 of the digest of the prefix before it and of the last turn's (role, text); so equal
digests are equal prefixes. Every prefix of every conversation is a row, and the rows of one (depth, digest) are a node.
Sums over subtrees come from exploding nodes to their ancestors, over paths: of a node's children the one with the most
members goes on the node's path, each other one begins a path. A path has one leaf, and above a node there are at most
log2(conversations) + 1 paths, as members at least halve from path to path; so each path is exploded to that many
ancestors, however deep the trie is. Along a path, sums run from its end upwards.

Scale: texts become digests in the task that reads them and are not shuffled. The digests of a conversation are a chain,
so its turns stream through one task, sorted, 32 bytes each, in constant memory; nothing is collected by conversation.
Nodes are aggregations with partial sums (the root has every conversation). The ids that end at one node are joined in
runs of bounded size first, and a node's runs stream, sorted, through one hash. Running sums over a long path are made in
blocks of depths. Joins with the parent of very many children are sort-merge joins, which Spark splits where they are skewed.

Defined results: turns are ordered by turn (null first), equal ones by role and then by the digest of role and text, so
repeated rows follow each other and count as turns; null roles and texts are empty; rows without a conv_id belong to no
conversation and are left out; an empty table gives no rows, not even a root; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, text_of, written

RUN = 4096  # ids of one run are those that agree beyond this many
BLOCK = 1024  # depths of a block of a running sum
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest() -> Column:
    """Of (role, text): the role's length first, so that no two pairs are one string."""
    role, text = text_of("role"), text_of("text")
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, t, n): t is the digest of role and text, n the code points of the text."""
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"), turn_digest().alias("t"), F.length(text_of("text")).cast("long").alias("n"))


def rebuilt(turns: DataFrame, head: Column, take: Column, most: int) -> DataFrame:
    """Conversations whose first `take` turns (`most` at most) are those of the conversation `head`: rows (conv_id, part, i,
    turn, role, t, n, skip) with part 0 for the conversation itself, 1 for the i-th turn of the head, 2 for own ones, of which
    the first `skip` are to be left out. take and head are columns over conv_id."""
    own = turns.withColumn("skip", take.cast("int"))
    every = turns.select("conv_id").distinct().withColumn("head", head).withColumn("skip", take.cast("int"))
    heads = turns.join(every.select(F.col("head").alias("conv_id")).distinct(), "conv_id", "left_semi")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "t")
    firsts = heads.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most).select(F.col("conv_id").alias("head"), "i", "t", "n")
    given = every.join(firsts, "head").filter("i <= skip")
    rows = own.withColumns({"part": F.lit(2), "i": F.lit(0)})
    rows = rows.unionByName(given.drop("head").withColumn("part", F.lit(1)), allowMissingColumns=True)
    return rows.unionByName(every.drop("head").withColumns({"part": F.lit(0), "i": F.lit(0)}), allowMissingColumns=True)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, n, ends): a row for each prefix of each conversation, the empty one included. n: code
    points of the last turn's text; ends: whether the conversation has no further turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("n", pa.int64()), ("ends", pa.bool_())])

    def chain(batches: Batches) -> Batches:
        root = hashlib.sha256(b"").digest()
        last, skipped = None, 0  # the last prefix, which ends its conversation unless a turn follows
        for batch in batches:
            out = []
            for conv, part, t, n, skip in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    if last:
                        out.append((*last, True))
                    last, skipped = (conv, 0, root, None, 0), 0
                elif part == 2 and skipped < skip:
                    skipped += 1
                else:
                    out.append((*last, False))
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + t).digest(), last[2], n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*last, True), schema, strict=True)], schema=schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i", F.asc_nulls_first("turn"), "role", "t")
    return dealt.select("conv_id", "part", "t", "n", "skip").mapInArrow(chain, "conv_id long, depth long, digest binary, parent binary, n long, ends boolean")


def end_digests(found: DataFrame) -> DataFrame:
    """(digest, ends_sha256): of the decimal ids that end at a node, ascending, joined by commas."""
    run = F.floor(F.col("conv_id") / RUN)
    runs = found.filter("ends").groupBy("digest", run.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def join(batches: Batches) -> Batches:
        node, digest, done = None, None, ([], [])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["digest", "ends_sha256"])
            done[0].clear()
            done[1].clear()
            return batch

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done[0].append(node)
                        done[1].append(digest.hexdigest())
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield flush()
        if node is not None:
            done[0].append(node)
            done[1].append(digest.hexdigest())
            yield flush()

    return runs.repartition("digest").sortWithinPartitions("digest", "run").select("digest", "ids").mapInArrow(join, "digest binary, ends_sha256 string")


def below(rows: DataFrame) -> DataFrame:
    """rows (path, depth, leaves, saved, ...) with the sums over all rows of the path that are as deep or deeper, in blocks of depths."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    up = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("l").over(up), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(up), F.lit(0)).alias("s"))
    inside = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"leaves": F.sum("leaves").over(inside), "saved": F.sum("saved").over(inside)}).join(blocks, ["path", "block"]).withColumns({"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}).drop("l", "s", "block")


def trie(conversations: DataFrame, head: Column | None = None, take: Column | None = None, most: int = 0) -> DataFrame:
    """A row for each node of the trie of the conversations (conv_id, turn, role, text): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. With head and take, conversations are
    rebuilt first (see rebuilt); without, they are taken as they are."""
    turns = written(turns_of(conversations), "turns")
    rows = rebuilt(turns, F.col("conv_id") if head is None else head, F.lit(0) if take is None else take, most)
    found = written(prefixes(rows), "prefixes")

    nodes = found.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n").alias("n"))
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n")), "nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"), F.max_by("digest", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    nodes = nodes.join(kids, "digest", "left").join(end_digests(found), "digest", "left")
    nodes = written(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))}), "grown")
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    nodes = nodes.drop("heavy").join(above, "parent", "left")
    begins = F.col("parent").isNull() | (F.col("digest") != F.col("heavy"))
    nodes = written(nodes.withColumn("begins", begins).drop("heavy", "parent"), "linked")

    # down the conversation that stands for a node: the paths that it passes
    walked = found.select(F.col("conv_id").alias("walker"), "digest").join(nodes.select(F.col("conv_id").alias("walker")).distinct(), "walker", "left_semi")
    walked = walked.join(nodes.select("digest", "depth", "conv_id", "begins", "saved"), "digest")
    down = Window.partitionBy("walker").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.collect_list(F.when(F.col("begins"), F.struct("depth", "digest"))).over(down)
    walked = written(walked.withColumn("passed", passed).filter("walker = conv_id"), "walked")
    path = F.element_at("passed", -1)["digest"]
    own = walked.select(path.alias("path"), "depth", "digest", "saved")
    whole = own.groupBy("path").agg(F.sum("saved").alias("saved"))

    # each path to all paths above it, where it hangs
    begun = walked.filter("begins").select(F.col("digest").alias("path"), "passed").join(whole, "path")
    hung = begun.select("saved", "passed", F.explode(F.sequence(F.lit(1), F.size("passed"))).alias("i")).filter("i < size(passed)")
    hung = hung.select(F.element_at("passed", F.col("i"))["digest"].alias("path"), (F.element_at("passed", F.col("i") + 1)["depth"] - 1).alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(1).cast("long").alias("leaves"), "saved")
    hung = hung.groupBy("path", "depth", "digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = below(own.withColumn("leaves", F.lit(0).cast("long")).unionByName(hung)).filter("digest is not null")
    out = nodes.drop("saved").join(sums.select("digest", (F.col("leaves") + 1).alias("n_leaves"), F.col("saved").alias("saved_tokens")), "digest")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
