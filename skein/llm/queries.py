"""Queries over the driver's tables, one for each operator, with production parameters and whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_automaton, byte_bpe, chained_passages, collocations, edit_lines, html_wrapper, latent_decontamination, mpeg_audio, order_minhash, piece_bpe, prefix_trie, quality_classifier, secret_scan
from .common import table


def op1_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_lines.dedup_report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_classifier.train(docs, labels.filter(~held_out(5, 0)))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = backoff_automaton.scores(docs, ~held_out(7, 2))
    return scored.select("doc_id", F.coalesce(held_out(7, 2), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.learn(docs))


def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained_passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_columns(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), c - c % 100, F.crc32(c.cast("string")) % 6, most=5)


QUERIES = {f.__name__: f for f in (op1_edit_lines, op2_byte_bpe, op3_html_wrapper, op4_quality_classifier, op5_order_minhash, op6_latent_decontamination, op7_backoff_automaton, op8_secret_scan, op9_chained_passages, op10_mpeg_audio, op11_collocations, op12_piece_bpe, op13_prefix_trie)}

# crc32 of a decimal number, bit by bit; then prefixes as lists of turns, each exploded to all that it begins with
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
prefixes AS (
  SELECT conv_id, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS key FROM rebuilt
  UNION ALL SELECT conv_id, [] FROM convs),
ended AS (SELECT *, len(key) = MAX(len(key)) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
nodes AS (
  SELECT key, len(key) AS depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
         COALESCE(sha256(STRING_AGG(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256
  FROM ended GROUP BY key),
kids AS (SELECT key[1:depth - 1] AS key, COUNT(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
grown AS (SELECT n.*, COALESCE(k.n, 0) AS n_children, (n.n_convs - 1) * COALESCE(length(n.key[-1].t), 0) AS saved FROM nodes n LEFT JOIN kids k ON k.key = n.key),
sums AS (
  SELECT key[1:d] AS key, COUNT(*) FILTER (n_children = 0) AS n_leaves, SUM(saved) AS saved
  FROM (SELECT *, UNNEST(range(0, depth + 1)) AS d FROM grown) GROUP BY ALL)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON s.key = g.key LEFT JOIN nodes p ON g.depth > 0 AND p.key = g.key[1:g.depth - 1]
"""

# every run of one to three words of a piece, counted by text
PHRASE_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (
  SELECT lang, piece, UNNEST(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT lang, ROW_NUMBER() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)),
nexts AS (SELECT lang, w, LEAD(w) OVER following AS w2, LEAD(w, 2) OVER following AS w3 FROM worded WINDOW following AS (PARTITION BY piece ORDER BY i)),
runs AS (
  SELECT lang, 1 AS m, w AS phrase FROM nexts
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM nexts WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM nexts WHERE w3 IS NOT NULL),
counts AS (SELECT lang, m, phrase, COUNT(*) AS f FROM runs GROUP BY ALL),
words AS (SELECT lang, SUM(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, UNNEST(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, MAX(a) AS f
  FROM (SELECT *, UNNEST([1, 2]) AS i FROM candidates WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, w.n, r.score FROM ranked r JOIN words w ON w.lang = r.lang WHERE r.rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op11_collocations": PHRASE_SQL, "op13_prefix_trie": TRIE_SQL}
