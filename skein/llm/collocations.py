"""Phrases whose words occur together, mined from position bitmaps.

Texts are packed into shards. Each word of a language has a bitmap of its places in the shard, compressed to the blocks of
64 places that are not empty; pieces have a place without a word between them. A phrase's bitmap has a bit at the place
of each occurrence's last word: shifted by one place and ANDed with the bitmap of a further word, it is the bitmap of
the longer phrase, and its popcount the occurrences. As a place has one word, the bitmaps of words do not overlap; so
one look at the words of the shifted bits is the AND with all of them at once. Phrases are extended depth-first, a bounded
batch of first words at a time, and only over pairs of words that are frequent in the whole corpus, which every frequent
phrase consists of.

Scale: whether a word or a pair is frequent is asked with codes, hashes cut to 4 bits more than the corpus has bytes: a shard
hands on its different codes, sorted and packed, with popcounts; the codes of a slice of the code space meet in a group (as
many slices as bound its size) and one bit for each goes back. A code in two uses can only let a rare phrase pass this test,
which costs its bytes. What passes is
counted exactly, as strings, over the shards' popcounts, so no count depends on hashes: a shard's phrases go to the slices of
the code space, packed in their order, where one prefix follows another, and a slice adds them up. Scores, containment and
ranks are joins and aggregations over phrases that are frequent; each task keeps the best of a language before ranks are shuffled.

Defined results: a null text is empty, a null language is `und`; languages are compared as they are written; repeated
rows count as often as they are there; an empty table gives no rows; equal scores and counts are ranked by phrase in the order
of UTF-8 bytes; other columns of the input are ignored. Counts up to 10^15 are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backoff_automaton import FACTOR, pack, unpack
from .common import Batches, text_of, written
from .order_minhash import mixed

SHARD = 14_000_000  # bytes of text
SLICE = 16_000_000  # bytes of text for each slice of the code space
BATCH = 1 << 18  # places that are extended at once
GAP = b"."  # between pieces
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + GAP * 10)


class Bitmaps(NamedTuple):
    """Bitmaps of owners, a row for each block of 64 places that is not empty."""

    owner: np.ndarray
    block: np.ndarray
    mask: np.ndarray

    @staticmethod
    def of(owner: np.ndarray, place: np.ndarray) -> Bitmaps:
        """From (owner, place) in ascending order."""
        block, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])][: len(owner)])
        return Bitmaps(owner[first], block[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit)

    def popcounts(self, owners: int) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.mask), owners).astype(np.int64)

    def shifted(self) -> Bitmaps:
        """One place on; a bit that leaves its block is a row of the next one."""
        out = self.mask << np.uint64(1)
        stay, carry = out != 0, np.flatnonzero(self.mask >> np.uint64(63))
        return Bitmaps(np.r_[self.owner[stay], self.owner[carry]], np.r_[self.block[stay], self.block[carry] + 1], np.r_[out[stay], np.ones(len(carry), np.uint64)])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(owner, place) of every bit."""
        owners, places = [self.owner[:0]], [np.zeros(0, np.int32)]
        for at in range(0, len(self.mask), 1 << 16):
            part = slice(at, at + (1 << 16))
            bits = np.unpackbits(self.mask[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            owners.append(self.owner[part][row])
            places.append(((self.block[part][row] << 6) + bit).astype(np.int32))
        return np.concatenate(owners), np.concatenate(places)


class Words(dict):
    """Numbers of a language's words in a shard; 0 is the gap."""

    def __init__(self, lang: int, every: list[tuple[int, bytes]]):
        super().__init__({GAP: 0})
        self.lang, self.every = lang, every

    def __missing__(self, word: bytes) -> int:
        self.every.append((self.lang, word))
        self[word] = out = len(self.every)
        return out


def shards(docs: DataFrame, lang_col: str, text_col: str, size: int) -> DataFrame:
    """(shard, size, langs, words, of, lang, owner, block, mask): the vocabulary and the bitmaps of neighbouring texts, packed.
    words has the words joined by spaces, `of` the number of each one's language; lang and tokens count a language's words."""

    def run(batches: Batches) -> Batches:
        number, press = 0, zstandard.ZstdCompressor(level=3).compress

        def row(x: list[int], every: list, langs: dict[str, Words], bytes_: int) -> pa.RecordBatch:
            nonlocal number
            key = (TaskContext.get().partitionId() << 32) + number
            number += 1
            x = np.array(x, np.int32)
            order = np.argsort(x, kind="stable").astype(np.int32)
            order = order[np.searchsorted(x[order], 1) :]
            maps = Bitmaps.of(x[order], order)
            lang = np.array([k for k, _ in every], np.int64)
            tokens = np.bincount(lang, maps.popcounts(len(every) + 1)[1:], len(langs)).astype(np.int64)
            packed = [press(b" ".join([w for _, w in every])), pack(lang), pack(np.diff(maps.owner, prepend=0)), pack(np.diff(maps.block.astype(np.int64), prepend=0)), pack(maps.mask)]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([bytes_], pa.int64()), pa.array([list(langs)], pa.list_(pa.string())), pa.array([tokens.tolist()], pa.list_(pa.int64())), *[pa.array([z], pa.binary()) for z in packed]], ["shard", "size", "langs", "tokens", "words", "of", "owner", "block", "mask"])

        x, every, langs, held = [], [], {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                words = langs.setdefault(lang, Words(len(langs), every))
                x.extend(map(words.__getitem__, raw.translate(TABLE).replace(GAP, b" . ").split()))
                x.append(0)
                held += len(raw) + 1
                if held >= size:
                    yield row(x, every, langs, held)
                    x, every, langs, held = [], [], {}, 0
        if held:
            yield row(x, every, langs, held)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "shard long, size long, langs array<string>, tokens array<long>, words binary, of binary, owner binary, block binary, mask binary")


class Shard:
    """A shard as its bitmaps, the word of each place, and the pairs of neighbouring words with their codes."""

    def __init__(self, langs: list[str], words: bytes, of: bytes, owner: bytes, block: bytes, mask: bytes):
        names = zstandard.decompress(words).split(b" ") if len(unpack(of)) else []
        self.langs = pa.array(langs, pa.string())
        self.lang = np.r_[0, unpack(of).astype(np.int64)]
        self.names = pa.array([b"", *names], pa.binary()).cast(pa.string())
        prefix = [lang.encode() + b" " for lang in langs]
        self.code = np.array([0, *(xxhash.xxh3_64_intdigest(prefix[k] + w) for k, w in zip(self.lang[1:].tolist(), names, strict=True))], np.uint64)
        maps = Bitmaps(np.cumsum(unpack(owner).view(np.int64), dtype=np.int32), np.cumsum(unpack(block).view(np.int64), dtype=np.int32), unpack(mask))
        owner, place = maps.places()
        self.word = np.zeros(int(place.max(initial=-1)) + 2, np.int32)  # 0 behind the last place
        self.word[place] = owner
        del owner, place
        self.counts = maps.popcounts(len(self.code))
        # of pairs: each bitmap of a word shifted, against those of all words; by their numbers, the second word's place
        maps = maps.shifted()
        owner, place = maps.places()
        del maps
        there = self.word[place] > 0
        owner, place = owner[there], place[there]
        pair = owner.astype(np.int64) * len(self.code) + self.word[place]
        del owner, there
        order = np.lexsort((place, pair))
        pair, self.place = pair[order], place[order]
        del order, place
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        self.pair_counts = np.diff(np.r_[first, len(pair)])
        self.one, self.two = np.divmod(pair[first], len(self.code)) if len(first) else (pair, pair)

    def coded(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words and of pairs: the different codes in ascending order, their counts, and the number among them of each."""
        for code, count in ((self.code[1:], self.counts[1:]), (mixed(self.code[self.one] * FACTOR + self.code[self.two]), self.pair_counts)):
            codes, number = np.unique(code >> np.uint64(64 - bits), return_inverse=True)
            yield codes, np.bincount(number, count, len(codes)).astype(np.int64), number

    def phrases(self, words: np.ndarray, pairs: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """(words, languages, codes, phrases, popcounts) of the phrases of up to `most` words that consist of frequent words and pairs."""
        kept = np.flatnonzero(words) + 1
        yield 1, self.lang[kept], self.code[kept], self.names.take(kept), self.counts[kept]
        follows = np.zeros(len(self.word) + 1, bool)  # places whose word makes a frequent pair with the one before
        number = np.repeat(np.arange(len(pairs), dtype=np.int32), self.pair_counts)
        good = pairs[number] if len(pairs) else np.zeros(0, bool)
        follows[self.place[good]] = True
        at = np.flatnonzero(good)
        while len(at):  # depth-first: a batch of pairs down to its longest phrases
            cut = len(at) if len(at) <= BATCH else max(np.searchsorted(number[at], number[at[BATCH]]), np.searchsorted(number[at], number[at[0]], "right"))
            now, at = at[:cut], at[cut:]
            different, owner = np.unique(number[now], return_inverse=True)
            text = pc.binary_join_element_wise(self.names.take(self.one[different]), self.names.take(self.two[different]), " ")
            one, two = self.one[different], self.two[different]
            yield from self.extended(2, Bitmaps.of(owner, self.place[now]), self.lang[one], mixed(self.code[one] * FACTOR + self.code[two]), text, follows, most)

    def extended(self, n: int, maps: Bitmaps, lang: np.ndarray, code: np.ndarray, text: pa.Array, follows: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        yield n, lang, code, text, maps.popcounts(len(lang))
        if n == most:
            return
        owner, place = maps.shifted().places()
        there = follows[place]
        owner, place = owner[there], place[there]
        order = np.lexsort((place, self.word[place], owner))
        owner, place = owner[order], place[order]
        key = owner.astype(np.int64) * len(self.code) + self.word[place]
        different, number = np.unique(key, return_inverse=True)
        if len(different):
            before, word = np.divmod(different, len(self.code))
            longer = pc.binary_join_element_wise(text.take(before), self.names.take(word), " ")
            yield from self.extended(n + 1, Bitmaps.of(number, place), lang[before], mixed(code[before] * FACTOR + self.code[word]), longer, follows, most)


def frequent(held: DataFrame, slices: int, bits: int, least: int) -> DataFrame:
    """(shard, gram, slice, flags): for each shard's different codes of words (gram 0) and pairs (1), in their order, whether they
    occur `least` times in all."""

    def ask(batches: Batches) -> Batches:
        bounds = np.array([-((-k << bits) // slices) for k in range(1, slices)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                number = row.pop("shard")
                for gram, (codes, counts, _) in enumerate(Shard(**row).coded(bits)):
                    cuts = np.r_[0, np.searchsorted(codes, bounds), len(codes)].tolist()
                    found = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([gram] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array([pack(np.diff(codes[a:b], prepend=np.uint64(0))) for _, a, b in found], pa.binary()), pa.array([pack(counts[a:b]) for _, a, b in found], pa.binary())],
                        ["gram", "slice", "shard", "codes", "counts"],
                    )

    def add(rows: pa.Table) -> pa.Table:
        codes = [np.cumsum(unpack(z), dtype=np.uint64) for z in rows.column("codes").to_pylist()]
        ends = np.cumsum([len(c) for c in codes])
        different, number = np.unique(np.concatenate(codes), return_inverse=True)
        counts = np.concatenate([unpack(z) for z in rows.column("counts").to_pylist()])
        often = np.bincount(number, counts, len(different)) >= least
        flags = [np.packbits(often[number[a:b]]).tobytes() for a, b in zip([0, *ends], ends)]
        sizes = [len(c) for c in codes]
        return pa.table({"shard": rows.column("shard"), "gram": rows.column("gram"), "slice": rows.column("slice"), "size": pa.array(sizes, pa.int32()), "flags": pa.array(flags, pa.binary())})

    asked = held.select("shard", "langs", "words", "of", "owner", "block", "mask").mapInArrow(ask, "gram int, slice int, shard long, codes binary, counts binary")
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a slice is much work for its bytes
    return asked.repartition(tasks, "gram", "slice").groupBy("gram", "slice").applyInArrow(add, "shard long, gram int, slice int, size int, flags binary")


def counted(held: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, words, phrase, f): all words and phrases of up to `most` words that occur `least` times, with their occurrences."""
    size = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits, slices = min(64, int(size + 2).bit_length() + 4), int(size) // SLICE + 1
    flags = frequent(held, slices, bits, least)

    def mine(texts: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(**texts.select(["langs", "words", "of", "owner", "block", "mask"]).to_pylist()[0])
        order = sorted(zip(*(answers.column(c).to_pylist() for c in ("gram", "slice", "size", "flags")), strict=True))
        often = []
        for gram, (_, _, number) in enumerate(shard.coded(bits)):
            answered = [np.unpackbits(np.frombuffer(z, np.uint8), count=n) for g, _, n, z in order if g == gram]
            often.append(np.concatenate(answered).astype(bool)[number] if answered else np.zeros(0, bool))
        parts = list(shard.phrases(*often, most))
        names = shard.langs
        del shard, often, order
        n = np.repeat([x[0] for x in parts], [len(x[1]) for x in parts])
        lang, code, f = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 4))
        text = pa.concat_arrays([x[3] for x in parts])
        del parts
        place = ((code >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(place[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
        press, rows = zstandard.ZstdCompressor(level=3).compress, []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            own = order[a:b]
            said = text.take(own)
            rows.append((int(place[own[0]]), names.to_pylist(), pack(lang[own]), pack(n[own]), pack(pc.binary_length(said).to_numpy()), press("".join(said.to_pylist()).encode()), pack(f[own])))
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate((("slice", pa.int32()), ("langs", pa.list_(pa.string())), ("lang", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("f", pa.binary())))})

    def add(rows: pa.Table) -> pa.Table:
        """Of the phrases of a slice, which has all of theirs, those that are frequent."""
        every = []
        for row in rows.to_pylist():
            ends = np.r_[0, np.cumsum(unpack(row["sizes"]))].astype(np.int32)
            phrase = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(zstandard.decompress(row["text"])))
            every.append(pa.table({"lang": pa.array(row["langs"], pa.string()).take(unpack(row["lang"]).view(np.int64)), "words": unpack(row["words"]).astype(np.int32), "phrase": phrase, "f": unpack(row["f"]).view(np.int64)}))
        total = pa.concat_tables(every).group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
        total = total.filter(pc.greater_equal(total["f_sum"], least))
        return pa.table({"lang": total["lang"], "words": total["words"], "phrase": total["phrase"], "f": total["f_sum"]})

    found = held.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(mine, "slice int, langs array<string>, lang binary, words binary, sizes binary, text binary, f binary")
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "slice").groupBy("slice").applyInArrow(add, "lang string, words int, phrase string, f long")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, k, l, r, score): of phrases (lang, words, phrase, f) those of two or more words, with the cut
    that scores lowest: floor(1000000 a a / (l r)) of the occurrences of the first k words and of the rest."""
    parts = F.split("phrase", " ")
    join = lambda begin, size: F.array_join(F.slice(parts, begin, size), " ")
    cuts = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": join(F.lit(1), F.col("k")), "rest": join(F.col("k") + 1, F.col("words") - F.col("k"))})
    total = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(total.toDF("lang", "first", "l"), ["lang", "first"]).join(total.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    million = F.lit(1_000_000).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": million * exact["a"] * exact["a"], "under": exact["l"] * exact["r"]}).withColumn("score", F.expr("CAST(over div under AS BIGINT)"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, most: int = 3, top: int = 2000, percent: int = 50) -> DataFrame:
    """Each language's first `top` phrases (lang, rank, phrase, a, l, r, n, score) of 2 to `most` words that occur `least` times;
    without those that occur for `percent` in a hundred or more inside one longer phrase."""
    held = written(shards(docs, lang_col, text_col, SHARD), "shards")
    n = held.select(F.explode(F.arrays_zip("langs", "tokens")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.tokens").alias("n"))
    phrases = written(counted(held, least, most), "phrases")
    found = scored(phrases)
    part = F.expr("explode(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))")
    inside = phrases.filter("words > 2").select("lang", "f", part.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    found = found.join(inside, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
