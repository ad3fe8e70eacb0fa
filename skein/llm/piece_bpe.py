"""SentencePiece BPE encoding and decoding that keeps the offsets, by a given model file; no model is trained here.

A text is normalised first, by the longest prefix at each place that the model's compiled character map knows (a double
array of UTF-8 bytes); white space is marked, and every character of the result remembers the source byte where it came
from. The normalised text is cut where no piece of the vocabulary can reach across; each distinct part is merged once,
by score, and remembered. The pieces' lengths, added up, lead over the remembered places back to spans of source
bytes: spans follow each other and cover what the text was read from. A character without a piece is spelt in byte
pieces, the last of which has its span. Decoding joins the ids' pieces and reads the bytes as UTF-8.

Rows stay in their tasks: no shuffle. A long text is cut into stretches where the parts are cut anyway, so a task holds
one text, its places and the ids of a stretch.

Defined results: a null text counts as empty (no ids); an empty table gives no rows; ids may repeat; other columns of
the input are ignored. The model must be of type BPE with byte fallback, white space before words, and without
user-defined or unused pieces; others are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

MARK = "▁"  # stands for a space in pieces
STRETCH = 1 << 18  # characters that are encoded at once
CACHE = 250_000  # distinct parts of late that a Python worker remembers, and as many before
LONG = 40  # characters of a part that are merged with a heap

# Kinds of pieces and field numbers of the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, SUFFIX, FALLBACK, SURFACE = 3, 24, 35, 44
CHARSMAP, PREFIX, COLLAPSE, ESCAPE = 2, 3, 4, 5


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, raw[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double array from byte strings to places in a block of normalised strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.out = blob[4 + size :]
        self.memo: dict[int, str] = {}
        # characters that begin no key are copied without a look at the map
        known = {b for b in range(256) if self.step(self.root(), b)}
        self.first = {c for c in range(128) if c in known}
        self.high = any(b >= 128 for b in known)

    def root(self) -> int:
        return self.offset(self.units[0])

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def step(self, node: int, byte: int) -> tuple[int, bool] | None:
        """The node behind a byte and whether a key ends there."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        return (at ^ self.offset(unit), bool(unit >> 8 & 1)) if unit & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """The bytes of the longest key at a place of raw, and what they become."""
        node, best = self.root(), None
        for i in range(at, len(raw)):
            found = self.step(node, raw[i])
            if not found:
                break
            node = found[0]
            if found[1]:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        if best[1] not in self.memo:
            self.memo[best[1]] = self.out[best[1] : self.out.index(b"\0", best[1])].decode()
        return best[0], self.memo[best[1]]


def byte_places(text: str) -> np.ndarray:
    """The byte where each character begins in UTF-8, and the end."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), out=out[1:])
    return out


class Model:
    def __init__(self, raw: bytes):
        parts: dict[int, list] = {}
        for number, value in fields(raw):
            parts.setdefault(number, []).append(value)
        trainer, norm = (dict(fields(b"".join(parts.get(k, [])))) for k in (TRAINER, NORMALIZER))
        self.raw: list[bytes] = []  # what an id stands for; empty for control pieces
        self.rank: dict[str, float] = {}  # of pieces that merges make: the lower, the sooner
        self.ids: dict[str, str] = {}  # decimal
        self.bytes = [""] * 256
        surface = trainer.get(SURFACE, " ⁇ ".encode())
        for i, piece in enumerate(parts.get(PIECES, [])):
            got = dict(fields(piece))
            name, kind = got[PIECE].decode(), got.get(KIND, NORMAL)
            if kind == NORMAL:
                self.ids[name], self.rank[name] = str(i), -struct.unpack("<f", got.get(SCORE, bytes(4)))[0]
                self.raw.append(name.replace(MARK, " ").encode())
            elif kind == BYTE:
                self.bytes[int(name[3:5], 16)] = str(i)
                self.raw.append(bytes([int(name[3:5], 16)]))
            elif kind in (UNKNOWN, CONTROL):
                self.raw.append(surface if kind == UNKNOWN else b"")
            else:
                raise ValueError(f"pieces of kind {kind} are not supported: {name}")
        if trainer.get(MODEL_TYPE) != 2 or not trainer.get(FALLBACK) or not all(self.bytes) or trainer.get(SUFFIX):
            raise ValueError("the model must be of type BPE with byte fallback and white space before words")
        self.prefix, self.collapse, self.escape = (bool(norm.get(k, 1)) for k in (PREFIX, COLLAPSE, ESCAPE))
        self.map = CharacterMap(norm[CHARSMAP]) if norm.get(CHARSMAP) else None
        self.by_text = {str(i): x for i, x in enumerate(self.raw)}
        self.marked = {i for name, i in self.ids.items() if name.startswith(MARK)}
        self.parts = self.cutter()
        self.known: dict[str, tuple[str, bytes]] = {}  # parts of late, and those before
        self.older: dict[str, tuple[str, bytes]] = {}

    def cutter(self) -> re.Pattern:
        """Matches the parts of a normalised text that no merge reaches beyond."""
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in self.rank):
            return re.compile(r".+", re.S)
        joining = "".join(sorted({c for name in self.rank if len(name) > 1 for c in name} - {MARK}))
        if not joining:
            return re.compile(f"{MARK}+|[^{MARK}]", re.S)
        joining = re.escape(joining)
        return re.compile(f"{MARK}*[{joining}]+|{MARK}+|[^{MARK}{joining}]", re.S)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters the source byte that it came from; at last the end."""
        space = MARK if self.escape else " "
        if self.map is None and not self.collapse:
            if not text:
                return "", np.zeros(1, np.int64)
            places = byte_places(text)
            out = text.replace(" ", space)
            return (space + out, np.concatenate([places[:1], places])) if self.prefix else (out, places)
        raw, at, units = text.encode(), 0, []
        while at < len(raw):  # the longest prefixes
            lead = raw[at]
            found = self.map.longest(raw, at) if self.map and (lead in self.map.first if lead < 128 else self.map.high) else None
            if not found:
                size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                found = size, raw[at : at + size].decode()
            units.append((at, *found))
            at += found[0]
        begin = 0
        if self.collapse:
            while begin < len(units) and units[begin][2] == " ":
                begin += 1
        if begin == len(units):
            return "", np.zeros(1, np.int64)
        out, places, blank = [], [], self.collapse
        if self.prefix:
            out.append(space)
            places.append(units[begin][0])
        for place, _, got in units[begin:]:
            got = got.lstrip(" ") if blank else got
            if got:
                out.append(got.replace(" ", space))
                places += [place] * len(got)
                blank = self.collapse and got.endswith(" ")
        done, end = "".join(out), units[-1][0] + units[-1][1]
        if self.collapse and done.endswith(space):
            kept = len(done.rstrip(space))
            done, end, places = done[:kept], places[kept], places[:kept]
        return done, np.array([*places, end], np.int64)

    def merged(self, part: str) -> list[str]:
        """A part's symbols after all merges: the adjacent pair whose piece has the best score first, the leftmost of equals."""
        if part in self.rank and len(part) < 3:
            return [part]
        if len(part) > LONG:
            return self.merged_long(part)
        rank, worst = self.rank.get, float("inf")
        out = list(part)
        cost = [rank(a + b, worst) for a, b in zip(out, out[1:])]
        while cost and (best := min(cost)) < worst:
            i = cost.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = rank(out[i - 1] + out[i], worst)
            if i < len(cost):
                cost[i] = rank(out[i] + out[i + 1], worst)
        return out

    def merged_long(self, part: str) -> list[str]:
        """As merged, with a heap over linked symbols, for parts of any length."""
        n, rank = len(part), self.rank.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or (j := after[i]) < 0 or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := rank(part[a : end[b]])) is not None:
                    heappush(heap, (r, a, end[b]))
        return [part[i : end[i]] for i in range(n) if alive[i]]

    def part(self, part: str) -> tuple[str, bytes]:
        """The ids of a part as text, and the characters that each stands for as 16-bit numbers."""
        symbols = self.merged(part)
        try:
            return ",".join([self.ids[x] for x in symbols]), array("H", map(len, symbols)).tobytes()
        except KeyError:  # a character without a piece is spelt
            spelt = [(x, x.encode() if x not in self.ids else b"") for x in symbols]
            ids = [i for x, raw in spelt for i in ([self.bytes[b] for b in raw] or [self.ids[x]])]
            return ",".join(ids), array("H", [n for x, raw in spelt for n in [0] * (len(raw) - 1) + [len(x)]]).tobytes()

    def encode(self, text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Of each stretch: the ids as decimal text, and the source bytes where their spans begin and end."""
        normal, places = self.normalise(text)
        part, at = self.part, 0
        while at < len(normal):
            stop = at + STRETCH
            cut = re.compile(f"(?<!{MARK}){MARK}").search(normal, stop) if stop < len(normal) and self.parts.pattern != ".+" else None
            stop = cut.start() if cut else len(normal)
            found, known, older = [], self.known, self.older
            for p in self.parts.findall(normal[at:stop]):
                got = known.get(p)
                if got is None:
                    got = older.get(p) or part(p)
                    if len(p) <= LONG:
                        known[p] = got
                found.append(got)
            if len(known) >= CACHE:
                self.known, self.older = {}, known
            sizes = np.frombuffer(b"".join([s for _, s in found]), np.uint16)
            ends = at + np.cumsum(sizes, dtype=np.int64)
            yield ",".join([i for i, _ in found]), places[ends - sizes], places[ends]
            at = stop

    def decode(self, ids: list[str], first: bool = True) -> str:
        """The text of decimal ids; the space that normalising put before a text goes, if these are its first ids."""
        out = b"".join(map(self.by_text.__getitem__, ids))
        if first and (self.prefix or self.collapse):
            lead = next((i for i in ids if self.by_text[i]), None)
            if lead in self.marked:
                out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self.decode_broken(ids, first)

    def decode_broken(self, ids: list[str], first: bool) -> str:
        """As decode where byte pieces are not whole characters: each byte that is none becomes a replacement mark."""
        out, held, spelt = [], b"", set(self.bytes)

        def flush() -> None:
            nonlocal held
            while held:
                size = 1 + (held[0] >= 0xC0) + (held[0] >= 0xE0) + (held[0] >= 0xF0)
                try:
                    out.append(held[:size].decode())
                except UnicodeDecodeError:
                    size = 1
                    out.append("�")
                held = held[size:]

        for i in ids:
            if i in spelt:
                held += self.by_text[i]
                continue
            flush()
            text = self.by_text[i].decode()
            out.append(text[1:] if first and i in self.marked and not any(out) and (self.prefix or self.collapse) else text)
        flush()
        return "".join(out)


@lru_cache(maxsize=1)
def load(path: str) -> Model:
    """A worker's later tasks use the model of its first one, and what that remembers."""
    with open(path, "rb") as f:
        return Model(f.read())


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) for each row of df, and with_ids also ids, begins and ends
    (the source bytes of each piece). spans_sha256 is over the begins and ends as 64-bit numbers, each stretch's begins first."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        model = load(model_path)

        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "ids", "begins", "ends")}
            for text in batch.column(1).to_pylist():
                count, digests, every, begins, ends = 0, [hashlib.sha256() for _ in range(3)], [], [], []
                for ids, begin, end in model.encode(text):
                    tokens = ids.split(",")
                    digests[0].update((f",{ids}" if count else ids).encode())
                    digests[1].update(model.decode(tokens, not count).encode())
                    digests[2].update(begin.tobytes())
                    digests[2].update(end.tobytes())
                    count += len(tokens)
                    if with_ids:
                        every.append(np.array(tokens, np.int32))
                        begins.append(begin)
                        ends.append(end)
                out["n_tokens"].append(count)
                for name, digest in zip(("ids_sha256", "decoded_sha256", "spans_sha256"), digests, strict=True):
                    out[name].append(digest.hexdigest())
                if with_ids:
                    for name, arrays in (("ids", every), ("begins", begins), ("ends", ends)):
                        out[name].append(np.concatenate(arrays) if arrays else np.zeros(0, np.int64))
            return out | {id_col: batch.column(0)}

        return f

    more = ", ids array<int>, begins array<long>, ends array<long>" if with_ids else ""
    return map_rows(df.select(F.col(id_col), text_of(text_col).alias("t")), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string{more}", make)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row's ids; null ids decode to an empty text, ids that the model lacks fail."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        model = load(model_path)
        return lambda batch: {id_col: batch.column(0), "text": [model.decode([str(i) for i in ids or []]) for ids in batch.column(1).to_pylist()]}

    return map_rows(df.select(F.col(id_col), F.col(ids_col).alias("ids")), f"`{id_col}` {kind}, text string", make)
