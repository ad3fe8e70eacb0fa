"""MPEG audio in media columns.

`encode_audio` stores a payload losslessly as an MPEG-1 layer III stream of silent frames whose ancillary
bytes carry it; `scan_audio` reads any MPEG audio bytes: it resynchronises on frame headers, parses ID3 tags and
variable-bitrate tables (Xing, Info, VBRI), verifies the CRC-16 of protected layer I and III frames, and returns
exact durations and the seek offset of every frame. All work is inside one task per row; nothing is shuffled.

Defined results: null bytes scan as empty ones; bytes without two consistent frames (or one that ends the
stream) give no frame; free-format streams are not recognised; CRCs of layer II count as unchecked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

# Fixed values of ISO/IEC 11172-3 and 13818-3: bitrates in kbit/s by (MPEG-1?, layer) and sample rates in Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192  # payload bytes in a frame
HEADER = b"\xff\xfa\x64\xc0"  # MPEG-1 layer III, CRC, 80 kbit/s, 48 kHz, mono
FRAME = 240  # 80 kbit/s at 48 kHz
SIDE = 17  # side information of a mono frame


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1) ^ 0x8005 if x & 0x8000 else x << 1
        out[i] = x & 0xFFFF
    return out


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for i in range(rows.shape[1]):
        crc = ((crc & 0xFF) << 8) ^ CRC_TABLE[(crc >> 8) ^ rows[:, i]]
    return crc


def _synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """An ID3v2.3 tag with the unpadded size, an Info frame with a seek table, and a frame for each 192 bytes."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    crc = int(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6 : 6 + SIDE]], axis=1))[0])
    frames[:, 4:6] = crc >> 8, crc & 0xFF
    body = 6 + SIDE
    frames[1:, body : body + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(i * 256 // 100 for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, body : body + len(info)] = np.frombuffer(info, np.uint8)
    text = b"\x00payload_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes()


def parse_header(data: bytes, at: int) -> dict | None:
    """The frame header at `at`, or None where there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    rate, kbit = b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer == 4 or rate == 3 or kbit in (0, 15) or b3 & 3 == 2:
        return None
    hz, bits, pad = SAMPLE_RATES[version][rate], BITRATES[(version == 3, layer)][kbit] * 1000, b2 >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    mono = b3 >> 6 == 3
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    alloc = 0
    if layer == 1:
        bound = (b3 >> 4 & 3) * 4 + 4 if b3 >> 6 == 1 else 32
        alloc = (32 if mono else bound * 2 + 32 - bound) // 2
    return {"version": version, "layer": layer, "hz": hz, "bits": bits, "size": size, "samples": samples, "mono": mono, "crc": not b1 & 1, "side": side, "guarded": side or alloc, "key": (version, layer, hz)}


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where the audio begins and ends, and what the tags say."""
    begin, end, tags = 0, len(data), {}
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= len(data):
        major, size = data[begin + 3], sum((x & 127) << 7 * i for i, x in enumerate(data[begin + 9 : begin + 5 : -1]))
        at, stop = begin + 10, min(begin + 10 + size, len(data))
        while major in (3, 4) and at + 10 <= stop and data[at] != 0:
            raw = data[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if major == 3 else sum((x & 127) << 7 * i for i, x in enumerate(raw[::-1]))
            name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, stop)]
            if name[:1] == "T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(coding, "replace").strip("\x00").split("\x00", 1)
                tags[f"TXXX:{parts[0]}" if name == "TXXX" and len(parts) == 2 else name] = parts[-1]
            at += 10 + n
        begin = begin + 10 + size + (10 if major == 4 and data[begin + 5] & 16 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\x00")[0].decode("latin-1").strip():
                tags[f"v1:{name}"] = value
    return min(begin, end), end, tags


def _vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    for x in (at + 4 + h["side"] + 2 * h["crc"], at + 4 + h["side"]):
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, = struct.unpack(">I", data[x + 4 : x + 8].ljust(4, b"\0"))
            out, x, kind = {}, x + 8, data[x : x + 4].decode()
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], x = int.from_bytes(data[x : x + 4], "big"), x + 4
            return {"kind": kind, "toc": list(data[x : x + 100]) if flags & 4 else []} | out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= len(data):
        size, frames = struct.unpack(">II", data[x + 10 : x + 18])
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": []}
    return None


def scan(data: bytes) -> dict:
    """Frames (offsets; without a leading table frame), samples, rate, checksums, tags and table of one stream."""
    begin, end, tags = _tags(data)
    view, at, runs, skipped, last = np.frombuffer(data, np.uint8), begin, [], 0, None
    skipped_here = False
    while at < end:
        h = parse_header(data, at)
        good = h and h["size"] >= 24 and at + h["size"] <= end and (last is None or h["key"] == last)
        if good and (last is None or skipped_here):  # a first frame, or one after lost bytes: the next must agree
            after = at + h["size"]
            following = parse_header(data, after) if after < end else None
            good = after == end or bool(following and following["key"] == h["key"])
        if not good:
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            skipped, at, skipped_here = skipped + step, at + step, True
            continue
        n = (end - at) // h["size"]
        rows = view[at : at + n * h["size"]].reshape(n, h["size"])
        same = np.logical_and.reduce(rows[:, :4] == rows[0, :4], axis=1)
        n = n if same.all() else int(same.argmin())
        runs.append((at, n, h, rows[:n]))
        at, last, skipped_here = at + n * h["size"], h["key"], False
    out = {"offsets": np.zeros(0, np.int64), "samples": 0, "hz": runs[0][2]["hz"] if runs else 0, "crc_ok": 0, "crc_bad": 0, "crc_unchecked": 0, "skipped": skipped, "tags": tags, "table": None, "runs": runs}
    offsets = []
    for at, n, h, rows in runs:
        if h["crc"] and h["guarded"]:
            want = crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + h["guarded"]]], axis=1))
            ok = int((want == (rows[:, 4].astype(np.uint16) << 8 | rows[:, 5])).sum())
            out["crc_ok"], out["crc_bad"] = out["crc_ok"] + ok, out["crc_bad"] + n - ok
        elif h["crc"]:
            out["crc_unchecked"] += n
        first = not offsets
        offsets.append(at + h["size"] * np.arange(n, dtype=np.int64))
        out["samples"] += n * h["samples"]
        if first and (found := _vbr_table(data, at, h)):
            out["table"], offsets[0] = found, offsets[0][1:]
            out["samples"] -= h["samples"]
    if offsets:
        out["offsets"] = np.concatenate(offsets)
    return out


def read_payload(data: bytes, found: dict | None = None) -> bytes:
    """The ancillary payload of each frame of a stream that `encode_payload` made."""
    found = found or scan(data)
    body, skip, out = 6 + SIDE, bool(found["table"]), []
    for i, (_, _, _, rows) in enumerate(found["runs"]):
        out.append(rows[1 if skip and i == 0 else 0 :, body : body + UNIT].tobytes())
    return b"".join(out)


def encode_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text, null as empty, as UTF-8 with spaces up to a positive multiple of 192 bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                media.append(encode_payload(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT), len(raw)))
            return {"id": batch.column(0), "n_bytes": sizes, "media": media}

        return f

    return map_rows(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")), f"id {kind}, n_bytes long, media binary", make)


def scan_audio(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each stream: frames, exact duration as samples / rate, checksums, tags, table, seek offsets, payload."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("media_bytes", "n_frames", "samples", "sample_rate", "crc_ok", "crc_bad", "crc_unchecked", "bytes_skipped", "vbr_kind", "vbr_frames", "tags", "seek_offsets", "payload")}
            for data in batch.column(1):
                data = data.as_py() or b""
                x = scan(data)
                table = x["table"] or {}
                for k, v in (("media_bytes", len(data)), ("n_frames", len(x["offsets"])), ("samples", x["samples"]), ("sample_rate", x["hz"]), ("crc_ok", x["crc_ok"]), ("crc_bad", x["crc_bad"]), ("crc_unchecked", x["crc_unchecked"]), ("bytes_skipped", x["skipped"]), ("vbr_kind", table.get("kind")), ("vbr_frames", table.get("frames")), ("tags", list(x["tags"].items())), ("seek_offsets", x["offsets"]), ("payload", read_payload(data, x))):
                    out[k].append(v)
            return {"id": batch.column(0)} | out

        return f

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")), f"id {kind}, media_bytes long, n_frames long, samples long, sample_rate long, crc_ok long, crc_bad long, crc_unchecked long, bytes_skipped long, vbr_kind string, vbr_frames long, tags map<string,string>, seek_offsets array<long>, payload binary", make)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as audio, read the stored bytes back, and derive digests and features from them."""
    media = encode_audio(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    inner = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_samples long, sample_rate long, seek_offsets array<long>"

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out = {x.split()[0]: [] for x in inner.split(", ")}
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                x = scan(data)
                payload = read_payload(data, x)
                table = x["table"] or {}
                feature = f"frames={len(x['offsets'])};samples={x['samples']};rate={x['hz']};crc_ok={x['crc_ok']};crc_bad={x['crc_bad']};vbr={table.get('kind')}:{table.get('frames')}:{table.get('bytes')};first={x['offsets'][0]};last={x['offsets'][-1]}"
                for k, v in (("n_bytes", n), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", feature), ("n_frames", len(x["offsets"])), ("duration_samples", x["samples"]), ("sample_rate", x["hz"]), ("seek_offsets", x["offsets"])):
                    out[k].append(v)
            return {id_col: batch.column(0)} | out

        return f

    return map_rows(media, f"`{id_col}` {kind}, {inner}", make)
