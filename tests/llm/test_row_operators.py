import base64
import hashlib
import random
import re
import zlib

import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from skein.llm import byte_bpe, mpeg_audio, quality_classifier, secret_scan
from skein.llm.common import unpacked
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF01, docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_bpe(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_equals_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_byte_bpe"](spark, SF01).collect()}
    texts = pd.read_parquet(f"{SF01}/documents.parquet")
    assert got == {i: expected_bpe(library, t) for i, t in zip(texts.doc_id, texts.text)}


def test_bpe_chunks_stitch(spark, library):
    random.seed(1)
    parts = ["the", " thble", "  ", "\n\n ", "'re", "'", " 123", "é", "$$$", " ", "\t", "x" * 40, "   '", "漢字"]
    rows = [(i, "".join(random.choices(parts, k=300))) for i in range(60)] + [(100, " " * 500 + "a" + " " * 500), (101, "a" * 700)]
    got = byte_bpe.encode(docs(spark, rows), PATH, P.PATTERN, chunk=64, overlap=16)
    back = {r.doc_id: r.text for r in byte_bpe.decode(got, PATH).collect()}
    assert back == dict(rows)
    for r in got.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_bpe(library, dict(rows)[r.doc_id]), r.doc_id


def test_bpe_long_pieces_merge_alike(library):
    ranks = byte_bpe.load_ranks(PATH)
    random.seed(2)
    for _ in range(200):
        raw = bytes(random.choices(b"thereandionxq ", k=random.randint(2, 120)))
        assert byte_bpe._merge_long(raw, ranks) == byte_bpe.merge(raw, ranks)


def test_bpe_awkward(spark, library):
    got = byte_bpe.encode(docs(spark, AWKWARD), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in got) == sorted((str(i), *expected_bpe(library, t)[:2]) for i, t in AWKWARD)
    assert byte_bpe.encode(docs(spark, []), PATH, P.PATTERN).count() == 0


def test_quality_held_out(spark):
    got = QUERIES["op4_quality_classifier"](spark, SF01).toPandas()
    labels = pd.read_parquet(f"{SF01}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = both[both.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (5, None)], "doc_id long, quality int")
    weights = quality_classifier.train(docs(spark, AWKWARD), labels)
    got = quality_classifier.score(docs(spark, AWKWARD), weights).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = quality_classifier.train(docs(spark, []), labels)
    assert [r.score for r in quality_classifier.score(docs(spark, [(1, "a")]), none).collect()] == [0.5]


def test_quality_texts_are_shuffled_packed_at_any_size(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0)], "id long, label int")
    rows = quality_classifier.learned_from(docs(spark, AWKWARD), labels, "doc_id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = rows.collect()
    assert sorted((r.id, unpacked(r.t)) for r in got) == sorted((i, t or "") for i, t in AWKWARD if i in (4, 7))


def test_quality_learns_from_all(spark, monkeypatch):
    """A word that one labelled row alone has gets a weight, whichever row it is; learners are as many as the rows need."""
    rows = [(i, f"same words here only{i}") for i in range(12000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    weights = quality_classifier.train(docs(spark, rows + rows[:50]), labels)
    words = quality_classifier.Words()
    alone = [quality_classifier.features(text, words)[6] for _, text in rows]  # the core of the last word
    assert sum(bool(weights[k]) for k in alone) > 0.9 * len(rows)
    again = quality_classifier.train(docs(spark, rows[::-1]).repartition(3), labels.repartition(2))
    assert (weights == again).all()


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark):
    got = QUERIES["op8_secret_scan"](spark, SF01).toPandas().set_index("doc_id")
    texts = pd.read_parquet(f"{SF01}/documents.parquet")
    for i, t in zip(texts.doc_id, texts.text):
        base = brute_spans(t)
        assert got.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got.spans[i].split(","))
        assert got.n_hex[i] == base.count("hex:") and got.n_access[i] == base.count("access:") and got.n_assign[i] == base.count("assign:")


def test_secrets_find_formats(spark):
    random.seed(3)
    hexes = ["".join(random.choices("0123456789abcdef", k=40)) for _ in range(80)]
    keys = ["AKIA" + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(80)]
    rows = [(i, f"x {h} and {k}") for i, (h, k) in enumerate(zip(hexes, keys))]
    df = docs(spark, [*rows, (900, "the key ASIA" + "Q7ZR2M5XKP3T6WJ4" + " here"), (901, "an ordinary-text_with-joined-words-2 " * 3), (902, "PaſſWord: abcdefabcdefabcdef é API_KEY = 'abc.def-ghi_jkl1'"), (903, None)])
    models = secret_scan.learn(df)
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df, models).collect()}
    assert got[900].spans == "format:8:28" and got[901].spans == "" and got[903].spans == ""
    assert (got[902].n_assign, got[902].n_hex) == (1, 1)
    assert secret_scan.scan_secrets(df, {}).count() == len(rows) + 4


def test_secrets_learn_from_all(spark, monkeypatch):
    """Frequencies and thresholds are those of all different labelled credentials, not of some hundreds."""
    monkeypatch.setattr(secret_scan, "HELD", 1000)
    random.seed(5)
    hexes = ["".join(random.choices("0123456789abcdef", k=random.choice([16, 20, 32, 40]))) for _ in range(1500)]
    rows = [(i, f"x {h} y {hexes[i // 2]}") for i, h in enumerate(hexes)]
    models = secret_scan.learn(docs(spark, rows))
    model, least = models["hex"]
    assert sum(c[secret_scan.END] for c in model.count) == len(set(hexes))
    shapes = [h.translate(secret_scan.TRANSLATE) for h in set(hexes)]
    counts = {}
    for shape in shapes:
        for step in model.walk(shape):
            counts[step] = counts.get(step, 0) + 1
    assert {(s, c): n for s, x in enumerate(model.count) for c, n in x.items() if n} == counts
    exact = sorted(model.score(x) for x in shapes)[len(shapes) // 20]
    assert least <= exact < least + 1 / secret_scan.STEPS + 1e-12
    assert set(models) == {"hex"} and secret_scan.learn(docs(spark, [])) == {}


def test_audio_round_trip(spark):
    texts = pd.read_parquet(f"{SF01}/documents.parquet").set_index("doc_id").text
    for r in QUERIES["op10_mpeg_audio"](spark, SF01).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.n_frames == len(payload) // 192 and r.duration_samples == 1152 * r.n_frames and len(r.seek_offsets) == r.n_frames


def test_audio_awkward(spark):
    got = mpeg_audio.media_columns(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    same = [(r.media_sha256, r.feature) for r in got if r.doc_id in (4, 5)]
    assert len(set(same)) == 1
    empty = next(r for r in got if r.doc_id == 1)
    assert (empty.n_bytes, empty.payload_bytes) == (0, 192)


def test_audio_resync_and_checksums(spark):
    stream = mpeg_audio.encode_payload(bytes(range(32, 128)) * 8, 700)
    audio = stream[stream.index(b"\xff\xfa"):]
    dirty = b"junk\xff\xfbnoise" + audio[:480] + b"\xff\x00lost bytes" + audio[480:] + b"TAG" + b"song".ljust(30, b"\0") + bytes(95)
    x = mpeg_audio.scan(dirty)
    assert len(x["offsets"]) == 4 and x["skipped"] == 11 + 12 and x["tags"]["v1:title"] == "song"
    assert mpeg_audio.read_payload(dirty, x) == bytes(range(32, 128)) * 8
    bad = bytearray(stream)
    bad[stream.index(b"\xff\xfa") + 10] ^= 1
    assert (mpeg_audio.scan(bytes(bad))["crc_bad"], mpeg_audio.scan(stream)["crc_bad"]) == (1, 0)
    assert mpeg_audio.scan(stream)["tags"] == {"TXXX:payload_bytes": "700"} and mpeg_audio.scan(stream)["table"]["frames"] == 4
    for junk in (b"", b"\xff", b"\xff" * 300, bytes(500)):
        assert len(mpeg_audio.scan(junk)["offsets"]) == 0
    df = spark.createDataFrame([(1, bytearray(stream)), (2, None)], "id long, media binary")
    assert [r.n_frames for r in mpeg_audio.scan_audio(df).orderBy("id").collect()] == [4, 0]


def test_audio_headers():
    # known sizes: 128 kbit/s at 44.1 kHz layer III, 192 kbit/s at 48 kHz layer II, MPEG-2 layer III 64 kbit/s at 22.05 kHz
    for head, size, samples in ((b"\xff\xfb\x90\x00", 417, 1152), (b"\xff\xfd\xa4\x00", 576, 1152), (b"\xff\xf3\x80\x00", 208, 576)):
        h = mpeg_audio.parse_header(head, 0)
        assert (h["size"], h["samples"]) == (size, samples)
