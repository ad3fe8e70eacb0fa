"""Ids, decoded texts and byte spans against the sentencepiece library, with the model's own character map and with others."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece

from skein.llm import piece_bpe
from skein.llm.queries import QUERIES

from .helpers import AWKWARD, SF01, docs

PATH = P.path("piece_bpe_32k.model")
ALPHABET = ["the", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "12", "a", "Hello", " world", "\0", "ﬁ", "<s>", "<0x0A>", "x" * 60, " " * 30, "​", "ü", "\r\n"]
FOLDED = ["Ａ", "①", "㍿", "é", "ｶﾞ", "\xa0", "　", "½", "ﷺ", "¨"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), digest(",".join(map(str, ids)).encode()), digest(library.decode(ids).encode() if ids else b"")


def same(model, library, texts):
    for text in texts:
        ids, spans = [], []
        for got, begin, end in model.encode(text):
            ids += got.split(",")
            spans += zip(begin.tolist(), end.tolist(), strict=True)
        want = library.encode(text, return_type="proto").pieces
        assert [int(i) for i in ids] == [p.id for p in want], text
        assert spans == [(p.begin, p.end) for p in want], text
        assert model.decode(ids) == library.decode([p.id for p in want]), text


def test_equals_library(spark, library):
    df = QUERIES["op12_piece_bpe"](spark, SF01)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}
    texts = pd.read_parquet(f"{SF01}/documents.parquet")
    assert got == {i: expected(library, t) for i, t in zip(texts.doc_id, texts.text)}


def test_ids_and_spans(library):
    random.seed(1)
    same(piece_bpe.load(PATH), library, ["".join(random.choices(ALPHABET, k=random.randint(0, 30))) for _ in range(1500)])


def with_normalizer(changes: bytes) -> bytes:
    """The model with the compiled NFKC map in place of its own."""

    def field(number: int, value: bytes) -> bytes:
        out, size = bytes([number << 3 | 2]), len(value)
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + value

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    norm = dict(piece_bpe.fields(spec))[piece_bpe.NORMALIZER]
    with open(PATH, "rb") as f:
        parts = b"".join(field(n, v) for n, v in piece_bpe.fields(f.read()) if n != piece_bpe.NORMALIZER)
    return parts + field(piece_bpe.NORMALIZER, norm + changes)


@pytest.mark.parametrize("changes", [b"", bytes([3 << 3, 0]), bytes([4 << 3, 0]), bytes([4 << 3, 0, 3 << 3, 0])], ids=["collapse", "no prefix", "keep white space", "neither"])
def test_compiled_map_keeps_offsets(changes):
    raw = with_normalizer(changes)
    random.seed(2)
    texts = ["".join(random.choices(ALPHABET + FOLDED, k=random.randint(0, 20))) for _ in range(800)]
    same(piece_bpe.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), [*texts, "", " ", "   ", "　"])


def test_long_parts_merge_alike():
    model = piece_bpe.load(PATH)
    random.seed(3)
    for _ in range(300):
        part = "".join(random.choices("thereandionxqé", k=random.randint(3, 40)))
        assert model.merged_long(part) == model.merged(part)


def test_stretches(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "STRETCH", 16)
    random.seed(4)
    model = piece_bpe.load(PATH)
    texts = ["".join(random.choices(ALPHABET, k=80)) for _ in range(200)]
    same(model, library, texts)
    assert len(list(model.encode(texts[0]))) > 1


def test_decode_any_ids(library):
    model = piece_bpe.load(PATH)
    random.seed(5)
    for _ in range(500):
        ids = random.choices(range(32000), k=6) + random.choices(range(259), k=5)
        random.shuffle(ids)
        assert model.decode([str(i) for i in ids]) == library.decode(ids), ids


def test_awkward(spark, library):
    got = piece_bpe.encode(docs(spark, AWKWARD), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(i), *expected(library, t)) for i, t in AWKWARD)
    for r in got:
        spans = np.array([r.begins, r.ends])
        assert len(r.ids) == r.n_tokens and r.spans_sha256 == digest(spans.astype(np.int64).tobytes())
        assert (spans[0, 1:] == spans[1, :-1]).all()
    back = {(r.doc_id, r.text) for r in piece_bpe.decode(piece_bpe.encode(docs(spark, AWKWARD), PATH), PATH).collect()}
    assert back == {(i, t or "") for i, t in AWKWARD}
    assert piece_bpe.encode(docs(spark, []), PATH).count() == 0


def test_refuses_other_models():
    with open(PATH, "rb") as f:
        raw = f.read()
    with pytest.raises(ValueError, match="of type BPE"):
        piece_bpe.Model(b"".join([raw, bytes([2 << 3 | 2, 2, 3 << 3, 1])]))  # model_type: unigram
