import base64
import hashlib

import pandas as pd
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from skein.llm import order_minhash, quality_classifier
from skein.llm.common import table, written

from .helpers import AWKWARD, SF, docs
from .test_edit_lines import kept
from .test_order_minhash import brute


def test_stages_equal_brute_force(spark):
    """Each stage on its own input."""
    data = table(spark, SF, "documents")
    columns = data.columns
    weights = quality_classifier.train(data, table(spark, SF, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    good = {r.doc_id for r in quality_classifier.score(data, weights).collect() if r.score >= 0.3}
    one = written(C.quality(spark, data, SF), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == good and len(good) > 150
    two = written(C.line_dedup(spark, one, SF), "t")
    assert two.columns == columns and two.dtypes == one.dtypes
    assert sorted((str(r.doc_id), r.text) for r in two.collect()) == kept([(r.doc_id, r.text) for r in one.collect()])
    three = written(C.near_dedup(spark, two, SF), "t")
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert three.columns == columns and sorted(str(r.doc_id) for r in three.collect()) == sorted(i for i, c in brute(rows) if i == str(c))
    four = written(C.decontamination(spark, three, SF), "t")
    assert four.columns == columns and 0 < four.count() < three.count()
    five = {r.doc_id: r.ids_sha256 for r in C.tokenisation(spark, four, SF).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert five == {r.doc_id: hashlib.sha256(" ".join(map(str, library.encode_ordinary(r.text))).encode()).hexdigest() for r in four.collect()}
    assert {r.doc_id: r.ids_sha256 for r in C.run(spark, SF).collect()} == five


def test_keep_one_awkward(spark):
    got = order_minhash.keep_one(docs(spark, [*AWKWARD, (None, "no id")]))
    assert got.columns == docs(spark, []).columns
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == ["1", "4", "6", "7", "8", "None"]


def test_empty_documents(spark):
    none = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0
