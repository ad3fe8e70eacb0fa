from skein.llm import common

from .helpers import AWKWARD, docs


def test_packed_texts_come_back(spark):
    rows = common.packed(docs(spark, AWKWARD), "text").collect()
    assert sorted((str(r.doc_id), str(r.text and common.unpacked(r.text))) for r in rows) == sorted((str(i), str(t)) for i, t in AWKWARD)
    assert all(r.line == "x" for r in rows) and common.packed(docs(spark, []), "text").count() == 0


def test_written_keeps_the_schema(spark):
    df = docs(spark, AWKWARD)
    again = common.written(df, "t")
    assert again.dtypes == df.dtypes and again.count() == df.count()
    assert common.written(docs(spark, []), "t").count() == 0
