"""Shared inputs: awkward rows that every operator must take."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def docs(spark, rows, extra=True):
    """Rows (doc_id, text) as documents, with extra columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("id", "t", "k", "key", "n", "label", "score", "media", "line", "pos"):
            df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (6, "wörd " * 30000), (7, "\n".join(["same line of some length here"] * 5)), (8, "emoji 😀   'll don't 12345   x"), (None, "no id"), (4, "one two three")]
