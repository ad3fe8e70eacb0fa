"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """df with the text column as zstd bytes: texts that are shuffled take half the disk that way. The readers, all in
    Python, call unpacked()."""
    import zstandard
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = df.columns.index(text_col)
    schema = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in df.schema])

    def run(batches: Batches) -> Batches:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([None if t is None else press(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def unpacked(z: bytes) -> str:
    import zstandard

    return zstandard.decompress(z).decode()


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow where `make()` runs once in a task and returns the function from a batch to named columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Batches) -> Batches:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], (pa.Array, pa.ChunkedArray)) else out[x.name] for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
