"""Run tallies: how many events a batch stored and how many secrets were masked in it, counted while the rows pass.

The counts are Spark's observed metrics of the write itself, so no second job reads the rows. Each batch has one file of a
row, replaced when the batch is repeated; reports add them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files

MARK = r"\[masked:(assignment|token|entropy):\d+:[0-9a-f]{8}\]"
SCHEMA = "runtime string, batch string, events long, masked long, sessions long"


def marks(x: Column) -> Column:
    return F.when(x.contains("[masked:"), F.size(F.regexp_extract_all(x, F.lit(MARK), F.lit(0)))).otherwise(0)


class Tally:
    """Counts of one runtime's batch: events, masked places in texts and extra, and sessions (approximately)."""

    def __init__(self, runtime: str):
        self.runtime, self.seen = runtime, Observation()

    def watch(self, events: DataFrame) -> DataFrame:
        masked = F.coalesce(F.sum(marks(F.col("text")) + marks(F.col("extra"))), F.lit(0))
        return events.observe(self.seen, F.count(F.lit(1)).alias("events"), masked.alias("masked"), F.approx_count_distinct("session_id").alias("sessions"))

    def counts(self) -> dict[str, int]:
        return {k: int(v or 0) for k, v in self.seen.get.items()}

    def save(self, spark: SparkSession, path: str, batch: str) -> dict[str, int]:
        """To the lake's tallies, under the batch's name; after the watched write."""
        row = {"runtime": self.runtime, "batch": batch} | self.counts()
        files.write_json(spark, f"{path}/tallies/{self.runtime}-{batch}.json", row)
        return row


def tallies(spark: SparkSession, path: str) -> DataFrame:
    """By runtime: batches, events and masked places of all runs."""
    rows = spark.read.schema(SCHEMA).json(f"{path}/tallies") if files.exists(spark, f"{path}/tallies") else spark.createDataFrame([], SCHEMA)
    return rows.groupBy("runtime").agg(F.count("*").alias("batches"), F.sum("events").alias("events"), F.sum("masked").alias("masked"))
