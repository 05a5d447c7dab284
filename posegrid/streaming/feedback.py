"""Feedback between micro-batches: corrections that one batch's work yields are what the next batch starts from.

Corrections are kept as versions, one folder for each micro-batch. A batch reads the versions before its own and writes its own
version as a whole, so a batch that is run again after a failure sees and writes what it did the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class Corrections:
    """A versioned table (``keys`` and values) under ``path``; what a version doesn't name stays as the one before left it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def as_of(self, version: int) -> DataFrame:
        """keys and values after ``version`` (-1: before the first), the latest for each key."""
        empty = self.spark.createDataFrame([], self.schema)
        if version < 0:
            return empty
        names = [f.name for f in empty.schema if f.name not in self.keys]
        every = self.spark.read.schema(f"{self.schema}, version long").option("basePath", self.path).parquet(self.path).filter(F.col("version") <= version)
        latest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "version").alias("_v"))
        return latest.select(*self.keys, *[F.col(f"_v.{n}").alias(n) for n in names])


def with_feedback(
    stream: DataFrame, checkpoint: str, corrections: Corrections, apply: Callable[[DataFrame, DataFrame], DataFrame], derive: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], **trigger
) -> StreamingQuery:
    """Each micro-batch is worked on by ``apply(batch, corrections as of the version before)`` and handed to ``sink``; then
    ``derive(result, the same corrections)`` becomes this batch's version.

    The version is the batch's number, and is written last: the next batch can't see half of one.
    """

    def step(batch: DataFrame, number: int) -> None:
        before = corrections.as_of(number - 1)
        done = apply(batch, before)
        done.persist()
        try:
            sink(done, number)
            corrections.write(derive(done, before), number)
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
