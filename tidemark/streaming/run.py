"""Run a streaming frame over everything that is there and read back its output."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import checkpoint_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the schema is taken from the files' footer."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Process what is available now and return all rows written so far.

    Output and progress go to ``base`` (a new place in the shared checkpoint
    folder by default). Run again on the same ``base``, the query restores its
    state and goes on after the last committed batch. Every row carries its
    ``epoch``.
    """
    spark = stream.sparkSession
    base = base or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a batch that is run again replaces its own rows
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/progress")
    writer.foreachBatch(sink).start().awaitTermination()
    try:
        return spark.read.option("basePath", out).parquet(out).drop("batch")
    except AnalysisException:  # nothing arrived, so nothing was written
        return spark.createDataFrame([], StructType([*stream.schema.fields, StructField("epoch", IntegerType())]))


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Last emitted row per key of an update-mode run. The keys may be null."""
    cols = [c for c in updates.columns if c not in (*keys, "epoch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("s")).select(*keys, "s.*")
