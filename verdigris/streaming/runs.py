"""Running totals of a stream, and running a stream over what its source holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.session import delete_paths, scratch_path


#: Folders of micro-batches that are merged into one.
COMPACT_EVERY = 32


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_trigger: int = 64_000_000
) -> DataFrame:
    """Parquet files of a folder as a stream, about ``per_trigger`` bytes of files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxBytesPerTrigger", per_trigger)
        .parquet(folder)
    )


def running_totals(scores: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Counts and means so far per group; state is one row per group."""
    return scores.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"avg_{v}") for v in values]
    )


def _latest(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The row of the latest micro-batch per key, with its number."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_last"), F.max("batch").alias("batch"))
    return last.select(*key, "_last.*", "batch")


def run_available(stream: DataFrame, key: list[str], compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Process what the source holds now and return the latest row per key.

    Each micro-batch writes its changed rows to its own folder, overwritten when a batch is repeated after a failure. When there
    are ``compact_every`` folders they become one with the latest row per key, so a read opens that many at most,
    however many batches there were. Rows carry their batch's number: one that is found twice, because a failure came between
    writing and deleting, changes nothing. An empty source gives no rows.
    """
    spark = stream.sparkSession
    table, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    values = [c for c in stream.columns if c not in key]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    folders: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        folder = f"{table}/batch-{number}"
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(folder)
        folders.extend([folder] if folder not in folders else [])
        if len(folders) >= compact_every:
            merged = f"{table}/upto-{number}-{uuid.uuid4().hex}"
            rows = batch.sparkSession.read.schema(schema).parquet(*folders)
            _latest(rows, key, values).select(*schema.names).write.parquet(merged)
            delete_paths(spark, folders)
            folders[:] = [merged]

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not folders:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).parquet(*folders)
    return _latest(rows, key, values).select(*key, *values)
