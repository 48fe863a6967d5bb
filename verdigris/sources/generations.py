"""A store of recorded generations, bucketed by request."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import scratch_path


def generation_store(generations: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Records ``request_id, text`` as a table of buckets by request, sorted inside, each request once with its smallest text.

    A job that reads the record several times shuffles its texts once, here: a join by ``request_id`` finds the
    buckets in place. ``path`` is a folder in shared storage; without it the table lies in the scratch folder. The number of
    buckets is that of shuffle partitions unless given.
    """
    spark = generations.sparkSession
    name = f"generations_{uuid.uuid4().hex}"
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = generations.groupBy("request_id").agg(F.min("text").alias("text"))
    writer = once.write.format("parquet").option("path", path or scratch_path(spark, "generations"))
    writer.bucketBy(count, "request_id").sortBy("request_id").saveAsTable(name)
    return spark.table(name)
