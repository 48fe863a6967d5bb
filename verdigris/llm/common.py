"""Helpers shared by the corpus operators: tables, stored steps, text keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import scratch_path

#: A word is a run of characters that are none of these (space, \t, \n, \v, \f, \r).
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_collecting: list[list[str]] = []


@contextmanager
def steps_into(paths: list[str]) -> Iterator[None]:
    """Note the folders of all steps stored inside the block in ``paths``, for ``drop_paths`` when they are no longer read."""
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.remove(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage, keeps column pruning and lets the shuffle files of the step go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _collecting:
        paths.append(path)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in the shared checkpoint folder; those that are gone already are left out."""
    for folder in paths:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except PySparkException:
            return


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a table from ``stored`` that nothing reads any more."""
    drop_paths(spark, sorted({name.rpartition("/")[0] for name in df.inputFiles()}))


def as_text(name: str) -> Column:
    """An integer column as text: pandas would turn integers beside nulls into floating point."""
    return F.col(name).cast("string").alias(name)


def from_text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def row_key(*columns: Column) -> Column:
    """64 bits that stand for a row; equal rows have equal keys, which every user here allows."""
    return F.xxhash64(*columns)
