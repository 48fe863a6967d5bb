"""Connected components by alternating stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import drop_stored, stored


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b")))).first()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (a, b) that is not the smallest of its component.

    Each round is stored in the shared checkpoint folder and the one before is deleted. The number of rounds
    grows with the logarithm of the largest component.
    """
    spark = links.sparkSession
    current = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(current.distinct(), "stars")
    state = _state(current)
    while state[0]:
        following = stored(_small_star(_large_star(current)), "stars")
        drop_stored(spark, current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
