"""Pairwise comparison of two sample logs and the win rate of the second."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import parsing, text
from verdigris.operators import prompts


def paired_answers(first: DataFrame, second: DataFrame, key: str = "original") -> DataFrame:
    """Inner join of two logs on the full text, each distinct pairing once with its multiplicity.

    Duplicate texts multiply in the join. Counting equal rows on each side before it gives
    ``n_pairs`` and keeps copies of a text from being paired one by one. Rows meet by the digest
    of the text, so only the first log's texts move.
    """
    count = F.count(F.lit(1))
    left = (
        first.withColumn("_digest", F.sha2(key, 256))
        .groupBy("_digest", "option_1")
        .agg(F.first(key).alias(key), count.alias("_n1"))
    )
    right = (
        second.select(F.sha2(key, 256).alias("_digest"), "option_2")
        .groupBy("_digest", "option_2")
        .agg(count.alias("_n2"))
    )
    pairs = left.join(right, "_digest").withColumn("n_pairs", F.col("_n1") * F.col("_n2"))
    return pairs.select(key, "option_1", "option_2", "n_pairs")


def pairwise_requests(
    pairs: DataFrame, templates: Mapping[str, str], key: str = "original", reference: str | None = None
) -> DataFrame:
    """Add the judge request of each pairing and whether its sides are swapped."""
    identity = F.concat_ws("\x1f", key, "option_1", "option_2")
    swapped = pairs.withColumn("swap", prompts.swap_sides(identity))
    return swapped.withColumn(
        "request",
        prompts.pairwise_request(
            F.col(key),
            F.col(reference) if reference else None,
            F.col("option_1"),
            F.col("option_2"),
            F.col("swap"),
            templates,
        ),
    )


def with_selection(judged: DataFrame, output: str = "judge_text") -> DataFrame:
    """Read each judge output and undo the swap; an unreadable one has no selection."""
    return text.once(judged, "_s", parsing.selection(F.col(output))).select(
        *judged.columns,
        prompts.unswap(F.col("_s.selection"), F.col("swap")).alias("selection"),
        F.col("_s.explanation").alias("explanation"),
    )


def win_rate(selections: DataFrame) -> DataFrame:
    """Share of readable selections that prefer option 2, 0 without any."""
    readable = selections.where(F.col("selection").isNotNull())
    wins = F.sum(F.when(F.col("selection") == 2, F.col("n_pairs")).otherwise(0))
    total = F.sum("n_pairs")
    return readable.agg(
        F.coalesce(wins.cast("double") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(total, F.lit(0)).alias("n"),
    )
