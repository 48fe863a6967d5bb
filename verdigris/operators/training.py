"""Training tables: prompt pairs, size matching, union, sequence packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.functions.text import strip_or_empty
from verdigris.operators import ordered
from verdigris.operators.prompts import render
from verdigris.session import store

VOCABULARY_BYTES = 64_000_000
#: Most frequent tokens that are looked up without moving their rows, if the vocabulary is too large to be broadcast.
FREQUENT_TOKENS = 10_000
PAIR_COLUMNS = ("ord", "original_query", "candidate_prompt")


def rewrite_pairs(df: DataFrame) -> DataFrame:
    """``ord, original_prompt, analysis, optimized_prompt`` to query and JSON candidate."""
    return df.select(
        "ord",
        render(fixed.TUNE_REWRITE, prompt=strip_or_empty(F.col("original_prompt"))).alias("original_query"),
        F.to_json(
            F.struct(
                strip_or_empty(F.col("analysis")).alias("explanation"),
                strip_or_empty(F.col("optimized_prompt")).alias("final_rewritten_query"),
            )
        ).alias("candidate_prompt"),
    )


def rating_pairs(df: DataFrame) -> DataFrame:
    """``ord, prompt, avg_rating`` to query and JSON rating."""
    return df.select(
        "ord",
        render(fixed.TUNE_RATING, prompt=strip_or_empty(F.col("prompt"))).alias("original_query"),
        F.to_json(
            F.struct(
                F.lit(fixed.RATING_EXPLANATION).alias("explanation"),
                F.coalesce(F.col("avg_rating").cast("string"), F.lit(fixed.RATING_MISSING)).alias("final_rating"),
            )
        ).alias("candidate_prompt"),
    )


def match_and_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets, the second cut to the row count of the first."""
    return first.unionByName(ordered.first_rows(second, first.count(), ["ord"]))


def frequent_entries(tokens: DataFrame, vocabulary: DataFrame, most: int = FREQUENT_TOKENS) -> DataFrame:
    """Vocabulary entries of the ``most`` most frequent tokens, stored; tokens are counted, which combines before the shuffle."""
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), "token").limit(most).drop("_n")
    return store(top.join(vocabulary, "token", "left"), "frequent-tokens")


def encode(tokens: DataFrame, vocabulary: DataFrame, key: list[str], max_rows: int = 1_000_000) -> DataFrame:
    """Token ids per row from a vocabulary ``token, id``, in token order.

    ``tokens`` has the key and an array ``tokens``. Rows are dealt by their key once, with whole arrays; places are looked up by
    broadcast and gathered where they are. What is broadcast is the vocabulary if its counted rows and bytes allow it, else the entries
    of the most frequent tokens. Only the other tokens travel to their vocabulary entry and back, each once for a row that holds
    it. Unknown tokens give NULL ids; a row without tokens, or with NULL, keeps an empty list.
    """
    near = vocabulary
    whole = ordered.is_small(vocabulary, max_rows, VOCABULARY_BYTES)
    if not whole:
        near = frequent_entries(tokens, vocabulary)
        if not ordered.is_small(near, FREQUENT_TOKENS, VOCABULARY_BYTES):
            near = near.limit(0)
    words = tokens.select(*key, "tokens").repartition(*key).select(*key, F.posexplode_outer("tokens").alias("_pos", "token"))
    known = words.join(F.broadcast(near.select("token", "id", F.lit(True).alias("_near"))), "token", "left")
    here = F.col("_pos").isNotNull() & (F.lit(whole) | F.col("_near").isNotNull())
    entries = known.groupBy(*key).agg(F.collect_list(F.when(here, F.struct("_pos", "id"))).alias("_ids"))
    if not whole:
        far = known.where(F.col("_pos").isNotNull() & F.col("_near").isNull())
        far = far.groupBy(*key, "token").agg(F.collect_list("_pos").alias("_at"))
        found = far.join(vocabulary, "token", "left").select(*key, "id", F.explode("_at").alias("_pos"))
        found = found.groupBy(*key).agg(F.collect_list(F.struct("_pos", "id")).alias("_far"))
        entries = ordered.match(entries, found, key, "left")
        none = F.slice("_ids", 1, 0)
        entries = entries.withColumn("_ids", F.concat("_ids", F.coalesce("_far", none)))
    return entries.select(*key, F.sort_array("_ids")["id"].alias("ids"))


def pack(
    df: DataFrame,
    prompt_ids: Column,
    target_ids: Column,
    end_id: int,
    pad_id: int,
    max_length: int = fixed.PACK_LENGTH,
) -> DataFrame:
    """Fixed-length ``input_ids, labels, attention_mask`` from prompt and target ids.

    The end mark follows the target; a long target is cut to what the prompt leaves, and a
    prompt that is itself too long is cut so that every row has exactly ``max_length`` entries.
    """
    ids = df.withColumn("_prompt", F.slice(prompt_ids.cast("array<int>"), 1, max_length)).withColumn(
        "_target", F.concat(target_ids.cast("array<int>"), F.array(F.lit(end_id)))
    )
    kept = ids.withColumn(
        "_target", F.slice("_target", F.lit(1), F.lit(max_length) - F.size("_prompt"))
    ).withColumn("_pad", F.lit(max_length) - F.size("_prompt") - F.size("_target"))
    ignored = F.lit(fixed.IGNORED_LABEL)
    return (
        kept.withColumn("input_ids", F.concat("_prompt", "_target", F.array_repeat(F.lit(pad_id), F.col("_pad"))))
        .withColumn(
            "labels",
            F.concat(
                F.array_repeat(ignored, F.size("_prompt")), F.col("_target"), F.array_repeat(ignored, F.col("_pad"))
            ),
        )
        .withColumn(
            "attention_mask",
            F.concat(
                F.array_repeat(F.lit(1), F.lit(max_length) - F.col("_pad")),
                F.array_repeat(F.lit(0), F.col("_pad")),
            ),
        )
        .drop("_prompt", "_target", "_pad")
    )
