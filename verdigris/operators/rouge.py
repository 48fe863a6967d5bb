"""ROUGE-L: longest common subsequence of two token lists as an F score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.stemming import porter_stems
from verdigris.functions.text import overlap_f1, rouge_tokens


def _common(positions: dict, length: int, other) -> int:
    """Length of the longest common subsequence, one machine word per 64 positions."""
    full = (1 << length) - 1
    open_ = full
    for token in other:
        hit = open_ & positions.get(token, 0)
        if hit:
            open_ = (open_ + hit | open_ - hit) & full
    return length - open_.bit_count()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _common_lengths(token_lists: pd.Series) -> pd.Series:
    """Per row the subsequence lengths of the first list with each of the others."""
    out = []
    for answer, *references in token_lists:
        positions: dict = {}
        for i, token in enumerate(answer):
            positions[token] = positions.get(token, 0) | 1 << i
        out.append([_common(positions, len(answer), reference) for reference in references])
    return pd.Series(out)


# Declared non-deterministic so that a filter on the score is not pushed below it as a second run.
_common_lengths = _common_lengths.asNondeterministic()


def tokens(text: Column, stem: bool) -> Column:
    found = rouge_tokens(text)
    return porter_stems(found) if stem else found


def with_rouge(df: DataFrame, answer: str, references: str, into: str, stem: bool = True) -> DataFrame:
    """Add the ROUGE-L of an answer against each of its references as an array.

    A row holds the answer and all of its references, so the score needs no shuffle and a
    frequent token costs no more than a rare one: no match pairs are ever listed.
    """
    texts = F.concat(
        F.array(answer), F.coalesce(F.col(references), F.array().cast("array<string>"))
    )
    prepared = df.withColumn("_tokens", F.transform(texts, lambda t: tokens(F.coalesce(t, F.lit("")), stem)))
    sizes = F.transform("_tokens", lambda t: F.size(t))
    lengths = prepared.withColumn("_sizes", sizes).withColumn("_common", _common_lengths("_tokens"))
    scored = F.transform(
        "_common", lambda common, i: overlap_f1(common, F.get("_sizes", i + 1), F.get("_sizes", F.lit(0)))
    )
    return lengths.withColumn(into, scored).drop("_tokens", "_sizes", "_common")


def with_best_rouge(df: DataFrame, answer: str, references: str, into: str, stem: bool = True) -> DataFrame:
    """Add the best ROUGE-L over all references, at least 0."""
    return with_rouge(df, answer, references, into, stem).withColumn(
        into, F.coalesce(F.array_max(into), F.lit(0.0))
    )
