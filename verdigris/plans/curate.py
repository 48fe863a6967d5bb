"""Curating training prompts: cross-judge matrix and quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.operators import ordered
from verdigris.operators.rouge import with_best_rouge
from verdigris.session import store

ANSWERERS = ("first", "second")
JUDGES = ("first", "second")
# Scores of a candidate: each answerer's answer by each judge, own judge first.
SCORE_ORDER = (("first", "first"), ("second", "first"), ("second", "second"), ("first", "second"))


def judge_matrix(judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Long ``keys, answerer, judge, score`` to one row per candidate with four scores.

    A missing or failed judgement counts as -1. Aggregation combines before the shuffle.
    """

    def cell(answerer: str, judge: str):
        here = (F.col("answerer") == answerer) & (F.col("judge") == judge)
        return F.coalesce(F.max(F.when(here, F.col("score"))), F.lit(-1.0))

    return judgements.groupBy(*keys).agg(
        *[cell(a, j).alias(f"{a}_by_{j}") for a, j in SCORE_ORDER]
    )


def with_gate(
    matrix: DataFrame, success: float = fixed.SUCCESS_SCORE, perfect: float = fixed.PERFECT_SCORE
) -> DataFrame:
    """Add the score list and whether all scores reach each threshold."""
    scores = F.array(*[F.col(f"{a}_by_{j}") for a, j in SCORE_ORDER])
    return (
        matrix.withColumn("scores", scores)
        .withColumn("successful", F.forall("scores", lambda s: s >= success))
        .withColumn("perfect", F.forall("scores", lambda s: s >= perfect))
    )


def curate(
    gated: DataFrame, wanted: int = fixed.CURATE_WANTED, order: tuple[str, ...] = ("ord", "cand_idx")
) -> DataFrame:
    """Successful candidates up to the ``wanted``-th in scan order, perfect ones marked.

    Scanning stops after the wanted number, so the result is the first ``wanted`` successes; a
    perfect candidate is always a successful one.
    """
    return ordered.first_rows(gated.where("successful"), wanted, list(order))


def curate_in_ranges(
    judgements: DataFrame,
    keys: tuple[str, ...] = ("ord", "cand_idx"),
    wanted: int = fixed.CURATE_WANTED,
    success: float = fixed.SUCCESS_SCORE,
    perfect: float = fixed.PERFECT_SCORE,
    first_range: int | None = None,
) -> DataFrame:
    """As ``curate`` over the gated matrix of ``judgements``, reading no further than it has to.

    The first of ``keys``, a whole number, is cut into ranges, each twice as wide as all before it. A range is judged and gated, and its
    successes stored, until there are enough: a filter on the key reaches the scan, so of a record sorted or partitioned by it only
    the key is read as a whole (for its ends), judgements about as far as the gate needs. Rows with a NULL key come first,
    as in a sort.
    """
    order = keys[0]
    ends = judgements.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    gate = lambda part: with_gate(judge_matrix(part, list(keys)), success, perfect).where("successful")
    found = [store(gate(judgements.where(F.col(order).isNull())), "gated")]
    have = found[0].count()
    if ends["low"] is not None:
        start, width = ends["low"], first_range or 2 * wanted
        while have < wanted and start <= ends["high"]:
            inside = (F.col(order) >= start) & (F.col(order) < start + width)
            found.append(store(gate(judgements.where(inside)), "gated"))
            have += found[-1].count()
            start, width = start + width, 2 * width
    return ordered.first_rows(reduce(DataFrame.unionByName, found), wanted, list(keys))


def curated_prompts(kept: DataFrame, candidates: DataFrame, keys: list[str], stem: bool = True) -> DataFrame:
    """Records of the kept candidates with their texts, scores and the first answer's ROUGE-L.

    ROUGE is for the record only and is computed for kept candidates alone. ``kept`` holds the
    wanted number of rows at most and is broadcast after counting it.
    """
    chosen = ordered.broadcast_if_small(kept.select(*keys, "scores", "perfect"))
    records = candidates.join(chosen, keys).withColumn("_reference", F.array("reference_answer"))
    return with_best_rouge(records, "final_answer_first", "_reference", "rouge_score", stem).select(
        *keys,
        "original_query",
        "reference_answer",
        "candidate_prompt",
        "final_answer_first",
        "final_answer_second",
        "scores",
        "rouge_score",
        "perfect",
    )
