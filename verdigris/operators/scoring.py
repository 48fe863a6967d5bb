"""Reward jobs over tables: recorded judge scores, composites, z-scores, perplexity."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import fixed_values as fixed
from verdigris.functions import parsing, rewards
from verdigris.operators import ordered
from verdigris.operators.rouge import with_best_rouge
from verdigris.session import store

REWARD_JOBS: dict[str, Callable[..., DataFrame]] = {}


def reward_job(name: str):
    """Register a ``DataFrame -> DataFrame`` reward under a name."""

    def keep(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REWARD_JOBS[name] = job
        return job

    return keep


def bound_reward(name: str, **params) -> Callable[[DataFrame], DataFrame]:
    """A registered reward with its parameters set, still carrying its name."""
    job = partial(REWARD_JOBS[name], **params)
    job.__name__ = name
    return job


def user_reward(fn: Callable[..., pd.Series], columns: list[str], into: str = "reward"):
    """A reward job from a user's function on pandas Series, run in Arrow batches."""
    # Declared non-deterministic so that filters on the reward do not run the function again.
    scored = F.pandas_udf(fn, T.DoubleType()).asNondeterministic()

    def job(df: DataFrame) -> DataFrame:
        return df.withColumn(into, scored(*[F.col(c) for c in columns]))

    job.__name__ = getattr(fn, "__name__", "user_reward")
    return job


def attach_recorded(
    df: DataFrame, recorded: Mapping[str, DataFrame], weights: Mapping[str, float], key: str = "sample_id"
) -> DataFrame:
    """Join recorded scores by component; a component without weight is not read at all.

    A sample recorded more than once counts once, with its largest score, so no row is multiplied.
    """
    for name, scores in recorded.items():
        if weights.get(name, 0) > 0:
            df = df.join(scores.groupBy(key).agg(F.max("score").alias(name)), key, "left")
    return df


def composite_rewards(
    df: DataFrame,
    weights: Mapping[str, float] = fixed.COMPOSITE_WEIGHTS,
    task: str | None = None,
    mode: str = "reference",
    into: str = "reward",
) -> DataFrame:
    """Weighted composite of the component columns present in ``df``.

    ``first_prompt_score`` and ``second_prompt_score`` together make the prompt-quality part.
    """
    parts = {name: F.col(name) for name in weights if name in df.columns}
    if "first_prompt_score" in df.columns:
        parts["prompt_quality"] = rewards.prompt_quality(
            F.col("first_prompt_score"), F.col("second_prompt_score"), mode
        )
    scale = rewards.judge_scale(F.col(task), mode) if task else None
    return df.withColumn(into, rewards.composite(parts, weights, scale))


def zscore(df: DataFrame, reward: str, batch: str, into: str) -> DataFrame:
    """Reward minus batch mean over batch deviation (population) plus a small constant.

    Mean and deviation are partial aggregates; a batch's rows are never brought together.
    ``df`` is stored once, so a costly or random reward is the same for the statistics and for the rows.
    """
    df = store(df, "rewards")
    stats = df.groupBy(batch).agg(
        F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"), F.count(F.lit(1)).alias("_rows")
    )
    joined = ordered.join_group_stats(df, stats, [batch], "_rows")
    return joined.withColumn(
        into, (F.col(reward) - F.col("_mean")) / (F.col("_sd") + fixed.ZSCORE_EPSILON)
    ).drop("_mean", "_sd", "_rows")


@reward_job("rouge")
def rouge_batch_reward(
    df: DataFrame, completion: str = "completion", answer: str = "answer", batch: str = "batch_id", stem: bool = True
) -> DataFrame:
    """Best ROUGE-L of answers whose completion parsed, else 0, as z-score of the batch."""
    scored = with_best_rouge(df, answer, "target", "_rouge", stem)
    parsed = parsing.prefixed_rewrite(F.col(completion)).isNotNull()
    raw = scored.withColumn("raw_reward", F.when(parsed, F.col("_rouge")).otherwise(0.0)).drop("_rouge")
    return zscore(raw, "raw_reward", batch, "reward")


@reward_job("judge")
def judge_batch_reward(
    df: DataFrame, completion: str = "completion", judged: str = "judge_text", batch: str = "batch_id"
) -> DataFrame:
    """Judge score of answers whose completion parsed, else 0, as z-score of the batch."""
    parsed = parsing.prefixed_rewrite(F.col(completion)).isNotNull()
    score = parsing.strict_score(F.col(judged), missing=0.0)
    raw = df.withColumn("raw_reward", F.when(parsed, score).otherwise(0.0))
    return zscore(raw, "raw_reward", batch, "reward")


@reward_job("composite")
def composite_job(df: DataFrame, **params) -> DataFrame:
    return composite_rewards(df, **params)


def perplexity_rewards(logits: DataFrame, group: str, values: str = "logits") -> DataFrame:
    """Inverse perplexity of the most likely classes, per group of positions."""
    certainty = rewards.argmax_log_probability(F.col(values))
    return logits.groupBy(group).agg(
        (1 / F.exp(-F.avg(certainty))).alias("reward"), F.count(F.lit(1)).alias("n_positions")
    )


def score_metric(df: DataFrame, name: str, into: str = "value", stem: bool = True) -> DataFrame:
    """Metric by name over ``answer, target ARRAY, judge_text``; NULL for an unknown name."""
    if name == "rouge":
        return with_best_rouge(df, "answer", "target", into, stem)
    build = rewards.metric(name)
    if build is None:
        return df.withColumn(into, F.lit(None).cast("double"))
    return df.withColumn(
        into, build(F.col("answer"), F.get("target", F.lit(0)), F.col("judge_text"))
    )
