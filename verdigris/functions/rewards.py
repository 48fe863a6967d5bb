"""Reward columns: clamping, weighted sums, case rules, metric names."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.functions import parsing, text


def clamp_with_weight(reward: Column, weight: float, scale: Column | float | None = None) -> Column:
    """Struct ``value, weight``: scaled into [0, 1], or both 0 for a failed (-1) or missing score."""
    if scale is None:
        scaled = reward
    else:
        scaled = reward / (scale if isinstance(scale, Column) else F.lit(float(scale)))
    failed = F.coalesce(reward == parsing.NO_SCORE, F.lit(True))
    return F.struct(
        F.when(failed, 0.0).otherwise(F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))).alias("value"),
        F.when(failed, 0.0).otherwise(F.lit(float(weight))).alias("weight"),
    )


def weighted_mean(parts: list[Column]) -> Column:
    """Mean of clamped parts by their remaining weights; 0 when none remains."""
    if not parts:
        return F.lit(0.0)
    total = sum((p.getField("value") * p.getField("weight") for p in parts), F.lit(0.0))
    weight = sum((p.getField("weight") for p in parts), F.lit(0.0))
    return F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))


def prompt_quality(first: Column, second: Column, mode: str = "reference") -> Column:
    """Mean of two prompt scores.

    ``reference`` averages a single failure (-1) in; ``strict`` uses the score that exists.
    """
    if mode == "reference":
        return (first + second) / 2
    usable = [F.when(c >= 0, c) for c in (first, second)]
    return (
        F.when(usable[0].isNotNull() & usable[1].isNotNull(), (first + second) / 2)
        .otherwise(F.coalesce(*usable, F.lit(parsing.NO_SCORE)))
    )


def judge_scale(task: Column, mode: str = "reference") -> Column:
    """5 for summary tasks, else 1; ``strict`` also accepts their aliases."""
    if mode == "reference":
        names = list(fixed.SUMMARY_TASKS)
        known = task.isin(names)
    else:
        names = [a for a, t in fixed.TASK_ALIASES.items() if t in fixed.SUMMARY_TASKS]
        known = F.lower(task).isin(names)
    return F.when(known, F.lit(fixed.JUDGE_SCALE)).otherwise(F.lit(1.0))


def composite(
    parts: Mapping[str, Column],
    weights: Mapping[str, float] = fixed.COMPOSITE_WEIGHTS,
    scale: Column | None = None,
) -> Column:
    """Weighted composite over the named parts; parts without weight are left out of the plan."""
    scale = F.lit(1.0) if scale is None else scale
    scales = {"prompt_quality": fixed.JUDGE_SCALE, "judge": scale, "local_judge": scale, "second_judge": scale}
    return weighted_mean(
        [
            clamp_with_weight(parts[name], weight, scales.get(name))
            for name, weight in weights.items()
            if weight > 0 and name in parts
        ]
    )


def composite_math(
    match: Column, first: Column, second: Column, use_prompt_scores: bool = True, mode: str = "reference"
) -> Column:
    """Numeric match blended with up to two prompt scores."""
    if not use_prompt_scores:
        return match.cast("double")
    unusable = 1.0 if mode == "reference" else parsing.NO_SCORE
    return (
        F.when((first != -1) & (second != unusable), match / 2 + first / 20 + second / 20)
        .when(first != -1, match / 2 + first / 10)
        .when(second != -1, match / 2 + second / 10)
        .otherwise(match.cast("double"))
    )


def two_score(prompt_score: Column, output_score: Column) -> Column:
    """Blend of a 0-5 prompt score and an output score, each usable when not negative."""
    return (
        F.when((prompt_score >= 0) & (output_score >= 0), prompt_score / 10 + output_score / 2)
        .when(prompt_score >= 0, prompt_score / 5)
        .when(output_score >= 0, output_score.cast("double"))
        .otherwise(F.lit(0.0))
    )


def argmax_log_probability(logits: Column) -> Column:
    """Log softmax at the largest logit of one position."""
    return let_max(logits, lambda top: -F.ln(
        F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top))
    ))


def let_max(values: Column, body: Callable[[Column], Column]) -> Column:
    return text.let(F.array_max(values).cast("double"), body)


def metric(name: str) -> Callable[..., Column] | None:
    """Column builder of a row-local metric by name, None for an unknown one.

    Judge metrics read a recorded judge output; ``rouge`` is a table job
    (``operators.rouge.with_best_rouge``) and is dispatched there.
    """
    return {
        "em": lambda answer, target, judged: text.exact_match(target, answer),
        "gsm8k": lambda answer, target, judged: text.numeric_match(answer, target),
        "llm_prompt": lambda answer, target, judged: parsing.strict_score(judged),
        "llm": lambda answer, target, judged: parsing.strict_score(judged, missing=0.0),
        "llm_test": lambda answer, target, judged: parsing.strict_score(judged),
    }.get(name)
