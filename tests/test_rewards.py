import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.functions import rewards
from verdigris.operators import scoring


@pytest.mark.parametrize(
    "reward, scale, want",
    [(-1.0, None, (0, 0)), (None, 5, (0, 0)), (4.0, 5, (0.8, 0.3)), (7.0, 5, (1, 0.3)), (-0.5, None, (0, 0.3)), (0.4, None, (0.4, 0.3))],
)
def test_clamp(value, reward, scale, want):
    got = value(rewards.clamp_with_weight(F.col("x"), 0.3, scale), "x DOUBLE", (reward,))
    assert (got["value"], got["weight"]) == pytest.approx(want)


def composite(value, parts, weights, scale=None):
    names = list(parts)
    column = rewards.composite({n: F.col(n) for n in names}, weights, scale)
    return value(column, ", ".join(f"{n} DOUBLE" for n in names), tuple(parts.values()))


def test_composite_renormalises(value):
    weights = {"json": 0.2, "prompt_quality": 0.3, "judge": 0.5}
    assert composite(value, {"json": 1.0, "prompt_quality": 5.0, "judge": -1.0}, weights) == pytest.approx(1.0)
    assert composite(value, {"json": 0.0, "prompt_quality": 2.5, "judge": 1.0}, weights) == pytest.approx(0.65)
    assert composite(value, {"json": -1.0, "prompt_quality": -1.0, "judge": -1.0}, weights) == 0.0


def test_composite_does_not_depend_on_weight_scale(value):
    parts = {"json": 1.0, "prompt_quality": 3.0, "judge": 0.4}
    one = composite(value, parts, {"json": 0.2, "prompt_quality": 0.3, "judge": 0.5})
    ten = composite(value, parts, {"json": 2.0, "prompt_quality": 3.0, "judge": 5.0})
    assert one == pytest.approx(ten)


def test_unweighted_component_is_not_read(spark):
    samples = spark.range(5).withColumnRenamed("id", "sample_id")
    scores = samples.withColumn("score", F.lit(1.0))
    unread = scores.withColumn("score", F.raise_error("read").cast("double"))
    joined = scoring.attach_recorded(samples, {"judge": scores, "local_judge": unread}, {"judge": 0.5, "local_judge": 0})
    assert joined.columns == ["sample_id", "judge"] and joined.count() == 5


@pytest.mark.parametrize(
    "first, second, reference, strict",
    [(4.0, 2.0, 3.0, 3.0), (4.0, -1.0, 1.5, 4.0), (-1.0, 3.0, 1.0, 3.0), (-1.0, -1.0, -1.0, -1.0)],
)
def test_prompt_quality(value, first, second, reference, strict):
    cols = ("a DOUBLE, b DOUBLE", (first, second))
    assert value(rewards.prompt_quality(F.col("a"), F.col("b")), *cols) == reference
    assert value(rewards.prompt_quality(F.col("a"), F.col("b"), "strict"), *cols) == strict


@pytest.mark.parametrize(
    "m, g, l, reference, strict",
    [
        (1.0, 4.0, 2.0, 0.8, 0.8),
        (1.0, 4.0, -1.0, 0.65, 0.9),  # a failed second score is subtracted
        (1.0, 4.0, 1.0, 0.9, 0.75),  # a second score of 1 is ignored
        (0.0, -1.0, 3.0, 0.3, 0.3),
        (1.0, -1.0, -1.0, 1.0, 1.0),
    ],
)
def test_composite_math(value, m, g, l, reference, strict):
    cols = ("m DOUBLE, g DOUBLE, l DOUBLE", (m, g, l))
    build = lambda mode: rewards.composite_math(F.col("m"), F.col("g"), F.col("l"), mode=mode)
    assert value(build("reference"), *cols) == pytest.approx(reference)
    assert value(build("strict"), *cols) == pytest.approx(strict)


@pytest.mark.parametrize("p, o, want", [(5.0, 1.0, 1.0), (4.0, -1.0, 0.8), (-1.0, 0.7, 0.7), (-1.0, -1.0, 0.0), (0.0, 0.0, 0.0)])
def test_two_score(value, p, o, want):
    got = value(rewards.two_score(F.col("p"), F.col("o")), "p DOUBLE, o DOUBLE", (p, o))
    assert got == pytest.approx(want)


def test_judge_scale_aliases(value):
    scale = lambda name, mode: value(rewards.judge_scale(F.col("x"), mode), "x STRING", (name,))
    assert scale("cnndm", "reference") == 5 and scale("cnn_dailymail", "reference") == 1
    assert scale("cnn_dailymail", "strict") == 5 and scale("nq", "strict") == 1


def test_zscore(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (1, 2.0)], "b INT, r DOUBLE")
    got = sorted((r["b"], r["z"]) for r in scoring.zscore(df, "r", "b", "z").collect())
    assert got == [(0, pytest.approx(-1, abs=1e-5)), (0, pytest.approx(1, abs=1e-5)), (1, 0.0), (1, 0.0)]


def test_batch_rewards_zero_unparsed(spark):
    good = '"final_rewritten_query": "q"}'
    df = spark.createDataFrame(
        [(0, good, "red fox", ["red fox"], '{"score": 1}'), (0, "bad", "red fox", ["red fox"], '{"score": 1}')],
        "batch_id INT, completion STRING, answer STRING, target ARRAY<STRING>, judge_text STRING",
    )
    for name in ("rouge", "judge"):
        job = scoring.bound_reward(name)
        assert job.__name__ == name
        assert sorted(r["raw_reward"] for r in job(df).collect()) == [0.0, 1.0]


def test_perplexity(spark):
    rows = [(0, [0.0, 0.0]), (0, [0.0, 0.0, 0.0, 0.0]), (1, [1000.0, 0.0])]
    df = spark.createDataFrame(rows, "g INT, logits ARRAY<DOUBLE>")
    got = {r["g"]: r["reward"] for r in scoring.perplexity_rewards(df, "g").collect()}
    assert got[0] == pytest.approx(math.exp((math.log(0.5) + math.log(0.25)) / 2))
    assert got[1] == pytest.approx(1.0)


def test_unknown_metric_is_null(spark):
    df = spark.createDataFrame([("a", ["a"], "{}")], "answer STRING, target ARRAY<STRING>, judge_text STRING")
    assert scoring.score_metric(df, "nonsense").first()["value"] is None
    assert scoring.score_metric(df, "em").first()["value"] == 1.0


def test_user_reward_runs_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x * 1.0

    job = scoring.user_reward(count, ["x"])
    assert job.__name__ == "count"
    assert job(spark.range(20).withColumnRenamed("id", "x")).where("reward > 5").count() == 14
    assert seen.value == 20
