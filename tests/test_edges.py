"""Edges of hooks, parsing, numbers and logs."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import parsing, text
from verdigris.operators import hooks, scoring
from verdigris.operators.prompts import request_id
from verdigris.plans import evaluate
from verdigris.sources import logs


def test_one_bad_prompt_costs_few_calls(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def backend():
        def answer(batch):
            with open(calls, "a") as log:
                log.write(f"{len(batch)}\n")
            if any(p == "bad" for p in batch):
                raise ValueError("refused")
            return [p.upper() for p in batch]

        return answer

    rows = [(i, "bad" if i == 77 else f"p{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k INT, prompt STRING").coalesce(1)
    got = hooks.generate(df, "prompt", backend).collect()
    assert [r["text"] for r in got if r["k"] != 77] == [f"P{i}" for i in range(500) if i != 77]
    assert [(r["text"], r["error"]) for r in got if r["k"] == 77] == [("", "refused")]
    sizes = list(map(int, open(calls).read().split()))
    assert len(sizes) <= 20
    open(calls, "w").close()
    hooks.generate(df.where("k < 70"), "prompt", backend, batch_size=16).collect()
    assert max(map(int, open(calls).read().split())) == 16


def test_recorded_twice_counts_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k INT, prompt STRING")
    ids = df.select(request_id(F.col("prompt")).alias("request_id"), F.lit("x").alias("text"))
    found = hooks.recorded(df, ids.where("true").union(ids.withColumn("text", F.lit("y"))), "prompt").collect()
    assert sorted((r["k"], r["text"]) for r in found) == [(1, "x"), (2, "x"), (3, "x")]
    samples = spark.createDataFrame([(1,), (2,)], "sample_id INT")
    scores = spark.createDataFrame([(1, 0.5), (1, 0.7)], "sample_id INT, score DOUBLE")
    joined = scoring.attach_recorded(samples, {"judge": scores}, {"judge": 1.0}).collect()
    assert sorted((r["sample_id"], r["judge"]) for r in joined) == [(1, 0.7), (2, None)]


@pytest.mark.parametrize("body, score", [
    ('{"score": 3, "score": 4}', 4.0), ('{"score": 3}', 3.0), ("{'score': 3}", -1.0), ('{"a": 1, "a": 2, "score": 2}', 2.0),
])
def test_repeated_keys(value, body, score):
    assert value(parsing.strict_score(F.lit(body))) == score


@pytest.mark.parametrize("gold, match", [("5", 1.0), ("5d", 0.0), ("5f", 0.0), ("NaN", 0.0), ("5.0", 1.0), ("+5", 1.0), ("5e0", 1.0)])
def test_numbers_are_plain(value, gold, match):
    assert value(text.numeric_match(F.lit("it is 5"), F.lit(gold), mode="strict")) == match


def test_log_numbers_of_any_size(value):
    assert value(logs.fixed_decimals(F.lit(float("nan")), 4)) == "NaN"
    assert value(logs.fixed_decimals(F.lit(1e25), 2)) == "1.0E25"
    assert value(logs.fixed_decimals(F.lit(0.125), 2)) == "0.12"


def test_every_run_has_its_pick(spark):
    scored = spark.createDataFrame([(0, 1.0), (1, 2.0)], "cand_idx INT, avg_em DOUBLE")
    picks = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 7), ("e", None)], "run_id STRING, cand_idx INT")
    got = sorted((r["run_id"], r["avg_em"]) for r in evaluate.pick_report(scored, picks).collect())
    assert got == [("a", 2.0), ("b", 1.0), ("c", 2.0)]


def test_rewards_are_evaluated_once(spark):
    noisy = spark.range(200).selectExpr("id % 4 AS batch", "rand() AS reward")
    rows = scoring.zscore(noisy, "reward", "batch", "z").collect()
    for batch in range(4):
        own = [r for r in rows if r["batch"] == batch]
        assert abs(sum(r["z"] for r in own)) < 1e-3
