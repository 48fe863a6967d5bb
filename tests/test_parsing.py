import pytest
from pyspark.sql import functions as F

from verdigris.functions import parsing

FIELD = "final_rewritten_query"


@pytest.mark.parametrize(
    "completion, rewrite, outcome",
    [
        ('{"final_rewritten_query": "x {y}"}', "x {y}", "strict"),
        ('```json\n{"final_rewritten_query": "x"}\n```', "x", "strict"),
        ('```\n{"final_rewritten_query": "x"}```', "x", "strict"),
        ('{"explanation": "e"}', None, "strict"),
        ('{"final_rewritten_query": null}', None, "strict"),
        ('{"final_rewritten_query": 5}', None, "strict"),
        ('"explanation": "e", "final_rewritten_query": "x"}', "x", "cut"),
        ('{"final_rewritten_query": "x"} and more }', "x", "cut"),
        ('{"final_rewritten_query": "x"} {"b": 1}', "x", "cut"),
        ("{'final_rewritten_query': 'it'}", "it", "lenient"),
        ('{"final_rewritten_query": "a", "final_rewritten_query": "b"}', "b", "lenient"),
        ('{"explanation": "say "hi"", "final_rewritten_query": "x', "x", "pattern"),
        ("plain words", None, "failed"),
        ("", None, "failed"),
    ],
)
def test_rewritten_query_rungs(value, completion, rewrite, outcome):
    got = value(parsing.rewritten_query(F.col("x")), "x STRING", (completion,))
    assert (got["value"], got["outcome"]) == (rewrite, outcome)


def test_empty_rewrite_counts_as_json_but_gives_raw(spark):
    text = '{"final_rewritten_query": ""}'
    row = spark.createDataFrame([(text,)], "c STRING").withColumn("p", parsing.rewritten_query(F.col("c"))).select(
        parsing.json_success(F.col("p")).alias("ok"), parsing.rewrite_or_raw(F.col("p"), F.col("c")).alias("raw")
    ).first()
    assert row["ok"] == 1.0 and row["raw"] == text


@pytest.mark.parametrize(
    "text, strict, tolerant",
    [
        ('{"score": 4}', 4, 4),
        ('{"score": "4"}', 4, 4),
        ('{"score": -0.5}', -0.5, -0.5),
        ('```json\n{"score": 3}```', -1, 3),
        ('{"score": 3} ok', -1, 3),
        ("{'score': 2}", -1, 2),
        ('"explanation": "x", "score": 1}', -1, 1),
        ('{"explanation": "a "b" c", "score": 5}', -1, 5),
        ('{"score": null}', -1, -1),
        ('{"score": "high"}', -1, -1),
        ('{"other": 1}', -1, -1),
        ("[1]", -1, -1),
        ("", -1, -1),
    ],
)
def test_scores(value, text, strict, tolerant):
    assert value(parsing.strict_score(F.col("x")), "x STRING", (text,)) == strict
    assert value(parsing.tolerant_score(F.col("x")), "x STRING", (text,)) == tolerant


def test_failed_score_is_a_parameter(value):
    assert value(parsing.strict_score(F.col("x"), missing=0.0), "x STRING", ("bad",)) == 0.0
    assert value(parsing.strict_score(F.col("x"), missing=None), "x STRING", ("bad",)) is None


@pytest.mark.parametrize(
    "text, index",
    [
        ('{"final_selection": 2}', 1),
        ('{"final_selection": "3"}', 2),
        ('{"final_selection": 0}', -1),
        ('{"explanation": "9", "final_selection": " 4 "}', 3),
        ("{'final_selection': '2'}", 1),
        ('{"final_selection": 2.5}', 4),
        ('{"final_selection": "none of 3"}', 2),
        ("I choose 12, no: 7.", 6),
        ("nothing", -1),
        ("", -1),
        ("1" * 30, 2**63 - 1),
    ],
)
def test_choice_index(value, text, index):
    assert value(parsing.choice_index(F.col("x")), "x STRING", (text,)) == index


def test_prefixed_rewrite(value):
    run = lambda s: value(parsing.prefixed_rewrite(F.col("x")), "x STRING", (s,))
    assert run('"final_rewritten_query": "x"}') == "x"
    assert run('{"final_rewritten_query": "x"}') is None
    assert run("x") is None


def test_selection(value):
    run = lambda s: value(parsing.selection(F.col("x")), "x STRING", (s,))
    assert tuple(run('{"selection": "2", "explanation": "e"}')) == (2, "e")
    assert tuple(run('{"selection": 1}')) == (1, "")
    assert run("Option 1")["selection"] is None


def test_echo(value):
    cols = ("o STRING, p STRING", ("ask ask me ", "ask"))
    assert value(parsing.strip_echo(F.col("o"), F.col("p")), *cols) == "ask me"
    assert value(parsing.remove_echoes(F.col("o"), F.col("p")), *cols) == "me"
    kept = ("o STRING, p STRING", (" me ask", "ask"))
    assert value(parsing.strip_echo(F.col("o"), F.col("p")), *kept) == "me ask"
