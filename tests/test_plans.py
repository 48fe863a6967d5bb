"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import ordered, prepare, rouge
from verdigris.plans import evaluate, fixtures
from verdigris.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    """Exchanges that move rows by key; the spreading of small test files is not one."""
    return [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" not in line]


NARROW = (
    "prep_summaries prep_sci prep_qa_context prep_math sample_projection task_instruction pack_sequences "
    "pair_em_f1 stem_tokens numeric_match parse_completion parse_score parse_choice final_prompt "
    "clamp_weight composite composite_math two_score split_exact split_threshold batch_hook"
).split()


@pytest.mark.parametrize("name", NARROW)
def test_row_local_work_does_not_shuffle(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not shuffles(plan)
    assert "BatchEvalPython" not in plan.replace("ArrowEvalPython", "")


def test_scan_reads_needed_columns_only(spark, sf):
    plan = plan_of(QUERIES["composite_math"](spark, sf))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert columns.count(":") == 5 and "l_shipdate" not in columns
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan_of(fixtures.questions(spark, sf))


def test_skip_becomes_a_pushed_filter(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert "GreaterThan(o_orderkey" in plan_of(ordered.skip_rows(orders, 250, "o_orderkey"))


def test_rouge_runs_once_under_a_filter(spark, sf):
    scored = evaluate.usable(evaluate.with_scores(fixtures.answers(spark, sf)))
    assert plan_of(scored).count("ArrowEvalPython") == 1


def test_costly_column_is_not_repeated(spark, sf):
    events = fixtures.completions(spark, sf)
    kept = text.once(events, "n", text.final_number(F.col("choice_text"))).where("n <> ''")
    assert plan_of(kept).count("regexp_extract_all") == 1


@pytest.mark.parametrize(
    "name",
    ["rolling_mean", "early_stop_ma", "early_stop_best", "batch_collate", "prep_end_to_end", "zscore", "quality_gate"],
)
def test_no_window_over_a_whole_table(spark, sf, name):
    """A window without partition may only order the summary of the range partitions."""
    plan = plan_of(QUERIES[name](spark, sf))
    for line in plan.splitlines():
        if "Window [" in line or "Window(" in line:
            assert "_rows" in line or "_block" in line or "_peak" in line, line


def test_aggregates_combine_before_the_shuffle(spark, sf):
    for name in ("candidate_report", "judge_matrix", "perplexity", "qa_em_f1"):
        assert "partial_" in plan_of(QUERIES[name](spark, sf))


def test_split_marks_without_shuffle(spark):
    marked = ordered.mark_test_rows(spark.range(1000), "id", 0.1)
    assert not shuffles(plan_of(marked))
    assert marked.where("is_test").count() == 100


def test_normalize_filters_before_rendering(spark, sf):
    plan = plan_of(prepare.normalize(fixtures.news(spark, sf), "cnndm", True))
    assert "Filter" in plan and plan.index("Rewrite the following") < plan.index("Filter")


def test_rouge_is_row_local(spark, sf):
    df = fixtures.news(spark, sf).select(F.col("article").alias("answer"), F.array("highlights").alias("target"))
    assert not shuffles(plan_of(rouge.with_best_rouge(df, "answer", "target", "r")))


@pytest.mark.parametrize("name", ["best_mean_choice", "win_rate"])
def test_filters_do_not_read_texts_twice(spark, sf, name):
    """A filter on what was parsed stays above the parsing, and so above the spreading of small files."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Filter ", line)]
    assert filters and not any("from_json" in line or "regexp" in line for line in filters)
