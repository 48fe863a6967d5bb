"""Evaluation reports over tables of recorded answers and judge outputs.

A scored answer has ``sample_id, answer, target ARRAY<STRING>, judge_text`` and gains
``em, f1, rouge, judge``. Reports drop empty answers and failed scores.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import parsing, text
from verdigris.operators import hooks, prompts
from verdigris.operators.rouge import with_best_rouge
from verdigris.session import store
from verdigris.sources import logs
from verdigris.sources.generations import generation_store

METRICS = ("em", "f1", "rouge", "judge")
#: Answers that one task scores, about: scoring takes much time for few bytes, so tasks are not cut by bytes.
SCORED_ROWS = 5_000
FAILED_IS_ZERO, FAILED_IS_DROPPED = 0.0, parsing.NO_SCORE


def corpus_em_f1(answers: DataFrame) -> DataFrame:
    """Mean of the best EM and F1 per prediction, 0 for an empty table."""
    best = answers.select(text.best_scores(F.col("target"), F.col("answer")).alias("best"))
    return best.agg(
        F.coalesce(F.avg("best.em"), F.lit(0.0)).alias("avg_em"),
        F.coalesce(F.avg("best.f1"), F.lit(0.0)).alias("avg_f1"),
        F.count(F.lit(1)).alias("n"),
    )


def with_scores(
    answers: DataFrame,
    math: bool = False,
    failed: float = FAILED_IS_ZERO,
    mode: str = "reference",
    stem: bool = True,
) -> DataFrame:
    """Score non-empty answers.

    ``reference`` takes EM and F1 from the first reference only, ``strict`` from the best one;
    ROUGE is always the best. Math tasks use the numeric match for ROUGE and judge.
    """
    given = answers.where(F.coalesce(F.col("answer"), F.lit("")) != "")
    compared = F.slice("target", 1, 1) if mode == "reference" else F.col("target")
    scored = given.withColumn("_best", text.best_scores(compared, F.col("answer"))).withColumns(
        {"em": F.col("_best.em"), "f1": F.col("_best.f1")}
    ).drop("_best")
    if math:
        matched = text.numeric_match(F.col("answer"), F.get("target", F.lit(0)), mode=mode)
        return text.once(scored, "rouge", matched).withColumn("judge", F.col("rouge"))
    judged = text.once(scored, "judge", parsing.strict_score(F.col("judge_text"), missing=failed))
    return with_best_rouge(judged, "answer", "target", "rouge", stem)


def usable(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("rouge") >= 0) & (F.col("judge") >= 0))


def _means() -> list[Column]:
    return [F.avg(m).alias(f"avg_{m}") for m in METRICS]


def answer_report(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Means of all metrics and the number of samples, per group if given."""
    return usable(scored).groupBy(*(group or [])).agg(*_means(), F.count(F.lit(1)).alias("n"))


def rewriter_report(
    scored: DataFrame, completions: DataFrame, completion: str = "completion", parsed: str | None = None
) -> DataFrame:
    """Answer report plus how many completions there were, by parse outcome; ``parsed`` names a column that holds it already."""
    parsed = F.col(parsed) if parsed else parsing.rewritten_query(F.col(completion))
    outcomes = completions.select(parsed.alias("p")).agg(
        F.count(F.lit(1)).alias("total_prompts"),
        F.count_if(F.col("p.value").isNotNull()).alias("correct_json_count"),
        *[
            F.count_if(F.col("p.outcome") == o).alias(f"n_{o}")
            for o in (parsing.STRICT, parsing.CUT, parsing.LENIENT, parsing.PATTERN, parsing.FAILED)
        ],
    )
    # Both sides are single rows.
    return answer_report(scored).withColumn("_one", F.lit(1)).join(
        F.broadcast(outcomes.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


def candidate_report(scored: DataFrame) -> DataFrame:
    """Metrics of each instruction candidate over all samples; no row for one without any."""
    return answer_report(scored, ["cand_idx"])


def pick_report(by_candidate: DataFrame, picks: DataFrame) -> DataFrame:
    """Report row of the picked candidate for every run.

    ``picks`` has the run's columns and ``cand_idx`` from its choice text; ``by_candidate`` one row per candidate. A run
    whose pick was not scored, or could not be read, has no row.
    """
    return picks.join(by_candidate, "cand_idx")


def candidate_metrics(scored: DataFrame, picks: DataFrame, n: int) -> DataFrame:
    """Best, mean and picked value of each metric over a sample's candidates, averaged over samples.

    Each metric takes its own best candidate. A pick counts when it names one of the ``n``
    candidates and that candidate was scored. The candidates are scored once: one aggregate per sample gives
    all three values, a second one their means. A sample has one pick; of several the smallest counts.
    """
    # picks are read out of texts: the range is tested on what was read, where the rows are spread
    read = text.once(picks, "_pick", F.col("pick")).where(F.col("_pick").between(0, n - 1))
    picked = read.groupBy("sample_id").agg(F.min("_pick").alias("_pick"))
    marked = usable(scored).join(picked, "sample_id", "left")
    chosen = F.col("cand_idx") == F.col("_pick")
    per_sample = marked.groupBy("sample_id").agg(
        *[F.max(m).alias(f"max_{m}") for m in METRICS],
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        *[F.avg(F.when(chosen, F.col(m))).alias(f"choice_{m}") for m in METRICS],
        F.count_if(chosen).alias("_choices"),
    )
    kinds = ("max", "mean", "choice")
    overall = per_sample.agg(
        *[F.avg(f"{kind}_{m}").alias(f"{kind}_{m}") for kind in kinds for m in METRICS],
        F.count(F.lit(1)).alias("_samples"),
        F.count_if(F.col("_choices") > 0).alias("_chosen"),
    )
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            *[F.col(f"{kind}_{m}").alias(f"avg_{m}") for m in METRICS],
            F.col("_chosen" if kind == "choice" else "_samples").alias("n"),
        )
        for kind in kinds
    ]
    return overall.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _answered(
    samples: DataFrame, generations: DataFrame, templates: Mapping[str, str], task: str, params: str = ""
) -> DataFrame:
    """Recorded answers to ``final_prompt`` and the recorded judgement of each, by request from a generation store.

    What is joined is stored before it is used again, and dealt evenly to tasks of about ``SCORED_ROWS`` for scoring.
    """
    answered = hooks.recorded(samples, generations, "final_prompt", params, into="answer", distinct=True)
    answered = store(answered.drop("request_id", "final_prompt"), "answered")
    request = prompts.answer_request(
        F.lit(task), F.col("text"), F.col("answer"), prompts.list_text(F.col("target")), templates
    )
    asked = text.once(answered, "judge_request", request)
    judged = hooks.recorded(asked, generations, "judge_request", params, into="judge_text", distinct=True)
    return judged.drop("request_id", "judge_request").repartition(max(1, -(-answered.count() // SCORED_ROWS)))


def evaluate_rewriter(
    samples: DataFrame,
    generations: DataFrame,
    templates: Mapping[str, str],
    task: str,
    run_name: str,
    results_path: str,
    samples_path: str,
    params: str = "",
    failed: float = FAILED_IS_ZERO,
    stem: bool = True,
) -> DataFrame:
    """From samples to both logs: recorded rewrites, answers and judgements, scores, report and sample log.

    ``generations`` is the record ``request_id, text`` of every model output; what is missing is an empty text. The record
    is bucketed once, completions are parsed once, and the scored table is stored once for report and sample log. Returns the
    report with counts of parse outcomes.
    """
    kept = generation_store(generations)
    asked = hooks.recorded(samples, kept, "prompt", params, into="completion", distinct=True).drop("request_id")
    parsed = store(asked.withColumn("parsed", parsing.rewritten_query(F.col("completion"))), "parsed-completions")
    final = prompts.follow_prompt(F.col("text"), F.col("parsed"), F.col("completion"))
    followed = text.once(parsed, "final_prompt", final)
    answered = _answered(followed, kept, templates, task, params)
    scored = store(with_scores(answered, failed=failed, stem=stem), "scored-samples")
    report = store(rewriter_report(scored, parsed, parsed="parsed"), "rewriter-report")
    logs.write_results(
        report.select(
            F.lit(run_name).alias("name"),
            F.col("avg_em").alias("accuracy"),
            F.col("avg_f1").alias("f1"),
            F.col("avg_rouge").alias("rouge"),
            F.col("avg_judge").alias("judge"),
        ),
        results_path,
    )
    logs.write_sample_log(
        scored.select(
            F.lit(run_name).alias("run_name"),
            F.concat("original", "text").alias("original"),
            parsing.rewrite_or_raw(F.col("parsed"), F.col("completion")).alias("rewrite"),
            F.col("answer").alias("final_answer"),
            F.col("em").alias("accuracy"),
            "judge",
        ),
        samples_path,
    )
    return report


def evaluate_sampling(
    samples: DataFrame,
    generations: DataFrame,
    templates: Mapping[str, str],
    task: str,
    run_name: str,
    n: int,
    results_path: str,
    stem: bool = True,
) -> DataFrame:
    """From samples to three named result rows: best, mean and picked of ``n`` recorded rewrites each.

    A candidate's requests carry its number as their parameter; the selection request of a sample lists its candidates.
    """
    kept = generation_store(generations)
    candidates = prompts.fan_out(samples, n)
    keyed = candidates.withColumn("_asked", F.concat_ws("#", "prompt", "cand_idx"))
    asked = hooks.recorded(keyed, kept, "_asked", into="completion", distinct=True).drop("request_id", "_asked")
    parsed = parsing.rewritten_query(F.col("completion"))
    rewritten = text.once(asked, "rewrite", parsing.rewrite_or_raw(parsed, F.col("completion")))
    final = prompts.candidate_follow_prompt(F.col("original"), F.col("text"), F.col("rewrite"))
    rewritten = store(text.once(rewritten, "final_prompt", final), "candidates")
    asked = rewritten.select("sample_id", "cand_idx", "text", "target", "final_prompt")
    scored = with_scores(_answered(asked, kept, templates, task), stem=stem)
    selection = prompts.selection_prompts(rewritten, per_example=True)
    chosen = hooks.recorded(selection, kept, "request", into="choice", distinct=True)
    picks = chosen.select("sample_id", parsing.choice_index(F.col("choice")).alias("pick"))
    report = store(candidate_metrics(scored, picks, n), "sampling-report")
    logs.write_results(
        report.select(
            F.concat_ws(" ", F.lit(run_name), "kind").alias("name"),
            F.col("avg_em").alias("accuracy"),
            F.col("avg_f1").alias("f1"),
            F.col("avg_rouge").alias("rouge"),
            F.col("avg_judge").alias("judge"),
        ),
        results_path,
    )
    return report
