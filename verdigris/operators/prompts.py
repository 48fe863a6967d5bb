"""Prompt and request tables: rendering, routing, fan-out, selection, pairwise swap."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.operators.ordered import broadcast_if_small


def render(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a text with columns; any other brace is literal."""
    pattern = "|".join(re.escape(f"{{{name}}}") for name in fields)
    parts = re.split(f"({pattern})", template)
    columns = [fields[p[1:-1]] if p[1:-1] in fields and p.startswith("{") else F.lit(p) for p in parts if p]
    return F.concat(*columns)


def meta_prompt(instruction: Column, text: Column | None = None) -> Column:
    """Rewrite request for an instruction, or for an instruction with its text."""
    short = render(fixed.META_PROMPT_INSTRUCTION, instruction=instruction)
    if text is None:
        return short
    full = render(fixed.META_PROMPT_FULL, instruction=instruction, text=text)
    return F.when(text == "", short).otherwise(full)


def chat_prompt(prompt: Column, prefix: str = fixed.CHAT_PREFIX, suffix: str = fixed.CHAT_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), prompt, F.lit(suffix))


def request_id(prompt: Column, params: Column | str = "") -> Column:
    """Key of a recorded generation: digest of prompt and parameters."""
    return F.sha2(F.concat(prompt, params if isinstance(params, Column) else F.lit(params)), 256)


def list_text(values: Column) -> Column:
    """An array as bracketed, quoted text, the form in which references enter a request."""

    def quoted(value: Column) -> Column:
        escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(name))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(value.contains("'") & ~value.contains('"'), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def prompt_quality_request(
    query: Column, rewritten: Column, templates: Mapping[str, str], open_brace: bool = False
) -> Column:
    asked = render(templates["prompt_quality"], query=query, rewritten_query=rewritten)
    return F.concat(asked, F.lit("{")) if open_brace else asked


def answer_request(
    task: Column,
    query: Column,
    answer: Column,
    references: Column,
    templates: Mapping[str, str],
    open_brace: bool = False,
) -> Column:
    """Judge request for an answer; summary tasks get the summary rubric.

    ``open_brace`` starts the JSON answer, as the second judge expects.
    """
    fields = {"query": query, "final_answer": answer, "target_answers": references}
    asked = F.when(task.isin(list(fixed.SUMMARY_TASKS)), render(templates["summary"], **fields)).otherwise(
        render(templates["answer"], **fields)
    )
    return F.concat(asked, F.lit("{")) if open_brace else asked


def test_answer_request(
    query: Column, answer: Column, references: Column, templates: Mapping[str, str]
) -> Column:
    return render(templates["test_answer"], query=query, final_answer=answer, target_answers=references)


def candidate_request(
    query: Column, reference: Column, templates: Mapping[str, str]
) -> Column:
    return render(templates["candidate"], original_query=query, reference_answer=reference)


def fan_out(df: DataFrame, n: int, into: str = "cand_idx") -> DataFrame:
    """``n`` copies of each row, numbered from 0; no rows for ``n`` below one."""
    numbers = F.array(*[F.lit(i) for i in range(n)]) if n > 0 else F.array().cast("array<int>")
    return df.withColumn(into, F.explode(numbers))


def selection_prompts(candidates: DataFrame, per_example: bool, key: str = "sample_id") -> DataFrame:
    """One selection request per sample over its numbered rewrites.

    Input rows are ``key, cand_idx, rewrite, original`` (and ``text`` per example). The list of
    a sample has its few candidates only.
    """
    context = ["original", "text"] if per_example else ["original"]
    gathered = candidates.groupBy(key).agg(
        *[F.first(c).alias(c) for c in context],
        F.sort_array(F.collect_list(F.struct("cand_idx", "rewrite"))).alias("_options"),
    )
    ending = "" if per_example else "\n"
    options = F.array_join(
        F.transform(
            "_options",
            lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o.getField("rewrite"), F.lit(ending)),
        ),
        "",
    )
    subject = F.concat_ws(" ", *[F.col(c) for c in context])
    tail = fixed.SELECT_NUMBER_TAIL if per_example else fixed.SELECT_JSON_TAIL
    return gathered.select(
        key,
        F.concat(F.lit(fixed.SELECT_INTRO), subject, F.lit(fixed.SELECT_LIST), options, F.lit(tail)).alias("request"),
    )


def instruction_prompt(instruction: Column, text: Column) -> Column:
    return F.concat(instruction, F.lit(" "), text)


def with_run_rewrite(samples: DataFrame, rewrites: DataFrame, run: str, into: str = "prompt") -> DataFrame:
    """Answer prompts from one rewrite per run, ``run, rewrite``, put before every text of the run.

    The few rewrites are broadcast after counting them; more than that meet in a shuffle join.
    """
    joined = samples.join(broadcast_if_small(rewrites), run)
    return joined.withColumn(into, instruction_prompt(F.col("rewrite"), F.col("text"))).drop("rewrite")


def rewritten_text_prompt(rewrite: Column, text: Column) -> Column:
    return F.concat(rewrite, text)


def follow_prompt(text: Column, parsed: Column, raw: Column) -> Column:
    """Answer prompt from a parse result: the rewrite with its query, or the raw text.

    Valid JSON without the field falls back to the raw text alone; unreadable output keeps the
    query in front of it.
    """
    value, outcome = parsed.getField("value"), parsed.getField("outcome")

    def following(rewrite: Column) -> Column:
        return F.concat(F.lit(fixed.FOLLOW_QUERY), text, F.lit("\n" + fixed.FOLLOW_REWRITE), rewrite)

    return F.when(value.isNotNull(), following(value)).when(outcome != "failed", raw).otherwise(following(raw))


def candidate_follow_prompt(original: Column, text: Column, rewrite: Column) -> Column:
    return F.concat(
        F.lit(fixed.FOLLOW_QUERY), original, F.lit(" "), text, F.lit(fixed.FOLLOW_REWRITE), rewrite
    )


def swap_sides(key: Column, seed: int = fixed.SPLIT_SEED) -> Column:
    """Repeatable coin per key for the order of the two options."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 2 == 1


def pairwise_request(
    original: Column,
    reference: Column | None,
    first: Column,
    second: Column,
    swap: Column,
    templates: Mapping[str, str],
) -> Column:
    return render(
        templates["pairwise"],
        original=original,
        reference=F.lit("") if reference is None else F.coalesce(reference, F.lit("")),
        option_1=F.when(swap, second).otherwise(first),
        option_2=F.when(swap, first).otherwise(second),
    )


def unswap(selected: Column, swap: Column) -> Column:
    return F.when(selected.isin(1, 2), F.when(swap, 3 - selected).otherwise(selected))
