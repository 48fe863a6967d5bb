"""Preparation: five source shapes into one sample shape, filters, slices, splits, batches.

A prepared sample is ``sample_id, ord, prompt, target ARRAY<STRING>, text, original``.
Normalisers drop a bad row with a filter, before any prompt is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.functions.text import final_number, let, strip, strip_or_empty
from verdigris.operators import ordered
from verdigris.operators.prompts import chat_prompt, meta_prompt
from verdigris.session import store

SAMPLE_COLUMNS = ("sample_id", "ord", "prompt", "target", "text", "original")


def task_of(name: str) -> str:
    task = fixed.DATASET_ALIASES.get(name.lower())
    if task is None:
        raise ValueError(f"unknown dataset: {name}")
    return task


def instruction_for(name: str, full_prompt: bool = False) -> str | None:
    """Instruction of a task by dataset name; none for full prompts or unknown names."""
    if full_prompt:
        return None
    return fixed.INSTRUCTIONS.get(fixed.TASK_ALIASES.get(name.lower(), ""))


def with_instruction(df: DataFrame, name_column: str, into: str = "instruction") -> DataFrame:
    """Add task and instruction by dataset name; the dozen names are literals in the plan."""
    aliases = F.create_map(*[F.lit(x) for pair in fixed.TASK_ALIASES.items() for x in pair])
    instructions = F.create_map(*[F.lit(x) for pair in fixed.INSTRUCTIONS.items() for x in pair])
    return df.withColumn("task", F.try_element_at(aliases, F.lower(name_column))).withColumn(
        into, F.try_element_at(instructions, F.col("task"))
    )


def short_answers(annotations: Column) -> Column:
    """All non-empty short answers, stripped, in order."""
    texts = F.flatten(
        F.transform(annotations, lambda a: F.coalesce(a.getField("text"), F.array().cast("array<string>")))
    )
    stripped = F.transform(F.coalesce(texts, F.array().cast("array<string>")), strip)
    return F.filter(stripped, lambda t: F.coalesce(t != "", F.lit(False)))


def with_prompt(rows: DataFrame, name: str, full_prompt: bool = False) -> DataFrame:
    """Normalised rows with their instruction and rewrite request."""
    instruction = F.lit(fixed.INSTRUCTIONS[task_of(name)])
    prompt = meta_prompt(instruction, F.col("text") if full_prompt else None)
    return rows.withColumns({"prompt": prompt, "original": instruction})


def _question_answers(df: DataFrame) -> DataFrame:
    question = strip_or_empty(F.col("question.text"))
    return df.where(question != "").select(
        "sample_id",
        "ord",
        short_answers(F.col("annotations.short_answers")).alias("target"),
        F.concat(F.lit("\nQuestion: "), question).alias("text"),
    )


def _summary(df: DataFrame, article: Column, summary: Column) -> DataFrame:
    # One test per text: the filter runs at the scan, where each use of the text strips it again.
    fits = let(F.length(article), lambda n: (n > 0) & (n <= fixed.MAX_ARTICLE_CHARS))
    return (
        df.where(fits & (summary != ""))
        .select("sample_id", "ord", article.alias("_article"), summary.alias("_summary"))
        .select(
            "sample_id",
            "ord",
            F.array("_summary").alias("target"),
            F.concat(F.lit("\nText: "), F.col("_article")).alias("text"),
        )
    )


def _news(df: DataFrame) -> DataFrame:
    return _summary(df, strip_or_empty(F.col("article")), strip_or_empty(F.col("highlights")))


def _papers(df: DataFrame) -> DataFrame:
    joined = strip_or_empty(F.array_join("source", " "))
    first = strip_or_empty(F.get("target", F.lit(0)))
    return _summary(df, joined, first)


def _math(df: DataFrame) -> DataFrame:
    question, answer = strip_or_empty(F.col("question")), strip_or_empty(F.col("answer"))
    return df.where((question != "") & (answer != "")).select(
        "sample_id",
        "ord",
        F.array(final_number(answer)).alias("target"),
        F.concat(F.lit("\nQuestion: "), question).alias("text"),
    )


def _context_questions(df: DataFrame) -> DataFrame:
    question, answer = strip_or_empty(F.col("question")), strip_or_empty(F.col("answer"))
    context = F.coalesce(F.array_join(F.flatten(F.col("context.sentences")), " "), F.lit(""))
    return df.where((question != "") & (answer != "") & (context != "")).select(
        "sample_id",
        "ord",
        F.array(answer).alias("target"),
        F.concat(F.lit("\nContext: "), context, F.lit("\nQuestion: "), question).alias("text"),
    )


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "nq": _question_answers,
    "cnndm": _news,
    "scitldr": _papers,
    "gsm8k": _math,
    "hotpot": _context_questions,
}


def normalize(df: DataFrame, name: str, full_prompt: bool = False) -> DataFrame:
    """Raw rows of a dataset (with ``sample_id`` and ``ord``) to prepared samples."""
    rows = NORMALIZERS[task_of(name)](df)
    return with_prompt(rows, name, full_prompt).select(*SAMPLE_COLUMNS)


def take(df: DataFrame, amount: int) -> DataFrame:
    """The first ``amount`` rows by ``ord``; all for a negative amount."""
    return df if amount < 0 else ordered.first_rows(df, amount, ["ord"])


def slice_raw(raw: DataFrame, name: str, amount: int = -1, slices: bool = True) -> DataFrame:
    """Take the first rows; two datasets have a fixed slice of their own."""
    task = task_of(name)
    taken = take(raw, amount)
    if slices and task == "nq":
        return ordered.skip_rows(taken, fixed.NQ_SKIP, "ord")
    if slices and task == "cnndm":
        return take(taken, fixed.CNNDM_HEAD)
    return taken


def load_samples(
    raw: DataFrame, name: str, amount: int = -1, full_prompt: bool = False, slices: bool = True
) -> DataFrame:
    """Take, slice and normalise."""
    return normalize(slice_raw(raw, name, amount, slices), name, full_prompt)


def keep_valid(samples: DataFrame) -> DataFrame:
    return samples.where(F.size("target") > 0)


def wrap_chat(samples: DataFrame, prefix: str = fixed.CHAT_PREFIX, suffix: str = fixed.CHAT_SUFFIX) -> DataFrame:
    return samples.withColumn("prompt", chat_prompt(F.col("prompt"), prefix, suffix))


def split(
    samples: DataFrame, name: str, test_size: float = fixed.TEST_SIZE, seed: int = fixed.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test samples; one dataset has a special test size."""
    if name == "scitldr":
        test_size = fixed.SCITLDR_TEST_SIZE.get(test_size, test_size)
    marked = ordered.mark_test_rows(samples, "sample_id", test_size, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def prepare(
    raw: DataFrame,
    name: str,
    amount: int = -1,
    batch_size: int | None = 8,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SPLIT_SEED,
    chat: bool = False,
    full_prompt: bool = False,
    evaluate: bool = False,
    slices: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """End to end: load, filter, split, slice, number the batches, render and wrap prompts.

    The valid rows are stored once; counting and splitting then read only their key, and prompts
    are rendered last, so they never pass a shuffle. Both parts keep the order of the split's shuffle: the evaluation
    head is its first test rows, test batches follow it, and train batches follow a second shuffle.
    ``batch_size=None`` leaves both parts unbatched.
    """
    rows = NORMALIZERS[task_of(name)](slice_raw(raw, name, amount, slices))
    valid = store(keep_valid(rows), "samples")
    if valid.isEmpty():
        raise ValueError("no sample has a target")
    train, test = split(valid, name, test_size, seed)
    shuffled = lambda part, by: part.withColumn("_hash", ordered.hash_order(F.col("sample_id"), by))
    order = ["_hash", "sample_id"]
    if evaluate:
        test = ordered.first_rows(shuffled(test, seed), fixed.EVALUATION_HEAD, order).drop("_hash")
    if batch_size is not None:
        train = ordered.with_batches(shuffled(train, seed + 1), batch_size, order, once=False).drop("_hash")
        test = ordered.with_batches(shuffled(test, seed), batch_size, order, once=False).drop("_hash")
    parts = [with_prompt(part, name, full_prompt) for part in (train, test)]
    if chat:
        parts = [wrap_chat(part) for part in parts]
    return parts[0], parts[1]


def reference_samples(samples: DataFrame) -> DataFrame:
    """Samples with one reference answer for curating training prompts."""
    answer = strip(F.get("target", F.lit(0)))
    text, original = strip(F.col("text")), strip(F.col("original"))
    return samples.where((F.size("target") > 0) & (original != "") & (text != "") & (answer != "")).select(
        "sample_id",
        "ord",
        strip(F.col("prompt")).alias("prompt"),
        original.alias("original"),
        text.alias("text"),
        F.concat(original, text).alias("original_query"),
        answer.alias("reference_answer"),
    )
