"""Stand-ins for the inputs of the jobs, derived by Spark from the test tables.

Where a job reads recorded model output, the text is built here from table values in the
shapes that real output has: plain, fenced, single-quoted, with a tail, without its brace, junk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris import judge_texts
from verdigris.sources.datasets import read_table

NEWLINE = "\n"

#: Neutral rubrics, one line each.
RUBRICS = {
    "prompt_quality": "Score the rewritten query.",
    "answer": "Score the response.",
    "summary": "Score the summary.",
    "test_answer": "Score the response again.",
    "pairwise": "Choose an option.",
    "candidate": "Write a prompt.",
}
TEMPLATES = judge_texts.templates(RUBRICS)


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit(NEWLINE), F.lit(1))


def last_line(text: Column) -> Column:
    return F.split_part(text, F.lit(NEWLINE), F.lit(-1))


def lines(text: Column) -> Column:
    return F.split(text, NEWLINE)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = read_table(spark, sf, "conversations", spread=True)
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replied, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("sample_id"), "conv_id", "turn", "question", "reply"
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers with references and judge output."""
    q = questions(spark, sf)
    judged = F.when(F.length("reply") % 7 == 0, F.lit("n/a")).otherwise(
        F.concat(
            F.lit('{"explanation": "ok", "score": '), (F.length("question") % 2).cast("string"), F.lit("}")
        )
    )
    return q.select(
        "sample_id",
        "conv_id",
        F.col("question").alias("answer"),
        lines(F.col("reply")).alias("target"),
        judged.alias("judge_text"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True)
    return d.select(
        F.col("doc_id").alias("sample_id"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("article"),
        first_line(F.col("text")).alias("highlights"),
    )


def papers(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True)
    return d.select(
        F.col("doc_id").alias("sample_id"),
        F.col("doc_id").alias("ord"),
        lines(F.col("text")).alias("source"),
        F.array(first_line(F.col("text")), F.col("lang")).alias("target"),
    )


def context_questions(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True)
    return d.select(
        F.col("doc_id").alias("sample_id"),
        F.col("doc_id").alias("ord"),
        first_line(F.col("text")).alias("question"),
        last_line(F.col("text")).alias("answer"),
        F.struct(F.transform(lines(F.col("text")), lambda p: F.split(p, "\\. ")).alias("sentences")).alias("context"),
    )


def nested_questions(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select(
        "sample_id",
        F.col("sample_id").alias("ord"),
        F.struct(F.col("question").alias("text")).alias("question"),
        F.struct(
            F.transform(
                lines(F.col("reply")), lambda t: F.struct(F.array(F.concat(t, F.lit(" ")), F.lit(" ")).alias("text"))
            ).alias("short_answers")
        ).alias("annotations"),
    )


def price(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def math_problems(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", spread=True)
    return o.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" of customer "), "o_custkey").alias("question"),
        F.concat(F.lit("2 parts, total #### "), price("o_totalprice")).alias("answer"),
    )


def shaped(shape: Column, fields: list[tuple[str, Column, bool]], junk: Column) -> Column:
    """JSON text of ``(name, value, quoted)`` fields in one of six shapes."""

    def body(quote: str) -> Column:
        parts = []
        for i, (name, value, quoted) in enumerate(fields):
            q = quote if quoted else ""
            parts += [F.lit(f"{', ' if i else ''}{quote}{name}{quote}: {q}"), value, F.lit(q)]
        return F.concat(*parts)

    plain = F.concat(F.lit("{"), body('"'), F.lit("}"))
    return (
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("{"), body("'"), F.lit("}")))
        .when(shape == 3, F.concat(plain, F.lit(" and more }")))
        .when(shape == 4, F.concat(body('"'), F.lit("}")))
        .otherwise(junk)
    )


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as completions, judge scores and choices in six shapes."""
    e = read_table(spark, sf, "events", spread=True)
    k = F.get_json_object("props", "$.k")
    shape = F.col("event_id") % 6
    rewrite = F.concat(F.lit("Do "), "event_type", F.lit(" "), k)
    fields = [("explanation", F.col("event_type"), True)]
    return e.select(
        F.col("event_id").alias("sample_id"),
        "user_id",
        "event_type",
        "value",
        shape.alias("shape"),
        k.cast("int").alias("k"),
        rewrite.alias("rewrite"),
        shaped(shape, [*fields, ("final_rewritten_query", rewrite, True)], rewrite).alias("completion"),
        shaped(
            shape, [*fields, ("score", (k.cast("int") % 6).cast("string"), False)], F.lit("no score")
        ).alias("judge_text"),
        shaped(
            shape,
            [*fields, ("final_selection", (k.cast("int") % 8).cast("string"), False)],
            F.concat(F.lit("of 5 I take "), k),
        ).alias("choice_text"),
    )


def reward_log(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run_id"),
        # The stored time has no zone; reading it as UTC keeps it apart from the session's zone.
        F.unix_micros(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00")))).cast("double").alias("ts"),
        F.col("value").alias("reward"),
        F.col("event_id").alias("step"),
    )


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as samples, line numbers as candidates, metrics from line values."""
    li = read_table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("cand_idx")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("em"),
        (F.max("l_discount") * 10).alias("f1"),
        (F.min("l_tax") * 10).alias("rouge"),
        F.when(F.max("l_quantity") >= 49, -1.0).otherwise(F.max("l_quantity") / 50).alias("judge"),
    )


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Choice texts per order."""
    o = read_table(spark, sf, "orders", spread=True)
    number = (F.col("o_custkey") % 9).cast("string")
    shape = F.col("o_orderkey") % 6
    return o.select(
        F.col("o_orderkey").alias("sample_id"),
        shaped(shape, [("final_selection", number, False)], F.concat(F.lit("number "), number)).alias("choice_text"),
    )


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and line numbers as candidates, judged by two judges on two answers."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").alias("ord"),
        (F.col("l_linenumber") - 1).alias("cand_idx"),
        F.when(F.col("l_returnflag") == "A", "first").otherwise("second").alias("answerer"),
        F.when(F.col("l_linestatus") == "O", "first").otherwise("second").alias("judge"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("score"),
    )


def candidate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the judged candidates, from their part."""
    keys = judgements(spark, sf).select("ord", "cand_idx").distinct()
    parts = read_table(spark, sf, "part")
    described = parts.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("Describe part "), "p_partkey").alias("original_query"),
        F.concat_ws(" ", "p_name", "p_type", F.lit("of"), "p_brand").alias("reference_answer"),
        F.concat_ws(" ", "p_brand", "p_name").alias("final_answer_first"),
        F.col("p_type").alias("final_answer_second"),
    )
    return keys.join(described, "ord").withColumn(
        "candidate_prompt", F.concat(F.lit("Candidate "), F.col("cand_idx"))
    )


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as reward components with failures."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linestatus") == "O", "cnn_dailymail")
        .when(F.col("l_returnflag") == "A", "cnndm")
        .otherwise("nq")
        .alias("task"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("json"),
        F.when(F.col("l_linenumber") == 7, -1.0).otherwise(F.floor(F.col("l_quantity") / 10)).alias("first_prompt_score"),
        F.when(F.col("l_linenumber") >= 6, -1.0).otherwise(F.round(F.col("l_tax") * 50)).alias("second_prompt_score"),
        F.when(F.col("l_linenumber") == 2, -1.0).otherwise(F.round(F.col("l_discount") * 50)).alias("judge"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("match"),
    )


DATASET_NAMES = tuple([*fixed.TASK_ALIASES, "full_prompt"])


def named_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose dataset name comes from their source."""
    d = read_table(spark, sf, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    names = F.array(*[F.lit(n) for n in DATASET_NAMES])
    return d.select("doc_id", "text", F.get(names, number % len(DATASET_NAMES)).alias("dataset"))
