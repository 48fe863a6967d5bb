"""Every operator as a query over the test tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import fixed_values as fixed
from verdigris.functions import parsing, rewards, text
from verdigris.operators import hooks, monitor, ordered, prepare, prompts, rouge, scoring, training
from verdigris.plans import compare, curate, evaluate, fixtures
from verdigris.session import scratch_path, store
from verdigris.sources import logs, schemas
from verdigris.sources.datasets import load_dataset, load_prompt_pairs, read_table
from verdigris.streaming.monitor import early_stop_available
from verdigris.streaming.runs import read_stream, run_available, running_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Early-stop settings that fire on runs of 49 to 86 points.
SHORT_MOVING = {"window": 10, "patience": 20}
SHORT_BEST = {"window": 10, "patience": 15, "start": 30}
BATCH_ROWS = 64


def query(job: Query) -> Query:
    QUERIES[job.__name__] = job
    return job


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def all_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, *[f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)])


def digest(column: str | Column) -> Column:
    return F.md5(F.col(column) if isinstance(column, str) else column)


def sample_digest(samples: DataFrame) -> DataFrame:
    return samples.select(
        "sample_id",
        digest("prompt").alias("prompt_md5"),
        F.size("target").cast("bigint").alias("n_targets"),
        digest(F.array_join("target", "|")).alias("target_md5"),
        digest("text").alias("text_md5"),
        "original",
    )


# Preparation


@query
def prep_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return sample_digest(prepare.keep_valid(prepare.normalize(fixtures.news(spark, sf), "cnn_dailymail", True)))


@query
def prep_sci(spark: SparkSession, sf: str) -> DataFrame:
    return sample_digest(prepare.normalize(fixtures.papers(spark, sf), "sci", True))


@query
def prep_qa_context(spark: SparkSession, sf: str) -> DataFrame:
    return sample_digest(prepare.normalize(fixtures.context_questions(spark, sf), "HotpotQA", True))


@query
def prep_nested_answers(spark: SparkSession, sf: str) -> DataFrame:
    return sample_digest(prepare.normalize(fixtures.nested_questions(spark, sf), "nq"))


@query
def prep_math(spark: SparkSession, sf: str) -> DataFrame:
    return sample_digest(prepare.normalize(fixtures.math_problems(spark, sf), "gsm8k", True))


@query
def prep_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for full_prompt in (False, True):
        both = prepare.prepare(
            fixtures.news(spark, sf), "cnndm", batch_size=BATCH_ROWS, chat=True, full_prompt=full_prompt, slices=False
        )
        for name, part in zip(("train", "test"), both):
            batches = ordered.collate(part, ["sample_id", "prompt"])
            parts.append(
                batches.select(
                    F.lit(full_prompt).alias("full_prompt"),
                    F.lit(name).alias("part"),
                    "batch_id",
                    F.size("sample_id").cast("bigint").alias("n"),
                    F.array_join(F.transform("sample_id", lambda i: i.cast("string")), ",").alias("ids"),
                    digest(F.array_join("prompt", "|")).alias("prompts_md5"),
                )
            )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _order_samples(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Orders as raw rows of a dataset, all of them valid."""
    o = read_table(spark, sf, "orders", spread=True)
    key, price = F.col("o_orderkey"), fixtures.price("o_totalprice")
    question = F.concat(F.lit("Order "), key)
    shapes = {
        "gsm8k": [question.alias("question"), F.concat(F.lit("#### "), price).alias("answer")],
        "cnndm": [question.alias("article"), price.alias("highlights")],
        "nq": [
            F.struct(question.alias("text")).alias("question"),
            F.struct(F.array(F.struct(F.array(price).alias("text"))).alias("short_answers")).alias("annotations"),
        ],
    }
    return o.select(key.alias("sample_id"), key.alias("ord"), *shapes[name])


@query
def prep_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation parts of three datasets, two with their fixed slice: head of the shuffled test rows, in batches."""
    out = None
    for name in ("gsm8k", "cnndm", "nq"):
        both = prepare.prepare(_order_samples(spark, sf, name), name, batch_size=BATCH_ROWS, evaluate=True)
        for part, rows in zip(("train", "test"), both):
            batches = ordered.collate(rows, ["sample_id"]).select(
                F.lit(name).alias("dataset"),
                F.lit(part).alias("part"),
                "batch_id",
                F.size("sample_id").cast("bigint").alias("n"),
                F.array_join(F.transform("sample_id", lambda i: i.cast("string")), ",").alias("ids"),
            )
            out = batches if out is None else out.unionByName(batches)
    return out


@query
def slice_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Heads and tails by a key that many rows share, on both sides of a part's size."""
    li = read_table(spark, sf, "lineitem")
    kept = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    index = ordered.order_index(li, ["l_orderkey"])
    out = None
    for n in (1_234, 5_001, 23_456):
        sides = ordered.first_rows(li, n, ["l_orderkey"], index), ordered.skip_rows(li, n, "l_orderkey", index)
        for side, rows in zip(("first", "rest"), sides):
            total = rows.agg(
                F.lit(n).cast("bigint").alias("n"),
                F.lit(side).alias("side"),
                F.count(F.lit(1)).alias("rows"),
                *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"sum_{c}") for c in kept],
                F.coalesce(F.min("l_orderkey"), F.lit(-1)).alias("first_key"),
                F.coalesce(F.max("l_orderkey"), F.lit(-1)).alias("last_key"),
            )
            out = total if out is None else out.unionByName(total)
    return out


@query
def slice_head(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.news(spark, sf)
    kept = prepare.take(ordered.skip_rows(raw, fixed.NQ_SKIP, "ord"), 500)
    return kept.select("ord", F.length("article").cast("bigint").alias("n_chars"), digest("article").alias("text_md5"))


@query
def slice_skip(spark: SparkSession, sf: str) -> DataFrame:
    kept = ordered.skip_rows(read_table(spark, sf, "orders"), fixed.NQ_SKIP, "o_orderkey")
    return kept.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return ordered.mark_test_rows(d, "doc_id", fixed.TEST_SIZE)


@query
def split_threshold(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return ordered.mark_test_rows_by_threshold(o, "o_orderkey", fixed.TEST_SIZE)


@query
def batch_collate(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    batches = ordered.collate(ordered.with_batches(d, 32, ["doc_id"]), ["doc_id", "n_chars"])
    return batches.select(
        "batch_id",
        F.size("doc_id").cast("bigint").alias("n"),
        F.array_join(F.transform("doc_id", lambda i: i.cast("string")), ",").alias("ids"),
        F.aggregate("n_chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"),
    )


@query
def sample_projection(spark: SparkSession, sf: str) -> DataFrame:
    samples = prepare.reference_samples(prepare.normalize(fixtures.news(spark, sf), "cnndm"))
    return samples.select(
        "sample_id",
        digest("prompt").alias("prompt_md5"),
        "original",
        digest("original_query").alias("query_md5"),
        "reference_answer",
    )


def _prompt_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("ord"),
        F.col("text").alias("original_prompt"),
        F.col("role").alias("analysis"),
        fixtures.first_line(F.col("text")).alias("optimized_prompt"),
    )
    rated = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        F.col("text").alias("prompt"),
        F.when(F.col("lang") != "es", (F.col("n_chars") % 5) + 0.5).cast("double").alias("avg_rating"),
    )
    return turns, rated


def _pair_digest(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "ord",
        digest("original_query").alias("query_md5"),
        F.get_json_object("candidate_prompt", "$.explanation").alias("explanation"),
        digest(F.get_json_object("candidate_prompt", "$.final_rewritten_query")).alias("rewrite_md5"),
        F.get_json_object("candidate_prompt", "$.final_rating").alias("rating"),
    )


@query
def prompt_pair_union(spark: SparkSession, sf: str) -> DataFrame:
    turns, rated = _prompt_sets(spark, sf)
    return _pair_digest(training.match_and_union(training.rewrite_pairs(turns), training.rating_pairs(rated)))


@query
def task_instruction(spark: SparkSession, sf: str) -> DataFrame:
    found = prepare.with_instruction(fixtures.named_documents(spark, sf), "dataset")
    return found.select(
        "doc_id",
        "dataset",
        "task",
        "instruction",
        digest(prompts.chat_prompt(prompts.instruction_prompt(F.col("instruction"), F.col("text")))).alias("chat_md5"),
    )


def _word_ids(words: Column) -> Column:
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))


@query
def pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True)
    packed = training.pack(
        d,
        _word_ids(F.split(fixtures.first_line(F.col("text")), " ")),
        _word_ids(F.split("text", " ")),
        end_id=1,
        pad_id=0,
    )

    def joined(name: str) -> Column:
        return digest(F.array_join(F.transform(name, lambda i: i.cast("string")), ",")).alias(f"{name}_md5")

    return packed.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("length"), joined("input_ids"), joined("labels"), joined("attention_mask")
    )


@query
def encode_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.when(F.col("turn") % 7 == 6, F.lit(None)).when(F.col("turn") % 5 == 4, F.array().cast("array<string>"))
    turns = read_table(spark, sf, "conversations", spread=True).select(
        "conv_id", "turn", kept.otherwise(F.split("text", " ")).alias("tokens")
    )
    vocabulary = ordered.with_positions(
        turns.select(F.explode("tokens").alias("token")).distinct(), ["token"], into="id"
    )
    ids = training.encode(turns, vocabulary, ["conv_id", "turn"])
    return ids.select(
        "conv_id",
        "turn",
        F.size("ids").cast("bigint").alias("n"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"),
    )


# Prompts and requests


@query
def render_judge(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.questions(spark, sf)
    task = F.when(F.col("turn") == 0, "cnndm").otherwise("nq")
    query_, reply = F.col("question"), F.col("reply")
    references = prompts.list_text(fixtures.lines(reply))
    return q.select(
        "sample_id",
        digest(prompts.prompt_quality_request(query_, reply, fixtures.TEMPLATES)).alias("quality_md5"),
        digest(prompts.prompt_quality_request(query_, reply, fixtures.TEMPLATES, open_brace=True)).alias("quality_open_md5"),
        digest(prompts.answer_request(task, query_, reply, references, fixtures.TEMPLATES)).alias("answer_md5"),
        digest(prompts.answer_request(task, query_, reply, references, fixtures.TEMPLATES, open_brace=True)).alias("answer_open_md5"),
        digest(prompts.test_answer_request(query_, reply, references, fixtures.TEMPLATES)).alias("test_md5"),
        prompts.request_id(query_, "t=0").alias("request_id"),
    )


@query
def candidate_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    q = prompts.fan_out(fixtures.questions(spark, sf), fixed.CURATE_CANDIDATES)
    return q.select(
        "sample_id",
        "cand_idx",
        digest(prompts.candidate_request(F.col("question"), F.col("reply"), fixtures.TEMPLATES)).alias("request_md5"),
    )


@query
def render_selection(spark: SparkSession, sf: str) -> DataFrame:
    rewrites = prompts.fan_out(fixtures.questions(spark, sf), 5).select(
        "sample_id",
        "cand_idx",
        F.lit(fixed.INSTRUCTIONS["nq"]).alias("original"),
        F.col("question").alias("text"),
        F.concat(F.lit("Version "), "cand_idx", F.lit(" of "), "reply").alias("rewrite"),
    )
    by_example = prompts.selection_prompts(rewrites, per_example=True)
    by_instruction = prompts.selection_prompts(rewrites, per_example=False)
    return by_example.select("sample_id", digest("request").alias("example_md5")).join(
        by_instruction.select("sample_id", digest("request").alias("instruction_md5")), "sample_id"
    )


@query
def final_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Answer prompts from rewrites that were read, from JSON without the field, and from text that is no JSON."""
    other = F.when(F.col("sample_id") % 12 == 5, '{"explanation": "no rewrite"}').otherwise(F.concat(F.lit("raw "), "rewrite"))
    c = fixtures.completions(spark, sf).withColumn("completion", F.when(F.col("shape") == 5, other).otherwise(F.col("completion")))
    parsed = parsing.rewritten_query(F.col("completion"))
    body = F.concat(F.lit("\nQuestion: "), "event_type")
    instruction = F.lit(fixed.INSTRUCTIONS["nq"])
    rewrite = parsing.rewrite_or_raw(F.col("parsed"), F.col("completion"))
    return c.withColumn("parsed", parsed).select(
        "sample_id",
        digest(prompts.instruction_prompt(instruction, body)).alias("instruction_md5"),
        digest(prompts.follow_prompt(body, F.col("parsed"), F.col("completion"))).alias("follow_md5"),
        digest(prompts.rewritten_text_prompt(rewrite, body)).alias("rewrite_md5"),
        digest(prompts.candidate_follow_prompt(instruction, body, rewrite)).alias("candidate_md5"),
    )


@query
def run_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """One rewrite per run, here per language, put before every text of the run."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    rewrites = d.groupBy("lang").agg(F.concat(F.lit("Rewrite for "), "lang").alias("rewrite"))
    return prompts.with_run_rewrite(d, rewrites, "lang").select("doc_id", digest("prompt").alias("prompt_md5"))


@query
def strip_echo(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.questions(spark, sf)
    echoed = F.concat("question", F.lit("\n "), "reply", F.lit(" "), "question")
    return q.select(
        "sample_id",
        digest(parsing.strip_echo(echoed, F.col("question"))).alias("stripped_md5"),
        digest(parsing.strip_echo(F.col("reply"), F.col("question"))).alias("untouched_md5"),
        digest(parsing.remove_echoes(echoed, F.col("question"))).alias("removed_md5"),
    )


# Parsing


@query
def parse_completion(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.completions(spark, sf)
    return c.withColumn("p", parsing.rewritten_query(F.col("completion"))).select(
        "sample_id",
        F.col("p.value").alias("rewrite"),
        F.col("p.outcome").alias("outcome"),
        parsing.json_success(F.col("p")).alias("json_success"),
        parsing.rewrite_or_raw(F.col("p"), F.col("completion")).alias("rewrite_or_raw"),
        parsing.prefixed_rewrite(F.col("completion")).alias("prefixed"),
    )


@query
def parse_score(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.completions(spark, sf)
    return c.select(
        "sample_id",
        parsing.strict_score(F.col("judge_text")).alias("strict_score"),
        parsing.strict_score(F.col("judge_text"), missing=0.0).alias("strict_or_zero"),
        parsing.tolerant_score(F.col("judge_text")).alias("tolerant_score"),
    )


@query
def parse_choice(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.completions(spark, sf)
    return c.select("sample_id", parsing.choice_index(F.col("choice_text")).alias("pick"))


# Scores


@query
def qa_em_f1(spark: SparkSession, sf: str) -> DataFrame:
    return all_rounded(evaluate.corpus_em_f1(fixtures.answers(spark, sf)))


@query
def pair_em_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Exact match and F1 of every document against its first line."""
    d = read_table(spark, sf, "documents", spread=True).select(
        "doc_id",
        text.normalize_answer(fixtures.first_line(F.col("text"))).alias("gold"),
        text.normalize_answer(F.col("text")).alias("answer"),
    )
    scored = d.select(
        "doc_id",
        (F.col("gold") == F.col("answer")).cast("double").alias("em"),
        text.normalized_f1(F.col("gold"), F.col("answer")).alias("f1"),
        digest("answer").alias("normalized_md5"),
    )
    return all_rounded(scored)


@query
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    q = fixtures.questions(spark, sf).withColumn("target", F.array("reply"))
    scored = rouge.with_best_rouge(q, "question", "target", "rouge", stem=False)
    return all_rounded(scored.select("sample_id", "rouge"))


@query
def rouge_best_ref(spark: SparkSession, sf: str) -> DataFrame:
    scored = rouge.with_best_rouge(fixtures.answers(spark, sf), "answer", "target", "rouge")
    return all_rounded(scored.select("sample_id", "rouge"))


@query
def stem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True)
    stems = d.select("doc_id", rouge.tokens(F.col("text"), stem=True).alias("stems"))
    return stems.select("doc_id", F.size("stems").cast("bigint").alias("n"), digest(F.array_join("stems", " ")).alias("stems_md5"))


@query
def numeric_match(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", spread=True).select("o_orderkey", fixtures.price("o_totalprice").alias("gold"))
    gold = F.col("gold")
    thousands = F.format_number(gold.cast("double"), 2)
    answer = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("3 items. The total is "), gold, F.lit(" EUR")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("1 2 #### -"), gold))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("#### "), F.replace(gold, F.lit("."), F.lit(""))))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("total #### "), thousands))
        .otherwise(F.lit("cannot tell"))
    )
    return o.select(
        "o_orderkey",
        text.final_number(answer).alias("number"),
        text.numeric_match(answer, gold).alias("as_reference"),
        text.numeric_match(answer, gold, mode="strict").alias("strict"),
    )


@query
def metric_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by name; each is a column of one pass over its answers."""
    problems = prepare.normalize(fixtures.math_problems(spark, sf), "gsm8k").select(
        F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("It is "), F.get("target", F.lit(0)))).otherwise("#### 7").alias("answer"),
        "target",
        F.lit(None).cast("string").alias("judge_text"),
    )
    out = None
    for scores, names in (
        (fixtures.answers(spark, sf), ("rouge", "em", "llm_prompt", "llm", "llm_test", "other")),
        (problems, ("gsm8k",)),
    ):
        for name in names:
            scores = scoring.score_metric(scores, name, into=f"m_{name}", stem=False)
        means = scores.agg(
            *[F.round(F.avg(f"m_{n}"), 6).alias(f"mean_{n}") for n in names], *[F.count(f"m_{n}").alias(f"n_{n}") for n in names]
        )
        rows = F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(f"mean_{n}").alias("mean"), F.col(f"n_{n}").alias("n")) for n in names]
        )
        one = means.select(F.explode(rows).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out


# Rewards


@query
def clamp_weight(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.score_rows(spark, sf)
    part = rewards.clamp_with_weight(F.col("first_prompt_score"), 0.3, fixed.JUDGE_SCALE)
    return all_rounded(
        rows.select("l_orderkey", "l_linenumber", "l_partkey", part.alias("p")).select(
            "l_orderkey", "l_linenumber", "l_partkey", F.col("p.value").alias("value"), F.col("p.weight").alias("weight")
        )
    )


@query
def composite(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.score_rows(spark, sf)
    both = scoring.composite_rewards(rows, task="task", mode="reference", into="as_reference")
    both = scoring.composite_rewards(both, task="task", mode="strict", into="strict")
    return all_rounded(both.select("l_orderkey", "l_linenumber", "l_partkey", "as_reference", "strict"))


@query
def composite_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Composite over recorded component tables; the unweighted one is not read."""
    lines = fixtures.score_rows(spark, sf)
    samples = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0).alias("json"),
    )
    judged = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.max("judge").alias("score"))
    local = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.max("match").alias("score"))
    weights = {"json": 0.2, "judge": 0.5, "local_judge": 0.0}
    joined = scoring.attach_recorded(samples, {"judge": judged, "local_judge": local}, weights)
    scored = scoring.composite_rewards(joined.withColumn("task", F.lit("cnndm")), weights, task="task")
    return all_rounded(scored.select("sample_id", "reward"))


@query
def composite_math(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.score_rows(spark, sf)
    first, second, match = F.col("first_prompt_score"), F.col("second_prompt_score"), F.col("match")
    return all_rounded(
        rows.select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            rewards.composite_math(match, first, second).alias("as_reference"),
            rewards.composite_math(match, first, second, mode="strict").alias("strict"),
            rewards.composite_math(match, first, second, use_prompt_scores=False).alias("match_only"),
        )
    )


@query
def two_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.score_rows(spark, sf)
    blended = rewards.two_score(F.col("first_prompt_score"), F.col("judge") / 5)
    return all_rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", blended.alias("reward")))


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(scoring.zscore(events, "value", "user_id", "reward").select("event_id", "reward"), "reward")


@query
def batch_reward_judge(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.completions(spark, sf).withColumn(
        "completion", F.when(F.col("completion").startswith("{"), F.substr(F.col("completion"), F.lit(2))).otherwise("")
    )
    scored = scoring.bound_reward("judge", batch="user_id")(c)
    return all_rounded(scored.select("sample_id", "raw_reward", "reward"))


@query
def batch_reward_rouge(spark: SparkSession, sf: str) -> DataFrame:
    a = fixtures.answers(spark, sf).withColumn(
        "completion",
        F.when(F.length("answer") % 4 == 0, "no json").otherwise('"final_rewritten_query": "Answer well"}'),
    )
    scored = scoring.bound_reward("rouge", batch="conv_id", stem=False)(a)
    return all_rounded(scored.select("sample_id", "raw_reward", "reward"))


@query
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return all_rounded(scoring.perplexity_rewards(e, "label", "embedding"))


@query
def user_reward(spark: SparkSession, sf: str) -> DataFrame:
    def length_ratio(answer: pd.Series, completion: pd.Series) -> pd.Series:
        return answer.str.len() / completion.str.len()

    q = fixtures.questions(spark, sf)
    return all_rounded(
        scoring.user_reward(length_ratio, ["question", "reply"])(q).select("sample_id", "reward")
    )


# Reports


@query
def baseline_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluate.with_scores(fixtures.answers(spark, sf), failed=evaluate.FAILED_IS_DROPPED, stem=False)
    return all_rounded(evaluate.answer_report(scored))


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    answers = fixtures.answers(spark, sf)
    out = None
    for mode in ("reference", "strict"):
        report = evaluate.answer_report(evaluate.with_scores(answers, mode=mode, stem=False))
        report = report.withColumn("mode", F.lit(mode))
        out = report if out is None else out.unionByName(report)
    return all_rounded(out)


@query
def math_report(spark: SparkSession, sf: str) -> DataFrame:
    problems = prepare.normalize(fixtures.math_problems(spark, sf), "gsm8k")
    given = F.when(
        F.col("sample_id") % 3 == 0, F.concat(F.lit("I get "), F.element_at("target", 1))
    ).otherwise(F.lit("#### 7"))
    return all_rounded(evaluate.answer_report(evaluate.with_scores(problems.withColumn("answer", given), math=True)))


@query
def rewriter_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluate.with_scores(fixtures.answers(spark, sf), stem=False)
    return all_rounded(evaluate.rewriter_report(scored, fixtures.completions(spark, sf)))


@query
def candidate_report(spark: SparkSession, sf: str) -> DataFrame:
    return all_rounded(evaluate.candidate_report(fixtures.candidate_scores(spark, sf)))


@query
def pick_report(spark: SparkSession, sf: str) -> DataFrame:
    """The picked candidate of every run; a user's latest choice text stands for a run's selection."""
    report = evaluate.candidate_report(fixtures.candidate_scores(spark, sf))
    latest = fixtures.completions(spark, sf).groupBy(F.col("user_id").alias("run_id")).agg(
        F.max_by("choice_text", "sample_id").alias("choice_text")
    )
    picks = latest.select("run_id", parsing.choice_index(F.col("choice_text")).cast("int").alias("cand_idx"))
    return all_rounded(evaluate.pick_report(report, picks))


@query
def best_mean_choice(spark: SparkSession, sf: str) -> DataFrame:
    picks = fixtures.picks(spark, sf).select(
        "sample_id", parsing.choice_index(F.col("choice_text")).alias("pick")
    )
    return all_rounded(evaluate.candidate_metrics(fixtures.candidate_scores(spark, sf), picks, n=7))


def _record(rows: DataFrame, asked: Column, said: Column) -> DataFrame:
    """Recorded generations of a request column."""
    return rows.select(prompts.request_id(asked).alias("request_id"), said.alias("text"))


def _run_answers(rows: DataFrame) -> DataFrame:
    """Stand-in answers and judgements of rows with ``final_prompt`` as further records; a seventh is not recorded."""
    answer = F.when(F.length("final_prompt") % 7 == 0, F.lit("")).otherwise(F.col("text"))
    answered = rows.withColumn("answer", answer)
    judged = prompts.answer_request(
        F.lit("nq"), F.col("text"), F.col("answer"), prompts.list_text(F.col("target")), fixtures.TEMPLATES
    )
    score = F.concat(F.lit('{"explanation": "x", "score": '), (F.length("text") % 2).cast("string"), F.lit("}"))
    answers = _record(answered.where("answer <> ''"), F.col("final_prompt"), F.col("answer"))
    return answers.unionByName(_record(answered, judged, score))


@query
def evaluate_rewriter(spark: SparkSession, sf: str) -> DataFrame:
    """One run from samples to its logs, joined by request; the report and what the logs hold."""
    samples = prepare.normalize(fixtures.nested_questions(spark, sf), "nq", True)
    said = (
        F.when(F.length("text") % 3 == 0, F.concat(F.lit('{"final_rewritten_query": "Q'), F.length("text"), F.lit('"}')))
        .when(F.length("text") % 3 == 1, F.lit('{"explanation": "none"}'))
        .otherwise(F.lit("no json"))
    )
    rewrites = samples.withColumn("completion", said)
    parsed = rewrites.withColumn("parsed", parsing.rewritten_query(F.col("completion")))
    final = parsed.withColumn("final_prompt", prompts.follow_prompt(F.col("text"), F.col("parsed"), F.col("completion")))
    generations = _record(rewrites, F.col("prompt"), F.col("completion")).unionByName(_run_answers(final))
    results, log = scratch_path(spark, "run-results"), scratch_path(spark, "run-samples")
    report = evaluate.evaluate_rewriter(
        samples, generations, fixtures.TEMPLATES, "nq", "run", results, log, stem=False
    )
    logged = logs.read_sample_log(spark, log).agg(
        F.count(F.lit(1)).alias("logged"), F.sum("LLM-as-a-judge reward").alias("logged_judge")
    )
    written = logs.read_results(spark, results).select(F.col("Name").alias("name"), F.col("ROUGE").alias("written_rouge"))
    for one_row in (logged, written):
        report = report.withColumn("_one", F.lit(1)).join(one_row.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return all_rounded(report)


@query
def evaluate_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Three result rows of five recorded candidates each, with the picked one by a recorded selection."""
    samples = store(prepare.normalize(fixtures.nested_questions(spark, sf), "nq", True), "samples")
    n = 5
    each = prompts.fan_out(samples, n)
    said = F.concat(F.lit('{"final_rewritten_query": "R'), F.col("cand_idx"), F.lit('"}'))
    rewritten = each.withColumn("completion", said).withColumn("rewrite", F.concat(F.lit("R"), "cand_idx"))
    final = rewritten.withColumn(
        "final_prompt", prompts.candidate_follow_prompt(F.col("original"), F.col("text"), F.col("rewrite"))
    )
    spoken = F.concat("text", F.lit(" "), "cand_idx")
    answers = _record(final, F.col("final_prompt"), spoken)
    judged = prompts.answer_request(F.lit("nq"), F.col("text"), spoken, prompts.list_text(F.col("target")), fixtures.TEMPLATES)
    score = F.concat(F.lit('{"score": '), (F.col("cand_idx") % 2).cast("string"), F.lit("}"))
    selection = prompts.selection_prompts(rewritten, per_example=True).withColumn(
        "choice", F.concat(F.lit("number "), (F.col("sample_id") % 7).cast("string"))
    )
    generations = (
        _record(rewritten, F.concat_ws("#", "prompt", "cand_idx"), F.col("completion"))
        .unionByName(answers)
        .unionByName(_record(final, judged, score))
        .unionByName(_record(selection, F.col("request"), F.col("choice")))
    )
    results = scratch_path(spark, "sampling-results")
    report = evaluate.evaluate_sampling(samples, generations, fixtures.TEMPLATES, "nq", "run", n, results, stem=False)
    written = logs.read_results(spark, results).select(F.col("Name").alias("name"), F.col("ROUGE").alias("written_rouge"))
    named = report.withColumn("name", F.concat(F.lit("run "), "kind"))
    return all_rounded(named.join(written, "name").drop("name"))


def _document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    first = d.select(F.col("text").alias("original"), F.concat_ws("-", "lang", "source").alias("option_1"))
    second = d.select(F.col("text").alias("original"), F.concat_ws("/", "source", "lang").alias("option_2"))
    return compare.pairwise_requests(compare.paired_answers(first, second), fixtures.TEMPLATES)


@query
def pairwise_swap(spark: SparkSession, sf: str) -> DataFrame:
    return _document_pairs(spark, sf).select(
        digest("original").alias("original_md5"),
        "option_1",
        "option_2",
        "n_pairs",
        "swap",
        digest("request").alias("request_md5"),
    )


@query
def win_rate(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("original") % 5
    judged = _document_pairs(spark, sf).withColumn(
        "judge_text",
        F.when(size == 0, "Option 1")
        .when(size <= 2, '{"selection": 1, "explanation": "shorter"}')
        .otherwise('{"selection": 2, "explanation": "longer"}'),
    )
    return all_rounded(compare.win_rate(compare.with_selection(judged)))


@query
def judge_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return curate.judge_matrix(fixtures.judgements(spark, sf), ["ord", "cand_idx"])


@query
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    kept = curate.curate_in_ranges(fixtures.judgements(spark, sf), wanted=100, success=2.0, perfect=3.0)
    scores = F.array_join(F.transform("scores", lambda s: s.cast("int").cast("string")), ",")
    return kept.select("ord", "cand_idx", scores.alias("scores"), "perfect")


@query
def curated_prompts(spark: SparkSession, sf: str) -> DataFrame:
    matrix = curate.judge_matrix(fixtures.judgements(spark, sf), ["ord", "cand_idx"])
    kept = curate.curate(curate.with_gate(matrix, success=2.0, perfect=3.0), wanted=100)
    records = curate.curated_prompts(kept, fixtures.candidate_texts(spark, sf), ["ord", "cand_idx"], stem=False)
    scores = F.array_join(F.transform("scores", lambda s: s.cast("int").cast("string")), ",")
    return all_rounded(records.withColumn("scores", scores))


# Logs and streams


@query
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = monitor.rolling_mean(fixtures.reward_log(spark, sf))
    return all_rounded(means.select("run_id", "step", "running_mean"))


@query
def early_stop_ma(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.stop_on_moving_average(fixtures.reward_log(spark, sf), **SHORT_MOVING)


@query
def early_stop_best(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.stop_on_best_window(fixtures.reward_log(spark, sf), **SHORT_BEST)


@query
def early_stop_default(spark: SparkSession, sf: str) -> DataFrame:
    """Both rules with their default settings, over the long runs that event types make."""
    events = read_table(spark, sf, "events")
    log = fixtures.reward_log(spark, sf).join(
        events.select(F.col("event_id").alias("step"), "event_type"), "step"
    ).select(F.col("event_type").alias("run_id"), "ts", "reward", "step")
    rules = (
        ("moving", monitor.stop_on_moving_average(log)),
        ("best", monitor.stop_on_best_window(log)),
        ("best per epoch", monitor.stop_on_best_window(log, epoch_length=500)),
    )
    out = None
    for name, rows in rules:
        named = rows.select(F.lit(name).alias("rule"), "run_id", "stop_step", "n_points")
        out = named if out is None else out.unionByName(named)
    return out


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # a pattern takes the table as one file or as a folder of files; a stream's path may not be a file
    return read_stream(spark, f"{sf}/events.parque[t]", read_table(spark, sf, "events").schema, "*.parquet")


def _stops_of(spark: SparkSession, sf: str, run: str) -> DataFrame:
    points = lambda e: e.select(F.col(run).alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("reward"))
    return early_stop_available(points(_event_stream(spark, sf)), points(read_table(spark, sf, "events")), **SHORT_MOVING)


@query
def stream_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _stops_of(spark, sf, "user_id")


@query
def stream_early_stop_named(spark: SparkSession, sf: str) -> DataFrame:
    """Runs named by a text; a few hold all points of a micro-batch."""
    return _stops_of(spark, sf, "event_type")


@query
def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = running_totals(_event_stream(spark, sf), ["event_type"], ["value"])
    return all_rounded(run_available(totals, ["event_type"]))


@query
def results_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    report = evaluate.candidate_report(fixtures.candidate_scores(spark, sf)).select(
        F.concat(F.lit('run "x", candidate '), "cand_idx").alias("name"),
        F.col("avg_em").alias("accuracy"),
        F.col("avg_f1").alias("f1"),
        F.col("avg_rouge").alias("rouge"),
        F.col("avg_judge").alias("judge"),
    )
    logs.write_results(report, path)
    return logs.read_results(spark, path)


def _through_sample_log(spark: SparkSession, sf: str, breaks: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    rows = fixtures.questions(spark, sf).select(
        F.concat(F.lit("turn"), "turn").alias("run_name"),
        F.col("question").alias("original"),
        F.concat(F.lit(' "'), "question", F.lit('", again ')).alias("rewrite"),
        F.col("reply").alias("final_answer"),
        (F.length("question") / 1000).alias("accuracy"),
        F.lit(-1.0).alias("judge"),
    )
    logs.write_sample_log(rows, path, breaks)
    back = logs.read_sample_log(spark, path, answer_as="option_1", breaks=breaks)
    return back.select(
        "run_name",
        digest("Original").alias("original_md5"),
        digest("Rewrite").alias("rewrite_md5"),
        digest("option_1").alias("answer_md5"),
        "Accuracy",
        F.col("LLM-as-a-judge reward").alias("judge"),
    )


@query
def sample_log(spark: SparkSession, sf: str) -> DataFrame:
    return _through_sample_log(spark, sf, "kept")


@query
def sample_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same log with a line per sample, which many tasks can read."""
    return _through_sample_log(spark, sf, "escaped")


@query
def reward_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rewards")
    log = fixtures.reward_log(spark, sf).select(
        (F.col("ts") / 1e6).alias("timestamp"), "reward", F.col("step").cast("int").alias("step")
    )
    logs.write_reward_log(log, path)
    return logs.read_reward_log(spark, path).select("step", "reward", F.round("timestamp", 3).alias("ts"))


@query
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    samples = prepare.reference_samples(prepare.normalize(fixtures.papers(spark, sf), "scitldr"))
    logs.write_json(samples, path)
    back = logs.read_json(spark, path, schemas.REFERENCE_SAMPLES)
    return back.select(
        "sample_id", digest("original_query").alias("query_md5"), digest("reference_answer").alias("reference_md5")
    )


# File sources


def _in_files(rows: DataFrame, key: str, files: int = 3) -> DataFrame:
    """Rows in order over files, without the key: a few, or as many as the scan has splits, so that a file does not grow with the table."""
    return rows.repartitionByRange(max(files, rows.rdd.getNumPartitions()), key).sortWithinPartitions(key).drop(key)


@query
def load_parquet(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "datasets")
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("article"), fixtures.first_line(F.col("text")).alias("highlights")
    )
    _in_files(d, "doc_id").write.parquet(f"{root}/cnndm/test")
    return sample_digest(load_dataset(spark, root, "cnn_dailymail", "validation", amount=700, full_prompt=True))


@query
def load_json(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "datasets")
    o = read_table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" of customer "), "o_custkey").alias("question"),
        F.concat(F.lit("2 parts, total #### "), fixtures.price("o_totalprice")).alias("answer"),
    )
    _in_files(o, "o_orderkey").write.json(f"{root}/gsm8k/train")
    return sample_digest(load_dataset(spark, root, "gsm8k", "train", full_prompt=True, fmt="json"))


@query
def load_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one array of a hundred papers each; summaries are plain texts where lists are wanted."""
    root = scratch_path(spark, "datasets")
    rows = fixtures.papers(spark, sf).select(
        F.floor(F.col("ord") / 100).alias("part"),
        F.struct("ord", "source", F.get("target", F.lit(0)).alias("target")).alias("row"),
    )
    arrays = rows.groupBy("part").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        F.lpad(F.col("part").cast("string"), 9, "0").alias("part"),
        F.to_json(F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target")))).alias("value"),
    )
    arrays.write.partitionBy("part").text(f"{root}/scitldr/train")
    return sample_digest(load_dataset(spark, root, "sci", "train", full_prompt=True, fmt="json_array"))


@query
def load_prompt_sets(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "prompts")
    turns, rated = _prompt_sets(spark, sf)
    turns.write.parquet(f"{root}/rewrites")
    rated.write.parquet(f"{root}/ratings")
    return _pair_digest(load_prompt_pairs(spark, f"{root}/rewrites", f"{root}/ratings"))


# Hook


def _digest_backend():
    """Stands for a model client: answers with a digest and refuses a sixteenth of the prompts."""

    def answer(batch: list[str]) -> list[str]:
        digests = [hashlib.md5(p.encode()).hexdigest() for p in batch]
        if any(d.startswith("7") for d in digests):
            raise ValueError("refused")
        return digests

    return answer


@query
def batch_hook(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True).select("doc_id", "text")
    asked = d.withColumnRenamed("text", "prompt")
    return hooks.generate(asked, "prompt", _digest_backend, batch_size=50).drop("prompt")


@query
def distinct_requests(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", spread=True).select("doc_id", F.col("text").alias("prompt"))
    answered = hooks.generate_distinct(d, "prompt", _digest_backend, params="t=0")
    return answered.select("doc_id", "request_id", "text", "error")


@query
def resumed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all documents after a job that had answered those of one language: each is in the ledger once, a failed one twice."""
    d = read_table(spark, sf, "documents", spread=True).select("doc_id", "lang", F.col("text").alias("prompt"))
    ledger = scratch_path(spark, "ledger")
    ask = lambda rows: hooks.generate_resumable(rows, "prompt", _digest_backend, ledger, params="t=0", batch_size=50)
    ask(d.where("lang = 'en'"))
    answered = ask(d).select("doc_id", "request_id", "text", "error")
    times = hooks.read_ledger(spark, ledger).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_asked"))
    return answered.join(times, "request_id")


@query
def recorded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as recorded generations for the documents that repeat them."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    items = read_table(spark, sf, "benchmark")
    generations = items.groupBy(prompts.request_id(F.col("text"), "t=0").alias("request_id")).agg(
        F.concat(F.lit("item "), F.min("item_id")).alias("text")
    )
    return hooks.recorded(d, generations, "prompt", "t=0").select("doc_id", "text")
