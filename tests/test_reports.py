import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from verdigris import judge_texts
from verdigris.operators import hooks, prompts
from verdigris.plans import compare, curate, evaluate, fixtures
from verdigris.sources import logs, schemas

SCHEMA = "sample_id INT, answer STRING, target ARRAY<STRING>, judge_text STRING"


def one(df):
    return df.first().asDict()


def test_first_reference_or_best(spark):
    df = spark.createDataFrame([(0, "blue", ["red", "blue"], '{"score": 1}')], SCHEMA)
    first = one(evaluate.answer_report(evaluate.with_scores(df)))
    best = one(evaluate.answer_report(evaluate.with_scores(df, mode="strict")))
    assert (first["avg_em"], first["avg_f1"], first["avg_rouge"]) == (0, 0, 1)
    assert (best["avg_em"], best["avg_f1"], best["avg_rouge"]) == (1, 1, 1)


def test_failed_judge_counts_or_drops(spark):
    rows = [(0, "a", ["a"], '{"score": 1}'), (1, "b", ["a"], "broken"), (2, "", ["a"], '{"score": 1}'), (3, None, ["a"], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    counted = one(evaluate.answer_report(evaluate.with_scores(df, failed=evaluate.FAILED_IS_ZERO)))
    dropped = one(evaluate.answer_report(evaluate.with_scores(df, failed=evaluate.FAILED_IS_DROPPED)))
    assert (counted["n"], counted["avg_judge"]) == (2, 0.5)
    assert (dropped["n"], dropped["avg_judge"]) == (1, 1.0)


def test_math_uses_number_for_all(spark):
    df = spark.createDataFrame([(0, "so #### 7", ["7"], ""), (1, "8", ["7"], "")], SCHEMA)
    assert one(evaluate.answer_report(evaluate.with_scores(df, math=True))) == {
        "avg_em": 0.0, "avg_f1": pytest.approx(1 / 3), "avg_rouge": 0.5, "avg_judge": 0.5, "n": 2,
    }


def test_empty_report(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert one(evaluate.answer_report(evaluate.with_scores(empty))) == {
        "avg_em": None, "avg_f1": None, "avg_rouge": None, "avg_judge": None, "n": 0,
    }
    assert one(evaluate.corpus_em_f1(empty)) == {"avg_em": 0.0, "avg_f1": 0.0, "n": 0}


def test_rewriter_counters(spark):
    completions = spark.createDataFrame(
        [('{"final_rewritten_query": "x"}',), ('{"other": 1}',), ("bad",), ("{'final_rewritten_query': 'x'}",)], "completion STRING"
    )
    scored = evaluate.with_scores(spark.createDataFrame([(0, "a", ["a"], "{}")], SCHEMA))
    got = one(evaluate.rewriter_report(scored, completions))
    assert (got["total_prompts"], got["correct_json_count"], got["n_strict"], got["n_failed"]) == (4, 2, 2, 1)


def test_candidate_metrics(spark):
    rows = [
        (0, 0, 1.0, 0.2, 0.1, 0.5), (0, 1, 0.0, 0.8, 0.3, 1.0), (0, 2, 1.0, 1.0, 1.0, -1.0),
        (1, 0, 0.0, 0.4, 0.5, 0.0), (2, 0, 1.0, 1.0, 1.0, -1.0),
    ]
    scored = spark.createDataFrame(rows, "sample_id INT, cand_idx INT, em DOUBLE, f1 DOUBLE, rouge DOUBLE, judge DOUBLE")
    # Sample 0 picks candidate 1; 1 picks beyond n; 2 picks a candidate that failed.
    picks = spark.createDataFrame([(0, 1), (1, 9), (2, 0)], "sample_id INT, pick BIGINT")
    got = {r["kind"]: r.asDict() for r in evaluate.candidate_metrics(scored, picks, 3).collect()}
    assert got["max"]["avg_f1"] == pytest.approx(0.6) and got["max"]["avg_em"] == 0.5 and got["max"]["n"] == 2
    assert got["mean"]["avg_f1"] == pytest.approx(0.45)
    assert got["choice"]["avg_f1"] == pytest.approx(0.8) and got["choice"]["n"] == 1
    none = spark.createDataFrame([(0, -1)], "sample_id INT, pick BIGINT")
    got = {r["kind"]: r.asDict() for r in evaluate.candidate_metrics(scored, none, 3).collect()}
    assert got["choice"]["avg_f1"] is None and got["choice"]["n"] == 0


def test_max_is_never_below_mean(spark):
    rows = [(i % 7, i, (i * 37 % 11) / 10, (i * 13 % 10) / 10, (i * 7 % 9) / 10, (i * 3 % 8) / 10) for i in range(60)]
    scored = spark.createDataFrame(rows, "sample_id INT, cand_idx INT, em DOUBLE, f1 DOUBLE, rouge DOUBLE, judge DOUBLE")
    picks = spark.createDataFrame([(0, 0)], "sample_id INT, pick BIGINT")
    got = {r["kind"]: r for r in evaluate.candidate_metrics(scored, picks, 60).collect()}
    assert all(got["max"][f"avg_{m}"] >= got["mean"][f"avg_{m}"] for m in evaluate.METRICS)


def test_pairs_multiply(spark):
    a = spark.createDataFrame([("t", "x"), ("t", "x"), ("t", "y"), ("u", "x")], "original STRING, option_1 STRING")
    b = spark.createDataFrame([("t", "z"), ("t", "z"), ("v", "z")], "original STRING, option_2 STRING")
    got = sorted((r["original"], r["option_1"], r["n_pairs"]) for r in compare.paired_answers(a, b).collect())
    assert got == [("t", "x", 4), ("t", "y", 2)]


def test_swap_round_trip(spark):
    pairs = spark.range(200).selectExpr("cast(id AS STRING) AS original", "'one' AS option_1", "'two' AS option_2", "1L AS n_pairs")
    asked = compare.pairwise_requests(pairs, judge_texts.templates({"pairwise": "Choose."}))
    assert 60 < asked.where("swap").count() < 140
    # A judge that always prefers the text 'two' must give option 2 a win rate of 1.
    places = F.when(F.instr("request", "[OPTION 1]\ntwo") > 0, '{"selection": 1}').otherwise('{"selection": 2}')
    judged = compare.with_selection(asked.withColumn("judge_text", places))
    assert one(compare.win_rate(judged)) == {"win_rate": 1.0, "n": 200}
    broken = compare.with_selection(asked.withColumn("judge_text", F.lit("?")))
    assert one(compare.win_rate(broken)) == {"win_rate": 0.0, "n": 0}


def test_quality_gate(spark):
    rows = []
    for ord_ in range(40):
        for cand in range(4):
            low = 5.0 if (ord_ + cand) % 3 == 0 else 4.0 if (ord_ + cand) % 3 == 1 else 3.0
            for i, (a, j) in enumerate(curate.SCORE_ORDER):
                rows.append((ord_, cand, a, j, low if i == 2 else 5.0))
    long = spark.createDataFrame(rows, "ord INT, cand_idx INT, answerer STRING, judge STRING, score DOUBLE").repartition(5)
    matrix = curate.judge_matrix(long, ["ord", "cand_idx"])
    kept = curate.curate(curate.with_gate(matrix), wanted=40).collect()
    want, perfect = [], []
    for ord_ in range(40):
        for cand in range(4):
            if len(want) < 40 and (ord_ + cand) % 3 != 2:
                want.append((ord_, cand))
                if (ord_ + cand) % 3 == 0:
                    perfect.append((ord_, cand))
    assert sorted((r["ord"], r["cand_idx"]) for r in kept) == want
    assert sorted((r["ord"], r["cand_idx"]) for r in kept if r["perfect"]) == perfect
    passing = sum((o + c) % 3 != 2 for o in range(40) for c in range(4))
    assert curate.curate(curate.with_gate(matrix), wanted=1000).count() == passing
    missing = curate.judge_matrix(long.where("judge = 'first'"), ["ord", "cand_idx"])
    assert curate.curate(curate.with_gate(missing)).count() == 0


def test_results_log_appends(spark, tmp_path):
    path = f"{tmp_path}/results"
    for name in ("a,b", 'c "d"\ne'):
        row = spark.createDataFrame([(name, 0.12344, 0.5, 1 / 3, 1.0)], "name STRING, accuracy DOUBLE, f1 DOUBLE, rouge DOUBLE, judge DOUBLE")
        logs.write_results(row, path)
    got = {r["Name"]: (r["Accuracy"], r["ROUGE"]) for r in logs.read_results(spark, path).collect()}
    assert got == {"a,b": (0.1234, 0.3333), 'c "d"\ne': (0.1234, 0.3333)}


def test_sample_log_keeps_text(spark, tmp_path):
    odd = [' lead', 'tail ', 'a "q", b\nline\n', "é", "'", "#"]
    rows = [(f"run{i % 2}", t, t + "x", "f" + t, 0.125, -1.0) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "run_name STRING, original STRING, rewrite STRING, final_answer STRING, accuracy DOUBLE, judge DOUBLE")
    logs.write_sample_log(df, f"{tmp_path}/log")
    back = logs.read_sample_log(spark, f"{tmp_path}/log", answer_as="option_1")
    assert sorted(r["Original"] for r in back.collect()) == sorted(odd)
    assert {r["Accuracy"] for r in back.collect()} == {0.12}
    assert logs.read_sample_log(spark, f"{tmp_path}/log/run_name=run1").count() == 3


def test_sample_log_of_one_line_each_is_read_by_many_tasks(spark, tmp_path):
    odd = [" lead", 'a "q", b\nline\n', "\r\n", "\\n", "\\\n", "\\\\", "\\r\r\\", 'ends in "\\"', "é", None] + [f"text {i}\n" * 50 for i in range(2000)]
    rows = [("run", t, t, t, 0.125, -1.0) for t in odd]
    schema = "run_name STRING, original STRING, rewrite STRING, final_answer STRING, accuracy DOUBLE, judge DOUBLE"
    logs.write_sample_log(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_path}/log", breaks="escaped")
    files = list((tmp_path / "log" / "run_name=run").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().count("\n") == len(odd) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        back = logs.read_sample_log(spark, f"{tmp_path}/log", breaks="escaped")
        assert back.rdd.getNumPartitions() > 3
        for column in ("Original", "Rewrite", "Final Answer"):
            assert sorted(map(repr, odd)) == sorted(repr(r[column]) for r in back.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        logs.read_sample_log(spark, f"{tmp_path}/log", breaks="none")


def test_sample_log_files_are_bounded(spark, tmp_path):
    rows = [("run", f"a\n{i}", "b", "c", 0.5, 1.0) for i in range(25)]
    schema = "run_name STRING, original STRING, rewrite STRING, final_answer STRING, accuracy DOUBLE, judge DOUBLE"
    logs.write_sample_log(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_path}/log", rows_per_file=10)
    assert len(list((tmp_path / "log" / "run_name=run").glob("*.csv"))) == 3
    assert logs.read_sample_log(spark, f"{tmp_path}/log").count() == 25


def test_reward_log(spark, tmp_path):
    (tmp_path / "rewards.txt").write_text("1.5 0.25   3\n  2.5\t0.5 1  \n\n")
    got = logs.read_reward_log(spark, str(tmp_path / "rewards.txt")).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(2.5, 0.5, 1), (1.5, 0.25, 3)]


def test_json_sources(spark, tmp_path):
    rows = [{"sample_id": 1, "ord": 1, "prompt": "p", "original": "o", "text": "t", "original_query": "q", "reference_answer": "r"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    got = logs.read_json(spark, str(tmp_path / "array.json"), schemas.REFERENCE_SAMPLES, array_file=True)
    assert got.first()["reference_answer"] == "r"
    logs.write_json(got, f"{tmp_path}/out")
    assert logs.read_json(spark, f"{tmp_path}/out", schemas.REFERENCE_SAMPLES).collect() == got.collect()


def test_hook_isolates_failures(spark):
    def backend():
        def answer(batch):
            if "bad" in batch:
                raise ValueError("refused")
            return [p.upper() for p in batch]

        return answer

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "prompt STRING").coalesce(1)
    got = {r["prompt"]: (r["text"], r["error"]) for r in hooks.generate(df, "prompt", backend).collect()}
    assert got == {"a": ("A", None), "b": ("B", None), "bad": ("", "refused")}


def test_hook_hands_out_portions_of_bytes(spark):
    """Without a batch size a call has a portion of an Arrow batch; rows, orders and other columns stay as they are."""
    rows = [(i, None if i == 5 else "" if i == 6 else str(i % 10) * (3_000_000 if i == 50 else 20_000), [i, None]) for i in range(400)]
    df = spark.createDataFrame(rows, "k INT, prompt STRING, more ARRAY<INT>").coalesce(1)

    def backend():
        return lambda prompts: [f"{len(prompts)} {sum(len(p or '') for p in prompts)} {p and p[0]}" for p in prompts]

    got = hooks.generate(df, "prompt", backend).collect()
    assert [(r["k"], r["prompt"], r["more"]) for r in got] == rows and {r["error"] for r in got} == {None}
    assert [r["text"].split(" ")[2] for r in got] == [p[0] if p else str(p) for _, p, _ in rows]
    assert max(int(r["text"].split()[1]) for r in got if r["k"] != 50) <= hooks.ASK_BYTES + 3_000_000
    assert max(int(r["text"].split()[0]) for r in got) <= hooks.ASK_BYTES // 20_000 + 3
    empty = hooks.generate(df.where("k < 0"), "prompt", backend, into="said").collect()
    assert empty == []


def test_hook_holds_texts_of_a_portion(spark):
    """With a batch size too, a task has the texts of a portion beside its Arrow batch, not those of the whole batch."""
    n, size = 400, 50_000
    df = spark.range(0, n, 1, 1).select(F.repeat(F.lit("x"), size).alias("prompt"))

    def backend():
        tracemalloc.start()

        def answer(batch):
            held = tracemalloc.get_traced_memory()[0]  # 0 after the first call
            tracemalloc.stop()
            return [f"{len(batch)} {held}"] * len(batch)

        return answer

    asked = hooks.generate(df, "prompt", backend, batch_size=10).select("text").collect()
    assert len(asked) == n and max(int(r["text"].split()[0]) for r in asked) == 10
    held = max(int(r["text"].split()[1]) for r in asked)
    assert n * size < held < n * size + 2 * hooks.ASK_BYTES


def test_hook_asks_each_request_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counting():
        def answer(batch):
            asked.add(len(batch))
            return [p.upper() for p in batch]

        return answer

    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 10 AS STRING) END AS prompt")
    got = hooks.generate_distinct(df, "prompt", counting).collect()
    assert len(got) == 300 and all(r["text"] == r["prompt"].upper() for r in got)
    assert asked.value == 11


def _logging_backend(folder, dies_at=None):
    """Writes a line for each prompt; its process ends without a word at the prompt ``dies_at``, once."""

    def make():
        import os
        import uuid

        log = open(f"{folder}/{uuid.uuid4().hex}.log", "a")

        def answer(batch):
            for prompt in batch:
                if prompt == dies_at and not os.path.exists(f"{folder}/died"):
                    open(f"{folder}/died", "w").close()
                    os._exit(1)
                log.write(prompt + "\n")
                log.flush()
            if "p7" in batch:
                raise ValueError("refused")
            return [p.upper() for p in batch]

        return answer

    return make


def _asked(folder):
    return sorted(line for f in folder.glob("*.log") for line in f.read_text().split())


def test_a_job_that_is_started_again_asks_only_what_is_missing(spark, tmp_path):
    """The process of one task dies half-way and with it the job: other tasks had committed."""
    df = spark.range(600).selectExpr("id", "concat('p', id % 200) AS prompt")
    ledger = f"{tmp_path}/ledger"
    how = dict(ledger=ledger, batch_size=1, commit_rows=20)
    with pytest.raises(Exception):
        hooks.generate_resumable(df, "prompt", _logging_backend(tmp_path, "p42"), **how)
    before = _asked(tmp_path)
    committed = {r["request_id"] for r in hooks.read_ledger(spark, ledger).where("error IS NULL").collect()}
    assert 0 < len(committed) < 200
    got = hooks.generate_resumable(df, "prompt", _logging_backend(tmp_path, "p42"), **how).collect()
    assert len(got) == 600
    assert all((r["text"], r["error"]) == (("", "refused") if r["prompt"] == "p7" else (r["prompt"].upper(), None)) for r in got)
    again = len(_asked(tmp_path)) - len(before)
    assert again <= 201 - len(committed)  # p7 failed and is asked again
    assert set(_asked(tmp_path)) == {f"p{i}" for i in range(200)}
    # nothing but the failed request is asked by a third job
    hooks.generate_resumable(df, "prompt", _logging_backend(tmp_path), **how).collect()
    assert len(_asked(tmp_path)) - len(before) - again == 1


def test_an_empty_table_asks_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id LONG, prompt STRING")
    assert hooks.generate_resumable(df, "prompt", _logging_backend(tmp_path), f"{tmp_path}/ledger").collect() == []


def test_answers_are_scored_by_even_tasks(spark, monkeypatch):
    """Tasks have ``SCORED_ROWS`` answers, however few bytes these take; what was joined is stored, not joined again."""
    monkeypatch.setattr(evaluate, "SCORED_ROWS", 20)
    samples = spark.range(95).selectExpr("id AS sample_id", "concat('q', id) AS text", "array('r') AS target", "concat('p', id) AS final_prompt")
    asked = prompts.request_id(F.col("final_prompt"))
    kept = samples.select(asked.alias("request_id"), F.concat(F.lit("a"), "sample_id").alias("text"))
    answered = evaluate._answered(samples, kept, fixtures.TEMPLATES, "nq")
    assert sorted((r["sample_id"], r["answer"], r["judge_text"]) for r in answered.collect()) == [(i, f"a{i}", "") for i in range(95)]
    sizes = [n for n in answered.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) == 5 and max(sizes) <= 24
    assert "final_prompt" not in answered._jdf.queryExecution().optimizedPlan().toString()


def test_generations_stay_in_their_buckets(spark):
    from verdigris.sources.generations import generation_store

    df = spark.range(50).selectExpr("concat('p', id) AS prompt")
    record = df.select(prompts.request_id(F.col("prompt")).alias("request_id"), F.concat("prompt", F.lit("!")).alias("text"))
    kept = generation_store(record.union(record.withColumn("text", F.lit("zz"))), buckets=4)
    assert kept.count() == 50
    got = hooks.recorded(df, kept, "prompt", distinct=True)
    assert all(r["text"] == r["prompt"] + "!" for r in got.collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("-1", "false", "4")):
            spark.conf.set(key, value)
        ids = df.select(prompts.request_id(F.col("prompt")).alias("request_id")).distinct()
        plan = ids.join(kept, "request_id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin" in plan and "text" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]


def test_recorded_answers_default_to_empty(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt STRING")
    found = df.limit(1).select(prompts.request_id(F.col("prompt")).alias("request_id"), F.lit("x").alias("text"))
    got = {r["prompt"]: r["text"] for r in hooks.recorded(df, found, "prompt").collect()}
    assert sorted(got.values()) == ["", "x"]


def test_gate_that_is_met_early_reads_a_part(spark, tmp_path):
    """Judgements in files by order: the same rows as over everything, from a small part of the input."""
    rows = spark.range(40_000).selectExpr(
        "id div 8 AS ord", "cast(id div 4 % 2 AS INT) AS cand_idx", "if(id % 2 = 0, 'first', 'second') AS answerer",
        "if(id div 2 % 2 = 0, 'first', 'second') AS judge", "concat(if(hash(id div 4) % 3 = 0, 5, 4), repeat(md5(cast(id AS STRING)), 8)) AS text",
    )
    rows.repartitionByRange(50, "ord").sortWithinPartitions("ord").write.parquet(f"{tmp_path}/j")
    record = spark.read.parquet(f"{tmp_path}/j").withColumn("score", F.substring("text", 1, 1).cast("double"))
    keys = ("ord", "cand_idx")

    def scanned(work):
        spark.sparkContext.setJobGroup("gate", "gate")
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("gate"))
        got = sorted(map(tuple, work().select(*keys, "perfect").collect()))
        tracker, status = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup("gate") if j not in before for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext.setJobGroup("other", "other")
        read = 0
        for s in stages:
            try:
                read += status.lastStageAttempt(s).inputRecords()
            except Exception:  # a skipped stage has no attempt
                continue
        return got, read

    whole, all_read = scanned(lambda: curate.curate(curate.with_gate(curate.judge_matrix(record, list(keys)), 4.0, 5.0), 60))
    part, some_read = scanned(lambda: curate.curate_in_ranges(record, keys, 60, 4.0, 5.0, first_range=20))
    assert part == whole and len(part) == 60
    assert all_read == 80_000  # the cut is looked for, then the rows are read
    assert some_read - 40_000 < 10_000  # once for the ends of the key, then the files of the first ranges
    scarce = curate.curate_in_ranges(record, keys, 60, 6.0, 7.0, first_range=20)
    assert scarce.count() == 0
    nulls = record.withColumn("ord", F.when(F.col("ord") > 5, F.col("ord")))
    a = curate.curate(curate.with_gate(curate.judge_matrix(nulls, list(keys)), 4.0, 5.0), 9).select(*keys).collect()
    b = curate.curate_in_ranges(nulls, keys, 9, 4.0, 5.0, first_range=1).select(*keys).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
