import hashlib
import json

import pytest
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris import judge_texts
from verdigris.operators import prepare, prompts, training
from verdigris.plans import queries
from verdigris.sources import datasets, schemas


def raw(spark, task, rows):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], schemas.RAW[task])


def test_aliases_and_unknown_names():
    assert prepare.task_of("CNN_DailyMail") == "cnndm" and prepare.task_of("hotpotqa") == "hotpot"
    for name in ("squad", "gsm"):
        with pytest.raises(ValueError):
            prepare.task_of(name)
    assert prepare.instruction_for("gsm") == prepare.instruction_for("gsm8k") == "SOLUTION"
    assert prepare.instruction_for("hotpotqa") == "Answer the question based on the context"
    assert prepare.instruction_for("nq", full_prompt=True) is None
    assert prepare.instruction_for("other") is None


def test_split_names():
    assert datasets.split_of("sci", "validation") == "test"
    assert datasets.split_of("gsm8k", "validation") == "test"
    assert datasets.split_of("nq", "validation") == "validation"
    assert datasets.split_of("cnndm", "train") == "train"


def test_questions(spark):
    rows = [
        (("  who? ",), ([([" a ", ""],), ([],), (None,), (["b", " "],)],)),
        ((" ",), ([(["x"],)],)),
        ((None,), None),
        (None, None),
        (("q",), ([],)),
        (("q2",), None),
    ]
    got = prepare.normalize(raw(spark, "nq", rows), "nq").orderBy("ord").collect()
    assert [(r["ord"], r["target"]) for r in got] == [(0, ["a", "b"]), (4, []), (5, [])]
    assert got[0]["text"] == "\nQuestion: who?" and got[0]["original"] == "Answer the question"
    # The short request uses the task's instruction.
    assert "Original instruction: Answer the question\n\nNew Instruction: {" in got[0]["prompt"]
    assert prepare.keep_valid(prepare.normalize(raw(spark, "nq", rows), "nq")).count() == 1


def test_news_length_limit(spark):
    rows = [("x" * 5000, "s"), (" " + "x" * 5000 + "\n", "s"), ("x" * 5001, "s"), ("", "s"), ("x", " "), (None, "s"), ("é" * 5000, " s ")]
    got = prepare.normalize(raw(spark, "cnndm", rows), "cnndm", True).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [0, 1, 6]
    assert got[2]["target"] == ["s"] and got[0]["text"] == "\nText: " + "x" * 5000


def test_papers_join_parts(spark):
    rows = [(["a", "b "], ["t1", "t2"]), (["a"], []), (None, ["t"]), (["a"], [" "])]
    got = prepare.normalize(raw(spark, "scitldr", rows), "scitldr").collect()
    assert [(r["text"], r["target"]) for r in got] == [("\nText: a b", ["t1"])]


def test_math_without_number_stays_valid(spark):
    rows = [("q", "so #### 1,234"), ("q", "none"), ("", "1"), ("q", "")]
    got = prepare.keep_valid(prepare.normalize(raw(spark, "gsm8k", rows), "gsm8k")).orderBy("ord").collect()
    assert [r["target"] for r in got] == [["234"], [""]]


def test_context_questions(spark):
    rows = [("q", "a", ([["s1", "s2"], ["s3"]],)), ("q", "a", ([],)), ("q", "a", None), ("q", "", ([["s"]],))]
    got = prepare.normalize(raw(spark, "hotpot", rows), "hotpot").collect()
    assert [r["text"] for r in got] == ["\nContext: s1 s2 s3\nQuestion: q"]


def test_meta_prompt_keeps_braces_and_percent(value):
    got = value(prompts.meta_prompt(F.lit("Do"), F.col("x")), "x STRING", ("100% {text} {instruction}",))
    assert got.endswith('Original instruction: Do: "100% {text} {instruction}"\nNew Instruction: {')
    empty = value(prompts.meta_prompt(F.lit("Do"), F.col("x")), "x STRING", ("",))
    assert empty.endswith("Original instruction: Do\n\nNew Instruction: {")


def test_prepare_end_to_end(spark):
    rows = [(f"article {i}", "" if i % 10 == 0 else f"sum {i}") for i in range(300)]
    train, test = prepare.prepare(raw(spark, "cnndm", rows), "cnndm", batch_size=16, test_size=0.1, chat=True)
    assert (train.count(), test.count()) == (243, 27)
    sizes = sorted(r["count"] for r in train.groupBy("batch_id").count().collect())
    assert sizes == [3] + [16] * 15
    first = test.where("batch_id = 0").orderBy("batch_pos").collect()
    digests = [hashlib.md5(f"42:{r['sample_id']}".encode()).hexdigest() for r in first]
    assert digests == sorted(digests)
    assert first[0]["prompt"].startswith(fixed.CHAT_PREFIX) and first[0]["prompt"].endswith(fixed.CHAT_SUFFIX)
    again, _ = prepare.prepare(raw(spark, "cnndm", rows), "cnndm", batch_size=16, test_size=0.1)
    order = lambda df: [r["sample_id"] for r in df.orderBy("batch_id", "batch_pos").collect()]
    assert order(train) == order(again) != sorted(order(train))


def test_prepare_rejects_empty(spark):
    with pytest.raises(ValueError):
        prepare.prepare(raw(spark, "cnndm", [("", "")]), "cnndm")


def test_slices(spark):
    rows = [((f"q{i}",), ([(["a"],)],)) for i in range(300)]
    nq = raw(spark, "nq", rows)
    assert prepare.load_samples(nq, "nq", 280).count() == 30  # take first, then skip
    assert prepare.load_samples(nq, "nq", 280, slices=False).count() == 280
    assert prepare.load_samples(nq, "nq").agg(F.min("ord")).first()[0] == 250


def test_special_test_size(spark):
    samples = spark.range(1000).withColumnRenamed("id", "sample_id")
    train, test = prepare.split(samples, "scitldr", 0.999)
    assert (train.count(), test.count()) == (2, 998)
    assert prepare.split(samples, "cnndm", 0.999)[0].count() == 1


def test_reference_samples(spark):
    rows = [(0, 0, " p ", [" r "], "\nText: t", "Sum"), (1, 1, "p", [""], "t", "S"), (2, 2, "p", [], "t", "S"), (3, 3, "p", ["r"], " ", "S")]
    df = spark.createDataFrame(rows, "sample_id BIGINT, ord BIGINT, prompt STRING, target ARRAY<STRING>, text STRING, original STRING")
    got = prepare.reference_samples(df).collect()
    assert len(got) == 1
    assert (got[0]["original_query"], got[0]["reference_answer"], got[0]["prompt"]) == ("SumText: t", "r", "p")


def test_read_raw_files(spark, tmp_path):
    rows = [(f"text {i}", "s") for i in range(20)]
    plain = spark.createDataFrame(rows, "article STRING, highlights STRING").coalesce(1)
    plain.write.parquet(f"{tmp_path}/cnndm/test")
    got = datasets.load_dataset(spark, str(tmp_path), "cnn_dailymail", "validation", amount=3).orderBy("ord").collect()
    assert [r["text"] for r in got] == ["\nText: text 0", "\nText: text 1", "\nText: text 2"]
    # Plain strings become lists of one.
    spark.createDataFrame([(0, 0, "src", "tgt")], "sample_id BIGINT, ord BIGINT, source STRING, target STRING").write.parquet(
        f"{tmp_path}/scitldr/train"
    )
    assert datasets.load_dataset(spark, str(tmp_path), "sci", "train").first()["target"] == ["tgt"]
    raw(spark, "gsm8k", [("q", "#### 5")]).write.json(f"{tmp_path}/gsm8k/train")
    assert datasets.load_dataset(spark, str(tmp_path), "gsm8k", "train", fmt="json").first()["target"] == ["5"]
    nested = spark.sql(
        "SELECT 0L AS sample_id, 0L AS ord, named_struct('text', 'q') AS question, "
        "named_struct('short_answers', array(named_struct('text', ' a '))) AS annotations"
    )
    nested.write.parquet(f"{tmp_path}/nq/train")
    loaded = prepare.normalize(datasets.read_raw(spark, str(tmp_path), "nq", "train"), "nq")
    assert loaded.first()["target"] == ["a"]


def test_prompt_pairs(spark, tmp_path):
    spark.createDataFrame([(0, " p ", "a", 'say "hi"'), (1, "q", None, "o")], schemas.REWRITE_PAIRS).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(i, f"r{i}", None if i else 4.5) for i in range(5)], schemas.RATED_PROMPTS).write.parquet(f"{tmp_path}/b")
    pairs = datasets.load_prompt_pairs(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert len(pairs) == 4
    parsed = {r["original_query"]: json.loads(r["candidate_prompt"]) for r in pairs}
    assert parsed[fixed.TUNE_REWRITE.replace("{prompt}", "p")] == {"explanation": "a", "final_rewritten_query": 'say "hi"'}
    assert parsed[fixed.TUNE_RATING.replace("{prompt}", "r0")]["final_rating"] == "4.5"
    assert parsed[fixed.TUNE_RATING.replace("{prompt}", "r1")]["final_rating"] == "N/A"
    with pytest.raises(Exception):
        datasets.load_prompt_pairs(spark, f"{tmp_path}/a", f"{tmp_path}/missing").count()


@pytest.mark.parametrize("n_prompt, n_target", [(2, 3), (5, 20), (8, 3), (12, 3), (0, 1)])
def test_pack(spark, n_prompt, n_target):
    df = spark.createDataFrame([(list(range(10, 10 + n_prompt)), list(range(50, 50 + n_target)))], "p ARRAY<INT>, t ARRAY<INT>")
    got = training.pack(df, F.col("p"), F.col("t"), end_id=1, pad_id=0, max_length=8).first()
    p = list(range(10, 10 + n_prompt))[:8]
    t = (list(range(50, 50 + n_target)) + [1])[: 8 - len(p)]
    pad = 8 - len(p) - len(t)
    assert got["input_ids"] == p + t + [0] * pad
    assert got["labels"] == [-100] * len(p) + t + [-100] * pad
    assert got["attention_mask"] == [1] * (8 - pad) + [0] * pad


def test_encode(spark):
    vocabulary = spark.createDataFrame([("a", 5), ("b", 6)], "token STRING, id INT")
    tokens = spark.createDataFrame([(0, ["b", "a", "?", "b"]), (1, ["a"])], "k INT, tokens ARRAY<STRING>")
    got = {r["k"]: r["ids"] for r in training.encode(tokens, vocabulary, ["k"]).collect()}
    assert got == {0: [6, 5, None, 6], 1: [5]}


def test_encode_keeps_rows_without_tokens(spark):
    vocabulary = spark.createDataFrame([("a", 5)], "token STRING, id INT")
    tokens = spark.createDataFrame([(0, ["a"]), (1, []), (2, None)], "k INT, tokens ARRAY<STRING>")
    got = {r["k"]: r["ids"] for r in training.encode(tokens, vocabulary, ["k"]).collect()}
    assert got == {0: [5], 1: [], 2: []}


def test_evaluation_head_follows_the_shuffle(spark):
    rows = [(f"q{i}", f"#### {i}") for i in range(3000)]
    _, test = prepare.prepare(raw(spark, "gsm8k", rows), "gsm8k", batch_size=None, test_size=0.5, evaluate=True)
    ids = [r["ord"] for r in test.collect()]
    by_hash = sorted(range(3000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert sorted(ids) == sorted(by_hash[:1000]) and max(ids) > 2900


def test_json_sources_without_order(spark, tmp_path):
    rows = spark.range(250).selectExpr("concat('q', id) AS question", "concat('#### ', id) AS answer")
    rows.repartitionByRange(3, "question").write.json(f"{tmp_path}/gsm8k/train")
    got = datasets.load_dataset(spark, str(tmp_path), "gsm8k", "train", fmt="json")
    assert sorted(r["ord"] for r in got.collect()) == list(range(250))
    train, test = prepare.split(got, "gsm8k")
    assert (train.count(), test.count()) == (225, 25)
    (tmp_path / "scitldr/train").mkdir(parents=True)
    for name, ids in (("a", (0, 1)), ("b", (2,))):
        papers = [{"source": [f"s{i}", "t"], "target": f"sum {i}" if i % 2 else [f"sum {i}", "x"]} for i in ids]
        (tmp_path / f"scitldr/train/{name}.json").write_text(json.dumps(papers, indent=1))
    loaded = datasets.load_dataset(spark, str(tmp_path), "sci", "train", fmt="json_array").orderBy("ord").collect()
    assert [(r["ord"], r["target"], r["text"]) for r in loaded] == [(i, [f"sum {i}"], f"\nText: s{i} t") for i in range(3)]


def test_order_of_parquet_files_moves_no_texts(spark, tmp_path):
    plain = spark.range(50).selectExpr("concat('text ', id) AS article", "'s' AS highlights")
    plain.repartition(4).write.parquet(f"{tmp_path}/cnndm/test")
    got = datasets.read_raw(spark, str(tmp_path), "cnndm", "test")
    assert sorted(r["ord"] for r in got.collect()) == list(range(50))
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hash" in line or "Exchange range" in line]
    assert all("_groupingexpression" in line for line in moved)  # only counts per file part are shuffled


def test_requests(spark, tmp_path):
    df = spark.createDataFrame(
        [("cnndm", "q {x}", "a", ["it's", 'say "x"', "b\nc"]), ("nq", "q", "a", [])],
        "task STRING, q STRING, a STRING, refs ARRAY<STRING>",
    )
    listed = prompts.list_text(F.col("refs"))
    asked = judge_texts.templates({"answer": "Is it right?", "summary": "Is it short?", "prompt_quality": "Is it clear?"})
    rows = df.select(
        listed.alias("refs"),
        prompts.answer_request(F.col("task"), F.col("q"), F.col("a"), listed, asked, open_brace=True).alias("r"),
        prompts.prompt_quality_request(F.col("q"), F.col("a"), asked).alias("p"),
    ).collect()
    assert rows[0]["refs"] == str(["it's", 'say "x"', "b\nc"]) and rows[1]["refs"] == "[]"
    assert rows[0]["r"].startswith("Is it short?\n") and rows[1]["r"].startswith("Is it right?\n")
    assert '[QUERY]: "q {x}"' in rows[0]["r"] and rows[0]["r"].endswith("Evaluation:{")
    assert '"score": <number from 0 to 5>' in rows[0]["p"] and '[REWRITTEN QUERY]: "a"' in rows[0]["p"]
    with pytest.raises(ValueError):
        judge_texts.templates({"other": "x"})
    (tmp_path / "answer.txt").write_text("own\nrubric")
    assert judge_texts.read_rubrics(spark, str(tmp_path)) == {"answer": "own\nrubric"}


def test_selection_prompts(spark):
    rows = [(7, k, f"rw{k}", "Inst", "txt") for k in (2, 0, 1)]
    df = spark.createDataFrame(rows, "sample_id INT, cand_idx INT, rewrite STRING, original STRING, text STRING")
    example = prompts.selection_prompts(df, per_example=True).first()["request"]
    assert example.startswith("This was the initial instruction: Inst txt.\n Here are") and "1. rw02. rw13. rw2Which" in example
    instruction = prompts.selection_prompts(df, per_example=False).first()["request"]
    assert "\n1. rw0\n2. rw1\n3. rw2\nWhich" in instruction and instruction.endswith("nothing else.\n\n{")


def test_fan_out(spark):
    assert prompts.fan_out(spark.range(3), 0).count() == 0
    rows = prompts.fan_out(spark.range(3), 4).collect()
    assert sorted((r["id"], r["cand_idx"]) for r in rows) == [(i, k) for i in range(3) for k in range(4)]


def test_frequent_tokens_stay_and_rare_ones_travel(spark):
    """A vocabulary too large to broadcast: same ids, and only rare tokens reach the shuffle join."""
    rows = [(i, ["the"] * 5 + [f"w{i % 7}", f"rare{i}", "the", "unknown"]) for i in range(40)] + [(100, []), (101, None), (None, ["the", "w1"])]
    tokens = spark.createDataFrame(rows, "k INT, tokens ARRAY<STRING>")
    names = ["the", *(f"w{i}" for i in range(7)), *(f"rare{i}" for i in range(40))]
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token STRING, id INT")
    ids = {t: i for i, t in enumerate(names)}
    expected = {k: [ids.get(t) for t in words or []] for k, words in rows}
    before = training.FREQUENT_TOKENS
    for most in (0, 3, before):
        training.FREQUENT_TOKENS = most
        try:
            assert {r["k"]: r["ids"] for r in training.encode(tokens, vocabulary, ["k"], max_rows=5).collect()} == expected
        finally:
            training.FREQUENT_TOKENS = before
    frequent = training.frequent_entries(tokens, vocabulary, 3)
    assert "the" in {r["token"] for r in frequent.collect()} and frequent.count() == 3
    plan = training.encode(tokens, vocabulary, ["k"], max_rows=5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "isnull(_near" in plan


def test_head_of_many_files_opens_one(spark, tmp_path):
    from verdigris.sources.datasets import first_files, load_dataset, read_raw

    for i in range(50):
        spark.range(4 * i, 4 * i + 4).coalesce(1).selectExpr("concat('article ', id) AS article", "concat('s ', id) AS highlights").write.parquet(
            f"{tmp_path}/parts/{i:02d}"
        )
    from shutil import copy

    folder = tmp_path / "data/cnndm/test"
    folder.mkdir(parents=True)
    for i in range(50):
        copy(next((tmp_path / f"parts/{i:02d}").glob("*.parquet")), folder / f"part-{i:02d}.parquet")
    head = read_raw(spark, f"{tmp_path}/data", "cnndm", "validation", amount=3)
    assert len(head.inputFiles()) == 1 and head.count() == 4
    assert len(read_raw(spark, f"{tmp_path}/data", "cnndm", "validation", amount=9).inputFiles()) == 3
    everything = spark.read.parquet(str(folder))
    assert len(first_files(everything, 0).inputFiles()) == 1 and first_files(everything, 10_000).count() == 200
    got = load_dataset(spark, f"{tmp_path}/data", "cnndm", "validation", amount=6).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in got] == [(i, f"\nText: article {i}") for i in range(6)]


def test_files_of_a_dataset_follow_the_splits_of_its_table(spark, sf, tmp_path):
    """Each split of a scan has a file, in order of the key; a small table has three."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("doc_id").alias("id"))
    queries._in_files(rows.coalesce(1), "doc_id").write.parquet(f"{tmp_path}/small")
    queries._in_files(rows.repartition(9), "doc_id").write.parquet(f"{tmp_path}/large")
    for folder, files in (("small", 3), ("large", 9)):
        found = sorted((tmp_path / folder).glob("*.parquet"))
        ids = [r["id"] for f in found for r in spark.read.parquet(str(f)).collect()]
        assert len(found) == files and ids == sorted(r["doc_id"] for r in rows.collect())
