"""Rolling mean and early-stop rules against plain loops; streams against batch."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from verdigris.operators import monitor
from verdigris.plans.queries import QUERIES
from verdigris.streaming.monitor import early_stop_available, early_stop_stream
from verdigris.streaming.runs import read_stream, run_available, running_totals

WINDOW, PATIENCE, DELTA = 5, 8, 0.01


def plain_moving_stop(rewards):
    history, means = [], []
    for i, r in enumerate(rewards):
        history.append(r)
        if len(history) >= WINDOW:
            means.append(sum(history[-WINDOW:]) / WINDOW)
            if len(means) > PATIENCE and means[-1] - means[-1 - PATIENCE] < DELTA:
                return i
    return None


def plain_best_stop(rewards, start, epoch=None):
    window, best, since = deque(maxlen=WINDOW), float("-inf"), 0
    for i, r in enumerate(rewards):
        window.append(r)
        if len(window) == WINDOW:
            mean = sum(window) / WINDOW
            if mean > best + DELTA:
                best, since = mean, 0
            else:
                since += 1
            if (i % epoch if epoch else i) >= start and since >= PATIENCE:
                return i
    return None


def make_runs():
    rng = random.Random(5)
    runs = {0: [i * 0.0007 + rng.random() * 0.01 for i in range(1500)]}  # a third of all points
    for g in range(1, 25):
        n = rng.randrange(1, 150)
        drift = rng.choice([0, 0.001, 0.004, 0.02])
        runs[g] = [rng.random() + i * drift for i in range(n)]
    runs[25] = [i * 0.5 for i in range(60)]
    runs[26] = [i * 0.0001 for i in range(400)]
    return runs


RUNS = make_runs()


@pytest.fixture(scope="module")
def log(spark):
    rows = [(g, float(i), r, i * 3) for g, rewards in RUNS.items() for i, r in enumerate(rewards)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "run_id BIGINT, ts DOUBLE, reward DOUBLE, step BIGINT")


def stops(df):
    return {r["run_id"]: None if r["stop_step"] is None else r["stop_step"] // 3 for r in df.collect()}


@pytest.mark.parametrize("block", [None, 50])
def test_rolling_mean(log, block):
    for r in monitor.rolling_mean(log, 10, block).collect():
        seen = RUNS[r["run_id"]][max(0, r["pos"] - 9) : r["pos"] + 1]
        assert r["running_mean"] == pytest.approx(sum(seen) / len(seen))
        assert r["step"] == r["pos"] * 3


@pytest.mark.parametrize("block", [None, 13])
def test_moving_average_stop(log, block):
    got = monitor.stop_on_moving_average(log, WINDOW, PATIENCE, DELTA, block)
    assert stops(got) == {g: plain_moving_stop(r) for g, r in RUNS.items()}
    assert {r["run_id"]: r["n_points"] for r in got.collect()} == {g: len(r) for g, r in RUNS.items()}


@pytest.mark.parametrize("block, epoch", [(None, None), (70, 60)])
def test_best_window_stop(log, block, epoch):
    got = stops(monitor.stop_on_best_window(log, WINDOW, DELTA, PATIENCE, 20, epoch, block))
    assert got == {g: plain_best_stop(r, 20, epoch) for g, r in RUNS.items()}


def test_best_window_stop_in_small_batches(spark, log):
    # The chain through a run's records crosses Arrow batches without a change.
    some = log.where("run_id IN (0, 2, 3, 25, 26)")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = stops(monitor.stop_on_best_window(some, WINDOW, DELTA, PATIENCE, 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: plain_best_stop(RUNS[g], 20) for g in (0, 2, 3, 25, 26)}


def test_not_a_number_and_missing_rewards(spark):
    nan = float("nan")
    rising = [i * 0.02 for i in range(60)]
    runs = {0: [*rising[:25], nan, *rising[25:]], 1: [*rising[:25], nan, *[0.1] * 40], 2: [nan] * 40, 3: rising}
    rows = [(g, float(i), r, i * 3) for g, rewards in runs.items() for i, r in enumerate(rewards)]
    rows += [(3, 0.5, None, 1), (3, 9.5, None, 28)]
    log = spark.createDataFrame(rows, "run_id BIGINT, ts DOUBLE, reward DOUBLE, step BIGINT")
    got = monitor.stop_on_best_window(log, WINDOW, DELTA, PATIENCE, 20)
    assert stops(got) == {g: plain_best_stop(r, 20) for g, r in runs.items()}
    assert {r["run_id"]: r["n_points"] for r in got.collect()} == {g: len(r) for g, r in runs.items()}
    assert stops(monitor.stop_on_moving_average(log, WINDOW, PATIENCE, DELTA)) == {
        g: plain_moving_stop(r) for g, r in runs.items()
    }


def test_a_long_rising_run(spark):
    log = spark.range(100_000).selectExpr("1L AS run_id", "cast(id AS DOUBLE) AS ts", "id * 0.5D AS reward", "id AS step")
    row = monitor.stop_on_best_window(log).first()
    assert (row["stop_step"], row["n_points"]) == (None, 100_000)


def test_late_points_are_counted_and_change_nothing(spark, tmp_path):
    schema = "run_id BIGINT, reward DOUBLE, step BIGINT"
    import time

    for i, rows in enumerate(([(1, 0.5, s) for s in range(20)], [(1, 9.0, 3), (1, None, 30), *[(1, 0.5, s) for s in range(20, 40)]])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        time.sleep(1.1)
    source = read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, per_trigger=1)
    row = run_available(early_stop_stream(source, WINDOW, PATIENCE, DELTA), ["run_id"]).first()
    assert (row["n_points"], row["n_late"], row["stop_step"]) == (40, 1, WINDOW + PATIENCE - 1)


def test_late_points_of_a_source_are_done_by_the_batch_rule(spark, log, tmp_path):
    """The later half of the steps comes first; runs that end before are streamed, all others have late points."""
    for i, late in enumerate((True, False)):
        half = log.where((F.col("step") >= 60) == late).coalesce(1)
        half.write.parquet(f"{tmp_path}/in/part={i}")
        time.sleep(1.1)
    stream = read_stream(spark, f"{tmp_path}/in/*", log.schema, per_trigger=1)
    got = early_stop_available(stream, log, window=WINDOW, patience=PATIENCE, delta=DELTA)
    batch = monitor.stop_on_moving_average(log, WINDOW, PATIENCE, DELTA)
    assert stops(got) == stops(batch)
    assert {r["run_id"]: r["n_points"] for r in got.collect()} == {g: len(rewards) for g, rewards in RUNS.items()}


def test_stream_decides_ties_as_the_batch_rule(spark, tmp_path):
    """Gains of just ``delta``, up to the rounding of the sums."""
    rows = [
        (seed, float(i), rng.randrange(100) / 100, i)
        for seed in (2295, 3119, 5027, 6711)
        for rng in [random.Random(seed)]
        for i in range(30)
    ]
    log = spark.createDataFrame(rows, "run_id BIGINT, ts DOUBLE, reward DOUBLE, step BIGINT")
    log.write.parquet(f"{tmp_path}/in")
    rule = {"window": 10, "patience": 20, "delta": 0.01}
    streamed = run_available(early_stop_stream(read_stream(spark, f"{tmp_path}/in", log.schema), **rule), ["run_id"])
    got = {r["run_id"]: r["stop_step"] for r in streamed.collect()}
    assert got == {r["run_id"]: r["stop_step"] for r in monitor.stop_on_moving_average(log, **rule).collect()}


@pytest.mark.parametrize("name", ["stream_early_stop", "stream_early_stop_named", "stream_totals"])
def test_stream_queries_read_a_folder_of_files(spark, sf, tmp_path, name):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3, "user_id").write.parquet(f"{tmp_path}/events.parquet")
    got, expected = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path), sf))
    assert got == expected and got


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "run_id BIGINT, reward DOUBLE").write.parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame([], "run_id BIGINT, reward DOUBLE").schema
    totals = running_totals(read_stream(spark, f"{tmp_path}/in", schema, files="none*"), ["run_id"], ["reward"])
    assert run_available(totals, ["run_id"]).collect() == []


def test_stream_equals_batch(spark, log, tmp_path):
    # Two files, so that state crosses micro-batches.
    half = log.withColumn("late", F.col("step") >= 60)
    for i, late in enumerate((False, True)):
        half.where(F.col("late") == late).drop("late").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = read_stream(spark, f"{tmp_path}/in/*", log.schema, per_trigger=1)
    streamed = run_available(early_stop_stream(source, WINDOW, PATIENCE, DELTA), ["run_id"])
    batch = monitor.stop_on_moving_average(log, WINDOW, PATIENCE, DELTA)
    assert stops(streamed) == stops(batch)


def test_stream_of_named_runs_with_half_a_million_points_in_a_batch(spark, tmp_path):
    rows = spark.range(500_400).selectExpr(
        "CASE WHEN id < 500000 THEN 'long' WHEN id % 3 = 0 THEN NULL ELSE concat('r', id % 3) END AS run_id",
        "id AS step", "CASE WHEN id % 97 = 0 THEN NULL ELSE sqrt(id) + pmod(hash(id), 1000) / 1e4 END AS reward",
    )
    rows.repartition(3).sortWithinPartitions(F.desc("step")).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = read_stream(spark, f"{tmp_path}/in", rows.schema, per_trigger=1)
    streamed = run_available(early_stop_stream(source, 300, 5_000, 3.6), ["run_id"])
    batch = monitor.stop_on_moving_average(rows.withColumn("ts", F.col("step").cast("double")), 300, 5_000, 3.6)
    assert stops(streamed) == stops(batch)
    assert set(stops(batch)) == {"long", "r1", "r2", None} and stops(batch)["long"] is not None


def test_micro_batches_are_merged(spark, log, tmp_path):
    from pathlib import Path

    from verdigris.session import checkpoint_root

    log.repartition(11).write.parquet(f"{tmp_path}/in")
    totals = running_totals(read_stream(spark, f"{tmp_path}/in", log.schema, per_trigger=1), ["run_id"], ["reward"])
    got = run_available(totals, ["run_id"], compact_every=3)
    assert {r["run_id"]: r["n"] for r in got.collect()} == {run: len(rewards) for run, rewards in RUNS.items()}
    folders = {Path(f.removeprefix("file:")).parent for f in got.inputFiles()}
    assert len(folders) <= 3 and len(list(next(iter(folders)).parent.iterdir())) <= 3
    assert str(next(iter(folders))).startswith(checkpoint_root(spark).removeprefix("file:"))


def test_running_totals(spark, log, tmp_path):
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    totals = running_totals(read_stream(spark, f"{tmp_path}/in", log.schema, per_trigger=1), ["run_id"], ["reward"])
    for r in run_available(totals, ["run_id"]).collect():
        rewards = RUNS[r["run_id"]]
        assert r["n"] == len(rewards)
        assert r["avg_reward"] == pytest.approx(sum(rewards) / len(rewards))
