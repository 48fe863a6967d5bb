"""Positions, slices, splits and blocks, with one group holding a third of all rows."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else 1 + i % 40, i, rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g BIGINT, ord BIGINT, x DOUBLE").repartition(7)


def test_positions(skewed):
    rows = sorted(ordered.with_positions(skewed, ["ord"]).collect(), key=lambda r: r["ord"])
    assert [r["pos"] for r in rows] == list(range(3000))


def test_positions_per_group(skewed):
    rows = ordered.with_positions(skewed, ["ord"], ["g"]).collect()
    assert len(rows) == 3000
    groups = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        groups.setdefault(r["g"], []).append(r["pos"])
    assert all(places == list(range(len(places))) for places in groups.values())
    assert len(groups[0]) == 1000


@pytest.mark.parametrize("take_rows", [3, 40, 10_000])
def test_first_and_skip(skewed, monkeypatch, take_rows):
    monkeypatch.setattr(ordered, "TAKE_ROWS", take_rows)
    assert [r["ord"] for r in ordered.first_rows(skewed, 5, ["ord"]).orderBy("ord").collect()] == [0, 1, 2, 3, 4]
    rest = ordered.skip_rows(skewed, 2995, "ord")
    assert sorted(r["ord"] for r in rest.collect()) == [2995, 2996, 2997, 2998, 2999]
    assert ordered.first_rows(skewed, 4000, ["ord"]).count() == 3000
    by_two = ordered.first_rows(skewed, 1003, ["g", "ord"]).orderBy("g", "ord").collect()
    assert [r["g"] for r in by_two] == [0] * 1000 + [1] * 3
    assert ordered.skip_rows(skewed, 0, "ord").count() == 3000
    assert ordered.skip_rows(skewed, 5000, "ord").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.001, 0.1, 0.998, 1.0])
def test_exact_split(skewed, share):
    marked = ordered.mark_test_rows(skewed, "ord", share).where("is_test").collect()
    by_hash = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {r["ord"] for r in marked} == set(by_hash[: math.ceil(3000 * share)])


def test_split_is_seeded(skewed):
    pick = lambda seed: {r["ord"] for r in ordered.mark_test_rows(skewed, "ord", 0.1, seed).where("is_test").collect()}
    assert pick(1) == pick(1) != pick(2)


def test_threshold_split(skewed):
    n = ordered.mark_test_rows_by_threshold(skewed, "ord", 0.2).where("is_test").count()
    assert 480 < n < 720


def test_batches(skewed):
    batches = ordered.collate(ordered.with_batches(skewed, 64, ["ord"]), ["ord"]).orderBy("batch_id").collect()
    assert [len(b["ord"]) for b in batches] == [64] * 46 + [56]
    assert [i for b in batches for i in b["ord"]] == list(range(3000))


@pytest.mark.parametrize("include", [True, False])
def test_running_max(skewed, include):
    placed = ordered.with_positions(skewed, ["ord"], ["g"])
    got = ordered.with_running_max(placed, ["g"], "x", "m", include, block=50).collect()
    best = {}
    for r in sorted(got, key=lambda r: (r["g"], r["pos"])):
        before = best.get(r["g"])
        after = r["x"] if before is None else max(before, r["x"])
        assert r["m"] == (after if include else before)
        best[r["g"]] = after


@pytest.mark.parametrize("small", [0, 10_000])
def test_group_stats_keep_every_row(skewed, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL_ROWS", small)
    monkeypatch.setattr(ordered, "HOT_KEYS", 3)
    stats = skewed.groupBy("g").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))
    joined = ordered.join_group_stats(skewed, stats, ["g"], "n").collect()
    assert sorted(r["ord"] for r in joined) == list(range(3000))
    want = {r["g"]: r["total"] for r in stats.collect()}
    assert all(r["total"] == pytest.approx(want[r["g"]]) for r in joined)


def test_missing_keys_are_a_group(skewed, monkeypatch):
    some = skewed.withColumn("g", F.when(F.col("g") % 2 == 1, F.col("g")))
    places = sorted(r["pos"] for r in ordered.with_positions(some, ["ord"], ["g"]).where("g IS NULL").collect())
    assert places == list(range(len(places))) and len(places) > 1000
    stats = some.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for small in (0, 10_000):
        monkeypatch.setattr(ordered, "SMALL_ROWS", small)
        monkeypatch.setattr(ordered, "HOT_KEYS", 3)
        joined = ordered.join_group_stats(some, stats, ["g"], "n")
        assert joined.columns == [*some.columns, "n"] and joined.count() == 3000


def test_broadcast_only_when_small(skewed):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(ordered.broadcast_if_small(skewed, 3000))
    assert not hinted(ordered.broadcast_if_small(skewed, 2999))


@pytest.mark.parametrize("take_rows", [3, 60, 10_000])
def test_slices_with_ties_and_missing_keys(spark, monkeypatch, take_rows):
    monkeypatch.setattr(ordered, "TAKE_ROWS", take_rows)
    rows = [(None if i % 5 == 0 else i % 4, i // 3, "x") for i in range(200)] + [(2, 7, "x")] * 30
    df = spark.createDataFrame(rows, "k INT, v INT, c STRING").repartition(5)
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for n in (0, 41, 150, 229, 500):
        first = ordered.first_rows(df, n, ["k"]).collect()
        rest = ordered.skip_rows(df, n, "k").collect()
        assert sorted(map(str, map(tuple, first))) == sorted(map(str, in_order[:n]))
        assert sorted(map(str, map(tuple, rest))) == sorted(map(str, in_order[n:]))


@pytest.mark.parametrize("take_rows", [30, 10_000])
def test_split_with_ties_and_missing_keys(spark, monkeypatch, take_rows):
    monkeypatch.setattr(ordered, "TAKE_ROWS", take_rows)
    rows = [(None if i % 4 == 0 else i % 6, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k INT, v INT").repartition(3)
    for share in (0.1, 0.9):
        marked = ordered.mark_test_rows(df, "k", share).collect()
        assert len(marked) == 100 and sum(r["is_test"] for r in marked) == math.ceil(100 * share)
        assert sorted(r["v"] for r in marked) == list(range(100))


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_positions_in_many_parts(skewed, many_parts):
    rows = sorted(ordered.with_positions(skewed, ["ord"]).collect(), key=lambda r: r["ord"])
    assert [r["pos"] for r in rows] == list(range(3000))
    groups = {}
    for r in ordered.with_positions(skewed, ["ord"], ["g"], once=False).collect():
        groups.setdefault(r["g"], []).append((r["ord"], r["pos"]))
    assert all([p for _, p in sorted(places)] == list(range(len(places))) for places in groups.values())


def test_index_in_many_parts(skewed, many_parts):
    index = ordered.order_index(skewed, ["g"])
    assert len(index.parts) > 10 and sum(n for _, n in index.parts) == 3000
    keys = sorted(r["g"] for r in skewed.collect())
    for n in (1, 999, 1000, 1001, 1050, 2999, 3000):
        edge, wanted = index.cut(n)
        assert edge["g"] == keys[n - 1]
        assert wanted == (0 if n == 3000 or keys[n] != edge["g"] else n - keys.index(edge["g"]))
    assert index.cut(3001) == (None, 0)


def test_the_input_is_evaluated_once(spark, skewed):
    """A counting input: each evaluation of a row adds one."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        seen.add(1)
        return x

    df = skewed.withColumn("ord", counted.asNondeterministic()("ord"))
    assert ordered.with_positions(df, ["ord"]).count() == 3000
    assert seen.value == 3000


def test_few_jobs(spark, skewed, many_parts):
    """Jobs without run-time plans: keys are sampled, stored, counted and looked up; a split counts and sorts."""

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, name)
        work()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    index = ordered.order_index(skewed, ["ord"])
    assert jobs("index", lambda: ordered.order_index(skewed, ["ord"])) <= 3
    assert jobs("slice", lambda: ordered.first_rows(skewed, 1700, ["ord"], index)) <= 1
    assert jobs("take", lambda: ordered.first_rows(skewed, 300, ["ord"])) <= 1
    assert jobs("split", lambda: ordered.mark_test_rows(skewed, "ord", 0.1)) <= 2


def test_split_counts_again_in_a_crowded_sliver(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "TAKE_ROWS", 1)
    monkeypatch.setattr(ordered, "SPLIT_DIGITS", 1)
    marked = {r["ord"] for r in ordered.mark_test_rows(skewed, "ord", 0.37).where("is_test").collect()}
    by_hash = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert marked == set(by_hash[: math.ceil(3000 * 0.37)])


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 20, "t STRING")
    assert ordered.is_small(wide, 100) and not ordered.is_small(wide, 100, 5000)


def test_groups_without_a_hot_one_are_joined_in_one_pass(spark, monkeypatch):
    """Rows are evaluated a second time only to keep groups of at least ``HOT_ROWS`` where they are."""
    monkeypatch.setattr(ordered, "SMALL_ROWS", 2)
    df = spark.range(300).selectExpr("id", "if(id < 40, 0, id) AS g")
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for hot_rows, passes in ((41, 1), (40, 2)):
        monkeypatch.setattr(ordered, "HOT_ROWS", hot_rows)
        joined = ordered.join_group_stats(df, stats, ["g"], "n")
        assert joined._jdf.queryExecution().optimizedPlan().toString().count("Range (") == passes
        assert sorted((r["id"], r["n"]) for r in joined.collect()) == [(i, 40 if i < 40 else 1) for i in range(300)]
