import random

import pytest
import xxhash
from pyspark.sql import functions as F

from verdigris.llm import simhash
from verdigris.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(fps, radius=3):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        r = roots[f]
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, f"{f:016x}", least[roots[f]]) for i, f in fps), key=str)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, rows), key=str) == expected
    assert len({r["component_id"] for r in rows}) < len(rows)


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs.withColumnsRenamed({"lang": "fp", "source": "component_id"})).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.deduplicated(docs_of([])).collect() == []


@pytest.mark.parametrize("tile_rows", [4, 64, 4096])
def test_links_lose_nothing_in_crowded_blocks(spark, tile_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(60):
            fps.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) & (2**64 - 1))
    chain = base[0]
    for _ in range(30):
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        fps.add(chain)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = simhash.links(df, 3, tile_rows)
    roots = {r["node"]: r["root"] for r in components(linked).collect()}
    mask = (1 << 64) - 1
    expected = brute_components({f & mask for f in signed})
    ours, theirs = {}, {}
    for f in signed:
        ours.setdefault(roots.get(f, f), set()).add(f)
        theirs.setdefault(expected[f & mask], set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_dense_square_spans_all(spark):
    import numpy as np

    fps = np.array([1 << i for i in range(60)] * 1 + [0], dtype=np.uint64)
    rows = np.argsort(np.bitwise_count(fps), kind="stable")
    found = list(simhash.tile_links(fps, rows, rows, 3))
    assert len(found) == 60


def test_one_document_of_each_group_stays(docs_of):
    near = " ".join(f"word{i}" for i in range(400))
    docs = docs_of([(5, near), (2, near), (2, near), (9, "quite another text of some words"), (None, near), (None, "only without id here")])
    kept = simhash.deduplicated(docs.withColumnRenamed("lang", "keep_id"))
    assert kept.columns == ["doc_id", "text", "keep_id", "source", "n_chars"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == [(2, near), (9, "quite another text of some words")]
    assert kept.filter("doc_id is null").count() == 1


def test_deduplicated_with_wider_radius(docs_of):
    """Copies with a word in a hundred changed: the contract's values leave most, five-word shingles and 12 bits nearly none."""
    rng = random.Random(11)
    rows, n = [], 60
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        copy = list(words)
        for at in rng.sample(range(len(words)), len(words) // 100):
            copy[at] = "changed"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    counts = {}
    for shingle, radius in ((3, 3), (5, 12)):
        fps = {i: simhash.fingerprint(t, shingle) & (1 << 64) - 1 for i, t in rows}
        roots = brute_components(set(fps.values()), radius)
        least = {}
        for i, f in fps.items():
            least[roots[f]] = min(i, least.get(roots[f], i))
        got = {r["doc_id"] for r in simhash.deduplicated(docs_of(rows), shingle=shingle, radius=radius).collect()}
        assert got == set(least.values())
        counts[shingle] = sum(i >= 1000 for i in got)
        assert sum(i < 1000 for i in got) == n
    assert counts[3] > n / 4 and counts[5] <= n / 20


def test_repeats_of_one_id_leave_the_same_row_always(spark, docs_of):
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(4, near), (4, near), (4, near + " again"), (7, near)]
    docs = docs_of(rows).withColumn("n_chars", F.monotonically_increasing_id())
    kept = [simhash.deduplicated(docs.repartition(n)).collect() for n in (1, 3)]
    assert len(kept[0]) == 1 and kept[0][0]["doc_id"] == 4 and kept[0][0]["text"] == kept[1][0]["text"]


def test_texts_move_once(docs_of):
    plan = simhash.deduplicated(docs_of([f"text number {i}" for i in range(30)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
