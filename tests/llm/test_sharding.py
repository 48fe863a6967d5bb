import zlib

import numpy as np
import pytest

from verdigris.llm import sharding


def test_matrix_has_exact_margins():
    rows = [5, 0, 17, 1, 100]
    matrix = sharding.communication_matrix(rows, 6, seed=1)
    assert matrix.sum(axis=1).tolist() == rows
    assert sorted(matrix.sum(axis=0).tolist()) == [20, 20, 20, 21, 21, 21]
    assert (matrix >= 0).all()


def test_matrix_is_hypergeometric():
    draws = [sharding.communication_matrix([30, 70], 2, seed=s)[0, 0] for s in range(3000)]
    assert np.mean(draws) == pytest.approx(15, abs=0.2)
    assert np.var(draws) == pytest.approx(30 * 0.5 * 0.5 * 70 / 99, rel=0.1)


def test_large_population_follows_the_same_law(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(sharding, "_NUMPY_POPULATION", 1)
    draws = [sharding._hypergeometric(rng, 40, 60, 20) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(8, abs=0.15)
    assert np.var(draws) == pytest.approx(20 * 0.4 * 0.6 * 80 / 99, rel=0.1)


def _check(rows, texts, shards):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len(b) + 8, zlib.crc32(b)) for i, b in texts
    )
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1


def test_documents_against_the_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.document_shards(docs).collect()
    _check(rows, [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], 24)
    again = sharding.document_shards(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_odd_rows(odd_docs):
    rows = sharding.document_shards(odd_docs.withColumnsRenamed({"lang": "shard", "source": "slot"}), 5).collect()
    keyed = [r.asDict() | {"doc_id": -1 if r["doc_id"] is None else r["doc_id"]} for r in rows]
    texts = [(-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    _check(keyed, texts, 5)


def test_equal_rows_spread(docs_of):
    """1,000 equal rows among 4,000: as many in each shard as chance gives, and no long runs of slots."""
    docs = docs_of([(7, "the same")] * 1000 + [(i, f"text {i}") for i in range(100, 3100)])
    rows = sharding.document_shards(docs).collect()
    _check(rows, [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], 24)
    places = {}
    for r in sorted(rows, key=lambda r: r["slot"]):
        places.setdefault(r["shard"], []).append(r["doc_id"] == 7)
    for equal in places.values():
        assert 18 <= sum(equal) <= 70  # 41.7 expected, four deviations
        runs = "".join("x" if e else " " for e in equal).split()
        assert max(map(len, runs)) <= 10 and len(runs) >= 12


def test_empty(docs_of):
    assert sharding.document_shards(docs_of([])).collect() == []
