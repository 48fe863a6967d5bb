import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import quality_classifier as qc


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter("doc_id % 2 = 0")
    judged = qc.document_quality(docs, known).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [not r["kept"] for r in judged if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.7
    assert qc.document_quality(docs, known).count() == docs.count()


def brute_sites(rows):
    """Posterior means with each row left out, by plain loops; rows are (host, path, p)."""
    n, total = len(rows), sum(p for *_, p in rows)
    mu = total / n

    def strength(group_of, parent_of):
        groups, parents = {}, {}
        for r in rows:
            groups.setdefault(group_of(r), []).append(r[2])
            parents.setdefault(parent_of(r), []).append(r[2])
        parent_mean = {k: np.mean(v) for k, v in parents.items()}
        of = {group_of(r): parent_of(r) for r in rows}
        within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in groups.values())
        between = sum(len(v) * (np.mean(v) - parent_mean[of[k]]) ** 2 for k, v in groups.items())
        return qc._strength(within, between, len(groups), n, sum(len(v) ** 2 for v in groups.values()))

    kh = strength(lambda r: r[0], lambda r: None)
    kp = strength(lambda r: (r[0], r[1]), lambda r: r[0])
    out = []
    for host, path, p in rows:
        in_host = [x for h, _, x in rows if h == host]
        in_path = [x for h, q, x in rows if (h, q) == (host, path)]
        m_host = (kh * mu + sum(in_host) - p) / (kh + len(in_host) - 1)
        out.append((m_host, (kp * m_host + sum(in_path) - p) / (kp + len(in_path) - 1)))
    return out


def test_site_posteriors_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = []
    for host in range(12):
        base = rng.beta(6, 3)
        for path in range(3):
            for _ in range(rng.integers(1, 40)):
                rows.append((f"h{host}" if host else None, f"p{path}" if path else None, float(np.clip(rng.normal(base, 0.2), 0.01, 0.99))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id INT, host STRING, path STRING, p DOUBLE")
    df = df.withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    got = {r["id"]: r for r in qc.with_posteriors(df, 0.5).collect()}
    assert len(got) == len(rows)
    for i, (m_host, m_path) in enumerate(brute_sites(rows)):
        assert got[i]["host_posterior"] == pytest.approx(m_host, abs=1e-6)
        assert got[i]["path_posterior"] == pytest.approx(m_path, abs=1e-6)
        odds = rows[i][2] / (1 - rows[i][2]) * m_path / (1 - m_path)
        assert got[i]["score"] == pytest.approx(odds / (1 + odds), abs=1e-6)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 0.9)] * 200 + [("low", "a", 0.2)] * 200 + [("tiny", "a", 0.05), ("tiny", "a", 0.05)]
    rows = [(h, s, p + 0.05 * (i % 3 - 1)) for i, (h, s, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "host STRING, path STRING, p DOUBLE").withColumn("z", F.lit(0.0))
    got = {r["host"]: r["host_posterior"] for r in qc.with_posteriors(df, 0.5).collect()}
    assert got["big"] > 0.85 and got["low"] < 0.25 and 0.0 < got["tiny"]


def test_odd_rows(odd_docs, spark):
    labels = spark.createDataFrame([(3, 0), (8, 1), (None, 1), (5, None), (3, 0)], "doc_id LONG, quality INT")
    docs = odd_docs.withColumnsRenamed({"n_chars": "score"})
    rows = qc.document_quality(docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] is not None and 0 <= r["score"] <= 1 for r in rows)
    kept = qc.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_without_labels_all_stay(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert qc.accepted(odd_docs, none).count() == odd_docs.count()


def test_empty(docs_of, spark):
    labels = spark.createDataFrame([(3, 0), (8, 1)], "doc_id LONG, quality INT")
    assert qc.document_quality(docs_of([]), labels).collect() == []
    assert qc.accepted(docs_of([]), labels).collect() == []


def test_fit_finds_a_separating_measure():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(qc._MEASURES)))
    y = (x[:, 3] < 0).astype(float)
    model = qc.fit(x, y)
    z = model.intercept + x @ np.array(model.weights)
    assert ((z > 0) == (y > 0)).mean() > 0.97 and model.weights[3] < 0
