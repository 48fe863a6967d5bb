"""The pipeline against its operators' plain versions, stage by stage."""

import numpy as np
import public_tokenizers
import pytest
from test_simhash import brute as brute_components
from test_substring import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from verdigris.llm import quality_classifier as qc
from verdigris.llm import quality_rules as qr


@pytest.fixture(scope="module")
def stages(spark, sf):
    from verdigris.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "test-stage"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "SimHash near-dedup", "substring dedup", "best-fit packing",
    ]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_classifier_and_rules(spark, sf, stages):
    judged = qc.document_quality(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(texts(stages[1])) == {r["doc_id"] for r in judged.filter("kept").collect()}
    ruled = qr.quality_verdicts(stages[1])
    assert set(texts(stages[2])) == {r["doc_id"] for r in ruled.filter("kept").collect()}
    assert 0 < len(texts(stages[2])) < len(texts(stages[0]))
    assert all(texts(stages[0])[i] == t for i, t in texts(stages[2]).items())


def test_one_of_each_component(stages):
    expected = {c for *_, c in brute_components(list(texts(stages[2]).items()))}
    assert set(texts(stages[3])) == expected and stages[3].count() == len(expected)


def test_passages_are_cut(stages):
    import hashlib

    before, after = texts(stages[3]), texts(stages[4])
    for doc_id, n, removed, digest in brute_repeats(list(before.items())):
        if removed:
            assert hashlib.sha256(after[doc_id].encode()).hexdigest() == digest
        else:
            assert after[doc_id] == before[doc_id]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_all_tokens_are_packed(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    wanted = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages[4]).items()}
    got = {}
    rows = stages[5].collect()
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == wanted
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * np.ceil(sum(wanted.values()) / 1024) + 1


def test_run_gives_the_last_stage(spark, sf, stages):
    count = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert count(corpus_pipeline.run(spark, sf)) == count(stages[-1])


def test_steps_are_deleted_when_the_next_stage_starts(spark, sf):
    from pathlib import Path

    from verdigris.llm.common import stored
    from verdigris.session import checkpoint_root

    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    label = lambda: {p.name.rpartition("-")[0] for p in set(root.iterdir()) - before}
    docs = stored(spark.read.parquet(f"{sf}/documents.parquet").limit(40), "given")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)  # reads what the first stage stored
    assert "document-evidence" in label() and second.count() <= 40
    corpus_pipeline.STAGES[3][1](spark, stored(second, "kept"), sf)
    assert not {"document-evidence", "rule-counts"} & label()


def test_clashing_columns(spark, sf, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([f"some words of document {i % 7} " * 30 for i in range(20)])
    names = ["_id", "_fp", "fp", "key", "row", "keep_id", "keep_key", "n", "at", "new", "lang_", "p", "z", "host", "words", "text_"]
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[c] == i for r in out.collect() for i, c in enumerate(names))


def test_empty_documents(spark, sf, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_odd_documents(spark, sf, odd_docs):
    docs = odd_docs.withColumn("row", odd_docs["lang"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*odd_docs.columns, "row"]
    docs.collect()
    for _, stage in corpus_pipeline.STAGES[2:]:
        odd_docs = stage(spark, odd_docs, sf)
    assert odd_docs.count() > 0
