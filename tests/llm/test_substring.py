import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import substring


def brute(rows):
    texts = [[w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, substring.removals(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(docs) == expected
    assert sum(r[2] for r in expected) > 0


def test_odd_rows(odd_docs):
    docs = odd_docs.withColumnsRenamed({"lang": "key", "source": "at"})
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_empty(docs_of):
    assert found(docs_of([])) == []


@pytest.mark.parametrize("flush", [50, 2000])
def test_passages_at_every_offset(docs_of, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        cut = rng.randrange(25)
        body = [word() for _ in range(rng.randrange(40))] + passage[cut : cut + rng.choice([34, 35, 36, 50])]
        rows.append((i, " ".join(body + [word() for _ in range(rng.randrange(40))])))
    rows.append((100, "again " * 80))
    rows.append((101, " ".join(passage + ["x"] + passage)))
    assert found(docs_of(rows)) == brute(rows)


def test_rolling_equals_when_windows_equal():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    for width in (18, 35):
        h = substring.rolling(words, width)
        assert len(h) == len(words) - width + 1
        by = {}
        for i, x in enumerate(h.tolist()):
            assert by.setdefault(tuple(words[i : i + width].tolist()), x) == x
        assert len(set(by.values())) == len(by)


def test_cleaned_rows_keep_columns(docs_of):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = docs_of([(1, "a  b\n" + shared), (2, shared + " tail"), (3, "left\n alone"), (4, None), (5, shared)])
    out = substring.cleaned(docs.withColumnRenamed("lang", "new"))
    assert out.columns == ["doc_id", "text", "new", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b", 2: "tail", 3: "left\n alone", 4: None, 5: ""}
