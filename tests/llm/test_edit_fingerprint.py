import hashlib
import random

import numpy as np
import pytest

from verdigris.llm import edit_fingerprint as ef


def plain_walk(text):
    """The walk of one text, one step after the other."""
    chars = ef._mixed(np.array([ord(c) for c in text], dtype=np.uint32), ef.SEED + 1).tolist()
    sampled = set()
    for block in range(12):
        sampled |= set(ef._sampled_steps(block).tolist())
    at = step = 0
    bits, written = [], []
    while at < len(chars):
        key = int(ef._mixed(np.array([step]), ef.SEED)[0])
        mixed = ((chars[at] ^ key) * 0x9E3779B1) & 0xFFFFFFFF
        written.append(text[at])
        if step in sampled:
            bits.append(mixed >> 30 & 1)
        at += mixed >> 31
        step += 1
    return f"{step:x}-{np.packbits(np.array(bits, dtype=np.uint8)).tobytes().hex()}", written


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *ef.fingerprints([text, edited, following]), text == following))
    return sorted(out, key=str)


def found(docs):
    rows = ef.document_fingerprints(docs).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in rows), key=str)


def same(ours, expected):
    assert [r[:5] for r in ours] == [r[:5] for r in expected]
    for r, e in zip(ours, expected):
        assert r[5] == pytest.approx(ef.likeness(e[3], e[5]))


@pytest.mark.parametrize("rows_per_part", [4000, 13])
def test_documents_against_brute_force(spark, sf, monkeypatch, rows_per_part):
    monkeypatch.setattr(ef.with_next, "__defaults__", (rows_per_part,))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(found(docs), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_odd_rows(odd_docs, monkeypatch):
    monkeypatch.setattr(ef.with_next, "__defaults__", (3,))
    docs = odd_docs.withColumnsRenamed({"lang": "part", "source": "ahead"})
    ours = found(docs)
    expected = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert [r[:3] for r in ours] == [r[:3] for r in expected]


def test_one_row_and_no_row(docs_of):
    assert [r[1] for r in found(docs_of([(7, "abcd")]))] == [4]
    assert found(docs_of([])) == []


def test_batch_walk_equals_plain_walk():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcde é\U0001f600") for _ in range(rng.choice([0, 1, 5, 63, 64, 200, 3000]))) for _ in range(60)]
    assert ef.fingerprints(texts) == [plain_walk(t)[0] for t in texts]
    assert ef.fingerprints(texts[:3]) == [plain_walk(t)[0] for t in texts[:3]]


def test_likeness_estimates_equal_steps():
    rng = random.Random(1)
    error = []
    for _ in range(60):
        a = "".join(rng.choice("etaoin shrdlu") for _ in range(2000))
        b = list(a)
        for _ in range(rng.choice([0, 2, 20, 200])):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b)
        (pa, wa), (pb, wb) = plain_walk(a), plain_walk(b)
        equal = sum(x == y for x, y in zip(wa, wb)) / max(len(wa), len(wb))
        error.append(ef.likeness(pa, pb) - equal)
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.12


def test_near_edited_beats_near_next(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 500")
    rows = ef.document_fingerprints(docs).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.9
    assert np.mean([r["near_edited"] for r in rows]) > 0.4


def test_near_pairs(docs_of):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
    a = text()
    docs = docs_of([(1, a), (2, a), (3, a[:1400] + "changed" + a[1400:]), (4, text()), (5, None), (6, "")])
    pairs = {(r["a"], r["b"]) for r in ef.near_pairs(docs).collect()}
    assert pairs == {(1, 3)}


def near_copies(n, seed):
    """Texts that share an opening (hot first bands), each with a copy that has changes all over the rest."""
    rng = random.Random(seed)
    piece = lambda size: "".join(rng.choice("etaoin shrdlu") for _ in range(size))
    opening, texts = piece(200), []
    for _ in range(n):
        text = opening + piece(130)
        copy = list(text)
        for at in range(205, len(text), 14):
            copy[at] = rng.choice("xyz")
        texts += [text, "".join(copy)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n, tile_rows", [(40, 4096), (200, 4096), (200, 50)])
def test_near_pairs_against_brute_force(docs_of, n, tile_rows):
    """All pairs of brute force are found at any size, also where unrelated texts crowd the band they share."""
    texts = near_copies(n, n)
    prints = ef.fingerprints(texts)
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    classes = sorted((i, p) for p, i in first.items())
    expected = {
        (i, j): like
        for k, (i, p) in enumerate(classes)
        for j, q in classes[k + 1 :]
        if (like := ef.likeness(p, q)) >= 0.8
    }
    assert len(expected) >= n / 2
    rows = ef.near_pairs(docs_of(texts), tile_rows=tile_rows).collect()
    assert {(r["a"], r["b"]): r["likeness"] for r in rows} == expected and len(rows) == len(expected)


def test_alike_equals_likeness():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 65, 130, 700]))) for _ in range(80)]
    prints = sorted(set(ef.fingerprints(texts)))
    rows = np.arange(len(prints))
    for least in (0.2, 0.5, 0.8):
        expected = {(i, j) for i in rows for j in rows[i + 1 :] if ef.likeness(prints[i], prints[j]) >= least}
        assert {tuple(sorted(p)) for p in ef.alike(prints, rows, rows, least)} == expected
        mixed = {(i, j) for i, j in expected if (i % 3 == 0) != (j % 3 == 0)}
        assert {tuple(sorted(p)) for p in ef.alike(prints, rows[rows % 3 == 0], rows[rows % 3 > 0], least)} == mixed
