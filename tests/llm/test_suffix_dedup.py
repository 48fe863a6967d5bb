"""Removed byte strings against a dictionary of all windows; the index against plain search."""

import hashlib
import random

import numpy as np
import pytest

from verdigris.llm import suffix_dedup as sd
from verdigris.llm.run_index import NEVER, RunIndex

DIGESTS: dict[str, int] = {}  # of the texts of a test, as the operator orders rows of one id


def brute(rows, width=100):
    """Rows in the order of ids (null first) and digests; equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, DIGESTS[r[1] or ""]))
    first, result = set(), {}
    for doc_id, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            if window in first:
                gone[i : i + width] = True
            first.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        result[doc_id, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *result[r]) for r in rows), key=str)


@pytest.fixture
def check(spark, docs_of):
    from pyspark.sql import functions as F

    def run(rows, width=100, **how):
        docs = docs_of(rows)
        for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("k")).collect():
            DIGESTS[r["t"]] = r["k"]
        made = sd.without_repeats(docs, width=width, **how) if (width != 100 or how) else None
        df = made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) if made else sd.document_repeats(docs)
        got = sorted((tuple(r) for r in df.collect()), key=str)
        assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], width)
        return got

    return run


def prose(rng, n, letters="abcdefghij klm\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_odd_rows(check, odd_docs):
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_passages_copies_and_edits(check):
    rng = random.Random(1)
    passage, other = prose(rng, 700), prose(rng, 130)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 900))
        if i % 3 == 0:
            text += passage
        if i % 4 == 0:
            cut = rng.randint(0, 300)
            text = passage[cut : cut + rng.randint(90, 400)] + "Ä" + text + other
        if i % 5 == 0 and rows:
            whole = list(rng.choice(rows)[1])
            if whole:
                whole[rng.randrange(len(whole))] = "\U0001f600"
            text = "".join(whole) + text[:50]
        rows.append((1000 - i if i % 2 else i, text))
    got = check(rows + rows[:5])
    assert sum(r[2] for r in got) > 10_000


def test_periodic_texts_and_long_portions(check, monkeypatch):
    for name, value in (("PORTION_BYTES", 500), ("STRING_WINDOWS", 60), ("REGION", 700)):
        monkeypatch.setattr(sd, name, value)
    rng = random.Random(2)
    long = prose(rng, 3000)
    check([(0, "ab" * 400), (1, "xab" * 200 + long), (2, long[1000:] + "ab" * 90), (3, "y" * 1500), (4, long + "y" * 140), (5, "abc" * 70)])


def test_one_anchor_among_many_neighbours(check):
    """A phrase shorter than a window is frequent, but no window repeats; then some windows do."""
    rng = random.Random(3)
    phrase = "the same forty eight bytes stand in all documents"
    rows = [(i, prose(rng, 80) + phrase + prose(rng, 80)) for i in range(150)]
    assert sum(r[2] for r in check(rows, unit_places=20)) == 0
    rows += [(200 + i, "zz" + rows[i][1][20:190]) for i in range(40)]
    rows += [(300 + i, prose(rng, 30) + rows[7][1][40:160]) for i in range(30)]
    assert sum(r[2] for r in check(rows, unit_places=20)) > 60 * 100


def test_other_width(check):
    rng = random.Random(4)
    check([(i, prose(rng, 200, "ab")) for i in range(30)], width=24, gram=8, unit_places=200)


def test_same_id_different_texts(check):
    rng = random.Random(5)
    a = prose(rng, 400)
    check([(1, a + "x"), (1, "y" + a), (1, a + "x"), (None, a[100:]), (None, a[50:300])])


def test_empty_table_and_other_names(spark, docs_of):
    assert sd.document_repeats(docs_of([])).collect() == []
    docs = docs_of([(1, "a" * 120)]).selectExpr("doc_id AS h", "text AS id", "lang AS k", "source AS spans")
    assert [tuple(r) for r in sd.without_repeats(docs, "h", "id").collect()] == [(1, 120, 119, 1, bytearray(b"a"))]


@pytest.mark.parametrize("seed", range(12))
def test_index_against_search(seed):
    rng = random.Random(seed)
    letters = [b"ab", b"abc", b"\x00\xffz"][seed % 3]
    some = lambda n: bytes(rng.choice(letters) for _ in range(n))
    base, width = some(60), rng.choice([7, 10, 14, 20, 29])
    part = lambda: base[rng.randint(0, 30) : rng.randint(31, 60)] + some(rng.randint(0, 20))
    strings = [base, *(part() for _ in range(rng.randint(0, 7)))]
    queries = [*(part() for _ in range(5)), some(3), b"zz"]
    places = np.array([rng.randint(0, 10**6) for _ in strings])
    matched, earliest = RunIndex(strings, places, width, 100).statistics(queries)
    for q, lengths, at in zip(queries, matched, earliest):
        for i in range(len(q)):
            longest = max(k for k in range(len(q) - i + 1) if any(q[i : i + k] in s for s in strings))
            starts = [p + s.find(q[i : i + width]) for s, p in zip(strings, places) if q[i : i + width] in s]
            assert lengths[i] == longest
            assert at[i] == (min(starts) if starts and i + width <= len(q) else NEVER)


def test_runs_are_fewer_in_repetitive_text():
    rng = random.Random(0)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(2000))
    one = RunIndex([base], np.array([0]), 100, 100)
    many = RunIndex([base] * 30, np.arange(30) * 10_000, 100, 100)
    assert many.rows > 29 * one.rows and len(many.key) < 1.2 * len(one.key)


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_choose_one_anchor(seed):
    rng = random.Random(seed)
    shared = bytes(rng.choice(b"ab") for _ in range(100))
    chosen = set()
    for _ in range(6):
        before = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        data = np.frombuffer(before + shared + bytes(rng.choice(b"abc") for _ in range(70)), dtype=np.uint8)
        h, _, lo, hi = sd.anchors(data, np.array([0]), np.array([len(data)]))
        of = np.flatnonzero((lo <= len(before)) & (hi >= len(before)))
        assert len(of) == 1 and (lo[1:] == hi[:-1] + 1).all() and hi[-1] == len(data) - 100
        chosen.add(int(h[of[0]]))
    assert len(chosen) == 1


@pytest.mark.parametrize("seed", range(3))
def test_small_portions_regions_and_strings_in_one_process(monkeypatch, seed):
    """The steps between the shuffles, with cuts everywhere: long texts in portions, short stretches, short strings."""
    import pyarrow as pa

    for name, value in (("PORTION_BYTES", 300), ("REGION", 500), ("STRING_WINDOWS", 40)):
        monkeypatch.setattr(sd, name, value)
    rng = random.Random(seed)
    long = prose(rng, 2500)
    texts = [long, "xy" * 300 + long[700:1900], prose(rng, 400) + long[:350], "z" * 900, long[300:] + "z" * 200, prose(rng, 90)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["id", "k", "text"])
    places: dict = {}
    for part in sd._references([batch], 100, 32):
        for r in part.to_pylist():
            places.setdefault(r["h"], []).append(((r["id"], r["k"], r["start"]), r["n"]))
    hits: dict = {}
    for h, found in places.items():
        if sum(n for _, n in found) > 1:
            (doc, k, start), _ = min(found)
            for (i, _, _), _ in found:
                hits.setdefault(i, {})[h] = (doc * 1000 + start // sd.REGION, start if i == doc else -1)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("h", "src", "salts", "start")]))
    rows = sorted(hits)
    listed = pa.array([[{"h": h, "src": s, "salts": 1, "start": p} for h, (s, p) in hits[i].items()] for i in rows], kind)
    some = pa.array(rows, pa.int64())
    met = pa.RecordBatch.from_arrays([some, some, pa.array([texts[i] for i in rows]), listed], names=["id", "k", "text", "hits"])
    pieces = pa.Table.from_batches(list(sd._pieces([met], 100, 32)))
    assert len(pieces) > 30 and max(len(p) for p in pieces["piece"].to_pylist()) < 40 + 69 + 100
    spans: dict = {}
    for unit in set(pieces["src"].to_pylist()):
        own = pieces.filter(pa.compute.equal(pieces["src"], unit)).combine_chunks()
        for r in sd.marked(own).to_pylist():
            assert r["w1"] is None
            spans.setdefault(r["id"], []).append(r)
    seen = set()
    for i, text in enumerate(texts):
        data, gone = text.encode(), np.zeros(len(text), dtype=bool)
        for p in range(len(data) - 99):
            gone[p : p + 100] |= data[p : p + 100] in seen
            seen.add(data[p : p + 100])
        kept = b"".join(data[a:b] for a, b in sd.kept_stretches(len(data), spans.get(i, [])))
        assert kept == bytes(b for b, g in zip(data, gone) if not g)
