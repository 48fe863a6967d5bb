"""Fill-in-the-middle rows against a loop over units."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from verdigris.llm import fill_in_middle as fim


def plain_loop(doc_id, text, seed=7, rate=100, spm_rate=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


LINES = [
    "\n", "\n\n\n", "a\n", "a\nb", "\na", "a\r\nb\x0b\x0c c d\n\n e", "x<P>y\nz", "a\n<M>", "<S>", "<<P\n>S>\n<M",
    "Ä\nß é\n\U0001f600 x\n" * 50, "long " * 3000 + "\n", "".join(f"line {i}\n" for i in range(3000)),
]


def rows_of(df):
    out = df.withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is not None, r[0], r[-1]))


def expected(rows, **kw):
    return sorted(((*plain_loop(i, t, **kw), t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0], r[-1]))


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(fim.fill_in_middle(odd_docs)) == expected(rows)


@pytest.mark.parametrize("kw", [{}, {"rate": 40, "spm_rate": 10, "seed": 3}, {"spm_rate": 100}])
def test_lines_and_marks(docs_of, kw):
    rows = [(i, LINES[i % len(LINES)]) for i in range(200)]
    got = rows_of(fim.fill_in_middle(docs_of(rows), **kw))
    assert got == expected(rows, **kw)
    assert {r[2] for r in got} == ({"plain", "spm", "psm"} if kw.get("spm_rate") != 100 else {"plain", "spm"})


def test_other_marks_and_portions(docs_of, monkeypatch):
    monkeypatch.setattr(fim, "PORTION_BYTES", 40)
    marks = fim.Marks("[p.", "|s|", "m*")
    rows = [(i, t) for i, t in enumerate(LINES)]
    made = fim.fill_in_middle(docs_of(rows), marks=marks)
    got = sorted(map(tuple, made.withColumn("t", fim.restored(F.col("output"), F.col("form"), marks)).collect()))
    assert got == sorted((*plain_loop(i, t, marks=marks), t) for i, t in rows)


def test_portions_cut_between_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "PORTION_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abcd"] * 7 + [None, "x" * 50, ""]})
    parts = [p["text"].to_pylist() for p in fim._portions(batch)]
    assert sum(parts, []) == batch["text"].to_pylist() and len(parts) > 2


def test_clashing_names_and_empty_table(docs_of):
    docs = docs_of([(1, "a\nb\nc")]).selectExpr("doc_id AS id", "text AS h0", "lang AS output", "source AS form", "n_chars AS n")
    assert [tuple(r) for r in fim.fill_in_middle(docs, "id", "h0").collect()] == [plain_loop(1, "a\nb\nc")]
    assert fim.document_forms(docs_of([])).collect() == []


def test_digests(docs_of):
    row = fim.document_forms(docs_of([(5, "a\nb\n")])).first()
    assert row["output_sha256"] == hashlib.sha256(plain_loop(5, "a\nb\n")[-1].encode()).hexdigest()
    assert row["restored_sha256"] == hashlib.sha256(b"a\nb\n").hexdigest()
