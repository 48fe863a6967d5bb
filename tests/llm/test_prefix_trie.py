"""The prefix trie against a plain dictionary of prefixes, with parts of the order as small as a few rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from verdigris.llm import prefix_trie as pt


def brute(sequences):
    """Nodes of {id: [(key, chars), ...]} by enumerating every prefix of every sequence."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, ids in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        parents = {p[:-1] for p in members if p}
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(prefix))
        out.append(
            (
                min(ids),
                len(prefix),
                min(members[prefix[:-1]]) if prefix else None,
                len(ids),
                sum(p[:-1] == prefix for p in members if p),
                sum(p not in parents for p in under),
                sum((len(members[p]) - 1) * p[-1][1] for p in under if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def digest(turn):
    return hashlib.md5(repr(turn).encode()).digest()


def nodes_of(spark, sequences, **kw):
    rows = [(c, bytearray(b"".join(map(digest, t))), [n for _, n in t]) for c, t in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, path binary, chars array<long>")
    return sorted((tuple(r) for r in pt.prefix_trie(df, **kw).collect()), key=str)


def some(seed, n, letters, longest):
    rng = random.Random(seed)
    turn = lambda: (rng.choice("abcdefgh"[:letters]), rng.randint(1, 2))
    ids = rng.sample(range(-50, 10 * n), n)
    return {c: [turn() for _ in range(rng.randint(0, longest))] for c in ids}


@pytest.mark.parametrize("seed,n,letters,longest,part_rows", [(1, 60, 1, 4, 7), (2, 80, 2, 5, 9), (3, 40, 8, 3, 3), (4, 50, 1, 12, 1000)])
def test_nodes_against_dictionary(spark, seed, n, letters, longest, part_rows):
    sequences = some(seed, n, letters, longest)
    assert nodes_of(spark, sequences, part_rows=part_rows) == brute(sequences)


def test_copies_and_one_deep_path(spark):
    deep = [("x", 3)] * 40
    sequences = {c: deep for c in range(25)} | {100 + c: deep[: c + 1] for c in range(20)} | {500: deep + [("y", 1)], 501: []}
    assert nodes_of(spark, sequences, part_rows=4) == brute(sequences)


def test_part_edges_in_one_process():
    """All cuts of a sorted list into two parts give the same closed and open sums."""
    sequences = some(9, 30, 2, 4)
    rows = sorted((b"".join(map(digest, t)), c, [n for _, n in t]) for c, t in sequences.items())
    whole = pt.part_nodes(0, np.array([r[1] for r in rows]), [r[0] for r in rows], np.array(sum((r[2] for r in rows), [])))
    assert sum(k == "open" for k in whole["kind"]) >= 1
    for cut in range(1, len(rows)):
        total = 0
        for part in (rows[:cut], rows[cut:]):
            got = pt.part_nodes(0, np.array([r[1] for r in part]), [r[0] for r in part], np.array(sum((r[2] for r in part), []), dtype=int))
            total += sum(n for n, d in zip(got["n_convs"], got["depth"]) if d == 0)
        assert total == len(rows)


def test_extents_against_scan():
    rng = np.random.default_rng(0)
    lcp = np.r_[-1, rng.integers(0, 4, 60)]
    row = rng.integers(0, 61, 200)
    depth = rng.integers(0, 5, 200)
    left, right = pt.extents(lcp, row, depth)
    for i, d, low, high in zip(row, depth, left, right):
        a = b = i
        while a > 0 and lcp[a] >= d:
            a -= 1
        while b < 60 and lcp[b + 1] >= d:
            b += 1
        assert (a, b) == (low, high)


def rebuilt(rows):
    """Sequences of (role, text) as the query rebuilds them; turns of one number by digest."""

    def key(r):
        role, text = (r[2] or "").encode(), r[3] or ""
        whole = str(len(role)).encode() + b":" + role + text.encode()
        return r[1] is not None, r[1] or 0, hashlib.sha256(whole).hexdigest()

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append(((r[2] or "", r[3] or ""), len(r[3] or "")))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_conversations_with_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "b", "Ä\U0001f600", "x" * 40000]
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice(texts)) for c in [0, 1, 2, 7, 99, 100, 105, 199, 301, 302] for _ in range(rng.randint(1, 8))]
    rows += rows[:4] + [(None, 0, "user", "nobody"), (950, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in pt.conversation_trie(df.selectExpr("*", "1 AS part", "2 AS depth", "3 AS path")).collect()), key=str)
    assert got == brute(rebuilt(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.conversation_trie(df).collect() == []
