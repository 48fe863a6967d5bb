"""The trie of shared conversation prefixes, from sorted sequences and their longest common prefixes.

Each conversation is a path: a 16-byte digest for every turn. Paths are sorted by range, so a part holds neighbours of the
order. Inside a part the conversations that share a prefix are an interval of rows, and the whole trie
lies in the array of longest common prefixes (LCP) of neighbouring rows: a sparse table answers range minima, and
every candidate prefix (each row's whole path, and each LCP) finds its left and right extent by its own binary search on the
table. No stack is kept and no candidate waits for another. Prefixes between two candidates have the members
of the deeper one. Nodes lie in preorder, so sums over a subtree are differences of running sums.

A prefix that reaches the first or last row of a part may go on in the next part. Those nodes, two chains of
prefixes a part, are merged by a digest of the prefix. What a part sums up below such a node without other open nodes just
adds up over parts; the open nodes below it are found from the part edge at which a node starts and the one it reaches, by
running sums over edges.

The SHA-256 of member ids is sequential: ids travel as one text per part, and one task streams the texts of a
node in order. A path must fit into one row (16 bytes a turn); texts do not move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import drop_stored, stored

PART_ROWS, PART_BYTES = 50_000, 16_000_000
#: Parts of the order at most; the tables of part edges are broadcast and have two rows a part.
MOST_PARTS = 16_384
HEAD_TURNS, HEAD_EVERY = 5, 100
_WIDTH = 16
_NO_IDS = hashlib.sha256(b"").hexdigest()

_PART = (
    "kind string, part int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, from_edge int, to_edge int, ends string"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``: digests and code points of a conversation's turns in order (null turn numbers first).

    Turns of one number are ordered by their digests, a defined order that needs no text. Rows without a
    conversation id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.substring(F.sha2(framed, 256), 1, 2 * _WIDTH).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def paths(turns: Column) -> list[Column]:
    """``path`` and ``chars`` of an array of turns."""
    path = F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))
    return [path.alias("path"), F.transform(turns, lambda t: t["chars"]).alias("chars")]


def with_shared_heads(own: DataFrame) -> DataFrame:
    """Paths of conversations whose first turns are taken from the first conversation of their hundred.

    Conversation c takes ``crc32(c) % 6`` turns; a head that is missing or short gives what it has.
    """
    hundred = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(HEAD_EVERY))
    heads = own.filter(F.pmod("conv_id", F.lit(HEAD_EVERY)) == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEAD_TURNS).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD_TURNS + 1)).cast("int")
    joined = own.withColumn("head_id", hundred).join(heads, "head_id", "left").withColumn("h", h)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, rest).alias("turns")).select("conv_id", *paths(F.col("turns")))


def _sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """``out[k][i]`` is the least of ``values[i : i + 2**k]``."""
    out, width = [values], 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def _common(paths_: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it, in turns; -1 for the first."""
    lcp = np.zeros(len(depth), dtype=np.int64)
    rows = np.arange(1, len(depth))
    for t in range(int(depth.max(initial=0))):
        rows = rows[(depth[rows] > t) & (depth[rows - 1] > t)]
        rows = rows[(paths_[start[rows] + t] == paths_[start[rows - 1] + t]).all(axis=1)]
        if not len(rows):
            break
        lcp[rows] += 1
    lcp[0] = -1
    return lcp


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row around ``row`` that share its first ``depth`` turns: two binary searches on range minima."""
    table, last = _sparse_minima(lcp), len(lcp) - 1
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        span = 1 << k
        go = np.flatnonzero(right + span <= last)
        go = go[table[k][right[go] + 1] >= depth[go]]
        right[go] += span
        go = np.flatnonzero(left >= span)
        go = go[table[k][left[go] - span + 1] >= depth[go]]
        left[go] -= span
    return left, right


def _chain(path: bytes, depth: int) -> list[bytes]:
    """Digests of all prefixes of a path, the empty one first."""
    digest, out = hashlib.sha256(), [hashlib.sha256().digest()[:_WIDTH]]
    for t in range(depth):
        digest.update(path[_WIDTH * t : _WIDTH * (t + 1)])
        out.append(digest.copy().digest()[:_WIDTH])
    return out


def _offsets(array: pa.Array) -> np.ndarray:
    lengths = array.value_lengths() if pa.types.is_list(array.type) else pa.compute.binary_length(array)
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]).astype(np.int64)


def part_nodes(part: int, conv: np.ndarray, path: list[bytes], chars: np.ndarray) -> dict[str, list]:
    """Nodes of one part of the order (rows sorted by path, then id), as columns of ``_PART``."""
    depth = np.array([len(p) // _WIDTH for p in path], dtype=np.int64)
    start = np.cumsum(depth) - depth
    m = len(depth)
    lcp = _common(np.frombuffer(b"".join(path), dtype="<u8").reshape(-1, 2), start, depth)

    # candidates, their intervals, and the prefixes between them
    rows = np.arange(m)
    left, right = extents(lcp, np.r_[rows, rows[1:]], np.r_[depth, lcp[1:]])
    top = left[m:]  # of the prefix that rows 1, 2, ... share with the row before
    code = left * (depth.max() + 1) + np.r_[depth, lcp[1:]]
    code, first = np.unique(code, return_index=True)
    c_row, c_depth, c_last = left[first], code % (depth.max() + 1), right[first]
    above = lcp[c_row].copy()
    same = np.flatnonzero(c_row[1:] == c_row[:-1]) + 1
    above[same] = c_depth[same - 1]
    times = c_depth - above
    row, last = np.repeat(c_row, times), np.repeat(c_last, times)
    at = np.concatenate([[0], np.cumsum(depth - lcp)])  # where a row's new nodes start
    d = np.arange(len(row)) - at[row] + lcp[row] + 1

    n = last - row + 1
    length = np.zeros(len(row), dtype=np.int64)
    length[d > 0] = chars[(start[row] + d - 1)[d > 0]]
    parent = np.arange(len(row)) - 1
    heads = at[1:m][depth[1:] > lcp[1:]]  # first new node of each later row that has any
    grown = row[heads]
    parent[heads] = at[top[grown - 1]] + lcp[grown] - lcp[top[grown - 1]] - 1
    branch = np.sort(lcp[1:][depth[1:] > lcp[1:]] * m + rows[1:][depth[1:] > lcp[1:]])
    children = (depth[row] > d) + np.searchsorted(branch, d * m + last, "right") - np.searchsorted(branch, d * m + row, "right")
    table = _sparse_minima(conv)
    level = np.frexp(n.astype(np.float64))[1] - 1
    least = np.empty(len(row), dtype=np.int64)
    for k in np.unique(level):
        of = level == k
        least[of] = np.minimum(table[k][row[of]], table[k][last[of] - (1 << k) + 1])

    opened = (row == 0) | (last == m - 1)
    below = np.minimum(at[last + 1], len(row))  # end of the subtree in preorder
    run = lambda x: np.concatenate([[0], np.cumsum(np.where(opened, 0, x))])
    sums = lambda x: (s := run(x))[below] - s[np.arange(len(row))]
    leaves, saved = sums(children == 0), sums((n - 1) * length)
    np.subtract.at(children, parent[opened & (d > 0)], 1)  # open children are counted when all parts are known

    keys = np.full(len(row), None, dtype=object)
    for side, on in ((m - 1, last == m - 1), (0, row == 0)):
        chain = _chain(path[side], int(depth[side]))
        keys[on] = [chain[x] for x in d[on]]

    copies = np.r_[False, (lcp[1:] == depth[1:]) & (lcp[1:] == depth[:-1])]
    ends_at = np.r_[np.flatnonzero(~copies)[1:], m]
    end_of = dict(zip(np.flatnonzero(~copies).tolist(), ends_at.tolist()))
    ids = conv.astype(str).astype(object)
    ends = np.full(len(row), _NO_IDS, dtype=object)
    texts = []
    for i in np.flatnonzero(depth[row] == d).tolist():
        text = ",".join(ids[row[i] : end_of[int(row[i])]])
        if opened[i]:
            texts.append((keys[i], text))
            ends[i] = None
        else:
            ends[i] = hashlib.sha256(text.encode()).hexdigest()

    has = d > 0
    parent_key = np.full(len(row), None, dtype=object)
    parent_key[has] = keys[parent[has]]  # none if the parent is closed
    known = has & ~opened & ~opened[parent]
    parent_conv = [int(least[p]) if k else None for p, k in zip(parent.tolist(), known.tolist())]
    more = len(texts)
    number = lambda x: [*x.tolist(), *[None] * more]
    return {
        "kind": [*np.where(opened, "open", "closed").tolist(), *["ends"] * more],
        "part": [part] * (len(row) + more),
        "key": [*keys, *[k for k, _ in texts]],
        "parent_key": [*parent_key, *[None] * more],
        "depth": number(d),
        "conv_id": number(least),
        "parent_conv_id": [*parent_conv, *[None] * more],
        "n_convs": number(n),
        "n_children": number(children),
        "n_leaves": number(leaves),
        "saved_tokens": number(saved),
        "chars": number(length),
        "from_edge": number(2 * part + (row > 0)),
        "to_edge": number(2 * part + (last == m - 1)),
        "ends": [*ends, *[t for _, t in texts]],
    }


_ARROW = pa.schema(
    [
        pa.field(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (f.split() for f in _PART.split(", "))
    ]
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task are one part of the order."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        chars = pa.compute.list_flatten(rows["chars"]).to_numpy()
        columns = part_nodes(rows["part"][0].as_py(), rows["conv_id"].to_numpy(), rows["path"].to_pylist(), chars)
        yield from pa.Table.from_pydict(columns, schema=_ARROW).to_batches(max_chunksize=20_000)


def _streamed_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined id texts of each key; rows arrive by key and part."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch["key"], batch["ends"]):
            k = bytes(k)
            if k == key:
                digest.update(b",")
            else:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
        if out:
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (``conv_id``, ``path``, ``chars``), with the columns ``NODE``.

    ``conv_id`` is unique and not null. A sequence without turns belongs to the root only; no sequences give no
    nodes; equal sequences share all their nodes.
    """
    spark = sequences.sparkSession
    sequences = stored(sequences.select("conv_id", "path", "chars"), "trie-paths")
    size = sequences.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("b")).first()
    parts = min(MOST_PARTS, max(1, -(-size["n"] // part_rows), -(-size["b"] // PART_BYTES)))
    in_order = sequences.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    raw = in_order.withColumn("part", F.spark_partition_id()).mapInArrow(_parts, _PART)
    raw = stored(raw, "trie-parts")
    drop_stored(spark, sequences)

    opened = raw.filter("kind = 'open'")
    merged = opened.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.max("depth").alias("depth"),
        F.max("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("from_edge").alias("from_edge"),
        F.max("to_edge").alias("to_edge"),
    )
    merged = stored(merged, "trie-open")
    branches = merged.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(branches, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    )
    own = {"own_saved": (F.col("n_convs") - 1) * F.col("chars"), "own_leaf": (F.col("n_children") == 0).cast("long")}
    merged = merged.withColumns(own)
    # open nodes below a node: those that start at its edge and are deeper, and all that start at later edges it reaches
    edges = (raw.agg(F.max("part")).first()[0] or 0) * 2 + 2
    started = merged.groupBy("from_edge").agg(F.sum("own_saved").alias("s"), F.sum("own_leaf").alias("l"))
    so_far = Window.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)  # two rows a part, see MOST_PARTS
    running = spark.range(edges).select(F.col("id").cast("int").alias("edge"))
    running = running.join(F.broadcast(started), F.col("edge") == F.col("from_edge"), "left").select(
        "edge", F.sum(F.coalesce("s", F.lit(0))).over(so_far).alias("s"), F.sum(F.coalesce("l", F.lit(0))).over(so_far).alias("l")
    )
    running = stored(running.coalesce(1), "trie-edges")
    at = lambda name: F.broadcast(running.select(F.col("edge").alias(f"{name}_edge"), F.col("s").alias(f"{name}_s"), F.col("l").alias(f"{name}_l")))
    deeper = Window.partitionBy("from_edge").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = lambda own, cut: F.sum(own).over(deeper) + F.col(f"to_{cut}") - F.col(f"from_{cut}")
    merged = merged.join(at("from"), "from_edge").join(at("to"), "to_edge").withColumns(
        {
            "saved_tokens": F.col("saved_tokens") + below("own_saved", "s"),
            "n_leaves": F.col("n_leaves") + below("own_leaf", "l"),
        }
    )
    ends = raw.filter("kind = 'ends'").select("key", "part", "ends")
    ends = ends.repartition("key").sortWithinPartitions("key", "part")
    ends = ends.mapInPandas(_streamed_digests, "key binary, ends_sha256 string")
    merged = stored(merged.join(ends, "key", "left"), "trie-merged")

    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    open_nodes = merged.join(parents, "parent_key", "left").select(
        "conv_id",
        "depth",
        F.col("open_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
    # an open parent is looked up part by part, so that a prefix which all conversations share is no hot key
    local = opened.select("part", "key").join(merged.select("key", "conv_id"), "key")
    local = local.select("part", F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    closed = raw.filter("kind = 'closed'").join(local, ["part", "parent_key"], "left")
    closed = closed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent"))
    return closed.withColumnRenamed("ends", "ends_sha256").select(NODE).unionByName(open_nodes.select(NODE))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations with shared heads.

    Null roles and texts are empty; a conversation without turns is a member of the root; repeated rows are
    repeated turns; an empty table gives no rows; other columns are not read.
    """
    own = stored(ordered_turns(conversations), "trie-turns")
    return prefix_trie(with_shared_heads(own))


#: Unsigned CRC-32 of a text of digits in DuckDB: for each character one exclusive-or, then eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s // 2, (s % 2) * 3988292384) END), 4294967295)"""
SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'k': md5(coalesce(role, '')) || md5(coalesce(text, '')), 'n': length(coalesce(text, ''))}}
    ORDER BY turn NULLS FIRST, md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (
  SELECT o.conv_id, o.turns, coalesce(b.turns, list_slice(o.turns, 1, 0)) AS head, {_CRC.format("o.conv_id")} % {HEAD_TURNS + 1} AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {HEAD_EVERY}
), rebuilt AS (
  SELECT conv_id, list_concat(list_slice(head, 1, h), list_slice(turns, h + 1, len(turns))) AS t FROM taken
), paths AS (
  SELECT conv_id, len(t) AS size, array_to_string(list_transform(t, lambda x: x.k), '') AS path, list_transform(t, lambda x: x.n) AS n FROM rebuilt
), members AS (
  SELECT *, unnest(range(0, size + 1)) AS depth FROM paths
), nodes AS (
  SELECT left(path, 64 * depth) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(max(n[depth]), 0) AS own, bool_and(size = depth) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY left(path, 64 * depth), depth
), above AS (
  SELECT *, unnest(range(0, depth + 1)) AS top FROM nodes
), sums AS (
  SELECT left(key, 64 * top) AS key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves,
    count(*) FILTER (WHERE depth = top + 1) AS n_children
  FROM above GROUP BY left(key, 64 * top)
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))
"""
