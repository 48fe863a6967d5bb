"""Repeated byte strings marked with run-length indexes.

A string of ``WIDTH`` bytes (a window) that starts at an earlier place too is removed from its text. The corpus is cut by content so that
equal windows meet without comparing everything with everything:

1. Anchors. Each window chooses the leftmost of its ``GRAM``-byte pieces with the smallest hash. Equal windows choose alike, so only
   anchors that occur twice in the corpus matter, and only texts that hold one of those go on.
2. Index. The first place of an anchor is its source. Neighbouring sources of one stretch of a document (``REGION`` bytes) form strings,
   and a unit of work indexes the strings of some stretches (``RunIndex``: run-compressed Burrows-Wheeler transform with sampled run
   ends). Wherever else the anchors of a stretch occur, the windows that chose them are sent to its unit, as strings of neighbours, and
   streamed through the index. A match of a whole window that starts earlier marks the window. A stretch that much of the corpus
   repeats has several units, each with the same index.
3. The rest. A window that its source does not hold (an anchor between other neighbours) can only repeat a window of the same anchor. Those
   meet in the unit, where all but the earliest of equal windows (128 bits of hash) are marked; for a stretch with several
   units they are grouped by Spark instead.

Places are ordered by document id (null first), a digest of the text, and the byte; so rows that share id and text are one document
given twice, with equal results, and rows that share only the id are ordered by digest. A group that grows with the corpus is only ever
counted or reduced to its minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import drop_stored, stored
from verdigris.llm.run_index import RunIndex
from verdigris.llm.substring import rolling

WIDTH, GRAM = 100, 32
#: Places of anchors that meet in one unit, on average, and at most for one source stretch.
UNIT_PLACES = 16_384
#: Bytes of a source stretch, windows in one string (and up to as many as an anchor has), bytes that are hashed together.
REGION, STRING_WINDOWS, PORTION_BYTES = 65_536, 512, 400_000
_BYTE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_NO_ID = -(1 << 63)

_REF = "h long, id long, k long, start long, n long"
_PIECE = "src long, salts long, first boolean, id long, k long, start long, piece binary"
_FOUND = "id long, k long, start long, stop long, w1 long, w2 long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts and ends in them; a null row is empty."""
    text = pc.fill_null(text, "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _portions(starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows cut into stretches (row, start, end) that overlap by ``width - 1`` bytes, about ``PORTION_BYTES`` together."""
    rows, low, high, size = [], [], [], 0
    for row, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        while e - s >= width:
            stop = min(e, s + PORTION_BYTES + width)
            rows.append(row)
            low.append(s)
            high.append(stop)
            size += stop - s
            if size >= PORTION_BYTES:
                yield np.array(rows), np.array(low), np.array(high)
                rows, low, high, size = [], [], [], 0
            if stop == e:
                break
            s = stop - width + 1
    if rows:
        yield np.array(rows), np.array(low), np.array(high)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of every ``gram`` bytes (a power of two): sums of powers, put together by doubling, then mixed."""
    out, size, factor = _BYTE[data], 1, _BASE
    while size < gram:
        out = out[:-size] * np.uint64(factor) + out[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, low: np.ndarray, high: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Anchors of stretches of ``data``: their hash, the stretch, and first and last window (places in ``data``) that chose them."""
    begin = int(low.min())
    hashes = gram_hashes(data[begin : int(high.max())], gram)
    # high bits of the hash, then the place: the least is the leftmost of the smallest
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    sizes = high - low - width + 1
    window = _ranges(low - begin, sizes)
    stretch = np.repeat(np.arange(len(low)), sizes)
    chosen = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (stretch[1:] != stretch[:-1])
    edge = np.flatnonzero(new)
    last = np.r_[edge[1:], len(window)] - 1
    return hashes[chosen[edge]].view(np.int64), stretch[edge], window[edge] + begin, window[last] + begin


def _references(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each anchor of each row once, with its first window and the number of its places."""
    schema = _schema(_REF)
    for batch in batches:
        data, starts, ends = _text_bytes(batch["text"])
        ids, ks = batch["id"].to_numpy(), batch["k"].to_numpy()
        for rows, low, high in _portions(starts, ends, width):
            h, stretch, lo, _ = anchors(data, low, high, width, gram)
            row = rows[stretch]
            order = np.lexsort((h, row))
            h, row, lo = h[order], row[order], lo[order]  # equal ones stay in the order of their places
            head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            n = np.diff(np.r_[head, len(h)])
            row = row[head]
            columns = h[head], ids[row], ks[row], lo[head] - starts[row], n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of repeated anchors of each row, as strings of neighbours with one source."""
    schema = _schema(_PIECE)
    for batch in batches:
        data, starts, ends = _text_bytes(batch["text"])
        ids, ks = batch["id"].to_numpy(), batch["k"].to_numpy()
        cuts = batch["hits"].offsets.to_numpy()
        cuts = cuts - cuts[0]
        hit_h, hit_src, hit_salts, hit_start = (x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(batch["hits"]).flatten())
        for rows, low, high in _portions(starts, ends, width):
            h, stretch, lo, hi = anchors(data, low, high, width, gram)
            cut = np.searchsorted(stretch, np.arange(len(rows) + 1))
            out: list[tuple] = []
            for i, row in enumerate(rows.tolist()):
                own = slice(cuts[row], cuts[row + 1])
                order = np.argsort(hit_h[own])
                own_h, part = hit_h[own][order], slice(cut[i], cut[i + 1])
                spot = np.minimum(np.searchsorted(own_h, h[part]), len(own_h) - 1)
                kept = np.flatnonzero(own_h[spot] == h[part])
                if not len(kept):
                    continue
                spot, base = own.start + order[spot[kept]], int(starts[row])
                a, b = lo[part][kept] - base, hi[part][kept] - base
                src, salts, first = hit_src[spot], hit_salts[spot], hit_start[spot] == a
                block = a // STRING_WINDOWS
                new = np.ones(len(kept), dtype=bool)
                new[1:] = (a[1:] != b[:-1] + 1) | (src[1:] != src[:-1]) | (first[1:] != first[:-1]) | (block[1:] != block[:-1])
                head = np.flatnonzero(new)
                stop = b[np.r_[head[1:], len(kept)] - 1] + width
                doc, k = int(ids[row]), int(ks[row])
                for s, n, f, p, e in zip(src[head].tolist(), salts[head].tolist(), first[head].tolist(), a[head].tolist(), stop.tolist()):
                    out.append((s, n, f, doc, k, p, data[base + p : base + e].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def marked(rows: pa.Table, width: int = WIDTH) -> pa.Table:
    """Removed spans of one unit, and the windows that have to be compared with those of other units."""
    ids, ks, start, salts = (rows[c].to_numpy() for c in ("id", "k", "start", "salts"))
    first = rows["first"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((ks, ids))
    new = np.r_[False, (ids[order[1:]] != ids[order[:-1]]) | (ks[order[1:]] != ks[order[:-1]])]
    document = np.empty(len(order), dtype=np.int64)
    document[order] = np.cumsum(new)
    place = (document << 40) | start  # in the order of documents, then bytes
    asked, sources = np.flatnonzero(~first), np.flatnonzero(first)
    schema = _schema(_FOUND)
    if not len(asked):
        return schema.empty_table()
    queries = rows["piece"].take(pa.array(asked)).to_pylist()
    sizes = np.array([len(q) for q in queries])
    counts = sizes - width + 1
    column = np.arange(int(counts.max()))
    open_ = column < counts[:, None]
    gone = np.zeros_like(open_)
    if len(sources):
        index = RunIndex(rows["piece"].take(pa.array(sources)).to_pylist(), place[sources], width, int(sizes.max()))
        matched, earliest = index.statistics(queries)
        own = place[asked][:, None] + column
        gone = (matched[:, : len(column)] >= width) & (earliest[:, : len(column)] < own) & open_
    q, c = np.nonzero(open_ & ~gone)
    whole = _BYTE[np.frombuffer(b"".join(queries), dtype=np.uint8)]
    window = (np.cumsum(sizes) - sizes)[q] + c
    w1, w2 = (rolling(whole, width, lane)[window].view(np.int64) for lane in (0, 1))
    here = np.flatnonzero(salts[asked[q]] == 1)  # all other places of the anchor are in this unit
    at = place[asked[q[here]]] + c[here]
    order = np.lexsort((at, w2[here], w1[here]))
    here, at = here[order], at[order]
    head = np.flatnonzero(np.r_[True, (w1[here[1:]] != w1[here[:-1]]) | (w2[here[1:]] != w2[here[:-1]])][: len(here)])
    earliest = np.repeat(at[head], np.diff(np.r_[head, len(here)]))
    again = here[at > earliest]  # equal places are rows of one document given twice
    gone[q[again], c[again]] = True
    step = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    of = asked[row]
    columns = [ids[of], ks[of], start[of] + a, start[of] + b - 1 + width]
    spans = pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns] + [pa.nulls(len(of), pa.int64())] * 2, schema=schema)
    there = np.flatnonzero(salts[asked[q]] > 1)
    of, c = asked[q[there]], c[there]
    columns = [ids[of], ks[of], start[of] + c, start[of] + c + width, w1[there], w2[there]]
    rest = pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)
    return pa.concat_tables([spans, rest]).combine_chunks()


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, unit_places: int = UNIT_PLACES) -> DataFrame:
    """``id``, ``k``, ``spans``: removed stretches (start, stop) of each row of ``docs`` (id, k, text) that has any."""
    spark = docs.sparkSession
    refs = docs.select("id", "k", "text").mapInArrow(lambda it: _references(it, width, gram), _REF)
    refs = stored(refs, "suffix-anchors")
    at = F.min(F.struct("id", "k", "start")).alias("at")
    counts = refs.groupBy("h").agg(F.sum("n").alias("n"), at).filter("n > 1")
    counts = counts.withColumn("src", F.xxhash64("at.id", "at.k", F.floor(F.col("at.start") / REGION)))
    counts = stored(counts, "suffix-repeats")
    loads = counts.groupBy("src").agg(F.ceil(F.sum("n") / unit_places).alias("salts"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    units = max(1, -(-total // unit_places))
    here = (F.col("at.id") == F.col("id")) & (F.col("at.k") == F.col("k"))
    hit = F.struct("h", "src", "salts", F.when(here, F.col("at.start")).otherwise(-1).alias("start"))
    hits = refs.select("h", "id", "k").join(counts.join(loads, "src").drop("n"), "h")
    hits = stored(hits.groupBy("id", "k").agg(F.collect_set(hit).alias("hits")), "suffix-hits")
    for used in (refs, counts):
        drop_stored(spark, used)
    pieces = docs.select("id", "k", "text").join(hits, ["id", "k"]).mapInArrow(lambda it: _pieces(it, width, gram), _PIECE)
    salt = F.when(F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id", "k", "start"), F.col("salts")))
    )
    dealt = pieces.withColumn("salt", F.explode(salt)).withColumn("unit", F.pmod(F.xxhash64("src", "salt"), F.lit(units)))
    found = dealt.drop("src", "salt").groupBy("unit").applyInArrow(lambda rows: marked(rows, width), _FOUND)
    found = stored(found, "suffix-found")
    drop_stored(spark, hits)
    rest = found.filter("w1 IS NOT NULL").select("w1", "w2", F.struct("id", "k", "start").alias("place"), "stop")
    twice = rest.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("place").alias("least")).filter("n > 1").drop("n")
    twice = stored(twice, "suffix-twice")  # by itself, so that a window which many rows hold is split in the join
    again = rest.join(twice, ["w1", "w2"]).filter(F.col("place") > F.col("least")).select("place.*", "stop")
    spans = found.filter("w1 IS NULL").select("id", "k", "start", "stop").unionByName(again)
    gathered = spans.groupBy("id", "k").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    gathered = stored(gathered, "suffix-spans")
    for used in (found, twice):
        drop_stored(spark, used)
    return gathered


def kept_stretches(size: int, spans: list) -> list[tuple[int, int]]:
    """What the union of ``spans`` leaves of ``size`` bytes."""
    out, at = [], 0
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if s > at:
            out.append((at, min(s, size)))
        at = max(at, e)
    if at < size:
        out.append((at, size))
    return out


_RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        data, starts, ends = _text_bytes(batch["text"])
        for s, e, spans in zip(starts.tolist(), ends.tolist(), batch["spans"].to_pylist()):
            size = e - s
            kept = kept_stretches(size, spans)
            whole = data[s:e].tobytes()
            left = b"".join(whole[a:b] for a, b in kept) if spans else whole
            edges = [0, *(x for pair in kept for x in pair), size]
            gaps = sum(b > a for a, b in zip(edges[::2], edges[1::2])) if spans else 0
            out.append((size, size - len(left), gaps, left))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _schema(_RESULT))] if out else []
        if out:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *_schema(_RESULT).names])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, **how) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and the bytes ``kept`` of every row of ``docs``.

    A null text is empty; a text shorter than a window keeps all; null ids come first in the order; rows that share id and text are one
    document given twice and get equal results; an empty table gives no rows; other columns are not read. What is kept
    may end inside a character, so it is a binary column.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = named.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("k"), "text"
    )
    spans = repeated_spans(rows, width, **how)
    joined = rows.join(spans, ["id", "k"], "left").select("doc_id", "text", "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {kind}, {_RESULT}")


def document_repeats(docs: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept; see ``without_repeats`` for nulls, repeats and short texts."""
    kept = without_repeats(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same for DuckDB, over documents with distinct ids; bytes as hexadecimal digits, cut into blocks so that windows are taken from short texts.
SQL = f"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), blocks AS (
  SELECT doc_id, base, substr(x, 2 * base + 1, {2 * (1000 + WIDTH - 1)}) AS x
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {WIDTH - 1}, 1000)) AS base FROM docs)
), windows AS (
  SELECT doc_id, base + i AS i, md5_number(substr(x, 2 * i + 1, {2 * WIDTH})) AS h
  FROM (SELECT doc_id, base, x, unnest(range(0, len(x) // 2 - {WIDTH - 1})) AS i FROM blocks)
), firsts AS (
  SELECT h, min(struct_pack(d := doc_id, i := i)) AS least_at FROM windows GROUP BY h HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE struct_pack(d := doc_id, i := i) > least_at
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM hits)
), gone AS (
  SELECT doc_id, min(i) AS a, max(i) + {WIDTH} AS b FROM runs GROUP BY doc_id, run
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM gone) g JOIN docs d ON d.doc_id = g.doc_id
  GROUP BY g.doc_id
)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
