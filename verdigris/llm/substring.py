"""Exact repeated passages through fixed-block anchors.

A passage counts as repeated when a window of ``WINDOW`` consecutive words of one document starts anywhere else too.
Every such window holds at least one whole block of ``BLOCK`` words of its own document's non-overlapping
grid (``WINDOW >= 2 * BLOCK - 1``). So the blocks are the index and every rolling window of ``BLOCK`` words of the
corpus is a probe: a block that no other probe meets rules out all windows around it. Around each block that was
hit, the windows of full length are compared in a second round, which extends hits to the maximal exact
repeats: their union is what is repeated.

Both rounds compare hashes by bucket. A task first merges equal hashes of its own rows, so a passage that a third of the
documents share reaches a bucket once per task, and it ships hashes as packed arrays, 8 bytes a probe. Hashes of
the first round only choose candidates; the second round uses 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import SPACES, as_text, from_text, row_key, stored

WINDOW = 35
BLOCK = 18
#: Hashes that a task merges before it ships them, and text bytes behind one bucket.
FLUSH = 1_500_000
BUCKET_BYTES = 6_000_000
_CACHED_WORDS = 300_000

_PACKED = "bucket int, h binary, h2 binary, many binary, ref_at binary, ref_key binary, ref_no binary"
_MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class _WordHashes(dict):
    """Hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # bytes split at ASCII white space only


def rolling(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of every window of ``width`` consecutive entries, put together from windows of powers of two."""
    if len(hashes) < width:
        return hashes[:0]
    left, right = (np.uint64(c) for c in _MIX[lane])
    shift = np.uint64(32)

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a ^ (a >> shift)) * left + (b ^ (b >> shift)) * right
        return mixed ^ (mixed >> np.uint64(29))

    out, have, power, size = None, 0, hashes, 1
    while width >= size:
        if width & size:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - have)
                out = merged(out[:n], power[have : have + n])
            have += size
        if width >= 2 * size:
            power = merged(power[:-size], power[size:])
        size *= 2
    n = len(hashes) - width + 1
    return (out[:n] ^ (out[:n] >> shift)) * left


def _pack(h: list, h2: list, at: list, keys: list, nos: list, bits: int) -> pd.DataFrame:
    """Merge equal hashes, cut by bucket (the leading ``bits``). ``at``: which hash a reference belongs to."""
    all_h = np.concatenate(h)
    all_h2 = np.concatenate(h2) if h2 else None
    order = np.argsort(all_h, kind="stable") if all_h2 is None else np.lexsort((all_h2, all_h))
    first = np.ones(len(order), dtype=bool)
    first[1:] = all_h[order[1:]] != all_h[order[:-1]]
    if all_h2 is not None:
        first[1:] |= all_h2[order[1:]] != all_h2[order[:-1]]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    many = np.diff(np.r_[heads, len(order)]) > 1
    unique = all_h[order[heads]]
    unique2 = all_h2[order[heads]] if all_h2 is not None else None
    ref = group[np.concatenate(at)]
    ref_order = np.argsort(ref, kind="stable")
    ref, key, no = ref[ref_order], np.concatenate(keys)[ref_order], np.concatenate(nos)[ref_order]
    cuts = np.searchsorted(unique, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0]
    cuts = np.r_[cuts, len(unique)]
    ref_cuts = np.searchsorted(ref, cuts)
    rows = []
    for b in range(1 << bits):
        s, e, rs, re_ = cuts[b], cuts[b + 1], ref_cuts[b], ref_cuts[b + 1]
        if e > s:
            rows.append(
                (
                    b,
                    unique[s:e].tobytes(),
                    unique2[s:e].tobytes() if unique2 is not None else b"",
                    many[s:e].tobytes(),
                    (ref[rs:re_] - s).astype("<i4").tobytes(),
                    key[rs:re_].astype("<i8").tobytes(),
                    no[rs:re_].astype("<i4").tobytes(),
                )
            )
    return pd.DataFrame(rows, columns=["bucket", "h", "h2", "many", "ref_at", "ref_key", "ref_no"])


class _Outbox:
    """Collects hashes and references of one task and packs them in bounded portions."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.size, self.h, self.h2, self.at, self.keys, self.nos = 0, [], [], [], [], []

    def add(self, key: int, h: np.ndarray, h2: np.ndarray | None, at: np.ndarray, nos: np.ndarray) -> None:
        self.h.append(h)
        if h2 is not None:
            self.h2.append(h2)
        self.at.append(at + self.size)
        self.keys.append(np.full(len(at), key, dtype=np.int64))
        self.nos.append(nos)
        self.size += len(h)

    def packed(self) -> Iterator[pd.DataFrame]:
        if self.size:
            yield _pack(self.h, self.h2, self.at, self.keys, self.nos, self.bits)
        self.clear()


def _probes(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    hashes, box = _WordHashes(), _Outbox(bits)
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"]):
            found = split_words(text)
            if len(found) < WINDOW:
                continue
            own = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
            starts = np.arange(0, len(found) - BLOCK + 1, BLOCK)
            box.add(key, rolling(own, BLOCK), None, starts, starts // BLOCK)
            if box.size >= FLUSH:
                yield from box.packed()
    yield from box.packed()


def _windows(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    hashes, box = _WordHashes(), _Outbox(bits)
    for batch in batches:
        for key, text, blocks in zip(batch["key"], batch["text"], batch["blocks"]):
            found = split_words(text)
            own = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
            last = len(found) - WINDOW
            edge = np.zeros(last + 2, dtype=np.int64)
            starts = np.asarray(blocks, dtype=np.int64) * BLOCK
            low = np.minimum(np.maximum(starts - (WINDOW - BLOCK), 0), last + 1)
            np.add.at(edge, low, 1)
            np.add.at(edge, np.minimum(starts, last) + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(at):
                box.add(key, rolling(own, WINDOW)[at], rolling(own, WINDOW, 1)[at], np.arange(len(at)), at)
            if box.size >= FLUSH:
                yield from box.packed()
    yield from box.packed()


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """References of one bucket whose hash occurs at least twice."""

    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name]), dtype=kind)

    h, h2, met = joined("h", "<u8"), joined("h2", "<u8"), joined("many", "?").copy()
    order = np.lexsort((h2, h)) if len(h2) else np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if len(h2):
        same &= h2[order[1:]] == h2[order[:-1]]
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    base = np.cumsum([0, *(len(x) // 8 for x in rows["h"][:-1])])
    at = joined("ref_at", "<i4") + np.repeat(base, [len(x) // 4 for x in rows["ref_at"]])
    hit = met[at]
    key, no = joined("ref_key", "<i8")[hit], joined("ref_no", "<i4")[hit]
    return pd.DataFrame({"key": key, "no": no})


def _gathered(packed: DataFrame) -> DataFrame:
    met = packed.groupBy("bucket").applyInPandas(_met, "key long, no int")
    return met.groupBy("key").agg(F.collect_set("no").alias("at"))


def _bits(docs: DataFrame) -> int:
    """Buckets grow with the text, so that a bucket stays of one size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, (total // BUCKET_BYTES).bit_length())


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``key``, ``at``: the starts of all repeated windows of each row of ``docs`` (key, text) that has any."""
    bits = _bits(docs)
    packed = docs.mapInPandas(lambda it: _probes(it, bits), _PACKED)
    anchors = stored(_gathered(packed).withColumnRenamed("at", "blocks"), "anchor-hits")
    near = docs.join(anchors, "key").select("key", "text", "blocks")
    packed = near.mapInPandas(lambda it: _windows(it, bits), _PACKED)
    return stored(_gathered(packed), "repeated-windows")


def _kept(text: str | None, at) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and how many there were."""
    found = split_words(text)
    if at is None or not len(at):
        return found, len(found)
    edge = np.zeros(len(found) + 1, dtype=np.int64)
    at = np.unique(np.asarray(at, dtype=np.int64))
    edge[at] += 1
    edge[at + WINDOW] -= 1
    free = np.cumsum(edge[:-1]) == 0
    return [w for w, keep in zip(found, free.tolist()) if keep], len(found)


def removals(docs: DataFrame) -> DataFrame:
    """Per document: ``n_words``, ``n_removed`` and the digest of the words that stay.

    A null text has no words. Repeated rows repeat each other, so both lose their windows; texts shorter than a
    window lose nothing; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
    """
    rows = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    hits = repeated_windows(rows.select("key", "text"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, at in zip(batch["text"], batch["at"]):
                kept, n = _kept(text, at)
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), frame], axis=1)

    joined = rows.join(hits, "key", "left").select(as_text("doc_id"), "text", "at")
    out = joined.mapInPandas(digest, "doc_id string, n_words long, n_removed long, kept_sha256 string")
    return from_text(out, "doc_id")


@F.pandas_udf(T.StringType())
def _without_windows(text: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([b" ".join(_kept(t, a)[0]).decode() if a is not None else t for t, a in zip(text, at)])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with repeated windows taken out of its texts; every row stays, untouched texts stay as they are.

    A column named by ``length`` is set to the characters of a changed text.
    """
    rows = docs.select(
        F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text")
    )
    hits = repeated_windows(rows.select("key", "text"))
    joined = rows.drop("text").join(hits, "key", "left")
    out = joined.withColumn("new", _without_windows(F.col(f"row.{text}"), F.col("at")))
    changed = {text: F.col("new")}
    if length:
        size = F.length("new").cast(docs.schema[length].dataType)
        changed[length] = F.when(F.col("at").isNull(), F.col(f"row.{length}")).otherwise(size)
    return out.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


#: The same for DuckDB, over documents with distinct ids.
SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)
), hits AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM hits
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT s.doc_id, len(s.words) AS n_words, len(s.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
