"""Document fingerprints by a randomised edit embedding.

A random walk reads a text: at step j it looks at one character, writes it down, and goes on to the next one or stays, as a
random bit of (j, character) says. All texts share these bits, so the walks of two texts that differ by a few edits fall
into step again, and the strings written down differ in few places (Hamming distance), while unrelated texts
differ nearly everywhere.

The fingerprint keeps a sample of what is written: one random bit of the character at sampled steps, all of the
first ``SAMPLE`` steps and ``SAMPLE`` of every later doubling. ``likeness`` estimates the share of equal steps from
it, each doubling weighted by its steps. ``near_pairs`` finds similar texts by bands of sampled bits and
verifies each candidate.

Walks are vectorised over the texts of a batch: one numpy operation moves all of them by one step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import as_text, from_text, stored

SAMPLE = 64
SEED = 42
#: Below this many walkers a plain loop per text is quicker than a step for all.
_FEW = 12
_STEPS_AT_ONCE = 64
#: Code points that are walked together, original and edited texts.
BATCH_CHARS = 12_000_000
ROWS_PER_PART, MOST_PARTS = 4000, 10_000
BAND_BITS = 16
#: Classes of one band that meet in one task; a band with more is cut into tiles, and each pair of tiles is a unit of work.
TILE_ROWS = 4096
_M = 0x9E3779B1
_MASK = 0xFFFFFFFF


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 32-bit values."""
    x = (x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=64)
def _sampled_steps(block: int) -> np.ndarray:
    """Sampled steps of a doubling: block 0 is [0, SAMPLE), block k is [SAMPLE * 2**(k-1), SAMPLE * 2**k)."""
    if block == 0:
        return np.arange(SAMPLE)
    width = SAMPLE << (block - 1)
    rng = np.random.default_rng([SEED, block])
    return np.sort(width + rng.choice(width, SAMPLE, replace=False))


class _Steps:
    """Random numbers of the steps, made as far as the longest walk needs, and which steps are sampled."""

    def __init__(self):
        self.keys: list[int] = []
        self.sampled: list[bool] = []
        self.block = 0

    def reach(self, steps: int) -> None:
        while len(self.keys) < steps:
            size = SAMPLE if self.block == 0 else SAMPLE << (self.block - 1)
            start = len(self.keys)
            self.keys += _mixed(np.arange(start, start + size), SEED).tolist()
            mark = np.zeros(size, dtype=bool)
            mark[_sampled_steps(self.block) - start] = True
            self.sampled += mark.tolist()
            self.block += 1


_steps = _Steps()


def _bits(code_points: list[np.ndarray]) -> tuple[list[bytearray], np.ndarray]:
    """Sampled bits of each text, in walk order, and the length of each walk in steps."""
    sizes = np.array([len(c) for c in code_points], dtype=np.int64)
    pad = np.zeros(_STEPS_AT_ONCE + 1, dtype=np.uint32)
    starts = np.cumsum([0, *(sizes[:-1] + len(pad))]).astype(np.int64)
    chars = np.concatenate([x for c in code_points for x in (_mixed(c, SEED + 1), pad)]) if len(sizes) else pad
    ends, at, begin = starts + sizes, starts.copy(), 0
    walked = np.zeros(len(sizes), dtype=np.int64)
    written: list[bytearray] = [bytearray() for _ in sizes]
    active = np.flatnonzero(sizes > 0)
    factor, high, second = np.uint32(_M), np.uint32(31), np.uint32(30)
    while len(active) > _FEW:
        _steps.reach(begin + _STEPS_AT_ONCE)
        where, last = at[active], ends[active]
        rows, trail = [], np.empty((_STEPS_AT_ONCE, len(active)), dtype=bool)
        for j in range(_STEPS_AT_ONCE):
            trail[j] = where < last
            mixed = (chars[where] ^ np.uint32(_steps.keys[begin + j])) * factor
            if _steps.sampled[begin + j]:
                rows.append((j, ((mixed >> second) & np.uint32(1)).astype(np.uint8)))
            where += mixed >> high
            np.minimum(where, last, out=where)
        walked[active] += trail.sum(axis=0)
        if rows:
            steps = [j for j, _ in rows]
            values = np.stack([v for _, v in rows], axis=1)
            counts = trail[steps].sum(axis=0)
            for k, text in enumerate(active.tolist()):
                written[text] += values[k, : counts[k]].tobytes()
        at[active] = where
        active = active[where < last]
        begin += _STEPS_AT_ONCE
    for text in active.tolist():
        step, here, end, out = begin, int(at[text]), int(ends[text]), written[text]
        own = chars[here:end].tolist()
        here, end = 0, len(own)
        while here < end:
            if step >= len(_steps.keys):
                _steps.reach(step + 1)
            mixed = ((own[here] ^ _steps.keys[step]) * _M) & _MASK
            if _steps.sampled[step]:
                out.append(mixed >> 30 & 1)
            here += mixed >> 31
            step += 1
        walked[text] = step
    return written, walked


def fingerprints(texts: list[str]) -> list[str]:
    """``<steps in hex>-<sampled bits in hex>`` of each text."""
    written, walked = _bits([np.frombuffer(t.encode("utf-32-le", "replace"), dtype="<u4") for t in texts])
    packed = (np.packbits(np.frombuffer(w, dtype=np.uint8)).tobytes().hex() for w in written)
    return [f"{steps:x}-{bits}" for steps, bits in zip(walked.tolist(), packed)]


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which two walks write the same character, from 0 to 1.

    Where only one walk still goes on, nothing is equal. Unequal characters have equal bits half of the time, which is taken
    out. Two empty texts are alike.
    """
    if a == b:
        return 1.0
    steps_a, bits_a = a.split("-")
    steps_b, bits_b = b.split("-")
    steps = int(steps_a, 16), int(steps_b, 16)
    if not max(steps):
        return 1.0
    both = min(4 * len(bits_a), 4 * len(bits_b))
    if not both:
        return 0.0
    joined = bytes.fromhex(bits_a[: both // 4]), bytes.fromhex(bits_b[: both // 4])
    apart = np.unpackbits(np.frombuffer(joined[0], np.uint8) ^ np.frombuffer(joined[1], np.uint8))
    equal, block, low, seen = 0.0, 0, 0, 0
    while low < min(steps):
        size = SAMPLE if block == 0 else SAMPLE << (block - 1)
        reach = min(steps) - low
        sampled = int((_sampled_steps(block) < min(steps)).sum())
        if sampled:
            share = 1 - 2 * apart[seen : seen + sampled].mean()
            equal += min(size, reach) * max(0.0, share)
        seen, low, block = seen + sampled, low + size, block + 1
    return float(min(1.0, equal / max(steps)))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(rows: list[tuple]) -> pd.DataFrame:
    """Rows of the result for (doc_id, text, following text)."""
    edited = [_edited(t, f) for _, t, f in rows]
    prints = fingerprints([t for _, t, _ in rows] + edited + [rows[-1][2]] if rows else [])
    own, changed = prints[: len(rows)], prints[len(rows) : 2 * len(rows)]
    by_text = dict(zip((t for _, t, _ in rows), own)) | {rows[-1][2]: prints[-1]} if rows else {}
    return pd.DataFrame(
        {
            "doc_id": [i for i, _, _ in rows],
            "n_chars": [len(t) for _, t, _ in rows],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
            "fingerprint": own,
            "edited_fingerprint": changed,
            "near_edited": [likeness(a, b) for a, b in zip(own, changed)],
            "near_next": [likeness(a, by_text[f]) for a, (_, _, f) in zip(own, rows)],
        }
    )


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair each row with the one after it; a row marked ``ahead`` only lends its text to the row before."""
    held: tuple | None = None
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc_id, text, ahead in zip(batch["doc_id"], batch["text"], batch["ahead"]):
            if held is not None:
                rows.append((*held, text))
                size += 2 * len(held[1])
            held = None if ahead else (doc_id, text)
            if size >= BATCH_CHARS:
                yield _compared(rows)
                rows, size = [], 0
    if rows:
        yield _compared(rows)


def with_next(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Partitions of (doc_id, text, ahead) in descending order of ``doc_id``, then text; null ids come last.

    The order is cut at quantiles of the ids. Each part's first row is sent a second time, marked ``ahead``, to the part
    before it, and the very first to the last part, so each row has its follower in its own part. Rows of one id
    stay in one part, which is read as a stream. Texts are shuffled once. The driver holds one bound per part.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    parts = min(MOST_PARTS, max(1, round(rows.count() / rows_per_part)))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.approxQuantile("doc_id", shares, 0.2 / parts))) if shares else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    above = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - above)
    placed = rows.withColumn("part", place.cast("int"))
    tops = sorted(tuple(r) for r in placed.groupBy("part").agg(F.max("doc_id")).collect())
    before = [(part, top, tops[i - 1][0]) for i, (part, top) in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(before, "top_part int, top long, before int"))  # MOST_PARTS rows at most
    lent = (
        placed.join(heads, (F.col("part") == F.col("top_part")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("before", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("ahead"))
    )
    both = placed.select("doc_id", "text", "part", F.lit(False).alias("ahead")).unionByName(lent)
    return (
        both.repartitionById(len(cuts) + 2, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")
        .select(as_text("doc_id"), "text", "ahead")
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the fingerprints of its text and of the text edited with the next document's, and their likeness.

    A null text is empty. Equal ids are ordered by text. A table of one row follows itself; an empty table gives no
    rows; only ``doc_id`` and ``text`` are read.
    """
    return from_text(with_next(docs).mapInPandas(_followed, _ROWS), "doc_id")


@F.pandas_udf(T.StringType())
def _prints(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprints([t or "" for t in texts]), dtype=object)


def _cut_bands(text: str) -> list[str]:
    """Whole bands of sampled bits, each with its place; texts too short for one have their whole print."""
    width = BAND_BITS // 4
    bits = text.split("-")[1]
    return [f"{i}:{bits[i : i + width]}" for i in range(0, len(bits) - width + 1, width)] or [text]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bands(prints: pd.Series) -> pd.Series:
    return pd.Series([_cut_bands(t) for t in prints], dtype=object)


@lru_cache(maxsize=4096)
def _weights(steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per doubling of a walk: the mask of its sampled bits, how many these are, and the steps they stand for."""
    masks, counts, sizes = [], [], []
    block = low = 0
    while low < steps:
        size = SAMPLE if block == 0 else SAMPLE << (block - 1)
        sampled = int((_sampled_steps(block) < steps).sum())
        masks.append(np.packbits(np.arange(SAMPLE) < sampled).view("<u8")[0])
        counts.append(max(1, sampled))
        sizes.append(min(size, steps - low) if sampled else 0)
        low, block = low + size, block + 1
    return np.array(masks, dtype="<u8"), np.array(counts), np.array(sizes, dtype=float)


def alike(prints: list[str], first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of row numbers, one of ``first`` and one of ``second``, whose likeness is ``least`` or more.

    Both are the same rows or have none in common. One walk is held against all that are no shorter at once; walks so long
    that their surplus alone rules the pair out are not looked at.
    """
    steps = np.array([int(p.split("-")[0], 16) for p in prints], dtype=np.int64)
    raw = [bytes.fromhex(p.split("-")[1]) for p in prints]
    wide = -(-max(map(len, raw), default=0) // 8)
    words = np.frombuffer(b"".join(r.ljust(8 * wide, b"\0") for r in raw), dtype="<u8").reshape(len(raw), wide)
    first, second = first[np.argsort(steps[first], kind="stable")], second[np.argsort(steps[second], kind="stable")]
    same = np.array_equal(first, second)
    for ours, theirs, side in ((first, second, "left"), (second, first, "right"))[: 1 if same else 2]:
        lengths = steps[theirs]
        lows = np.arange(1, len(ours) + 1) if same else np.searchsorted(lengths, steps[ours], side)
        highs = np.searchsorted(lengths, steps[ours] / max(least, 1e-9) * (1 + 1e-9), "right")
        for x, low, high in zip(ours.tolist(), lows.tolist(), highs.tolist()):
            if low >= high or not steps[x]:
                continue
            masks, counts, sizes = _weights(int(steps[x]))
            others = theirs[low:high]
            apart = np.bitwise_count((words[others, : len(masks)] ^ words[x, : len(masks)]) & masks)
            equal = np.maximum(0.0, 1 - 2 * apart / counts) @ sizes
            for y in others[equal >= (least - 1e-9) * steps[others]].tolist():
                if likeness(prints[x], prints[y]) >= least:
                    yield x, y


def _verified(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Links of each unit (band and two tiles); rows arrive sorted by unit. A pair is told in the first band it shares."""

    def linked(unit: tuple, rows: list[tuple]) -> list[tuple]:
        band, lo, hi = unit
        ids, prints, tiles = map(list, zip(*rows))
        tile = np.array(tiles)
        first, second = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        out = []
        for x, y in alike(prints, first, second, least):
            if next(a for a, b in zip(_cut_bands(prints[x]), _cut_bands(prints[y])) if a == b) == band:
                a, b = (x, y) if ids[x] < ids[y] else (y, x)
                out.append((ids[a], ids[b], likeness(prints[a], prints[b])))
        return out

    unit, rows = None, []
    for batch in batches:
        out = []
        for band, lo, hi, *row in batch[["band", "lo", "hi", "id", "print", "tile"]].itertuples(index=False, name=None):
            if (band, lo, hi) != unit:
                if len(rows) > 1:
                    out += linked(unit, rows)
                unit, rows = (band, lo, hi), []
            rows.append(row)
        yield pd.DataFrame(out, columns=["a", "b", "likeness"])
    if len(rows) > 1:
        yield pd.DataFrame(linked(unit, rows), columns=["a", "b", "likeness"])


def near_pairs(
    docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """All links (``a``, ``b``, ``likeness``) of at least ``least`` that share a band of sampled bits.

    Texts with equal fingerprints are one class, named by its smallest id; a class without an id has no link. In each band
    every two classes are compared, tile against tile, so what else shares the band hides no pair. The comparisons grow with
    the square of a band's classes. A null text is empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), _prints(F.col(text)).alias("print"))
    classes = stored(rows.groupBy("print").agg(F.min("id").alias("id")).filter("id is not null"), "edit-classes")
    banded = classes.select("id", "print", F.explode(_bands("print")).alias("band"))
    tiles = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = tiles.select("band", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    units = (
        banded.join(tiles, "band")
        .withColumn("tile", own)
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("band", F.least("tile", "partner").alias("lo"), F.greatest("tile", "partner").alias("hi"), "id", "print", "tile")
        .repartition("band", "lo", "hi")
        .sortWithinPartitions("band", "lo", "hi")
    )
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("likeness", T.DoubleType())])
    return units.mapInPandas(lambda batches: _verified(batches, least), out)
