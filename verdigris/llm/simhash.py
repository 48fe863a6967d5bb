"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits; two fingerprints link when at most ``radius`` bits differ. Distinct fingerprints
that agree in one of ``radius + 1`` bit blocks meet (two that differ in at most ``radius`` bits
must agree in one block, so no link is lost). Where they meet they are compared exactly, tile against tile, by
numpy exclusive-or and bit counts; tile pairs whose population counts differ by more than the radius
are skipped. A meeting with more rows than a tile is cut by population count and hash, and each pair of its
tiles within the radius becomes a unit of work of its own, so a crowded block value never lands in one
task. Every unit returns a spanning forest of its links instead of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import drop_stored, stored
from verdigris.llm.components import components

SHINGLE = 3
RADIUS = 3
TILE_ROWS = 4096
_SQUARE = 1024
_CHUNK = 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed integer over lower-cased (A-Z) word shingles of the whole text.

    A text of fewer words is one shingle; a text without words, or null, has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    if len(words) < shingle:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    while len(part := np.fromiter(map(_hash, islice(shingles, _CHUNK)), dtype="<u8")):
        bits = np.unpackbits(part.view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus its fingerprint column."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, of(F.col(text)))


class _Forest:
    """Union of row numbers; the smallest row of a tree is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _link_square(near: np.ndarray, left: np.ndarray, right: np.ndarray, forest: _Forest) -> None:
    """Join the rows that a square of comparisons links."""
    a, b = np.nonzero(near)
    if len(a) <= 4 * _SQUARE:
        for x, y in zip(left[a].tolist(), right[b].tolist()):
            forest.join(x, y)
        return
    # many links: spread the smallest row number along them until nothing moves, then join stars
    mark_l, mark_r, big = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_l = np.minimum(mark_l, np.where(near, mark_r[None, :], big).min(axis=1))
        new_r = np.minimum(mark_r, np.where(near, new_l[:, None], big).min(axis=0))
        if (new_l == mark_l).all() and (new_r == mark_r).all():
            break
        mark_l, mark_r = new_l, new_r
    for x, y in zip([*left.tolist(), *right.tolist()], [*mark_l.tolist(), *mark_r.tolist()]):
        forest.join(x, y)


def tile_links(fps: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links between rows of two tiles (row numbers, each sorted by population count)."""
    ones = np.bitwise_count(fps).astype(np.int64)
    forest = _Forest(len(fps))
    same = first is second
    for i in range(0, len(first), _SQUARE):
        left = first[i : i + _SQUARE]
        for j in range(i if same else 0, len(second), _SQUARE):
            right = second[j : j + _SQUARE]
            low = max(ones[left[0]], ones[right[0]])
            high = min(ones[left[-1]], ones[right[-1]])
            if low - high > radius:
                continue
            near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
            _link_square(near, left, right, forest)
    for x in range(len(fps)):
        if (root := forest.root(x)) != x:
            yield x, root


def _meetings(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Compare the rows of each unit; rows arrive sorted by unit, tile and population count."""

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows[["meet", "lo", "hi"]].to_numpy()
        fps, tile = rows["fp"].to_numpy().view(np.uint64), rows["tile"].to_numpy()
        edges = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(rows)]
        found: list[tuple[int, int]] = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            lo, hi = unit[s, 1], unit[s, 2]
            first = np.flatnonzero(tile[s:e] == lo)
            second = first if lo == hi else np.flatnonzero(tile[s:e] == hi)
            if len(first) and len(second):
                own = fps[s:e]
                found += [(int(own[x].view(np.int64)), int(own[y].view(np.int64))) for x, y in tile_links(own, first, second, radius)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch.iloc[-1]
        open_unit = (batch["meet"] == last["meet"]) & (batch["lo"] == last["lo"]) & (batch["hi"] == last["hi"])
        if open_unit.all() and held and _same_unit(held[-1], batch):
            held.append(batch)
            continue
        done = pd.concat([*held, batch[~open_unit]], ignore_index=True)
        held = [batch[open_unit]]
        if len(done):
            yield compared(done)
    if held:
        yield compared(pd.concat(held, ignore_index=True))


def _same_unit(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return all(a[c].iloc[-1] == b[c].iloc[0] for c in ("meet", "lo", "hi"))


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that span every pair of distinct fingerprints within ``radius`` bits.

    ``fps``: one row per distinct fingerprint in column ``fp``.
    """
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    meets = F.array(
        *[
            F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) * blocks + i
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )
    keyed = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.explode(meets).alias("meet"))
    cells = keyed.groupBy("meet", "ones").agg(F.count("*").alias("n"))
    tiles = F.map_from_entries(
        F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile_rows).cast("int").alias("n")))  # 65 at most
    )
    crowded = cells.groupBy("meet").agg(F.sum("n").alias("rows"), tiles.alias("tiles"))
    crowded = crowded.filter(F.col("rows") > tile_rows).select("meet", "tiles")
    wide = 1 << 20
    own = F.col("ones") * wide + F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("ones"))).cast("int")
    reach = F.filter(
        F.sequence(F.col("ones") - radius, F.col("ones") + radius),
        lambda q: F.map_contains_key("tiles", q),
    )
    partners = F.flatten(
        F.transform(
            reach,
            lambda q: F.transform(F.sequence(F.lit(0), F.element_at("tiles", q) - 1), lambda u: q * wide + u),
        )
    )
    alone = F.col("tiles").isNull()
    units = (
        keyed.join(crowded, "meet", "left")
        .select(
            "fp",
            "ones",
            "meet",
            F.when(alone, F.lit(0)).otherwise(own).alias("tile"),
            F.when(alone, F.array(F.lit(0))).otherwise(partners).alias("partners"),
        )
        .select("fp", "ones", "meet", "tile", F.explode("partners").alias("partner"))
        .select(
            "fp",
            "ones",
            "meet",
            "tile",
            F.least("tile", "partner").alias("lo"),
            F.greatest("tile", "partner").alias("hi"),
        )
        .repartition("meet", "lo", "hi")
        .sortWithinPartitions("meet", "lo", "hi", "tile", "ones", "fp")
    )
    return units.mapInPandas(lambda it: _meetings(it, radius), "a long, b long").distinct()


def groups(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``fp``, ``component_id``, ``keep_id``, ``keep_fp``: one row per distinct fingerprint.

    ``marked`` has ``id_col`` and ``fp``. ``component_id`` is the smallest id of the component (null ids only
    if it has no other); ``keep_fp`` is the smallest fingerprint among that id's rows.
    """
    smallest = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("fp").alias("fp")))
    fps = stored(marked.groupBy("fp").agg(smallest.alias("first")), "simhash-distinct")
    linked = stored(links(fps.select("fp"), radius), "simhash-links")
    roots = components(linked)
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    first = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    out = rooted.join(first, "root").select(
        "fp",
        F.col("keep.id").alias("component_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("keep.fp").alias("keep_fp"),
    )
    out = stored(out, "simhash-groups")
    for used in (linked, fps):
        drop_stored(marked.sparkSession, used)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, hexadecimal fingerprint and component.

    Null texts and texts without words have fingerprint zero and link like any other; rows with equal ids are
    kept; an empty table gives no rows.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked = stored(fingerprints(marked).select("doc_id", "fp"), "simhash-rows")
    found = groups(marked).select("fp", "component_id")
    return marked.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The columns of ``docs`` for one document of each component: the one with the smallest id.

    ``shingle`` words make a shingle; fingerprints of at most ``radius`` different bits link. Texts are read once for their fingerprints
    and moved once, when the chosen rows are picked; all decisions are taken on ids, fingerprints and digests.

    Null and empty texts have fingerprint zero and are one group; a null id is chosen only in a group without other ids; of rows with
    one id the smallest fingerprint, then the smallest digest of the text stays, and of rows that repeat id and text one, the
    smallest by a digest of its columns. An empty table gives no rows; the names of other columns do not matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    marked = fingerprints(rows.select("doc_id", "key", "text"), shingle=shingle).select("doc_id", "key", "fp")
    marked = stored(marked, "simhash-rows")
    found = groups(marked.select("doc_id", "fp"), radius=radius)
    keep = found.filter(F.col("fp") == F.col("keep_fp")).select("fp", "keep_id")
    candidates = marked.join(keep, "fp").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    counted = candidates.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    least = counted.groupBy("fp", "doc_id").agg(F.min("key").alias("key"), F.min_by("n", "key").alias("n"))
    chosen = stored(least.select(F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"), "n"), "simhash-chosen")
    for used in (marked, found):
        drop_stored(spark, used)
    here = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    picked = rows.drop("text").join(chosen.hint("shuffle_hash"), here)
    out = picked.filter("n = 1").select("row")
    if not chosen.filter("n > 1").isEmpty():
        digest = F.xxhash64(F.to_json("row"))
        one = picked.filter("n > 1").groupBy("keep_id", "keep_key").agg(F.min_by("row", digest).alias("row"))
        out = out.unionByName(one.select("row"))
    return out.select("row.*")
