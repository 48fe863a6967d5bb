"""Order-dependent operators without a global window: positions, slices, splits, blocks.

A window that orders a whole table runs in one task. Here rows are sorted in parts by range, stored once, and counted by part: the
count of earlier parts and the place inside a part give a row's position. Slices need only the n-th key: for a small n
the first keys are taken, for a large one it is looked up in a stored index of keys. Exact splits count a uniform
hash by its leading digits. NULL keys come first, as in an ascending sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import fixed_values as fixed
from verdigris.session import cut_lineage, store

#: Keys that a slice takes to the driver at most; beyond it uses an index.
TAKE_ROWS = 10_000
#: Leading hexadecimal digits of a hash that are counted in one pass of a split.
SPLIT_DIGITS = 3
BLOCK_ROWS = 100_000
HOT_KEYS = 1_000
#: Rows from which a group counts as hot; a task of a shuffle join takes smaller ones as they come.
HOT_ROWS = 1_000
SMALL_ROWS = 10_000
SMALL_BYTES = 8_000_000
_PART_SHIFT = 33  # bits of a row's place inside its task in monotonically_increasing_id


def hash_order(key: Column, seed: int = fixed.SPLIT_SEED) -> Column:
    """A repeatable random order: hex digest of seed and key; a NULL key has one too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, so that rows without a key are kept too."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, equal, how).drop(*[f"_right_{k}" for k in keys])


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and they take at most ``size`` bytes."""
    text = F.octet_length(F.to_json(F.struct("*")))
    measured = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes"))
    found = measured.first()
    return found["rows"] <= rows and found["bytes"] <= size


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """Broadcast hint only after counting rows and bytes of ``df``."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def _same_key(a: Row, b: Row) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def with_positions(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), into: str = "pos", once: bool = True
) -> DataFrame:
    """Add the 0-based position of each row in ``order``, per ``group`` if given.

    ``group + order`` should identify a row. Rows are sorted by range over group and order, so a group of any size spreads over as
    many tasks as it needs, and stored with their place inside the part. Counts per part and group then give each part its
    start; only that small table is joined. Sorting by range looks at its input twice: ``once`` stores the input first, so that
    it is evaluated a single time; leave it out for a plain scan of a stored table.
    """
    rows = store(df, "unsorted") if once else df
    keys = [*group, *order]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = store(rows.withColumn("_id", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_id", _PART_SHIFT).alias("_part")
    parts = rows.groupBy(part, *group).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "_part", *group, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        match(rows.withColumn("_part", part), starts, ["_part", *group])
        .withColumn(into, F.col("_id") + F.col("_shift"))
        .drop("_id", "_part", "_shift")
    )


@dataclass(frozen=True)
class OrderIndex:
    """The distinct keys of a table in order with their number of rows, stored in parts by range, and the rows of each part."""

    order: tuple[str, ...]
    keys: DataFrame
    parts: tuple[tuple[int, int], ...]

    def cut(self, n: int) -> tuple[Row | None, int]:
        """The ``n``-th key, and how many rows with that key belong to the first ``n``; 0 for all of them.

        Counts of parts say which part holds it; only that part is read.
        """
        for part, rows in self.parts:
            if n <= rows:
                break
            n -= rows
        else:
            return None, 0
        so_far = Window.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        inside = self.keys.where(F.col("_part") == part).withColumn("_upto", F.sum("_rows").over(so_far))
        found = inside.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_rows") < n)).first()
        wanted = n - (found["_upto"] - found["_rows"])
        edge = Row(*self.order)(*[found[c] for c in self.order])
        return edge, 0 if wanted == found["_rows"] else wanted


def order_index(df: DataFrame, order: Sequence[str]) -> OrderIndex:
    """An index of ``order`` for slices of ``df``, however many. Rows of one key are counted before keys are sorted."""
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_rows"))
    keys = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    keys = store(keys, "order-index")
    parts = keys.groupBy("_part").agg(F.sum("_rows").alias("n")).collect()  # one row for each shuffle partition
    return OrderIndex(tuple(order), keys, tuple(sorted((r["_part"], r["n"]) for r in parts)))


def _beyond(order: Sequence[str], edge: Row, above: bool) -> Column:
    """Whether a row's key is above (or below) ``edge``, as comparisons that a scan can use."""
    name, rest = order[0], order[1:]
    column, value = F.col(name), edge[name]
    if value is None:
        further, tied = (column.isNotNull() if above else F.lit(False)), column.isNull()
    else:
        further = column > F.lit(value) if above else (column < F.lit(value)) | column.isNull()
        tied = column == F.lit(value)
    return further | (tied & _beyond(rest, edge, above)) if rest else further


def _on(order: Sequence[str], edge: Row) -> Column:
    return reduce(and_, [F.col(name).eqNullSafe(F.lit(edge[name])) for name in order])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _others(df: DataFrame, order: Sequence[str]) -> list[str]:
    """The columns that tell rows with one and the same key apart."""
    return [f.name for f in df.schema.fields if f.name not in order and _orderable(f.dataType)]


def _cut(df: DataFrame, n: int, order: Sequence[str], index: OrderIndex | None) -> tuple[Row | None, int]:
    """The ``n``-th key, and how many rows with that key belong to the first ``n``; 0 for all of them.

    One job for a small ``n`` or with an index at hand.
    """
    if index is None and n > TAKE_ROWS:
        index = order_index(df, order)
    if index is not None and n > TAKE_ROWS // 10:
        return index.cut(n)
    first = df.select(*order).orderBy(*order).limit(n + 1).collect()
    if len(first) < n:
        return None, 0
    edge = first[n - 1]
    if len(first) == n or not _same_key(first[n], edge):
        return edge, 0
    return edge, sum(_same_key(key, edge) for key in first[:n])


def first_rows(df: DataFrame, n: int, order: Sequence[str], index: OrderIndex | None = None) -> DataFrame:
    """Exactly the first ``n`` rows in ``order``, all if there are fewer.

    Rows of the last key are told apart by their other columns in table order; equal rows are alike. Without such
    ties the result is a filter that reaches the scan, and the rows stay where they are. An ``order_index`` of ``df``
    serves several slices.
    """
    if n <= 0:
        return df.where(F.lit(False))
    edge, wanted = _cut(df, n, order, index)
    if edge is None:
        return df
    if not wanted:
        return df.where(~F.coalesce(_beyond(order, edge, above=True), F.lit(False)))
    tied, rest = df.where(_on(order, edge)), _others(df, order)
    head = first_rows(tied, wanted, [*order, *rest]) if rest else tied.limit(wanted)
    return df.where(_beyond(order, edge, above=False)).unionByName(head)


def skip_rows(df: DataFrame, n: int, key: str | Sequence[str], index: OrderIndex | None = None) -> DataFrame:
    """All rows but those that ``first_rows`` gives: a filter above the n-th smallest key, and its ties.

    An ``offset`` without a limit would move the whole table to one task.
    """
    if n <= 0:
        return df
    order = [key] if isinstance(key, str) else list(key)
    edge, wanted = _cut(df, n, order, index)
    if edge is None:
        return df.where(F.lit(False))
    above = df.where(_beyond(order, edge, above=True))
    if not wanted:
        return above
    tied, rest = df.where(_on(order, edge)), _others(df, order)
    return above.unionByName(skip_rows(tied, wanted, [*order, *rest]) if rest else _all_but(tied, wanted))


def _all_but(alike: DataFrame, n: int) -> DataFrame:
    """``n`` rows fewer of a table whose rows are all alike."""
    return alike.limit(max(0, alike.count() - n))


def _split_cut(hashed: DataFrame, key: str, share: float) -> tuple[int, Row | None, int]:
    """How many rows a split wants, the key of the last one, and how many rows of that key belong to it (0 for all).

    Hashes are uniform, so counts by their leading digits (a bounded table) put the cut into a sliver of the rows, and only the sliver's
    keys are sorted. A sliver of too many keys is counted again by its next digits.
    """
    wanted, below, prefix = -1, 0, ""
    while True:
        digits = F.substring("_hash", len(prefix) + 1, SPLIT_DIGITS).alias("d")
        inside = hashed.where(F.col("_hash").startswith(prefix)) if prefix else hashed
        counts = sorted((r["d"], r["n"]) for r in inside.groupBy(digits).agg(F.count(F.lit(1)).alias("n")).collect())
        if wanted < 0:
            wanted = math.ceil(sum(n for _, n in counts) * share)
            if wanted <= 0 or wanted >= sum(n for _, n in counts):
                return wanted, None, 0
        for d, n in counts:
            if below + n >= wanted:
                break
            below += n
        prefix += d
        sliver = hashed.where(F.col("_hash").startswith(prefix)).groupBy("_hash", key).agg(F.count(F.lit(1)).alias("_rows"))
        upto = below
        for row in sliver.orderBy("_hash", key).limit(TAKE_ROWS).collect():
            upto += row["_rows"]
            if upto >= wanted:
                short = wanted - (upto - row["_rows"])
                return wanted, Row("_hash", key)(row["_hash"], row[key]), 0 if upto == wanted else short


def mark_test_rows(
    df: DataFrame, key: str, test_size: float, seed: int = fixed.SPLIT_SEED, into: str = "is_test"
) -> DataFrame:
    """Mark exactly ``ceil(n * test_size)`` rows, chosen by hash order of the key.

    Two jobs find the cut at any size up to tens of millions of rows, two more for every factor of four thousand; marking needs no
    shuffle. Rows that share a key at the cut are told apart by their other columns.
    """
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    wanted, edge, ties = _split_cut(hashed, key, test_size)
    if edge is None:
        return df.withColumn(into, F.lit(wanted > 0))
    order = ["_hash", key]
    above = F.coalesce(_beyond(order, edge, above=True), F.lit(False))
    if not ties:
        return hashed.withColumn(into, ~above).drop("_hash")
    apart = hashed.where(~_on(order, edge)).withColumn(into, ~above)
    tied = hashed.where(_on(order, edge))
    first = first_rows(tied, ties, order).withColumn(into, F.lit(True))
    later = skip_rows(tied, ties, order).withColumn(into, F.lit(False))
    return apart.unionByName(first).unionByName(later).drop("_hash")


def mark_test_rows_by_threshold(
    df: DataFrame, key: str, test_size: float, seed: int = fixed.SPLIT_SEED, into: str = "is_test"
) -> DataFrame:
    """Mark rows whose hash lies below the test share: one pass, size right on average."""
    share = F.conv(F.substring(hash_order(F.col(key), seed), 1, 7), 16, 10).cast("bigint")
    return df.withColumn(into, share < F.lit(int(test_size * 16**7)))


def with_batches(
    df: DataFrame, size: int, order: Sequence[str], into: str = "batch_id", once: bool = True
) -> DataFrame:
    """Add the batch number of each row, ``size`` rows to a batch in ``order``; ``once`` as for ``with_positions``."""
    return (
        with_positions(df, order, into="_pos", once=once)
        .withColumn(into, F.floor(F.col("_pos") / size))
        .withColumn("batch_pos", F.col("_pos") % size)
        .drop("_pos")
    )


def collate(df: DataFrame, columns: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """One row per batch with a list per column, in batch order; a list has one batch's rows."""
    gathered = df.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct("batch_pos", *columns))).alias("_rows")
    )
    return gathered.select(batch, *[F.col("_rows")[c].alias(c) for c in columns])


def in_blocks(
    df: DataFrame, group: Sequence[str], reach: int, block: int | None = None, pos: str = "pos"
) -> tuple[DataFrame, Column]:
    """Cut each group into blocks of positions, with ``reach`` earlier rows copied in as context.

    Returns the rows with a ``_block`` column and the test for a block's own rows. Windows over
    ``group, _block`` then see every row their frame needs, and none is larger than a block.
    """
    block = max(block or BLOCK_ROWS, reach, 1)
    home = F.floor(F.col(pos) / block)
    copied = F.when(F.col(pos) % block >= block - reach, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(copied)), F.col("_block") == home


def with_running_max(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    into: str,
    include_current: bool,
    block: int | None = None,
    pos: str = "pos",
) -> DataFrame:
    """Add the maximum of ``value`` over the earlier rows of the group (and the current one)."""
    own = df.withColumn("_block", F.floor(F.col(pos) / (block or BLOCK_ROWS)))
    peaks = own.groupBy(*group, "_block").agg(F.max(value).alias("_peak"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    peaks = peaks.select(*group, "_block", F.max("_peak").over(before).alias("_carried"))
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        match(own.withColumn("_inside", F.max(value).over(inside)), peaks, [*group, "_block"])
        .withColumn(into, F.greatest("_inside", "_carried"))
        .drop("_block", "_inside", "_carried")
    )


def join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Attach per-group values to rows without moving a hot group.

    A table that is small in rows and bytes is broadcast. Of a larger one, the groups with the most rows, ``HOT_ROWS`` at least, at most
    ``HOT_KEYS`` of them and only if they are small in bytes too, are joined by broadcast; the rest is joined by
    shuffle, where a large partition is split at run time. Without such groups ``df`` is evaluated once.
    """
    fixed_stats = cut_lineage(stats)
    if is_small(fixed_stats, SMALL_ROWS):
        return match(df, F.broadcast(fixed_stats), keys)
    hot = fixed_stats.where(F.col(rows) >= HOT_ROWS).orderBy(F.desc(rows), *keys).limit(HOT_KEYS)
    if hot.isEmpty() or not is_small(hot, HOT_KEYS):
        return match(df, fixed_stats, keys)
    in_hot = match(df, F.broadcast(hot), keys)
    in_rest = match(match(df, F.broadcast(hot.select(*keys)), keys, "left_anti"), fixed_stats, keys)
    return in_hot.unionByName(in_rest)
