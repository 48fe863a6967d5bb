"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

The rows of a table are cut into source blocks. How many rows each block sends to each shard is drawn
first, exactly as a uniform shuffle of the whole table would distribute them (a multivariate
hypergeometric draw per block). A random permutation inside each block then decides *which* rows go, and
after the exchange each shard is permuted again. Together this is a uniform shuffle whose shard sizes
are fixed beforehand: they differ by one row at most.

Only identifiers, sizes and hashes move; texts stay where they are. All randomness is a keyed hash of the
row or a seeded draw over stored counts, so a lost executor's work is repeated with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import stored

#: numpy draws exactly below this population; above it the distribution is inverted around its mode.
_NUMPY_POPULATION = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` taken without replacement."""
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < _NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / (good + bad)
    spread = 14 * (mean * bad / (good + bad) + 1) ** 0.5
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    cumulative = np.cumsum(np.exp(log_p - log_p.max()))
    at = np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right")
    return int(k[min(at, len(k) - 1)])


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """``matrix[b, s]``: rows that block ``b`` sends to shard ``s``.

    Row sums are the block sizes, column sums the shard sizes (equal but for one).
    """
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(block_rows), shards), dtype=np.int64)
    for b, rows in enumerate(block_rows):
        pool = sum(left)
        for s in range(shards):
            pool -= left[s]
            sent = _hypergeometric(rng, left[s], pool, rows)
            matrix[b, s] = sent
            left[s] -= sent
            rows -= sent
    return matrix


def _told_apart(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with hashes of their own (``_h``) for those that share one; the numbers (``_row``) were stored with them."""
    shared = stored(rows.groupBy("_h").count().filter("count > 1").select(F.col("_h").alias("_shared")), "shard-repeats")
    if shared.isEmpty():
        return rows.drop("_row")
    met = rows.join(shared, F.col("_h") == F.col("_shared"), "left")
    own = F.when(F.col("_shared").isNull(), F.col("_h")).otherwise(F.xxhash64(F.lit(seed), "_h", "_row"))
    return stored(met.withColumn("_h", own).drop("_row", "_shared"), "shard-rows")


def assign_shards(
    docs: DataFrame,
    key: list[Column],
    carry: list[Column],
    shards: int = 24,
    seed: int = 42,
    rows_per_block: int = 20_000,
    most_blocks: int = 65_536,
) -> DataFrame:
    """``carry`` columns plus ``shard`` and ``slot`` (gapless from 0 in each shard) for every row.

    ``key`` is what makes a row's place random, whatever partition it stands in. Rows with an equal key (repeated rows) take
    the number they were stored under as a part of their key, so they spread over blocks, shards and slots like any other. Null
    keys are hashed as nulls. An empty table gives
    no rows. ``most_blocks`` bounds the matrix on the driver, not the rows: beyond it blocks grow. Columns
    of ``docs`` with clashing names do not matter, since only ``carry`` is kept.
    """
    spark = docs.sparkSession
    names = [f"_c{i}" for i in range(len(carry))]
    kept = [c.alias(n) for c, n in zip(carry, names)]
    hashed = docs.select(*kept, F.xxhash64(F.lit(seed), *key).alias("_h"), F.monotonically_increasing_id().alias("_row"))
    rows = _told_apart(stored(hashed, "shard-rows"), seed)
    total = rows.count()
    blocks = min(most_blocks, max(64, -(-total // rows_per_block)))
    rows = rows.withColumn("_block", F.pmod("_h", F.lit(blocks)).cast("int"))
    counts = dict(rows.groupBy("_block").count().collect())  # one row per block, most_blocks at most
    present = sorted(counts)
    matrix = communication_matrix([counts[b] for b in present], shards, seed)
    bounds = pa.table(
        {
            "_block": pa.array(present, pa.int32()),
            "_bounds": pa.array(list(np.cumsum(matrix, axis=1)), pa.list_(pa.int64())),
        }
    )
    bounds = spark.createDataFrame(bounds)

    def shuffled(by: list[str], salt: int):
        order = F.xxhash64(F.lit(seed + salt), "_h")
        return F.row_number().over(Window.partitionBy(*by).orderBy(order, "_h", *names))

    sent = (
        rows.withColumn("_rank", shuffled(["_block"], 1))
        .join(bounds, "_block")
        .withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))))
    )
    parts = max(4, -(-total // (shards * rows_per_block)))
    sent = sent.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), "_h"), F.lit(parts)).cast("int"))
    sent = stored(sent.select(*names, "_h", "shard", "_part"), "shard-sent")
    starts = sent.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    placed = sent.withColumn("_rank", shuffled(["shard", "_part"], 3)).join(starts, ["shard", "_part"])
    return placed.select(
        *[F.col(n).alias(_name(c, docs)) for n, c in zip(names, carry)],
        F.col("shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"),
    )


def _name(column: Column, docs: DataFrame) -> str:
    return docs.select(column).columns[0]


def document_shards(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """Documents dealt out by the law ``rows``: shard counts are one row apart at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long").alias("size")
    check = F.crc32(text.cast("binary")).alias("text_crc32")
    placed = assign_shards(
        docs, [F.col("doc_id"), F.col("text")], [F.col("doc_id"), size, check], shards, seed
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
