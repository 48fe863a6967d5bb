"""Reward logs: rolling mean and early-stop rules, for runs of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.operators import ordered
from verdigris.session import cut_lineage, store


def positioned(log: DataFrame) -> DataFrame:
    """Reward log ``run_id, ts, reward, step`` with positions by step within each run.

    Points without a reward do not count.
    """
    return ordered.with_positions(log.where(F.col("reward").isNotNull()), ["step", "ts", "reward"], ["run_id"])


def rolling_mean(log: DataFrame, window: int = 10, block: int | None = None) -> DataFrame:
    """Mean of the last ``window`` rewards, fewer at the start of a run."""
    rows, own = ordered.in_blocks(positioned(log), ["run_id"], window - 1, block)
    frame = Window.partitionBy("run_id", "_block").orderBy("pos").rowsBetween(1 - window, 0)
    return rows.withColumn("running_mean", F.avg("reward").over(frame)).where(own).drop("_block")


def _moving_means(placed: DataFrame, window: int, reach: int, block: int | None):
    rows, own = ordered.in_blocks(placed, ["run_id"], reach, block)
    frame = Window.partitionBy("run_id", "_block").orderBy("pos").rowsBetween(1 - window, 0)
    full = F.col("pos") >= window - 1
    return rows.withColumn("ma", F.when(full, F.avg("reward").over(frame))), own


def stop_on_moving_average(
    log: DataFrame,
    window: int = fixed.MOVING_WINDOW,
    patience: int = fixed.MOVING_PATIENCE,
    delta: float = fixed.MOVING_DELTA,
    block: int | None = None,
) -> DataFrame:
    """First step per run where the moving average gained less than ``delta`` in ``patience`` points."""
    rows, own = _moving_means(positioned(log), window, window - 1 + patience, block)
    by_pos = Window.partitionBy("run_id", "_block").orderBy("pos")
    stops = (
        (F.col("pos") >= window - 1 + patience)
        & (F.col("ma") - F.lag("ma", patience).over(by_pos) < delta)
    )
    first = F.min(F.when(F.col("stops"), F.struct("pos", "step")))
    return (
        rows.withColumn("stops", stops)
        .where(own)
        .groupBy("run_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_points"))
        .select("run_id", F.col("first.step").alias("stop_step"), "n_points")
    )


def stop_on_best_window(
    log: DataFrame,
    window: int = fixed.BEST_WINDOW,
    delta: float = fixed.BEST_DELTA,
    patience: int = fixed.BEST_PATIENCE,
    start: int = fixed.BEST_START,
    epoch_length: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """First step per run with ``patience`` points since the window mean last beat its best by ``delta``.

    A point that beats the best so far is also higher than all points before it, so only such
    records can move the best. They are found with running maxima, and the chain through a run's records is followed
    in one pass over them. The counter is the distance to the last improvement. A mean that is not a number moves nothing.
    """
    placed = store(positioned(log), "placed")
    rows, own = _moving_means(placed, window, window - 1, block)
    means = rows.where(own & (F.col("pos") >= window - 1)).select("run_id", "step", "pos", "ma")
    means = store(means.withColumn("ma", F.when(~F.isnan("ma"), F.col("ma"))), "means")
    seen = ordered.with_running_max(means, ["run_id"], "ma", "before", include_current=False, block=block)
    records = seen.where(
        F.col("ma").isNotNull() & (F.col("before").isNull() | (F.col("ma") > F.col("before")))
    ).select("run_id", "pos", "ma")
    improvements = cut_lineage(_improvements(records, delta))
    marked = ordered.match(
        means, improvements.withColumn("improved_at", F.col("pos")), ["run_id", "pos"], "left"
    )
    counted = ordered.with_running_max(
        marked, ["run_id"], "improved_at", "last_improved", include_current=True, block=block
    )
    in_epoch = F.col("pos") % epoch_length if epoch_length else F.col("pos")
    # without any improvement every full window counts
    since = F.col("pos") - F.coalesce("last_improved", F.lit(window - 2))
    stops = (in_epoch >= start) & (since >= patience)
    first = counted.groupBy("run_id").agg(F.min(F.when(stops, F.struct("pos", "step"))).alias("first"))
    runs = placed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_points"))
    return ordered.match(runs, first, ["run_id"], "left").select("run_id", F.col("first.step").alias("stop_step"), "n_points")


def _improvements(records: DataFrame, delta: float) -> DataFrame:
    """Positions where the best moves, from each run's rising records.

    The chain is sequential, so a run's records are read as one sorted stream. They are few unless a reward rises all the
    time; a batch is searched from improvement to improvement, and only the best is carried on.
    """

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, best = None, None
        for batch in batches:
            runs, means = batch["run_id"].to_numpy(), batch["ma"].to_numpy()
            kept = []
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)] if len(runs) else []
            for start, end in zip(edges, edges[1:]):
                if run is None or not _same_run(run[0], runs[start]):
                    run, best = (runs[start],), None
                at = start
                while at < end:
                    if best is not None:
                        at = start + int(np.searchsorted(means[start:end], best + delta, side="right"))
                        if at >= end:
                            break
                    kept.append(at)
                    best = means[at]
                    at += 1
            yield batch.iloc[kept][["run_id", "pos"]]

    sorted_runs = records.repartition("run_id").sortWithinPartitions("run_id", "pos")
    return sorted_runs.mapInPandas(followed, records.select("run_id", "pos").schema)


def _same_run(a, b) -> bool:
    return a == b or (a != a and b != b)
