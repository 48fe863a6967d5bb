"""Online early stop: the moving-average rule as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris import fixed_values as fixed
from verdigris.operators import ordered
from verdigris.operators.monitor import stop_on_moving_average
from verdigris.streaming.runs import run_available

STATE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("recent", T.ArrayType(T.DoubleType())),
        T.StructField("means", T.ArrayType(T.DoubleType())),
        T.StructField("stop_step", T.LongType()),
        T.StructField("last_step", T.LongType()),
        T.StructField("n_late", T.LongType()),
    ]
)
COUNTS = [T.StructField(name, T.LongType()) for name in ("n_points", "stop_step", "n_late")]


def _mean(rewards: deque) -> float:
    """The mean as an aggregate over a window adds it, oldest reward first: ``sum`` corrects its rounding, which decides other ties."""
    total = 0.0
    for reward in rewards:
        total += reward
    return total / len(rewards)


def early_stop_stream(
    log: DataFrame,
    window: int = fixed.MOVING_WINDOW,
    patience: int = fixed.MOVING_PATIENCE,
    delta: float = fixed.MOVING_DELTA,
) -> DataFrame:
    """Stream ``run_id, step, reward`` to each run's point count, stop step and late points so far.

    Run ids are of any type that can be grouped; points of a null run are one run. State per run is the last ``window`` rewards and
    ``patience + 1`` means, whatever the length of the run. A micro-batch of a run is read chunk by chunk, and of each point only step
    and reward are kept until they are sorted; the source's bytes-per-trigger limit bounds how many one batch brings. A point that is not after the last step of an earlier batch is late: it is counted as such and
    changes nothing, so a run without late points has the batch rule's result. Points without a reward or a step are skipped.
    """

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, recent, means, stop, last, late = state.get if state.exists else (0, [], [], None, None, 0)
        recent, means = deque(recent, window), deque(means, patience + 1)
        steps, rewards = [], []
        for chunk in chunks:
            given = chunk["reward"].notna().to_numpy() & chunk["step"].notna().to_numpy()
            step = chunk["step"].to_numpy()[given].astype(np.int64)
            fresh = step > last if last is not None else np.ones(len(step), dtype=bool)
            late += int((~fresh).sum())
            steps.append(step[fresh])
            rewards.append(chunk["reward"].to_numpy()[given][fresh].astype(float))
        order = np.argsort(np.concatenate(steps), kind="stable")
        for step, reward in zip(np.concatenate(steps)[order].tolist(), np.concatenate(rewards)[order].tolist()):
            n, last = n + 1, step
            recent.append(reward)
            if len(recent) < window:
                continue
            means.append(_mean(recent))
            if stop is None and len(means) > patience and means[-1] - means[0] < delta:
                stop = last
        state.update((n, list(recent), list(means), stop, last, late))
        yield pd.DataFrame(
            {"run_id": [key[0]], "n_points": [n], "stop_step": pd.array([stop], dtype="Int64"), "n_late": [late]}
        )

    output = T.StructType([T.StructField("run_id", log.schema["run_id"].dataType), *COUNTS])
    return log.groupBy("run_id").applyInPandasWithState(
        advance, output, STATE, "update", GroupStateTimeout.NoTimeout
    )


def early_stop_available(points: DataFrame, log: DataFrame, **rule) -> DataFrame:
    """Stop step and point count of each run over all that a source holds now, in whatever order its files come.

    ``log`` is the source of the stream ``points`` read as a table. Files come by the time of their last change, which need not be the order of
    steps: runs of which the stream counted late points are done by the batch rule, and only their rows are read for it.
    """
    rows = run_available(early_stop_stream(points, **rule), ["run_id"])
    late = rows.where("n_late > 0").select("run_id")
    if late.isEmpty():
        return rows.drop("n_late")
    again = ordered.match(log.where(F.col("step").isNotNull()), late, ["run_id"], "left_semi")
    stops = stop_on_moving_average(again.withColumn("ts", F.lit(0.0)), **rule)
    return rows.where("n_late = 0").drop("n_late").unionByName(stops)
