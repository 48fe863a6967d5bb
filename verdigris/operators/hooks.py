"""Batch generation hook: a user's ``list[str] -> list[str]`` run in Arrow batches, with a ledger of what was answered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators import ordered
from verdigris.operators.prompts import request_id
from verdigris.session import cut_lineage, store

Backend = Callable[[list[str]], list[str]]

#: Requests that one task asks and commits together, about.
COMMIT_ROWS = 2_000
#: Bytes of prompts, about, that a task holds as Python texts at once.
ASK_BYTES = 2_000_000
LEDGER = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]
)


def _ask(backend: Backend, prompts: list[str]) -> tuple[list[str], list[str | None]]:
    """Texts and errors of prompts asked together; after a failure each half is asked on its own.

    One bad prompt among n costs about 2 log2(n) more calls, and no good prompt is asked more than log2(n) times.
    """
    try:
        texts = list(backend(prompts))
        if len(texts) != len(prompts):
            raise ValueError("backend returned another number of texts")
        return texts, [None] * len(prompts)
    except Exception as failure:
        if len(prompts) == 1:
            return [""], [str(failure)]
    half = len(prompts) // 2
    first, second = _ask(backend, prompts[:half]), _ask(backend, prompts[half:])
    return first[0] + second[0], first[1] + second[1]


def _portions(batch: pa.RecordBatch, prompt: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``ASK_BYTES`` of prompts each; a longer prompt is one of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_numpy(zero_copy_only=False)
    portion = np.cumsum(sizes, dtype=np.int64) // ASK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def generate(
    requests: DataFrame,
    prompt: str,
    make_backend: Callable[[], Backend],
    into: str = "text",
    error: str = "error",
    batch_size: int | None = None,
) -> DataFrame:
    """Run a backend over the prompts of each partition.

    ``make_backend`` is called once per task, so a client is opened where it is used. ``batch_size`` bounds the prompts of one call; so
    does ``ASK_BYTES`` of an Arrow batch, the only part of it that is made Python texts: the columns of the requests are handed
    on as they came, and a worker's memory does not grow with its task. Prompts of a call that fails are halved until
    the failing prompts are found; a failing prompt gives '' and its error.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField(into, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make_backend()
        for batch in batches:
            for part in _portions(batch, prompt):
                prompts = part.column(prompt).to_pylist()
                step = batch_size or max(1, len(prompts))
                texts, errors = [], []
                for start in range(0, len(prompts), step):
                    found = _ask(backend, prompts[start : start + step])
                    texts += found[0]
                    errors += found[1]
                kind = part.column(prompt).type  # a text is of one kind in all columns
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, kind), pa.array(errors, kind)], names=schema.names)

    return requests.mapInArrow(run, schema)


def _distinct_requests(df: DataFrame, prompt: str, params: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``request_id``, and each request once with its prompt and number of rows."""
    keyed = df.withColumn("request_id", request_id(F.col(prompt), params))
    return keyed, keyed.groupBy("request_id").agg(F.min(prompt).alias(prompt), F.count(F.lit(1)).alias("_rows"))


def generate_distinct(
    df: DataFrame, prompt: str, make_backend: Callable[[], Backend], params: str = "", into: str = "text"
) -> DataFrame:
    """As ``generate``, asking each distinct request once.

    The answers are stored before they are joined back, so that no request is asked twice, and
    a prompt that many rows share is joined by broadcast.
    """
    keyed, asked = _distinct_requests(df, prompt, params)
    answers = cut_lineage(generate(asked, prompt, make_backend, into).drop(prompt))
    return ordered.join_group_stats(keyed, answers, ["request_id"], "_rows").drop("_rows")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Answers and errors that were committed to a ledger folder so far; none if it is not there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def generate_resumable(
    df: DataFrame,
    prompt: str,
    make_backend: Callable[[], Backend],
    ledger: str,
    params: str = "",
    into: str = "text",
    error: str = "error",
    batch_size: int | None = None,
    commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """As ``generate_distinct``, with answers that outlive a lost task and a lost job.

    Distinct requests are dealt to tasks of about ``commit_rows``, and each task commits its answers to the folder ``ledger`` (in
    shared storage) when it ends. A task that is repeated asks its own requests again and no others; a job that is started
    again asks only what the ledger lacks. Requests that failed are asked again by the next job; until one of them succeeds
    they give '' and the latest error. A request that was committed twice counts once, with its smallest text.
    """
    spark = df.sparkSession
    keyed, asked = _distinct_requests(df, prompt, params)
    answered = read_ledger(spark, ledger).where(F.col("error").isNull()).select("request_id")
    missing = store(asked.join(answered, "request_id", "left_anti").drop("_rows"), "missing-requests")
    rows = missing.count()
    if rows:
        dealt = missing.repartition(-(-rows // commit_rows), "request_id")
        made = generate(dealt, prompt, make_backend, "text", "error", batch_size).select(*LEDGER.names)
        # version 2 of the committer publishes the file of a task when the task commits, not when the job does
        made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    good = F.col("error").isNull()
    known = read_ledger(spark, ledger).groupBy("request_id").agg(
        F.min(F.when(good, F.col("text"))).alias(into), F.max(F.when(~good, F.col("error"))).alias(error)
    )
    answers = asked.select("request_id", "_rows").join(known, "request_id", "left")
    answers = answers.withColumn(error, F.when(F.col(into).isNull(), F.col(error))).fillna("", [into])
    return ordered.join_group_stats(keyed, answers, ["request_id"], "_rows").drop("_rows")


def recorded(
    df: DataFrame, generations: DataFrame, prompt: str, params: str = "", into: str = "text", distinct: bool = False
) -> DataFrame:
    """Join recorded generations ``request_id, text``; a missing one is an empty answer.

    A request recorded more than once counts once, with its smallest text. Requests that many rows share
    do not move those rows. ``distinct`` says that a request is recorded once, as in a generation store, whose texts
    then stay in their buckets: only the ids that are asked for are shuffled.
    """
    keyed = df.withColumn("request_id", request_id(F.col(prompt), params))
    found = generations if distinct else generations.groupBy("request_id").agg(F.min("text").alias("text"))
    asked = keyed.groupBy("request_id").agg(F.count(F.lit(1)).alias("_rows"))
    answers = asked.join(found.select("request_id", F.col("text").alias(into)), "request_id", "left")
    answers = answers.withColumn(into, F.coalesce(into, F.lit("")))
    return ordered.join_group_stats(keyed, answers, ["request_id"], "_rows").drop("_rows")
