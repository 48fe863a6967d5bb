"""The corpus pipeline over ``documents``: classify, apply rules, drop near copies, cut repeated passages, pack.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of
``documents``; the last returns the packed pieces. ``run`` writes each result as Parquet below
``spark.checkpoint.dir`` and reads it back for the next stage. What a stage stored on its way is deleted when the next one starts,
unless its documents still read it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import packing, quality_classifier, quality_rules, simhash, substring
from verdigris.llm.common import drop_paths, drop_stored, steps_into, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of steps that the latest stages stored.
_steps: list[str] = []


def _drop_finished(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the steps of earlier stages that ``docs`` does not read."""
    read = {name.rpartition("/")[0].rpartition("/")[2] for name in docs.inputFiles()}
    finished = [path for path in _steps if path.rpartition("/")[2] not in read]
    drop_paths(spark, finished)
    _steps[:] = [path for path in _steps if path not in finished]


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what is left of the stages before it."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop_finished(spark, docs)
        with steps_into(_steps):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


@_stage
def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.deduplicated(docs)


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere; ``n_chars`` follows the text."""
    return substring.cleaned(docs, length="n_chars")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their place in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]

#: The classifier's fit, the fingerprints and the tokenizer have no SQL form; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not given:
            drop_stored(spark, before)
    _drop_finished(spark, docs)
    return docs
