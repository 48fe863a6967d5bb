"""Frames of the judge requests; the rubric is the user's.

A frame is what a request and its answer must agree on: the fields shown and the JSON keys and range asked for. What
is good or bad is said by a rubric, one text per request kind, which every request needs and which goes in front of its frame.
To find recorded generations again, pass the rubric that they were asked with.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

FRAMES = {
    "prompt_quality": (
        'Answer with one JSON object only: {"explanation": "<text>", "score": <number from 0 to 5>}\n'
        '[QUERY]: "{query}"\n[REWRITTEN QUERY]: "{rewritten_query}"\nEvaluation:'
    ),
    "answer": (
        'Answer with one JSON object only: {"explanation": "<text>", "score": <0 or 1>}\n'
        '[QUERY]: "{query}"\n[RESPONSE]: "{final_answer}"\n[REFERENCE]: "{target_answers}"\nEvaluation:'
    ),
    "summary": (
        'Answer with one JSON object only: {"explanation": "<text>", "score": <number from 1 to 5>}\n'
        '[QUERY]: "{query}"\n[RESPONSE]: "{final_answer}"\n[REFERENCE]: "{target_answers}"\nEvaluation:'
    ),
    "pairwise": (
        'Answer with one JSON object only: {"selection": <1 or 2>, "explanation": "<text>"}\n'
        "[ORIGINAL]\n{original}\n[REFERENCE]\n{reference}\n[OPTION 1]\n{option_1}\n[OPTION 2]\n{option_2}\nEvaluation:"
    ),
    "candidate": "[ORIGINAL QUERY]: {original_query}\n\n[REFERENCE ANSWER]: {reference_answer}\n",
}
FRAMES["test_answer"] = FRAMES["answer"]


def templates(rubrics: Mapping[str, str]) -> dict[str, str]:
    """Request templates of the given rubrics, by kind."""
    unknown = set(rubrics) - set(FRAMES)
    if unknown:
        raise ValueError(f"unknown templates: {sorted(unknown)}")
    return {kind: f"{rubric}\n\n{FRAMES[kind]}" for kind, rubric in rubrics.items()}


def read_rubrics(spark: SparkSession, folder: str) -> dict[str, str]:
    """The ``<kind>.txt`` files of a folder that Spark can read."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    rows = files.select("_metadata.file_name", "value").limit(len(FRAMES) + 1).collect()
    return {PurePosixPath(r["file_name"]).stem: r["value"] for r in rows}
