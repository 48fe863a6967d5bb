"""Explicit schemas of every input and log."""

from pyspark.sql import types as T

from verdigris import fixed_values as fixed

_ORDER = [T.StructField("sample_id", T.LongType()), T.StructField("ord", T.LongType())]
_TEXTS = T.ArrayType(T.StringType())


def _raw(*fields: T.StructField) -> T.StructType:
    return T.StructType([*_ORDER, *fields])


RAW = {
    "nq": _raw(
        T.StructField("question", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField(
            "annotations",
            T.StructType(
                [T.StructField("short_answers", T.ArrayType(T.StructType([T.StructField("text", _TEXTS)])))]
            ),
        ),
    ),
    "cnndm": _raw(T.StructField("article", T.StringType()), T.StructField("highlights", T.StringType())),
    "gsm8k": _raw(T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())),
    "hotpot": _raw(
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("context", T.StructType([T.StructField("sentences", T.ArrayType(_TEXTS))])),
    ),
    "scitldr": _raw(T.StructField("source", _TEXTS), T.StructField("target", _TEXTS)),
}


REWRITE_PAIRS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("original_prompt", T.StringType()),
        T.StructField("analysis", T.StringType()),
        T.StructField("optimized_prompt", T.StringType()),
    ]
)
RATED_PROMPTS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("avg_rating", T.DoubleType()),
    ]
)
REFERENCE_SAMPLES = T.StructType(
    [
        *_ORDER,
        T.StructField("prompt", T.StringType()),
        T.StructField("original", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("original_query", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
    ]
)
CURATED_PROMPTS = T.StructType(
    [
        T.StructField("original_query", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("candidate_prompt", T.StringType()),
        T.StructField("final_answer_first", T.StringType()),
        T.StructField("final_answer_second", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("rouge_score", T.DoubleType()),
    ]
)
RESULTS_LOG = T.StructType(
    [T.StructField(name, T.StringType() if name == "Name" else T.DoubleType()) for name in fixed.RESULT_COLUMNS]
)
_SCORES = ("Accuracy", "LLM-as-a-judge reward")
SAMPLE_LOG = T.StructType(
    [T.StructField(name, T.DoubleType() if name in _SCORES else T.StringType()) for name in fixed.SAMPLE_COLUMNS]
)
REWARD_LOG = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
    ]
)
