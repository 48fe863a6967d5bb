"""Log readers and writers. A log is a directory, so that many tasks can append to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources import schemas

# Quotes are doubled inside quoted fields; texts keep their spaces and line breaks.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: A log without line breaks inside texts is cut at them, so that many tasks read one file.
LINE_OPTIONS = {**CSV_OPTIONS, "lineSep": "\n"}


def escaped_breaks(text: Column) -> Column:
    """A text on one line: line feeds, carriage returns and backslashes as two characters each."""
    for sign, pair in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(pair))
    return text


def restored_breaks(text: Column) -> Column:
    """The text that ``escaped_breaks`` made one line of."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.array_join(parts, "\\")


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number as text with ``digits`` decimals; ties of the decimal form go to the even digit.

    What has no such form, as NaN and numbers of more than twenty digits, is written as it is.
    """
    rounded = F.bround(value.try_cast("decimal(38,18)"), digits)
    return F.coalesce(rounded.cast(f"decimal(38,{digits})").cast("string"), value.cast("string"))


def write_results(results: DataFrame, path: str) -> None:
    """Append ``name, accuracy, f1, rouge, judge`` rows, metrics with four decimals."""
    columns = zip(("accuracy", "f1", "rouge", "judge"), schemas.RESULTS_LOG.names[1:])
    results.select(
        F.col("name").alias("Name"), *[fixed_decimals(F.col(c), 4).alias(title) for c, title in columns]
    ).write.mode("append").options(**CSV_OPTIONS).csv(path)


def write_sample_log(samples: DataFrame, path: str, breaks: str = "kept", rows_per_file: int = 100_000) -> None:
    """Append scored samples, scores with two decimals, one folder per ``run_name``.

    Texts keep their line breaks, as other readers of the log expect. With ``breaks="escaped"`` every sample takes one line, and
    files of any size are read by many tasks. Either way a file has ``rows_per_file`` samples at most.
    """
    titles = schemas.SAMPLE_LOG.names
    texts = zip(("original", "rewrite", "final_answer"), titles[:3])
    scores = zip(("accuracy", "judge"), titles[3:])
    lines = _one_line(breaks)
    samples.select(
        "run_name",
        *[(escaped_breaks(F.col(c)) if lines else F.col(c)).alias(title) for c, title in texts],
        *[fixed_decimals(F.col(c), 2).alias(title) for c, title in scores],
    ).write.mode("append").partitionBy("run_name").options(
        **(LINE_OPTIONS if lines else CSV_OPTIONS), maxRecordsPerFile=rows_per_file
    ).csv(path)


def _one_line(breaks: str) -> bool:
    if breaks not in ("kept", "escaped"):
        raise ValueError(f"breaks must be 'kept' or 'escaped', not {breaks!r}")
    return breaks == "escaped"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS_LOG).options(**CSV_OPTIONS, multiLine="true").csv(path)


def read_sample_log(spark: SparkSession, path: str, answer_as: str | None = None, breaks: str = "kept") -> DataFrame:
    """Sample log of one run or of all runs, with the answer column renamed if asked.

    ``breaks`` says how the log was written. Kept line breaks may stand anywhere in a file, so it is read as a whole; escaped
    ones let many tasks read a file.
    """
    reader = spark.read.schema(schemas.SAMPLE_LOG)
    if _one_line(breaks):
        log = reader.options(**LINE_OPTIONS).csv(path)
        log = log.withColumns({title: restored_breaks(F.col(f"`{title}`")) for title in schemas.SAMPLE_LOG.names[:3]})
    else:
        log = reader.options(**CSV_OPTIONS, multiLine="true").csv(path)
    return log.withColumnRenamed("Final Answer", answer_as) if answer_as else log


def read_reward_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless log of ``timestamp reward step`` separated by any white space."""
    parts = F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ")
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "\\s+", " ")) != "")
    return lines.select(
        *[parts.getItem(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.REWARD_LOG.fields)]
    )


def write_reward_log(log: DataFrame, path: str) -> None:
    log.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in schemas.REWARD_LOG.names])).write.mode(
        "append"
    ).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema, array_file: bool = False) -> DataFrame:
    """JSON lines, or files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", array_file).json(path)
