"""Dataset registry: name to files, split rule and preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import fixed_values as fixed
from verdigris.operators import prepare
from verdigris.sources import schemas


def split_of(name: str, split: str) -> str:
    """Three datasets are validated on their test part."""
    task = prepare.task_of(name)
    return "test" if split == "validation" and task in fixed.TEST_FOR_VALIDATION else split


def read_raw(
    spark: SparkSession, root: str, name: str, split: str, fmt: str = "parquet", amount: int = -1
) -> DataFrame:
    """Raw rows under ``root/<dataset>/<split>``, lazily, with the dataset's schema.

    Formats: ``parquet``, ``json`` (lines) and ``json_array`` (files that hold one array each). Rows need an order. Files
    may carry ``ord`` (and ``sample_id``); where they do not, the place of a row in its file, and of the file by name,
    gives both. A key that is present but NULL in some row is replaced the same way. With an ``amount``, Parquet files in
    the order of their names are opened only as far as they hold the first ``amount`` rows.
    """
    task = prepare.task_of(name)
    schema = schemas.RAW[task]
    path = f"{root}/{task}/{split_of(name, split)}"
    if fmt == "parquet":
        rows = spark.read.parquet(path)
        rows = with_order(rows if "ord" in rows.columns or amount < 0 else first_files(rows, amount))
    else:
        rows = _read_json(spark, path, schema, fmt)
    return as_lists(rows, schema).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def first_files(rows: DataFrame, amount: int) -> DataFrame:
    """A Parquet scan of the first files by name that together hold ``amount`` rows.

    Footers are counted for one file, then two, four and so on, so that no more than about twice the files needed are looked at.
    """
    spark, files, opened = rows.sparkSession, sorted(rows.inputFiles()), 1
    read = lambda n: spark.read.schema(rows.schema).parquet(*files[:n])
    while opened < len(files) and read(opened).count() < amount:
        opened *= 2
    if opened >= len(files):
        return rows
    counts = read(opened).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < max(1, amount)).count()
    return read(needed)


def with_order(rows: DataFrame) -> DataFrame:
    """Give scanned Parquet rows ``ord`` and ``sample_id`` where they have none.

    Rows are counted per file; a row's order is the start of its file plus its index there. No row moves.
    """
    if {"ord", "sample_id"} <= set(rows.columns):
        return rows
    if "ord" not in rows.columns:
        counts = rows.groupBy(F.col("_metadata.file_path").alias("_unit")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("first"))
        placed = rows.select("*", F.col("_metadata.file_path").alias("_of"), F.col("_metadata.row_index").alias("_place"))
        rows = _numbered(placed, counts)
    return rows if "sample_id" in rows.columns else rows.withColumn("sample_id", F.col("ord"))


def _numbered(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """``ord`` from the place in a unit (a file, or a part of one) and the rows in the units before it.

    ``counts`` has a row per unit: ``_unit, n`` rows, and the ``first`` place. The sums stay a table, joined by its size.
    """
    before = Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_unit", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_start"))
    return (
        placed.join(starts, F.col("_of") == F.col("_unit"))
        .withColumn("ord", F.col("_start") + F.col("_place"))
        .drop("_of", "_unit", "_place", "_start")
    )


def _relaxed(kind: T.DataType) -> T.DataType:
    """A schema that takes a list of texts as its JSON text, so that a plain text is read too."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.StringType() if isinstance(kind.elementType, T.StringType) else T.ArrayType(_relaxed(kind.elementType))
    return kind


def _listed(value: Column, kind: T.DataType) -> Column:
    """Undo ``_relaxed``: the JSON text of a list becomes the list, any other text a list of one."""
    if isinstance(kind, T.StructType):
        parts = F.struct(*[_listed(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        read = F.when(value.startswith("["), F.from_json(value, T.ArrayType(T.StringType())))
        return F.coalesce(read, F.when(value.isNotNull(), F.array(value)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _listed(v, kind.elementType))
    return value


def _read_json(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """JSON rows in the order of their files.

    A scan task reads parts of files in order, so ids that grow in a task number the rows of one part.
    """
    relaxed = T.StructType([T.StructField(f.name, _relaxed(f.dataType)) for f in schema.fields])
    rows = spark.read.schema(relaxed).option("multiLine", fmt == "json_array").json(path)
    part = F.concat_ws(
        "#", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    )
    placed = rows.withColumnRenamed("ord", "_ord").select(
        "*", part.alias("_of"), F.monotonically_increasing_id().alias("_place")
    )
    counts = placed.groupBy(F.col("_of").alias("_unit")).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    numbered = _numbered(placed, counts)
    order = F.coalesce("_ord", "ord")
    fields = [_listed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields if f.name not in ("ord", "sample_id")]
    return numbered.select(F.coalesce("sample_id", order).alias("sample_id"), order.alias("ord"), *fields)


def as_lists(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Turn a plain string into a list of one where the schema wants a list."""
    for field in schema.fields:
        wants_list = isinstance(field.dataType, T.ArrayType)
        if wants_list and isinstance(df.schema[field.name].dataType, T.StringType):
            df = df.withColumn(field.name, F.when(F.col(field.name).isNotNull(), F.array(field.name)))
    if "annotations" in df.columns:
        answers = df.schema["annotations"].dataType["short_answers"].dataType.elementType
        if isinstance(answers["text"].dataType, T.StringType):
            df = df.withColumn(
                "annotations",
                F.struct(
                    F.transform("annotations.short_answers", lambda a: F.struct(F.array(a["text"]).alias("text"))).alias(
                        "short_answers"
                    )
                ),
            )
    return df


def load_dataset(
    spark: SparkSession,
    root: str,
    name: str,
    split: str,
    amount: int = -1,
    full_prompt: bool = False,
    fmt: str = "parquet",
) -> DataFrame:
    """Prepared samples of a dataset by any of its names."""
    return prepare.load_samples(read_raw(spark, root, name, split, fmt, amount), name, amount, full_prompt)


def load_prompt_pairs(spark: SparkSession, rewrites: str, ratings: str) -> DataFrame:
    """Both training sets, mapped and joined; a missing source fails the job at once."""
    from verdigris.operators.training import match_and_union, rating_pairs, rewrite_pairs

    return match_and_union(
        rewrite_pairs(spark.read.schema(schemas.REWRITE_PAIRS).parquet(rewrites)),
        rating_pairs(spark.read.schema(schemas.RATED_PROMPTS).parquet(ratings)),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A test table. ``spread`` gives a scan with fewer splits than cores one per core."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
