import re
from collections import Counter

from verdigris.llm import quality_rules


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeat |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeat),
        len(words) < 50 or 100 * len(repeat) > 50 * len(words),
    )


def base(rows):
    return [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows]


def test_base_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality_rules.quality_verdicts(docs).collect()
    assert base(rows) == [brute(texts[r["doc_id"]]) for r in rows]
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_odd_rows(odd_docs):
    rows = quality_rules.quality_verdicts(odd_docs.withColumnsRenamed({"source": "kept", "n_chars": "row"})).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted(base(rows)) == sorted(map(brute, texts))
    assert all(r["kept"] is not None for r in rows)


def test_empty(docs_of):
    assert quality_rules.quality_verdicts(docs_of([])).collect() == []
    assert quality_rules.passing(docs_of([])).collect() == []


def test_divergent_documents_go(spark, docs_of, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0")
    rows = quality_rules.quality_verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    clean = rows.filter("quality = 1 and not base_failed")
    assert clean.filter("not kept").count() <= 0.01 * clean.count()


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality_rules.passing(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules.passing(docs).columns == docs.columns


def test_distance(spark):
    df = spark.sql("select array(0.5D, 0.5D, 0D) p, array(0.5D, 0D, 0.5D) q, array(1D, 0D, 0D) r, array(0D, 0D, 1D) s")
    row = df.select(
        quality_rules._distance("p", "p").alias("same"),
        quality_rules._distance("r", "s").alias("apart"),
        quality_rules._distance("p", "q").alias("half"),
    ).first()
    assert row["same"] == 0 and abs(row["apart"] - 1) < 1e-12 and abs(row["half"] - 0.5**0.5) < 1e-12


def test_medians_are_exact_at_any_size_and_order(spark):
    """More rows of a language than any sketch holds, against sorted shares; equal at any partitioning."""
    import numpy as np
    from pyspark.sql import functions as F

    n, places = 120_001, (len(quality_rules.CLASSES) + 2, len(quality_rules.COMMON_WORDS) + 1)
    draw = lambda k, top: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(top) * (i % 5) + 1).cast("int"))
    lang = F.when(F.col("id") < 100_001, "en").when(F.col("id") < 120_000, None).otherwise("few")
    counted = spark.range(n).select(lang.alias("lang"), (F.col("id") % 10 == 9).alias("base_failed"), draw(places[0], 997).alias("chars"), draw(places[1], 53).alias("common"))
    rows = counted.filter("NOT base_failed").drop("base_failed").toPandas()
    made = [{r["ref_lang"]: (r["ref_chars"], r["ref_common"]) for r in quality_rules.references(counted.repartition(k)).collect()} for k in (1, 40)]
    assert made[0] == made[1] and set(made[0]) == {"en", None}
    for key, got in made[0].items():
        own = rows[rows["lang"].isna() if key is None else rows["lang"] == key]
        for name, ours in zip(("chars", "common"), got):
            x = np.stack(own[name].to_numpy()).astype(float)
            shares = np.floor(x / x.sum(axis=1, keepdims=True) * quality_rules.BINS)
            middle = np.sort(shares, axis=0)[(len(x) + 1) // 2 - 1] / quality_rules.BINS
            assert np.allclose(ours, middle / middle.sum(), atol=1e-12)
