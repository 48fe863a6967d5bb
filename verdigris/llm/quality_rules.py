"""Quality rules by distribution divergence, in DataFrame functions only.

A document first passes two base rules (enough words, not mostly repeated three-word windows). What passes is
compared with its language: the share of character classes and the share of common words are held against the
median shares of all base-passing documents of that language by the Jensen-Shannon distance (base 2, so
from 0 to 1). Short documents are noisy, so each comparison has a least length and a limit that widens with the
inverse root of the length; a language with few documents gives no reference and no verdict.

Everything about one document is computed inside its row, without a shuffle; the references are one grouped aggregate
per language (medians, since a mean would drift toward the documents that it should tell apart). Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import NOT_SPACE, SPACES, stored, words

# Frequent function words of four languages. They count in lower case and with a capital.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with by "
    "der die und den von zu das mit sich des auf für ist im dem nicht "
    "de la le et les un du en une que est pour qui dans au sur "
    "el y los del se las por con no al lo su es para una como"
).split()
COMMON_WORDS = list(dict.fromkeys(COMMON_WORDS))
SYMBOLS = "[#*$%&|<>]"
#: Character classes after the symbols: upper case, digits, marks and what is none of these nor lower case. The rest of the
#: words is lower case, the largest class, so that no pattern has to match most of a text.
CLASSES = (
    r"\p{Lu}+",
    r"\p{Nd}+",
    r"[.,;:!?'\"()\[\]-]+",
    r"[^\p{Lu}\p{Ll}\p{Nd}.,;:!?'\"()\[\]#*$%&|<>\x20\x09-\x0D-]+",
)

MIN_WORDS = 50
MIN_CHARS = 200  # of words, for the character comparison
MIN_COMMON_WORDS = 100  # words of the document, for the word comparison
MIN_REFERENCE_DOCS = 20
CHAR_LIMIT, CHAR_NOISE = 0.13, 2.0
WORD_LIMIT, WORD_NOISE = 0.40, 0.5

FEW_REPEATS = 32
#: Shares are counted in bins of this width's inverse for the medians: exact counts, at any size and in any order of rows.
BINS = 100_000

_CODES = "".join(chr(48 + i) for i in range(len(COMMON_WORDS)))  # one character for each common word
_COMMON_FORMS = [form for w in COMMON_WORDS for form in dict.fromkeys((w, w.capitalize()))]


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def with_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang``, the base counts, ``chars`` and ``common`` histograms."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.struct("*").alias("row"), F.col(lang).alias("lang"), body.alias("body"))
    split = split.select("*", words(F.col("body")).alias("words")).select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("body").alias("chars_all"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
    )
    # a hashed membership test first; only the few words that pass are looked up in the list
    listed = F.array(*[F.lit(w) for w in COMMON_WORDS])
    frequent = F.filter("words", lambda w: w.isin(_COMMON_FORMS))
    code = F.transform(frequent, lambda w: F.substr(F.lit(_CODES), F.array_position(listed, F.lower(w)), F.lit(1)))
    hashes = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    counted = split.select(
        "row",
        "lang",
        "n_words",
        "word_chars",
        (F.col("chars_all") - _without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
        *[(F.col("chars_all") - _without(F.col("body"), c)).alias(f"class{k}") for k, c in enumerate(CLASSES)],
        F.array_join(code, "").alias("codes"),
    )
    # most texts repeat no window at all or a few; only the others are sorted with their positions
    counted = counted.select(
        "*", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).alias("sorted")
    )
    counted = counted.select(
        "*", F.array_distinct(F.filter("sorted", lambda x, j: x == F.get("sorted", j - 1))).alias("again")
    )
    positions = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    counted = counted.select("*", F.when(F.size("again") > FEW_REPEATS, F.sort_array(positions)).alias("w"))
    many = F.transform(
        F.filter("w", lambda x, j: (x["h"] == F.get("w", j - 1)["h"]) | (x["h"] == F.get("w", j + 1)["h"])),
        lambda x: x["i"],
    )
    few = F.filter(
        F.transform("h", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull()
    )
    starts = F.when(F.col("w").isNotNull(), many).when(F.size("again") > 0, few)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    classes = [F.col("n_symbols"), *[F.col(f"class{k}") for k in range(len(CLASSES))]]
    lower = functools.reduce(operator.sub, classes, F.col("word_chars"))
    hits = [F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit(""))) for c in _CODES]
    rest = F.col("n_words").cast("int") - F.length("codes")
    return counted.select(
        "row",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.when(starts.isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(F.array(*classes, F.greatest(lower, F.lit(0))), lambda n: n.cast("int")).alias("chars"),
        F.transform(F.array(rest, *hits), lambda n: n.cast("int")).alias("common"),
    ).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return F.transform(counts, lambda n: F.when(total > 0, n / total).otherwise(0.0))


def _distance(shares: str, reference: str) -> Column:
    """Jensen-Shannon distance of two share arrays."""

    def part(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        of = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
        return (of(p) + of(q)) / 2

    total = F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(counted: DataFrame) -> DataFrame:
    """Median shares per language over the documents that pass the base rules, scaled to one; a row per language.

    Documents are counted by language, place and bin of the share, so what is shuffled and sorted is bounded by the bins. The median is the
    lower one. Shares of zero are not counted: a place whose other shares do not reach the middle has median zero.
    """
    places = len(CLASSES) + 2, len(_CODES) + 1
    passed = counted.filter(~F.col("base_failed")).select("lang", F.concat(_shares("chars"), _shares("common")).alias("x"))
    in_bins = F.transform("x", lambda x, i: F.struct(i.alias("place"), F.floor(x * BINS).cast("int").alias("bin")))
    cells = (
        passed.select("lang", F.explode(F.filter(in_bins, lambda c: c["bin"] > 0)).alias("cell"))
        .groupBy("lang", "cell.place", "cell.bin")
        .agg(F.count("*").alias("n"))
    )
    sizes = counted.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("docs"))
    sizes = sizes.filter(F.col("docs") >= MIN_REFERENCE_DOCS)
    from_top = Window.partitionBy("lang", "place").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("down_to", F.sum("n").over(from_top))
    rank = F.col("docs") - F.floor((F.col("docs") + 1) / 2) + 1  # of the lower median, counted from the top
    middle = (
        ranked.join(sizes, F.col("lang").eqNullSafe(F.col("of")), "right")
        .groupBy("of")
        .agg(F.collect_list(F.when((F.col("down_to") >= rank) & (F.col("down_to") - F.col("n") < rank), F.struct("place", "bin"))).alias("m"))
        .select("of", F.map_from_entries("m").alias("m"))
    )
    at = lambda i: F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0)) / BINS
    medians = middle.select(
        F.col("of").alias("ref_lang"),
        F.array(*[at(i) for i in range(places[0])]).alias("chars"),
        F.array(*[at(places[0] + i) for i in range(places[1])]).alias("common"),
    )
    return medians.select("ref_lang", _shares("chars").alias("ref_chars"), _shares("common").alias("ref_common"))


def judged(counted: DataFrame) -> DataFrame:
    """``counted`` plus both distances (null without a reference) and ``kept``."""
    refs = stored(references(counted), "language-references")  # its file size decides how it is joined
    joined = counted.join(refs, counted["lang"].eqNullSafe(refs["ref_lang"]), "left")
    measured = joined.select(
        *counted.columns, "ref_chars", "ref_common", _shares("chars").alias("p"), _shares("common").alias("q")
    ).select(
        *counted.columns,
        _distance("p", "ref_chars").alias("char_distance"),
        _distance("q", "ref_common").alias("word_distance"),
    )
    char_off = (F.col("word_chars") >= MIN_CHARS) & (
        F.col("char_distance") > CHAR_LIMIT + CHAR_NOISE / F.sqrt("word_chars")
    )
    word_off = (F.col("n_words") >= MIN_COMMON_WORDS) & (
        F.col("word_distance") > WORD_LIMIT + WORD_NOISE / F.sqrt("n_words")
    )
    off = F.coalesce(char_off, F.lit(False)) | F.coalesce(word_off, F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~off)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document with its base counts and verdict.

    Null and empty texts have no words and fail the base rules; a null language is a language of its own; equal
    and repeated rows get equal verdicts; an empty table gives no rows; other columns are not read.
    """
    counted = with_counts(docs.select("doc_id", "text", "lang"))
    counted = stored(counted.withColumn("row", F.struct("row.doc_id")), "rule-counts")
    return judged(counted).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, that the rules keep; clashing column names are safe."""
    return judged(stored(with_counts(docs), "rule-counts")).filter("kept").select("row.*")


def _sql() -> str:
    listed = "[" + ", ".join("'" + w + "'" for w in COMMON_WORDS) + "]"
    classes = ", ".join(
        "chars_all - length(regexp_replace(body, '" + c.replace("'", "''") + "', '', 'g'))" for c in (SYMBOLS, *CLASSES)
    )
    return f"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') AS words
  FROM documents
), counted AS (
  SELECT *, length(body) AS chars_all, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '{NOT_SPACE}')) AS lines
  FROM split
), windows AS (
  SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS three
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM counted)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1)
  GROUP BY doc_id
), base AS (
  SELECT c.doc_id, lang, n_words, word_chars, [{classes}] AS parts,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    list_transform({listed}, lambda c: len(list_filter(words, lambda w: w = c OR w = upper(c[1]) || c[2:]))) AS common
  FROM counted c LEFT JOIN repeated r ON r.doc_id = c.doc_id
), hists AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_append(parts, greatest(word_chars - list_sum(parts), 0)) AS h_chars,
    list_prepend(n_words - list_sum(common), common) AS h_common
  FROM base
), bins AS (
  SELECT doc_id, lang, base_failed, 'c' AS kind, unnest(h_chars) AS n, generate_subscripts(h_chars, 1) AS k, list_sum(h_chars) AS total FROM hists
  UNION ALL
  SELECT doc_id, lang, base_failed, 'w', unnest(h_common), generate_subscripts(h_common, 1), list_sum(h_common) FROM hists
), shares AS (
  SELECT *, CASE WHEN total > 0 THEN n::DOUBLE / total ELSE 0.0 END AS p FROM bins
), medians AS (
  SELECT lang, kind, k, quantile_disc(floor(p * {BINS}), 0.5) / {BINS} AS m, count(*) AS docs FROM shares WHERE NOT base_failed GROUP BY lang, kind, k
), refs AS (
  SELECT *, m / sum(m) OVER (PARTITION BY lang, kind) AS q FROM medians WHERE docs >= {MIN_REFERENCE_DOCS}
), distances AS (
  SELECT s.doc_id, s.kind, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0.0 END) / 2
  ), 0.0)) AS d
  FROM shares s JOIN refs r ON r.lang IS NOT DISTINCT FROM s.lang AND r.kind = s.kind AND r.k = s.k GROUP BY s.doc_id, s.kind
)
SELECT h.doc_id, n_words, word_chars, CAST(parts[1] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND NOT coalesce(word_chars >= {MIN_CHARS} AND c.d > {CHAR_LIMIT}::DOUBLE + {CHAR_NOISE}::DOUBLE / sqrt(word_chars), false)
    AND NOT coalesce(n_words >= {MIN_COMMON_WORDS} AND w.d > {WORD_LIMIT}::DOUBLE + {WORD_NOISE}::DOUBLE / sqrt(n_words), false) AS kept
FROM hists h
LEFT JOIN distances c ON c.doc_id = h.doc_id AND c.kind = 'c'
LEFT JOIN distances w ON w.doc_id = h.doc_id AND w.kind = 'w'
"""


#: The same for DuckDB, over documents with distinct ids.
SQL = _sql()
