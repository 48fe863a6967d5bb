"""Text columns: stripping, answer normalisation, exact match, token F1, numbers.

Every function takes and returns a Column. Each works inside its own row, so none of
them adds a shuffle and none of them depends on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space (Unicode included) from both ends."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def strip_or_empty(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), fixed.ASCII_PUNCTUATION_CLASS, "")
    words = "|".join(fixed.ARTICLES)
    no_articles = F.regexp_replace(
        plain, f"(?<![\\p{{L}}\\p{{N}}_])({words})(?![\\p{{L}}\\p{{N}}_])", " "
    )
    return F.trim(F.regexp_replace(no_articles, f"{fixed.WHITESPACE_CLASS}+", " "))


def exact_match(gold: Column, answer: Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(answer)).cast("double")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and joins on it do not compute again.

    A filter on an ordinary column is pushed below it with a second copy of its expression; it
    cannot pass the output of a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def answer_tokens(text: Column) -> Column:
    """Words of the normalised answer; an empty answer has none."""
    return words(normalize_answer(text))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda word: word != "")


def _number_runs(ordered: Column) -> Column:
    """Tag each token of a sorted array with its place among equal ones, e.g. ``be 0``, ``be 1``."""
    last = F.size(ordered) - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)),
    )

    def tag_runs(firsts: Column) -> Column:
        return F.flatten(
            F.transform(
                firsts,
                lambda first, k: F.transform(
                    F.sequence(F.lit(0), F.coalesce(F.get(firsts, k + 1), last + 1) - first - 1),
                    lambda n: F.concat_ws(" ", F.get(ordered, first), n.cast("string")),
                ),
            )
        )

    return F.when(last < 0, ordered).otherwise(let(starts, tag_runs))


def number_repeats(tokens: Column) -> Column:
    """Make repeated tokens distinct, so that multisets can be compared as sets.

    The first of equal tokens stays as it is; the others, found side by side after sorting, get
    a number. The cost is that of the sort, also when one token fills the whole text.
    """

    def tag(ordered: Column) -> Column:
        repeats = F.filter(ordered, lambda token, i: token == F.get(ordered, i - 1))
        return F.concat(F.array_distinct(ordered), let(repeats, _number_runs))

    return let(F.sort_array(tokens), tag)


def overlap_f1(overlap: Column, n_gold: Column, n_answer: Column) -> Column:
    """Harmonic mean of overlap/answer and overlap/gold, 0 without overlap."""
    precision = overlap.cast("double") / n_answer
    recall = overlap.cast("double") / n_gold
    return F.when((n_gold == 0) | (n_answer == 0) | (overlap == 0), F.lit(0.0)).otherwise(
        2 * precision * recall / (precision + recall)
    )


def tagged_f1(gold: Column, answer: Column) -> Column:
    """Token F1 of two ``number_repeats`` arrays."""
    return F.when((F.size(gold) == 0) & (F.size(answer) == 0), F.lit(1.0)).otherwise(
        overlap_f1(F.size(F.array_intersect(gold, answer)), F.size(gold), F.size(answer))
    )


def token_f1(gold: Column, answer: Column) -> Column:
    """Token F1 over the multiset overlap of the normalised answers."""
    return normalized_f1(normalize_answer(gold), normalize_answer(answer))


def normalized_f1(gold: Column, answer: Column) -> Column:
    return let(
        number_repeats(words(gold)),
        lambda g: let(number_repeats(words(answer)), lambda a: tagged_f1(g, a)),
    )


def best_scores(references: Column, answer: Column) -> Column:
    """Struct ``em, f1`` of the best exact match and the best token F1 over all references.

    Each text is normalised once; without references both are 0.
    """

    def scores(normal: Column) -> Column:
        golds, given = normal.getField("golds"), normal.getField("given")
        matches = F.transform(golds, lambda g: (g == given).cast("double"))
        f1s = let(
            number_repeats(words(given)),
            lambda a: F.transform(golds, lambda g: let(number_repeats(words(g)), lambda t: tagged_f1(t, a))),
        )
        return F.struct(
            F.coalesce(F.array_max(matches), F.lit(0.0)).alias("em"),
            F.coalesce(F.array_max(f1s), F.lit(0.0)).alias("f1"),
        )

    normal = F.struct(
        F.transform(references, normalize_answer).alias("golds"), normalize_answer(answer).alias("given")
    )
    return let(normal, scores)


def final_number(text: Column) -> Column:
    """Last number after the last answer mark, or of the whole text; '' without one."""
    tail = F.element_at(F.split(text, fixed.FINAL_MARK), -1)
    found = F.regexp_extract_all(tail, F.lit(fixed.NUMBER_PATTERN), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def numeric_match(
    answer: Column,
    gold: Column,
    tolerance: float = fixed.NUMERIC_TOLERANCE,
    mode: str = "reference",
) -> Column:
    """1 when the answer's final number is within tolerance of the gold number.

    ``reference`` compares the normalised texts, which lose sign and decimal point;
    ``strict`` reads thousands separators and compares the numbers themselves.
    """
    if mode == "reference":
        left, right = normalize_answer(final_number(answer)), normalize_answer(gold)
    elif mode == "strict":
        left = final_number(drop_thousands(answer))
        right = strip(drop_thousands(gold))
    else:
        raise ValueError(f"unknown mode: {mode}")
    distance = F.abs(_number(left) - _number(right))
    return F.coalesce((distance <= tolerance).cast("double"), F.lit(0.0))


def _number(text: Column) -> Column:
    """A text as a number; other forms than plain decimals, with sign and exponent, give NULL."""
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, text.try_cast("double"))


def drop_thousands(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=\\p{Nd}),(?=\\p{Nd}{3}(?!\\p{Nd}))", "")


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
