"""Porter stemming as Column expressions.

Each step is one ``transform`` over the token array, so a step can look at its input
several times without the expression growing, and the tokens never leave the JVM.
Finished tokens carry a mark that no later step can match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris import fixed_values as fixed
from verdigris.functions.text import let

DONE = "!"
CUT = "+"
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
ONE_OR_MORE = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
EXACTLY_ONE = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
TWO_OR_MORE = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT_END = "(?:[^aeiouy]|^y|(?<=[aeiou])y)[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
DOUBLE_END = "([^aeiouy])\\1$"
MIN_LENGTH = 4


def _drop(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def _set_aside(word: Column) -> Column:
    return (
        F.when(F.length(word) < MIN_LENGTH, F.concat(word, F.lit(DONE)))
        .when(
            word.isin(list(fixed.STEM_IRREGULAR)),
            F.concat(_lookup(fixed.STEM_IRREGULAR, word), F.lit(DONE)),
        )
        .otherwise(word)
    )


def _plurals(word: Column) -> Column:
    return (
        F.when(~word.endswith("s") | word.endswith("ss") & ~word.endswith("sses"), word)
        .when(word.endswith("sses") | (word.endswith("ies") & (F.length(word) != 4)), _drop(word, 2))
        .otherwise(_drop(word, 1))
    )


def _past_and_gerund(word: Column) -> Column:
    return (
        F.when(
            word.endswith("ied"),
            F.when(F.length(word) == 4, _drop(word, 1)).otherwise(_drop(word, 2)),
        )
        .when(
            word.endswith("eed"),
            F.when(_drop(word, 3).rlike(ONE_OR_MORE), _drop(word, 1)).otherwise(word),
        )
        .when(
            word.endswith("ed") & _drop(word, 2).rlike(HAS_VOWEL),
            F.concat(_drop(word, 2), F.lit(CUT)),
        )
        .when(
            word.endswith("ing") & _drop(word, 3).rlike(HAS_VOWEL),
            F.concat(_drop(word, 3), F.lit(CUT)),
        )
        .otherwise(word)
    )


def _mend_cut(word: Column) -> Column:
    def mend(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(DOUBLE_END), F.when(stem.rlike("[lsz]$"), stem).otherwise(_drop(stem, 1)))
            .when(stem.rlike(EXACTLY_ONE) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    return F.when(word.endswith(CUT), let(_drop(word, 1), mend)).otherwise(word)


def _final_y(word: Column) -> Column:
    return F.when(
        word.endswith("y") & word.rlike("^.+(?:[^aeiouy]|(?<=[aeiou])y)y$"), F.concat(_drop(word, 1), F.lit("i"))
    ).otherwise(word)


def _adverb(word: Column) -> Column:
    return F.when(
        word.endswith("alli") & _drop(word, 4).rlike(ONE_OR_MORE), _drop(word, 2)
    ).otherwise(word)


def _with_suffix(word: Column, suffixes, body) -> Column:
    """``body(stem, suffix)`` for the longest of the suffixes that ends the word, else the word."""
    length = F.when(word.endswith(DONE), 0)
    for n in sorted({len(suffix) for suffix in suffixes}, reverse=True):
        length = length.when(F.right(word, F.lit(n)).isin([x for x in suffixes if len(x) == n]), n)

    def split(n: Column) -> Column:
        stem, suffix = F.left(word, F.length(word) - n), F.right(word, n)
        return F.when(n > 0, body(stem, suffix)).otherwise(word)

    return let(length.otherwise(0), split)


def _replace_suffix(table: dict[str, str]):
    def step(word: Column) -> Column:
        def swap(stem: Column, suffix: Column) -> Column:
            measured = F.when(suffix == "logi", F.concat(stem, F.lit("l"))).otherwise(stem)
            return F.when(measured.rlike(ONE_OR_MORE), F.concat(stem, _lookup(table, suffix))).otherwise(word)

        return _with_suffix(word, table, swap)

    return step


def _residual(word: Column) -> Column:
    def cut(stem: Column, suffix: Column) -> Column:
        allowed = ((suffix != "ion") | stem.rlike("[st]$")) & stem.rlike(TWO_OR_MORE)
        return F.when(allowed, stem).otherwise(word)

    return _with_suffix(word, fixed.STEM_RESIDUAL, cut)


def _final_e(word: Column) -> Column:
    def cut(stem: Column) -> Column:
        return F.when(
            stem.rlike(TWO_OR_MORE) | (stem.rlike(EXACTLY_ONE) & ~stem.rlike(SHORT_END)), stem
        ).otherwise(word)

    return F.when(word.endswith("e"), let(_drop(word, 1), cut)).otherwise(word)


def _final_ll(word: Column) -> Column:
    return F.when(
        word.endswith("ll") & _drop(word, 1).rlike(TWO_OR_MORE), _drop(word, 1)
    ).otherwise(word)


def _unmark(word: Column) -> Column:
    return F.rtrim(word, F.lit(DONE))


STEPS = (
    _set_aside,
    _plurals,
    _past_and_gerund,
    _mend_cut,
    _final_y,
    _adverb,
    _replace_suffix(fixed.STEM_DOUBLE),
    _replace_suffix(fixed.STEM_DERIVED),
    _residual,
    _final_e,
    _final_ll,
    _unmark,
)


def porter_stems(tokens: Column) -> Column:
    """Stem every token of an array; tokens below four characters stay as they are."""
    for step in STEPS:
        tokens = F.transform(tokens, step)
    return tokens
