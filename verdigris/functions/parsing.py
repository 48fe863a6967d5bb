"""Reading fields out of messy model text.

A text is tried in four rungs: strict JSON, JSON cut at its first closing brace,
lenient JSON (single quotes, raw line breaks), and a pattern on the field's name. The rung that
answered is kept, so that reports can count outcomes. Nothing here can fail a job: a text
that no rung can read gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import let, strip

STRICT, CUT, LENIENT, PATTERN, FAILED = "strict", "cut", "lenient", "pattern", "failed"
NO_SCORE = -1.0
ASKED_FIELDS = ("final_rewritten_query", "score", "final_selection", "selection", "explanation")


def strip_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, "```(?:json)?", ""))


def cut_at_brace(text: Column) -> Column:
    """Text up to its first closing brace, with an opening brace if it has none."""
    return F.when(
        text.contains("}"),
        let(
            F.concat(F.split_part(text, F.lit("}"), F.lit(1)), F.lit("}")),
            lambda head: F.when(head.startswith("{"), head).otherwise(F.concat(F.lit("{"), head)),
        ),
    )


def json_or_null(text: Column, repeated_keys: bool = False) -> Column:
    """Strict parse to VARIANT; only an object counts, anything else gives NULL.

    The parser stops after the first value, so text behind it is found by putting the whole
    between brackets: it must make an array of one. It refuses a key that is given twice; with ``repeated_keys`` the
    fields that requests ask for are then read one by one, and the last of equal keys counts.
    """
    braced = text.startswith("{") & text.endswith("}")
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    read = F.try_parse_json(text)
    if repeated_keys:
        named = F.from_json(text, ", ".join(f"{f} VARIANT" for f in ASKED_FIELDS), {"allowSingleQuotes": "false"})
        keys = F.json_object_keys(text)
        read = F.coalesce(read, F.when(F.size(keys) > F.size(F.array_distinct(keys)), F.to_variant_object(named)))
    return let(F.when(braced & whole, read), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def read_object(text: Column) -> Column:
    """Struct of the parsed rungs of one text, NULL where a rung cannot read it.

    The cut rung is tried only when the strict one failed.
    """
    return let(
        strip_fences(text),
        lambda clean: let(
            json_or_null(clean),
            lambda strict: F.struct(
                strict.alias("strict"),
                F.when(strict.isNull(), json_or_null(cut_at_brace(clean))).alias("cut"),
                clean.alias("clean"),
            ),
        ),
    )


def _lenient(clean: Column, field: str) -> Column:
    """Field of a text that is JSON but for its quotes; only read when the name occurs."""
    return F.when(clean.contains(field), F.from_json(clean, f"{field} STRING").getField(field))


def _field_type(parsed: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))


def read_string(text: Column, field: str) -> Column:
    """Struct ``value, outcome`` of a string field, through all rungs.

    When an object was read but has no such string field, ``value`` is NULL and the outcome
    is that rung's: the text was valid, it only lacks the field.
    """
    pattern = f"['\"]{field}['\"]\\s*:\\s*(?:\"((?:[^\"\\\\]|\\\\.)*+)\"?|'((?:[^'\\\\]|\\\\.)*+)'?)"

    def pick(rungs: Column) -> Column:
        strict, cut, clean = (rungs.getField(n) for n in ("strict", "cut", "clean"))
        lenient = _lenient(clean, field)
        matched = F.coalesce(
            F.nullif(F.regexp_extract(clean, pattern, 1), F.lit("")),
            F.nullif(F.regexp_extract(clean, pattern, 2), F.lit("")),
        )

        def string_of(v: Column) -> Column:
            return F.when(_field_type(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))

        return (
            F.when(strict.isNotNull(), F.struct(string_of(strict).alias("value"), F.lit(STRICT).alias("outcome")))
            .when(cut.isNotNull(), F.struct(string_of(cut).alias("value"), F.lit(CUT).alias("outcome")))
            .otherwise(
                let(
                    lenient,
                    lambda found: F.when(
                        found.isNotNull(), F.struct(found.alias("value"), F.lit(LENIENT).alias("outcome"))
                    ).otherwise(
                        let(
                            matched,
                            lambda m: F.struct(
                                m.alias("value"),
                                F.when(m.isNotNull(), PATTERN).otherwise(FAILED).alias("outcome"),
                            ),
                        )
                    ),
                )
            )
        )

    return let(read_object(text), pick)


def rewritten_query(completion: Column, field: str = "final_rewritten_query") -> Column:
    """Struct ``value, outcome``; mends the common single-quoted key first."""
    mended = F.replace(completion, F.lit(f"'{field}'"), F.lit(f'"{field}"'))
    return read_string(mended, field)


def rewrite_or_raw(parsed: Column, completion: Column) -> Column:
    """The parsed rewrite, or the raw completion when it is missing or empty."""
    return F.coalesce(F.nullif(parsed.getField("value"), F.lit("")), completion)


def json_success(parsed: Column) -> Column:
    return parsed.getField("value").isNotNull().cast("double")


def prefixed_rewrite(completion: Column, field: str = "final_rewritten_query") -> Column:
    """Strict parse of a completion that continues an opening brace; NULL on failure."""
    return let(
        json_or_null(F.concat(F.lit("{"), completion), repeated_keys=True),
        lambda v: F.when(_field_type(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string")),
    )


def strict_score(text: Column, field: str = "score", missing: float | None = NO_SCORE) -> Column:
    """Score of a judge whose output must be plain JSON, else the sentinel ``missing``."""
    return F.coalesce(
        F.try_variant_get(json_or_null(strip(text), repeated_keys=True), f"$.{field}", "double"), F.lit(missing).cast("double")
    )


def tolerant_score(text: Column, field: str = "score", missing: float | None = NO_SCORE) -> Column:
    """Score through all rungs, else the sentinel ``missing``."""

    def pick(rungs: Column) -> Column:
        clean = rungs.getField("clean")
        path = f"$.{field}"
        return F.coalesce(
            F.try_variant_get(rungs.getField("strict"), path, "double"),
            F.try_variant_get(rungs.getField("cut"), path, "double"),
            _lenient(clean, field).try_cast("double"),
            F.nullif(
                F.regexp_extract(clean, f"['\"]{field}['\"]\\s*:\\s*['\"]?(-?[0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")
            ).try_cast("double"),
            F.lit(missing).cast("double"),
        )

    return let(read_object(F.replace(text, F.lit(f"'{field}'"), F.lit(f'"{field}"'))), pick)


def choice_index(text: Column, offset: int = 1, field: str = "final_selection") -> Column:
    """Zero-based pick: the field as whole number, else the last digits in the text, else -1.

    Numbers too long for a BIGINT become its largest value, which no candidate list reaches.
    """
    largest = F.lit(2**63 - 1)

    def whole(digits: Column) -> Column:
        return F.coalesce(digits.try_cast("bigint") - offset, largest)

    def from_variant(v: Column) -> Column:
        kind = _field_type(v, field)
        words = strip(F.try_variant_get(v, f"$.{field}", "string"))
        return F.when(kind == "BIGINT", F.try_variant_get(v, f"$.{field}", "bigint") - offset).when(
            (kind == "STRING") & words.rlike("^\\p{Nd}+$"), whole(words)
        )

    def pick(rungs: Column) -> Column:
        lenient = strip(_lenient(rungs.getField("clean"), field))
        last = F.regexp_extract(text, "(?s)^.*?(\\p{Nd}+)\\P{Nd}*$", 1)
        return F.coalesce(
            from_variant(rungs.getField("strict")),
            from_variant(rungs.getField("cut")),
            F.when(lenient.rlike("^\\p{Nd}+$"), whole(lenient)),
            F.when(last != "", whole(last)),
            F.lit(-1).cast("bigint"),
        )

    return let(read_object(text), pick)


def selection(text: Column) -> Column:
    """Struct ``selection, explanation`` of a pairwise judge; selection NULL on failure."""
    return let(
        json_or_null(strip(text), repeated_keys=True),
        lambda v: F.struct(
            F.try_variant_get(v, "$.selection", "int").alias("selection"),
            F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit("")).alias("explanation"),
        ),
    )


def strip_echo(output: Column, prompt: Column) -> Column:
    """Drop the prompt from the start of an output that repeats it."""
    return strip(
        F.when(output.startswith(prompt), F.substring(output, F.length(prompt) + 1, F.length(output))).otherwise(output)
    )


def remove_echoes(output: Column, prompt: Column) -> Column:
    """Drop every occurrence of the prompt from an output."""
    return strip(F.replace(output, prompt, F.lit("")))
