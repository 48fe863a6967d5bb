"""Fill-in-the-middle documents as a pipeline of Arrow kernels.

A text is cut into lines (units). Two cuts, drawn from a digest of the document's id, part the units into prefix, middle
and suffix. The pieces are written in one of two orders between three marks: prefix, suffix, middle (``psm``) or
suffix, prefix, middle (``spm``); some documents stay as they are (``plain``). A text that holds a mark stays plain, so
the text can always be read back from output and form.

Work is row-local and per Arrow batch: texts are split into lists of units, the lists flattened beside the index of their
row, units numbered within their row, filtered by role, gathered into lists again and joined. No Python code
runs per row. A batch with long texts is taken in portions of about ``PORTION_BYTES``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
PORTION_BYTES = 16_000_000
_WORDS = 4
_EMPTY = pa.scalar("", pa.large_string())


class Marks(NamedTuple):
    """The texts that stand before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of the SHA-256 of ``seed:id`` (null id: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(_WORDS)]


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """The chosen units of each row, joined."""
    ends = np.cumsum(np.bincount(parent[chosen], minlength=rows))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, pc.filter(units, pa.array(chosen)))
    return pc.binary_join(lists, _EMPTY)


def formatted(
    text: pa.Array, h: list[np.ndarray], marks: Marks = Marks(), rate: int = 100, spm_rate: int = 50
) -> dict[str, pa.Array]:
    """Units, form, piece lengths and output of each text; ``h`` holds the four draws of each row."""
    text = pc.fill_null(text, "")
    rows = len(text)
    lists = pc.split_pattern(text, "\n")
    lines, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    ordinal = np.arange(len(lines)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = ordinal == sizes[parent] - 1  # what follows the last line break is a unit only if there is anything
    unit = ~(last & (pc.binary_length(lines).to_numpy() == 0))
    line_break = pa.scalar("\n", pa.large_string())
    units = pc.binary_join_element_wise(lines, pc.if_else(pa.array(last), _EMPTY, line_break), _EMPTY)
    n = np.bincount(parent[unit], minlength=rows)
    cuts = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(*cuts)[parent], np.maximum(*cuts)[parent]
    prefix = _joined(units, parent, unit & (ordinal < low), rows)
    middle = _joined(units, parent, unit & (ordinal >= low) & (ordinal < high), rows)
    suffix = _joined(units, parent, unit & (ordinal >= high), rows)
    plain = (n == 0) | (h[2] % 100 >= rate)
    for mark in marks:
        plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
    form = pa.array(np.where(plain, "plain", np.where(h[3] % 100 < spm_rate, "spm", "psm")), pa.string())
    is_plain, is_spm = pa.array(plain), pc.equal(form, "spm")
    mark = {name: pa.scalar(value, pa.large_string()) for name, value in marks._asdict().items()}
    first = pc.if_else(is_spm, mark["suffix"], mark["prefix"])
    second = pc.if_else(is_spm, mark["prefix"], mark["suffix"])
    head, tail = pc.if_else(is_spm, suffix, prefix), pc.if_else(is_spm, prefix, suffix)
    moved = pc.binary_join_element_wise(first, head, second, tail, mark["middle"], middle, _EMPTY)
    length = lambda piece: pc.if_else(is_plain, None, pc.utf8_length(piece)).cast(pa.int64())
    return {
        "n": pa.array(n, pa.int64()),
        "form": form,
        "prefix_chars": length(prefix),
        "middle_chars": length(middle),
        "output": pc.if_else(is_plain, text, moved),
    }


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in portions of about ``PORTION_BYTES`` of text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    part = before // PORTION_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = 100,
    spm_rate: int = 50,
    marks: Marks = Marks(),
) -> DataFrame:
    """``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, one row for each of ``docs``.

    Of the documents ``rate`` in a hundred are rearranged, ``spm_rate`` in a hundred of them suffix first. A null text
    counts as empty; an empty text and one that holds a mark are plain, without piece lengths. A null id draws like
    an empty one; rows of equal id and text get equal results. An empty table gives no rows; other columns are
    not read.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                h = [part[f"h{i}"].to_numpy() for i in range(_WORDS)]
                out = formatted(part["text"].cast(pa.large_string()), h, marks, rate, spm_rate)
                out["output"] = out["output"].cast(pa.string())
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], **out})

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text).alias("text"),
        *[x.alias(f"h{i}") for i, x in enumerate(draws(F.col(id_col), seed))],
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(mapped, schema)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text behind an output and its form."""
    pieces = F.split(output, "|".join(rf"\Q{m}\E" if re.search(r"\W", m) else m for m in marks), -1)
    moved = F.when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(
        F.concat(pieces[1], pieces[3], pieces[2])
    )
    return F.when(form == "plain", output).otherwise(moved)


def document_forms(docs: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts read back from them; see ``fill_in_middle`` for nulls and repeats."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The same for DuckDB.
SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h
  FROM split
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
         WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
    array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
