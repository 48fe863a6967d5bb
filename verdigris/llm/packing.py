"""Best-fit packing of token sequences with large-item matching.

Documents are encoded and closed with an end token; longer ones are cut so that all pieces but the first are
full. A piece above a third of the capacity is large: a sequence holds two of them at most. Large pieces are matched
greedily, the longest first, each with the longest other that still fits. Small pieces, the longest
first, then go where the gap that remains is smallest; a new sequence is opened when no gap fits.

Encoding is row-local. Only piece lengths are packed: pieces are dealt evenly and at random into portions of
about ``portion_rows`` and every portion is packed on its own, so the work splits however many
copies or equal lengths there are; a portion leaves about one sequence part empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.bpe_files import json_added, json_ranks
from verdigris.llm.common import as_text, from_text, stored
from verdigris.llm.pretokens import ChunkEncoder

CAPACITY = 1024
END_ID = 2
PORTION_ROWS = 50_000

_PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes the remainder."""
    head = length % capacity or min(length, capacity)
    starts = [0, *range(head, length, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length])]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        waiting[n].append(i)
    third = capacity // 3
    large = sum(1 << n for n in range(third + 1, capacity + 1) if waiting[n])
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = used = 0  # gaps: bit g is set while a sequence with gap g is open

    def opened(number: int, gap: int) -> None:
        nonlocal gaps
        open_by_gap[gap].append(number)
        gaps |= 1 << gap

    for n in range(capacity, third, -1):
        while waiting[n]:
            i = waiting[n].pop()
            if not waiting[n]:
                large &= ~(1 << n)
            sequence[i], gap = used, capacity - n
            partner = (large & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if partner > 0:
                j = waiting[partner].pop()
                if not waiting[partner]:
                    large &= ~(1 << partner)
                sequence[j], offset[j] = used, n
                gap -= partner
            opened(used, gap)
            used += 1
    for n in range(third, 0, -1):
        for i in waiting[n]:
            fitting = gaps >> n
            if fitting:
                gap = n + (fitting & -fitting).bit_length() - 1
                number = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps &= ~(1 << gap)
            else:
                number, gap = used, capacity
                used += 1
            sequence[i], offset[i] = number, capacity - gap
            opened(number, gap - n)
    return sequence, offset


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document (``doc_id``, ``text``), with its length and the checksum of its ids."""
    ranks = docs.sparkSession.sparkContext.broadcast(json_ranks(vocabulary))  # one vocabulary file, under 2 MB
    added = json_added(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder.of(ranks.value, added)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return from_text(docs.select(as_text("doc_id"), "text").mapInPandas(encoded, _PIECE), "doc_id")


def packed(pieces: DataFrame, capacity: int = CAPACITY, portion_rows: int = PORTION_ROWS) -> DataFrame:
    """``pieces`` (a stored table with ``length``) plus ``sequence_id`` and ``offset``."""
    portions = max(1, round(pieces.count() / portion_rows))
    # ids of a stored table's rows: a lost task reads the same file part and gets the same ids
    dealt = pieces.withColumn(
        "portion", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(portions)).cast("int")
    )
    kind = lambda f: "string" if f.name == "doc_id" else f.dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {kind(f)}" for f in pieces.schema)

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(rows["length"].to_numpy(), capacity)
        number = rows["portion"].to_numpy().astype(np.int64) * (1 << 32) + sequence
        return rows.drop(columns="portion").assign(sequence_id=number, offset=offset)

    out = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("portion")
    return from_text(out.applyInPandas(placed, f"{schema}, sequence_id long, offset long"), "doc_id")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place.

    A null or empty text is the end token alone. Repeated rows and null ids are packed like any other row. An empty
    table gives no rows; other columns are not read.
    """
    return packed(stored(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)
