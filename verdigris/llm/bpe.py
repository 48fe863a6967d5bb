"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a byte string ends in exactly one token that is valid there: a token whose bytes end the
prefix and that may follow the last token of what stands before it. ``Prefixes`` stores that token for each
prefix. The encoding is read backwards from the end; appending bytes extends the table and changes nothing in
it; after an edit the table is recomputed from the edit on, until it runs in step with the old one again.

Two tokens may stand side by side when merging their joined bytes gives back the two. That is decided on
the outer pieces of their merge trees: a piece exists from the rank it is made at until the rank of the merge that
uses it up, so the pair breaks if two facing pieces have a merge that comes before both are used up.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import deque
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from verdigris.llm.bpe_files import rank_file
from verdigris.llm.common import as_text, from_text
from verdigris.llm.pretokens import parts

CACHED_PARTS = 1_000_000
CACHED_PIECES = 100_000
CACHED_PAIRS = 600_000
#: Marks that the pattern takes alone behind a word.
_MARKS = frozenset(".,;:!?")
_NEVER = 1 << 40


class Vocabulary:
    """Ranks of byte strings, their merge trees and the pair rule."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Finds every token that ends at a byte, the longest first; a byte is one character of its keys.
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()
        self._edges: dict[int, tuple[list, list]] = {}
        self._pairs: dict[int, bool] = {}

    def _tree(self, token: bytes):
        """The merge tree of one token, by merging its bytes: (rank, left, right) or (rank, None, None)."""
        nodes = [(self.ranks[token[i : i + 1]], None, None) for i in range(len(token))]
        spans = [token[i : i + 1] for i in range(len(token))]
        while len(nodes) > 1:
            options = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(spans, spans[1:]))]
            rank, i = min(options)
            if rank == _NEVER:
                return None
            nodes[i : i + 2] = [(rank, nodes[i], nodes[i + 1])]
            spans[i : i + 2] = [spans[i] + spans[i + 1]]
        return nodes[0]

    def _edge(self, rank: int) -> tuple[list, list]:
        """Left and right outer pieces of a token, outermost last: (bytes, rank, rank of its use)."""
        found = self._edges.get(rank)
        if found is None:
            tree = self._tree(self.tokens[rank])
            sides = []
            for side in (1, 2):
                pieces, node, used = [], tree, _NEVER
                while node is not None:
                    pieces.append((self.tokens[node[0]], node[0], used))
                    node, used = node[side], node[0]
                sides.append(pieces)
            found = self._edges[rank] = (sides[0], sides[1])
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand directly after ``left`` in an encoding."""
        pair = left << 32 | right
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[pair] = self._may_follow(left, right)
        return found

    def fill(self, data: bytes, last: list, begin: int) -> Iterator[int]:
        """Enter the last token of each prefix that ends at ``begin`` or later; yields each end once it is known.

        ``last`` is final before ``begin``. Exactly one token is valid at each prefix, so the first found stands.
        """
        pairs, follows = self._pairs, self.follows
        offset = max(0, begin - self.longest + 1)
        for end, (rank, size) in self.finder.iter(data[offset:].decode("latin-1")):
            end += offset
            if end >= begin and last[end] is None:
                at = end - size
                if at < 0:
                    last[end] = rank
                    yield end
                else:
                    left = last[at]
                    if pairs.get(left << 32 | rank) or follows(left, rank):
                        last[end] = rank
                        yield end

    def encode(self, data: bytes) -> list[int]:
        """The ids of one byte string; one that is a token is itself."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()

    def _may_follow(self, left: int, right: int) -> bool:
        get = self.ranks.get
        for a, made_a, used_a in self._edge(left)[1]:
            for b, made_b, used_b in self._edge(right)[0]:
                # both exist at once, and their own merge comes first; of equal merges the left one wins
                if made_a < used_b and made_b < used_a:
                    rank = get(a + b)
                    if rank is not None and rank < used_a and rank <= used_b:
                        return False
        return True


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list = []
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self.last += [None] * len(more)
        deque(self.vocabulary.fill(self.data, self.last, begin), maxlen=0)

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Put ``by`` in place of the bytes from ``start`` to ``stop``; returns how many prefixes were computed again.

        A prefix's token depends only on the tokens of at most ``longest`` shorter prefixes and as many bytes. Once that many
        prefixes after the edit agree with the old table, all that follow agree too.
        """
        old, moved, longest = self.last, len(by) - (stop - start), self.vocabulary.longest
        self.data = self.data[:start] + by + self.data[stop:]
        self.last = old[:start] + [None] * (len(self.data) - start)
        agree = 0
        for at in self.vocabulary.fill(self.data, self.last, start):
            behind = at + 1 - (start + len(by))
            if behind > 0:
                agree = agree + 1 if self.last[at] == old[at - moved] else 0
                if agree >= longest and behind > longest:
                    self.last[at + 1 :] = old[at + 1 - moved :]
                    return at + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Encodes texts match by match of the pattern and decodes ids; one per worker."""

    _last: tuple[int, Codec] | None = None

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self._matches = regex.compile(pattern).findall
        self._pieces: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Codec:
        mark = hash((frozenset(ranks.items()), pattern))
        if cls._last is None or cls._last[0] != mark:
            cls._last = (mark, cls(ranks, pattern))
        return cls._last[1]

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= CACHED_PIECES:
                self._pieces.clear()
            ids = array("I", self.vocabulary.encode(piece.encode("utf-8"))).tobytes()
            if len(piece) <= 64:
                self._pieces[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self._matches(text)))

    def _part(self, part: str) -> bytes:
        """The ids of a space and a part that is not cached; a word and the mark behind it are two matches."""
        if part[-1:] in _MARKS and part[:-1].isalpha():
            word = part[:-1]
            return (self._parts.get(word) or self._part(word)) + self._piece(part[-1])
        if part.isalpha():
            ids = array("I", self.vocabulary.encode(b" " + part.encode("utf-8"))).tobytes()
        else:
            ids = self._whole(" " + part)
        if len(part) <= 64:
            if len(self._parts) >= CACHED_PARTS:
                self._parts.clear()
            self._parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        first, *rest = parts(text)
        get, part = self._parts.get, self._part
        return b"".join([self._whole(first), *[get(p) or part(p) for p in rest]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, memoryview(ids).cast("I")))


def round_trips(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: number of ids, their digest, and the digest of the bytes they decode to.

    A null text is empty and has no ids; every row is encoded on its own, whatever its id; an empty table gives no rows;
    only ``doc_id`` and ``text`` are read. Texts of any length are held one at a time.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(vocabulary))  # one vocabulary file, under 2 MB

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(ranks.value, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = codec.encode(text or "")
                digest = hashlib.sha256(codec.decode(ids)).hexdigest()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest))
            frame = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), frame], axis=1)

    rows = docs.select(as_text("doc_id"), "text")
    out = rows.mapInPandas(coded, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return from_text(out, "doc_id")
