"""Cutting texts where no match of the tokenizer pattern can cross, and encoding the parts once.

The pattern (``public_tokenizers.PATTERN``) takes a space together with the non-space that follows it, and white space
before that space separately. So a text may be cut before every ASCII space that a non-space follows:
the matches of the parts are the matches of the text. Parts repeat, and each is encoded once per worker
while the cache lasts. Added tokens of the vocabulary, if given, are cut out of the text first and have their own ids.
"""

from __future__ import annotations

import re
from array import array

import tiktoken

_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
CACHED_PARTS = 400_000


def parts(text: str) -> list[str]:
    """The parts of a text; all but the first have lost the space they begin with."""
    return _CUT.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


class ChunkEncoder:
    """Ids of texts as packed unsigned 32-bit integers, by a rank table."""

    _last: tuple[int, ChunkEncoder] | None = None

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None):
        import public_tokenizers

        self._encoding = tiktoken.Encoding(
            "parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._cache: dict[str, bytes] = {}
        self._added = {token: array("I", [i]).tobytes() for token, i in (added or {}).items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self._added else None

    @classmethod
    def of(cls, ranks: dict[bytes, int], added: dict[str, int] | None = None) -> ChunkEncoder:
        """One encoder per worker and vocabulary."""
        mark = hash((frozenset(ranks.items()), frozenset((added or {}).items())))
        if cls._last is None or cls._last[0] != mark:
            cls._last = (mark, cls(ranks, added))
        return cls._last[1]

    def _ids(self, part: str) -> bytes:
        return array("I", self._encoding.encode_ordinary(part)).tobytes()

    def _miss(self, part: str) -> bytes:
        if len(self._cache) >= CACHED_PARTS:
            self._cache.clear()
        ids = self._ids(" " + part)
        if len(part) <= 64:
            self._cache[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        pieces = self._cut.split(text)  # added tokens stand at the odd places
        return b"".join([self._added[p] if i % 2 else self._plain(p) for i, p in enumerate(pieces)])

    def _plain(self, text: str) -> bytes:
        first, *rest = parts(text)
        get, miss = self._cache.get, self._miss
        return b"".join([self._ids(first), *[get(p) or miss(p) for p in rest]])
