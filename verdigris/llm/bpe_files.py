"""Vocabulary files of byte-level tokenizers as ranks of byte strings."""

from __future__ import annotations

import base64
import json


def rank_file(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def json_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer in JSON and their ids; they are found in the text before anything else is."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", ())
    for token in tokens:
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
            raise ValueError(f"added token with stripping or word limits: {token['content']!r}")
    return {t["content"]: t["id"] for t in tokens}


def json_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer in JSON, whose tokens write each byte as one visible character.

    Bytes that are visible characters stand for themselves, the others for the characters from 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", ())}
    return {
        bytes(byte_of[c] for c in token): rank for token, rank in content["model"]["vocab"].items() if token not in special
    }
