import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdigris.llm import bpe_files, packing
from verdigris.llm.pretokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_vocabulary_files_agree():
    ranks = bpe_files.json_ranks(PATH)
    assert ranks == bpe_files.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))


SPACES = ["a  b", "a   b", " a", "a ", "a  ", "  a", "a \nb", "a\n b", "\n\n a", "a\t b", "a \tb", "a\xa0 b", "a \xa0b",
          "a \x1cb", "a\x1c b", "a \x85 b", "don't we'll 'tis", "x1 2y ½ ² Ⅷ", "<|endoftext|>", "   ", "", "  a  b", "\U0001f600 é"]


def test_parts_keep_ids(tokenizer):
    encoder = ChunkEncoder(bpe_files.json_ranks(PATH))
    rng = random.Random(2)
    alphabet = [" ", " ", "\n", "\t", "\xa0", "\x1c", "a", "bc", "1", "'s", ".", "é", " "]
    texts = SPACES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


ADDED = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "a<|endoftext|>\n b", "a  <|endoftext|>  b", "<|endoftext|>", "<|endoftext| >", "<|endoftext|"]


def test_added_tokens_by_default_settings(docs_of):
    """Without any setting the tokenizer gives an added token in a text its own id."""
    default = Tokenizer.from_file(PATH)
    encoder = ChunkEncoder(bpe_files.json_ranks(PATH), bpe_files.json_added(PATH))
    for text in SPACES + ADDED:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == default.encode(text, add_special_tokens=False).ids, repr(text)
    check(packing.pack_documents(docs_of(ADDED), PATH).collect(), dict(enumerate(ADDED)), default)


def check(rows, texts, tokenizer):
    """Every id of every document is in its place, cuts follow the rule, sequences have no gap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // 1024)))
        at = 0
        for p in pieces:
            assert p["start"] == at and (p["length"] == 1024 or p["piece"] == 0)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), sum(r["length"] for r in rows)


def test_documents_round_trip(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, tokens = check(packing.pack_documents(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer)
    assert used <= 1.02 * tokens / 1024 + 1


def test_odd_rows(odd_docs, tokenizer):
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(packing.pack_documents(docs.withColumnsRenamed({"lang": "portion", "source": "offset"}), PATH).collect(), texts, tokenizer)
    rows = packing.pack_documents(odd_docs, PATH).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_pack_fills_and_matches(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    lengths = rng.integers(1, capacity + 1, size=rng.integers(1, 400))
    sequence, offset = packing.pack(lengths, capacity)
    for s in np.unique(sequence):
        rows = sequence == s
        order = np.argsort(offset[rows])
        sizes = lengths[rows][order]
        assert (offset[rows][order] == np.r_[0, np.cumsum(sizes)[:-1]]).all()
        assert sizes.sum() <= capacity and (sizes > capacity // 3).sum() <= 2
    assert len(np.unique(sequence)) <= 11 / 9 * best_possible(lengths, capacity) + 1


def best_possible(lengths, capacity):
    return max(-(-lengths.sum() // capacity), (lengths > capacity / 2).sum())


def test_cut():
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]
