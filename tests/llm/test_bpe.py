import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from verdigris.llm import bpe
from verdigris.llm.bpe_files import rank_file

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return rank_file(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


def digests(doc_id, text, reference):
    ids = reference.encode_ordinary(text or "")
    packed = np.array(ids, dtype="<u4").tobytes()
    return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def found(docs):
    return sorted(map(tuple, bpe.round_trips(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)


def test_documents_as_the_library(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == sorted((digests(r["doc_id"], r["text"], reference) for r in docs.collect()), key=str)


def test_odd_rows(odd_docs, reference):
    docs = odd_docs.withColumnsRenamed({"lang": "n_tokens", "source": "ids_sha256"})
    assert found(docs) == sorted((digests(r["doc_id"], r["text"], reference) for r in odd_docs.collect()), key=str)


def test_empty(docs_of):
    assert found(docs_of([])) == []


def test_random_strings_as_the_library(ranks, reference):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    alphabets = ["ab", "aeinrst ", "the of and ", "é中\U0001f600x ", " \n\t\xa0", "0123456789.,'sS "]
    for i in range(4000):
        alphabet = alphabets[i % len(alphabets)]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def merged(data, ranks):
    """Plain merging of the lowest rank, leftmost first."""
    spans = [data[i : i + 1] for i in range(len(data))]
    while len(spans) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(spans, spans[1:])))
        if rank == 1 << 40:
            break
        spans[i : i + 2] = [spans[i] + spans[i + 1]]
    return [ranks[s] for s in spans]


def test_every_prefix_and_every_edit(ranks, vocabulary):
    rng = random.Random(6)
    for _ in range(150):
        data = bytes(rng.choice(b"aeinorst hl") for _ in range(rng.randrange(1, 40)))
        table = bpe.Prefixes(vocabulary)
        for i in range(len(data)):
            table.append(data[i : i + 1])
            assert table.ids() == merged(data[: i + 1], ranks)
        start = rng.randrange(len(data) + 1)
        stop = rng.randrange(start, len(data) + 1)
        by = bytes(rng.choice(b"aeinorst") for _ in range(rng.randrange(5)))
        table.replace(start, stop, by)
        assert table.ids() == merged(data[:start] + by + data[stop:], ranks)


def test_an_edit_is_local(ranks, vocabulary):
    data = b"thereisnospaceinthis" * 200
    table = bpe.Prefixes(vocabulary, data)
    again = table.replace(100, 103, b"xyz")
    assert again < 1000
    assert table.ids() == bpe.Prefixes(vocabulary, data[:100] + b"xyz" + data[103:]).ids()
