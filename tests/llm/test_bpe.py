import random

import public_tokenizers
import pytest
import tiktoken

from flowlab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    chars = [chr(c) for c in range(1, 0x500)] + [chr(c) for c in (0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x1F600, 0x4E2D)]
    made = ["", " ", "  \n ", "It's WE'LL they'd", "<|endoftext|>", "aaaa" * 2000, "thththe " * 50, "a\x1cb\x1f c"]
    return made + ["".join(rng.choices(chars, k=rng.randrange(120))) for _ in range(300)]


def test_equals_the_library(ranks, library):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids, at = codec.encode(texts())
    data, ends = codec.decode(ids, at)
    for i, t in enumerate(texts()):
        assert ids[at[i]:at[i + 1]].tolist() == library.encode_ordinary(t)
        assert data[ends[i]:ends[i + 1]].tobytes().decode() == t


def test_perfect_hash_is_minimal(ranks):
    hashes = bpe._key_hashes(list(ranks))
    perfect = bpe.PerfectHash(hashes)
    assert sorted(perfect.index(hashes).tolist()) == list(range(len(ranks)))


def test_forgetting_changes_nothing(ranks):
    whole, _ = bpe.Codec(ranks, public_tokenizers.PATTERN).encode(texts())
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, memo_size=10)
    parts = [codec.encode([t])[0].tolist() for t in texts()]
    assert sum(parts, []) == whole.tolist()


def test_data_frames(spark, ranks, library):
    rows = [(1, "The thing", "x"), (2, None, "y"), (2, "", "z"), (None, "é" * 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    back = bpe.decode(coded, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode(), r.ids) for r in back) == sorted((d or 0, t or "", library.encode_ordinary(t or "")) for d, t, _ in rows)
    assert bpe.encode(docs.filter("false"), ranks, public_tokenizers.PATTERN).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(none, ranks, public_tokenizers.PATTERN).first().decoded) == b""


def test_unknown_id_raises(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    import numpy as np
    with pytest.raises(ValueError):
        codec.decode(np.array([len(ranks) + 5]), np.array([0, 1]))
