import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from orrery.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(byte_bpe.read_ranks(open(PATH, "rb").read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode([text])[0], "<u4").tolist()


def fuzz(seed, n=150):
    rng = random.Random(seed)
    pools = ["abcdefghij etaoin", "ÀéîöüßñÇ łž", "0123456789 .,", "!?*&%$#'\"-–—…", "\n\t \r\x0b  　\x85", "漢字かなカナ한글", "😀👩‍👧🏽𝒳", "'s't're've'm'll'd"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_same_as_library(bpe, library, seed):
    for t in fuzz(seed):
        got = ids_of(bpe, t)
        assert got == library.encode_ordinary(t), repr(t)
        assert bpe.decode(bpe.encode([t])[0]) == t.encode()


@pytest.mark.parametrize("text", ["", "a", "a" * 3000, "ab" * 5000, "xyzzy" * 4000, "é" * 5000, " " * 9000])
def test_long_pieces(bpe, library, text):
    assert ids_of(bpe, text) == library.encode_ordinary(text)


def test_one_and_many_agree(bpe):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"thean\xc3\xa9") for _ in range(rng.randrange(2, 70))) for _ in range(300)]
    many = bpe.merge_many(pieces)
    assert [bpe.merge_one(p) for p in pieces] == [x.tolist() for x in many]


def test_cache_bound(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    for t in ("one two three four", "five six seven eight nine", "one nine"):
        assert ids_of(bpe, t) == library.encode_ordinary(t)


def test_query_whole(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = byte_bpe.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens string"
    assert byte_bpe.encoded(spark.createDataFrame([], schema)).count() == 0
    rows = [(2**60 + 1, None, "x", "y"), (None, "", None, None), (1, "a b", "x", "x"), (1, "a b", "x", "x")]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.encoded(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (1, 2), (1, 2), (2**60 + 1, 0)]
