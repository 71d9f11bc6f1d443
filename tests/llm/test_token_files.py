import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orrery.llm import token_files as t
from orrery.llm.common import Stage

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    v = (rng.integers(0, 2**32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = t.pack(v)
    assert len(control) == -(-n // 4)
    assert t.unpack(control, data, n).tolist() == v.tolist()


POOLS = ["abc THE and'", "Àéîöüß İıſ ǅ", "0123456789.,;:!?", "'s't're'll'd", "\t\r\x0b\x85   \x1c", "漢字かな한글", "😀é́̂", ["<|endoftext|>", "ᄀ", "ᅡ", "Σ", "^", "\u0958", "!", "İ"], "#$&*-_—"]


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_same_as_library(library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(rng.choice(POOLS)) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["", "word " * 3000, "x" * 20_000]
    want = [library.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    for cache in (800_000, 50):
        monkeypatch.setattr(t, "CACHE", cache)
        encoder = t.Encoder(open(PATH, encoding="utf-8").read(), 2)
        assert encoder.by_word and encoder.tails and encoder.mark and encoder.bare is not None
        for i in range(0, len(texts), 100):
            got = split(*encoder.encode(pa.array(texts[i : i + 100])))
            assert got == want[i : i + 100], [x for x, a, b in zip(texts[i:], got, want[i:]) if a != b][:1]


def test_long_text_in_slices(library, monkeypatch):
    rng = random.Random(2)
    encoder = t.Encoder(open(PATH, encoding="utf-8").read(), 2)
    for text in ("".join(rng.choice(rng.choice(POOLS)) for _ in range(4000)), "x" * 300 + " y" * 300, "no" * 500, ""):
        monkeypatch.setattr(t, "SLICE", 64)
        assert encoder.long(text).tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_tokenizer_that_keeps_blanks():
    """One whose ids depend on the blanks between words gets whole texts."""
    path = P.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    encoder = t.Encoder(open(path, encoding="utf-8").read(), 2)
    assert not encoder.by_word
    texts = ["ab cd", "", " a  b\n", "été 12"]
    assert split(*encoder.encode(pa.array(texts))) == [other.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def check(rows, texts, library):
    """texts: (doc_id, text) in order."""
    start = 0
    want = []
    for i, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted((s, i, n, c) for i, s, n, c in want)


def test_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    check(t.query(spark, d).collect(), texts, library)


def test_small_blocks_and_edges(spark, library):
    schema = "doc_id long, text string, ids string, part string"
    rows = [(5, "five words are in here", "x", "y"), (2**60 + 1, None, "", ""), (3, "", None, None), (4, "a " * 40_000, "", ""), (7, "b", "", ""), (7, "b", "", "")]
    stage = Stage(spark, "t")
    ids = stage.put(t.encode(spark.createDataFrame(rows, schema), PATH, 2), "ids")
    blocks, ranks = t.write(ids, stage, block=7)
    assert blocks.count() >= 3
    check(t.locate(*t.read(blocks, ranks)).collect(), sorted((r[0], r[1]) for r in rows), library)
    assert all(zlib.crc32(r["ids"]) == r.ids_crc32 and len(r["ids"]) == 4 * r.n_tokens for r in t.read(blocks, ranks)[0].collect())
    counted = Counter(i for r in rows for i in library.encode(r[1] or "", add_special_tokens=False).ids + [2])
    assert np.frombuffer(ranks.first()["ids"], "<u4").tolist() == sorted(counted, key=lambda i: (-counted[i], i))
    empty = stage.put(t.encode(spark.createDataFrame([], schema), PATH, 2), "none")
    assert t.locate(*t.read(*t.write(empty, Stage(spark, "e")))).count() == 0


def test_rows_without_id_or_of_one_id(spark, library):
    """Rows without an id come first; those of one id are spread over ranges and keep the order of their ties."""
    texts = [f"text number {i}" for i in range(400)]
    docs = [(None if i % 2 else 7 if i % 4 else i, x) for i, x in enumerate(texts)]
    stage = Stage(spark, "t")
    ids = stage.put(t.encode(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 2), "ids")
    rows = t.locate(*t.read(*t.write(ids, stage, block=50))).collect()
    encode = lambda x: np.array(library.encode(x, add_special_tokens=False).ids + [2], "<u2")
    order = sorted((i is not None, i or 0, zlib.crc32(encode(x).tobytes()), x) for i, x in docs)
    start, want = 0, []
    for there, i, _, x in order:
        n = encode(x)
        want.append((i if there else None, start, len(n), zlib.crc32(n.astype("<u4").tobytes())))
        start += len(n)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want
