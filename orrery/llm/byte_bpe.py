"""Byte-level BPE encoding and decoding from a rank file.

The positions of a piece's bytes are the leaves of a segment tree. A leaf holds (rank of the pair that starts there,
position), the root so the leftmost of the pairs with minimum rank. A merge makes three point updates: the pair at the
merged position, the one of its live left neighbour, and the one of the position that is absorbed; each costs one step
per level. Pieces that a worker hasn't met before are merged together, a numpy row for each; long ones in a tree of
their own. Encoded pieces are kept in a bounded cache, since natural text repeats them.

Defined results: null counts as the empty text, which has no ids; any text decodes to its own bytes; rows are
independent of each other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import kept, plain, table, trimmed

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)
#: Bytes from which a piece has a tree of its own.
LONG = 4096
#: Cells of the numpy trees at a time.
CELLS = 1 << 18
#: Pieces in a worker's cache before it starts afresh.
CACHE = 200_000
#: Documents in a returned batch.
BATCH = 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair = pairs
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.uint64)
        self.cache: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], LOW)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces of 2 to `size` bytes, size the power of two that the longest needs; a row of the tree for each."""
        size = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        tok = np.zeros((n, size + 1), np.int64)
        inside = np.arange(size) < length[:, None]
        tok[:, :size][inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        pos = np.arange(size, dtype=np.uint64)
        tree = np.full((n, 2 * size), NONE)
        rank = np.full((n, size), LOW)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.rank_of(tok[:, : size - 1][both], tok[:, 1:size][both])
        tree[:, size:] = np.where(rank == LOW, NONE, rank << np.uint64(32) | pos)
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        # Position size stands for "none": links may point there and are never read as a pair.
        nxt = np.minimum(np.arange(1, size + 2), length[:, None])
        nxt[nxt == length[:, None]] = size
        prv = np.tile(np.arange(-1, size), (n, 1))
        prv[:, 0] = size
        live = np.zeros((n, size), bool)
        live[inside] = True
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            root = tree[row, 1]
            at = (root & LOW).astype(np.int64)
            gone = nxt[row, at]
            after = nxt[row, gone]
            before = prv[row, at]
            tok[row, at] = (root >> np.uint64(32)).astype(np.int64)
            nxt[row, at] = after
            prv[row, after] = at
            live[row, gone] = False
            merged = tok[row, at]
            right = np.where(after < size, self.rank_of(merged, tok[row, after]), LOW)
            left = np.where(before < size, self.rank_of(tok[row, before], merged), LOW)
            spare = np.where(before < size, before, gone)
            for leaf, value in ((gone, NONE), (at, np.where(right == LOW, NONE, right << np.uint64(32) | at.astype(np.uint64))), (spare, np.where((before < size) & (left != LOW), left << np.uint64(32) | spare.astype(np.uint64), NONE))):
                node = leaf + size
                tree[row, node] = value
                while node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] != NONE]
        return [tok[i, :size][live[i]] for i in range(n)]

    def merge_one(self, piece: bytes) -> list[int]:
        """The same for one long piece, with plain lists."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none = 1 << 63
        tok = [int(self.byte[b]) for b in piece] + [0]
        pair = self.pair.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pair(tok[i] << 32 | tok[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        live = [True] * n

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                v = tree[2 * i]
                w = tree[2 * i + 1]
                v = v if v < w else w
                if tree[i] == v:
                    return
                tree[i] = v
                i >>= 1

        while tree[1] != none:
            r, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            tok[at], nxt[at], live[gone] = r, after, False
            put(gone, none)
            q = pair(r << 32 | tok[after]) if after < n else None
            put(at, none if q is None else q << 32 | at)
            if after < n:
                prv[after] = at
            if before >= 0:
                q = pair(tok[before] << 32 | r)
                put(before, none if q is None else q << 32 | before)
        return [t for t, a in zip(tok, live) if a]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            r = self.ranks.get(b)
            if r is not None:
                self.cache[p] = r.to_bytes(4, "little")
            elif len(b) >= LONG:
                self.cache[p] = np.array(self.merge_one(b), "<u4").tobytes()
            else:
                by_size.setdefault((len(b) - 1).bit_length(), []).append((p, b))
        for bits, known in by_size.items():
            step = max(1, CELLS >> bits)
            for i in range(0, len(known), step):
                part = known[i : i + step]
                for (p, _), ids in zip(part, self.merge_many([b for _, b in part])):
                    self.cache[p] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        new = {p for pieces in split for p in pieces}.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = {p for pieces in split for p in pieces}
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def made(data: bytes, pattern: str) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    mine, key = kept("bpe"), (hash(data), pattern)
    if key not in mine:
        mine[key] = Bpe(read_ranks(data), pattern)
    return mine[key]


def convert(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary, the bytes that the ids stand for)
    for every row. The rank file is read by the driver and sent to the executors; its size doesn't depend on the data."""
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = made(data.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                ids = bpe.encode(part.column(1).to_numpy(zero_copy_only=False).tolist())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                back = pa.array([bpe.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), back], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return plain(docs, id_col, text_col).mapInArrow(trimmed(run, "bpe"), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def encoded(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ids and their count for each document, and whether they decode to its text."""
    import public_tokenizers

    out = convert(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
