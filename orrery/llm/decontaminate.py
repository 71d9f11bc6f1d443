"""Benchmark decontamination by latent semantic retrieval.

The index holds windows of WINDOW words of every benchmark item as TF-IDF vectors, reduced by a randomised SVD whose
products with the window matrix are made by Spark tasks. Document frequencies are counted over all documents. Every
document is read as windows of the same length, STRIDE words apart. A window whose weight lies mostly in words that no
item has can't be like an item and is left out; the others are projected, and pairs with a cosine of COSINE or more and
enough of the item's energy are candidates. Those that share words of enough weight are confirmed by the longest common
subsequence of the item's words and the words of the document around the match: a share of SAME or more of the item, or
PARAPHRASE or more where the item's last words, its answer, all stand there in order.

The weights above drop paraphrases whose heaviest words changed and items shorter than a window. So the same rule is also
applied wherever a count of words allows it: a common subsequence of PARAPHRASE of an item needs as many places of the
item whose words stand in the document, and as many words of the item in the stretch that is looked at. Nothing that
passes the rule at a place ITEM_STRIDE words apart fails these counts, whatever its words weigh.

The benchmark is the query set. It is taken in blocks of at most BLOCK items, each broadcast by itself and gone before the
next one is built; the words of many blocks are counted in one pass over the documents.

Defined results: null and blank texts are clean; an empty benchmark leaves all documents clean; items of under MIN_WORDS
words are found where all their words stand one after the other, items without words or id never; among several items
that a document holds, `items` lists all in order, and `item_id` is the one of greatest similarity, ties to the smallest;
ids of items may be of any type that has an order; repeated rows get equal results; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.common import Stage, plain, rows_of, table, trimmed, without

WINDOW, STRIDE, ITEM_STRIDE = 16, 4, 4
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: Least cosine in the latent space, share of the item window's energy there that the document's window must have, and
#: share of its squared weight in words that both have.
COSINE, ENERGY, OVERLAP = 0.5, 0.4, 0.4
SAME, PARAPHRASE, ANSWER = 0.8, 0.6, 4
#: Share of a window's squared weight that must lie in words of the benchmark.
KNOWN = 0.45
MIN_WORDS, BLOCK, BATCH = 5, 2000, 500
#: Distinct words of the blocks that are counted in one pass, and the most such blocks.
VOCABULARY, TOGETHER = 500_000, 50
APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs without white space and ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(APART).split()


def ids_of(vocabulary: dict[bytes, int], text: str | None) -> np.ndarray:
    """Word ids; 0 for words that no item has."""
    w = words_of(text)
    return np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w))


def common_length(item: dict[int, int], size: int, region: list[int]) -> int:
    """Longest common subsequence, bit-parallel. item: for each word the set bits of its places."""
    full = (1 << size) - 1
    v = full
    for c in region:
        u = v & item.get(c, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def starts(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of so many words the places of its windows, the last flush with its end; and the run of each."""
    spare = np.maximum(lengths - WINDOW, 0)
    n = np.where(lengths > 0, -(-spare // stride) + 1, 0)
    run = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(k * stride, spare[run]), run


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    items: list[tuple[object, list[int]]]
    weight: np.ndarray  # idf by word id; at 0 that of words that no item has
    basis: np.ndarray  # row of the projection by word id
    words: np.ndarray  # word ids of item windows, padded with -1
    latent: np.ndarray  # unit vectors of item windows
    norm: np.ndarray  # their lengths before
    of: np.ndarray  # item of each window
    at: np.ndarray  # its place in the item

    def __post_init__(self) -> None:
        """For each word the items that hold it and at how many places: pairs from edge[word] to edge[word + 1]."""
        self.size = np.array([len(w) for _, w in self.items])
        self.need = np.where(self.size < MIN_WORDS, self.size, np.ceil(PARAPHRASE * self.size - 1e-9)).astype(np.int64)
        self.sure = np.where(self.size < MIN_WORDS, self.size, np.ceil(SAME * self.size - 1e-9)).astype(np.int64)
        word = np.concatenate([np.asarray(w, np.int64) for _, w in self.items])
        key, self.times = np.unique(word * len(self.items) + np.repeat(np.arange(len(self.items)), self.size), return_counts=True)
        self.holder = key % len(self.items)
        self.edge = np.searchsorted(key // len(self.items), np.arange(len(self.vocabulary) + 2))

    def counted(self, run: np.ndarray) -> dict[int, float]:
        """The items that a run of word ids holds by the rule, tried at all places that the word counts allow."""
        out: dict[int, float] = {}
        u = np.unique(run)
        u = u[u > 0]
        n = self.edge[u + 1] - self.edge[u]
        at = np.repeat(self.edge[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        there = np.bincount(self.holder[at], self.times[at], len(self.items))
        for k in np.flatnonzero(there >= self.need).tolist():
            item_id, item = self.items[k]
            if len(item) < MIN_WORDS:
                spare = len(run) - len(item) + 1
                if spare > 0 and np.logical_and.reduce([run[i : i + spare] == c for i, c in enumerate(item)]).any():
                    out[item_id] = 1.0
                continue
            end = item[-ANSWER:]
            if there[k] < self.sure[k] and not np.isin(end, u).all():
                continue
            mine = np.zeros(len(self.weight), bool)
            mine[item] = True
            held = np.flatnonzero(mine[run])
            slack = ITEM_STRIDE + max(8, len(item) // 4)
            begin = np.arange(-len(item), len(run), ITEM_STRIDE)
            # Words that the item lacks never count in a subsequence, so regions are stretches of the held words.
            lo, hi = np.searchsorted(held, np.maximum(begin - slack, 0)), np.searchsorted(held, begin + len(item) + slack)
            tried = np.unique(np.stack([lo, hi], 1)[hi - lo >= self.need[k]], axis=0)
            words = run[held].tolist()
            best, a = 0, 0
            while a < len(tried) and best < len(item):
                # A subsequence of a stretch that covers several regions is at least as long as that of each.
                b = a + 1
                while b < len(tried) and b < a + 8 and tried[b, 0] < tried[b - 1, 1]:
                    b += 1
                if common_length(self.places(k), len(item), words[tried[a, 0] : tried[b - 1, 1]]) >= max(self.need[k], best + 1):
                    for x, y in tried[a:b].tolist():
                        same = common_length(self.places(k), len(item), words[x:y])
                        if same > best and (same / len(item) >= SAME or same / len(item) >= PARAPHRASE and common_length(places(end), len(end), words[x:y]) == len(end)):
                            best = same
                a = b
            if best:
                out[item_id] = max(best / len(item), out.get(item_id, 0.0))
        return out

    def search(self, runs: list[np.ndarray], cosine: float = COSINE) -> list[list[tuple[int, float]]]:
        """For each run of word ids the items that it holds, with their similarity."""
        out = [self.counted(r) for r in runs]
        if not len(self.of):
            return [sorted(x.items()) for x in out]
        lengths = np.array([len(r) for r in runs])
        flat = np.concatenate([*runs, np.zeros(WINDOW, np.int32)])
        base = np.cumsum(lengths) - lengths
        s, run = starts(lengths, STRIDE)
        lo = base[run] + s
        hi = np.minimum(lo + WINDOW, base[run] + lengths[run])
        square = self.weight[flat] ** 2
        every = np.r_[0, np.cumsum(square)]
        known = np.r_[0, np.cumsum(np.where(flat > 0, square, 0))]
        keep = known[hi] - known[lo] >= KNOWN * (every[hi] - every[lo])
        lo, hi, run, s = lo[keep], hi[keep], run[keep], s[keep]
        tasks: dict[tuple[int, int, int], None] = {}
        for a in range(0, len(lo), 8192):
            place = lo[a : a + 8192, None] + np.arange(WINDOW)
            word = np.where(place < hi[a : a + 8192, None], flat[place], 0)
            x = self.basis[word].sum(1)
            dot = x @ self.latent.T
            length = np.linalg.norm(x, axis=1, keepdims=True)
            w, j = np.nonzero(dot >= np.maximum(cosine * length, ENERGY * self.norm))
            w, j = self.overlapping(word, w, j)
            w += a
            begin = (s[w] - self.at[j]) // ITEM_STRIDE
            tasks |= dict.fromkeys(zip(run[w].tolist(), self.of[j].tolist(), begin.tolist()))
        for r, k, begin in tasks:
            item_id, item = self.items[k]
            slack = ITEM_STRIDE + max(8, len(item) // 4)
            a = begin * ITEM_STRIDE
            region = runs[r][max(0, a - slack) : max(0, a + len(item) + slack)].tolist()
            same = common_length(self.places(k), len(item), region) / len(item)
            if same < SAME:
                end = item[-ANSWER:]
                if same < PARAPHRASE or common_length(places(end), len(end), region) < len(end):
                    continue
            out[r][item_id] = max(same, out[r].get(item_id, 0.0))
        return [sorted(x.items()) for x in out]

    def overlapping(self, word: np.ndarray, w: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate pairs those whose windows share words of enough weight."""
        keep = np.zeros(len(w), bool)
        for a in range(0, len(w), 8192):
            item = self.words[j[a : a + 8192]]
            weight = np.where(item < 0, 0, self.weight[item] ** 2)
            both = (item[:, :, None] == word[w[a : a + 8192], None, :]).any(2)
            keep[a : a + 8192] = (weight * both).sum(1) >= OVERLAP * weight.sum(1)
        return w[keep], j[keep]

    def places(self, k: int) -> dict[int, int]:
        if not hasattr(self, "_places"):
            self._places: dict[int, dict[int, int]] = {}
        if k not in self._places:
            self._places[k] = places(self.items[k][1])
        return self._places[k]


def document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary stands, over all documents; and their number. Each task sends
    one row per word at most."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value) + 1, np.int64)
        n = 0
        for batch in batches:
            for t in batch.column(0).to_numpy(zero_copy_only=False):
                n += 1
                df[np.unique(ids_of(shared.value, t))] += 1
        df[0] = n
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], ["word", "df"])

    got = docs.select("text").mapInArrow(trimmed(count), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    shared.unpersist()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[got.column("word").to_numpy()] = got.column("df").to_numpy()
    return df, int(df[0])


def randomised_svd(spark: SparkSession, rows: list[np.ndarray], weight: np.ndarray, rank: int = RANK, seed: int = 0) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix with a row for each window. The tasks hold the rows
    and return their share of A'(A Q); the driver keeps only tables of words x (rank + OVERSAMPLE)."""
    width = len(weight)
    k = min(rank + OVERSAMPLE, width, max(1, len(rows)))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    parts = max(1, min(8, len(rows) // 4000))
    spread = rows_of(spark, w=[r.tolist() for r in rows]).repartition(parts).persist()

    def product(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((basis, weight))

        def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, idf = shared.value
            z = np.zeros_like(q)
            for frame in frames:
                for w in frame["w"]:
                    w, n = np.unique(np.asarray(w), return_counts=True)
                    v = n * idf[w]
                    v /= np.linalg.norm(v)
                    z[w] += v[:, None] * (v @ q[w])
            yield pd.DataFrame({"z": [z.tobytes()]})

        out = sum(np.frombuffer(r["z"]).reshape(basis.shape) for r in spread.mapInPandas(share, "z binary").collect())
        shared.unpersist()
        return out

    for _ in range(POWER):
        q = np.linalg.qr(product(q))[0]
    value, vector = np.linalg.eigh(q.T @ product(q))
    spread.unpersist()
    return q @ vector[:, np.argsort(-value)[:rank]]


def build(spark: SparkSession, block: list[tuple[object, str]], count: dict[bytes, int], n: int) -> Index | None:
    """Index of a block of items; None if it has no item with words. count: in how many of n documents a word stands.
    Items of under MIN_WORDS words have no windows."""
    texts = [(i, w) for i, t in block if (w := words_of(t))]
    if not texts:
        return None
    known = sorted({w for _, t in texts for w in t})
    vocabulary = {w: k for k, w in enumerate(known, 1)}
    items = [(i, [vocabulary[w] for w in t]) for i, t in texts]
    weight = np.log((1 + n) / (1 + np.array([n, *(count[w] for w in known)]))) + 1
    weight[0] = np.median(weight[1:])
    s, of = starts(np.array([len(t) if len(t) >= MIN_WORDS else 0 for _, t in items]), ITEM_STRIDE)
    if not len(s):
        return Index(vocabulary, items, weight, np.zeros((len(weight), 1), np.float32), np.zeros((0, WINDOW), np.int64), np.zeros((0, 1)), np.zeros(0), of, s)
    rows = [np.array(items[k][1][a : a + WINDOW]) for a, k in zip(s.tolist(), of.tolist())]
    basis = randomised_svd(spark, rows, np.r_[0.0, weight[1:]])
    basis = (basis * weight[:, None]).astype(np.float32)
    basis[0] = 0
    latent = np.stack([basis[r].sum(0) for r in rows])
    norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    padded = np.full((len(rows), WINDOW), -1)
    for i, r in enumerate(rows):
        padded[i, : len(r)] = r
    return Index(vocabulary, items, weight, basis, padded, latent / norm[:, None], norm, of, s)


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    held: list[tuple[object, str]] = []
    for r in benchmark.select("item_id", "text").filter("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def together(found: Iterator[list[tuple[object, str]]], most: int = VOCABULARY) -> Iterator[tuple[list[list[tuple[object, str]]], set[bytes]]]:
    """Blocks whose words are counted in one pass, one block at least, and the words."""
    held: list[list[tuple[object, str]]] = []
    words: set[bytes] = set()
    for block in found:
        more = {w for _, t in block for w in words_of(t)}
        if held and (len(words | more) > most or len(held) == TOGETHER):
            yield held, words
            held, words = [], set()
        held.append(block)
        words |= more
    if held:
        yield held, words


def indexes(docs: DataFrame, benchmark: DataFrame, size: int) -> Iterator[Index]:
    """The index of one block after another."""
    for some, words in together(blocks(benchmark, size)):
        if words:
            df, n = document_frequency(docs, {w: k for k, w in enumerate(sorted(words), 1)})
            count = dict(zip(sorted(words), df[1:].tolist()))
            yield from (x for block in some if (x := build(docs.sparkSession, block, count, n)))


FIELDS = ["doc_id", "contaminated", "item_id", "similarity", "items"]


def searched(rows: DataFrame, index: object, kind: str, own: str, item: pa.DataType, hits_only: bool) -> DataFrame:
    """The rows against a broadcast index, None for none. hits_only: rows with an item alone, with the digest of their
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                texts = part.column(1).to_numpy(zero_copy_only=False)
                found = index.value.search([ids_of(index.value.vocabulary, t) for t in texts]) if index else [[] for _ in texts]
                best = [min(((-s, x) for x, s in f), default=(None, None)) for f in found]
                columns = [
                    part.column(0), pa.array([bool(f) for f in found], pa.bool_()), pa.array([b[1] for b in best], item),
                    pa.array([None if b[0] is None else -b[0] for b in best], pa.float64()), pa.array([[x for x, _ in f] for f in found], pa.list_(item)),
                ]
                names = FIELDS
                if hits_only:
                    columns, names = [*columns, part.column(2), pa.array([[s for _, s in f] for f in found], pa.list_(pa.float64()))], [*FIELDS, "digest", "scores"]
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out.filter(columns[1]) if hits_only else out

    more = ", digest binary, scores array<double>" if hits_only else ""
    return rows.mapInArrow(trimmed(run), f"doc_id {own}, contaminated boolean, item_id {kind}, similarity double, items array<{kind}>{more}")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """doc_id, contaminated, item_id, similarity, items for every row. With one block the rows are judged where they are
    read. With more, each block is a pass of its own over the documents that leaves only what it found, so no task ever
    holds two indexes; what is found meets the rows again by id and digest of the text."""
    spark = docs.sparkSession
    rows = plain(docs, id_col, text_col)
    kind, own = benchmark.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    item = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    found = indexes(rows, benchmark, size)
    first, second = next(found, None), next(found, None)
    if second is None:
        return searched(rows, spark.sparkContext.broadcast(first) if first else None, kind, own, item, False)
    stage = Stage(spark, "matches")
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    parts = []
    for n, index in enumerate(chain([first, second], found)):
        shared = spark.sparkContext.broadcast(index)
        parts.append(stage.put(searched(keyed, shared, kind, own, item, True).distinct(), f"block{n}"))
        shared.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    pairs = every.select("doc_id", "digest", F.explode(F.arrays_zip("items", "scores")).alias("x"))
    best = F.min(F.struct((-F.col("x.scores")).alias("s"), F.col("x.items").alias("i")))
    met = pairs.groupBy("doc_id", "digest").agg(best.alias("best"), F.array_sort(F.collect_set("x.items")).alias("_items"))
    met = met.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "best", "_items")
    keys = keyed.select("doc_id", "digest")
    out = keys.join(met, keys["doc_id"].eqNullSafe(met["_id"]) & (keys["digest"] == met["_digest"]), "left")
    empty = F.array().cast(f"array<{kind}>")
    return out.select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.i").alias("item_id"), (-F.col("best.s")).alias("similarity"), F.coalesce("_items", empty).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that hold no item, with their own columns. An id is dropped if any of its rows is
    contaminated; rows without an id stay."""
    bad = matches(docs, benchmark).filter("contaminated and doc_id is not null").select("doc_id")
    return without(docs, bad, Stage(docs.sparkSession, "clean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
