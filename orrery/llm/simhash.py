"""SimHash near-deduplication with a Gray-ordered hierarchical index.

Two fingerprints that differ in at most 3 of 64 bits agree in at least one of four 16-bit blocks, so each distinct
fingerprint is entered in four buckets, one per block. Inside a bucket the fingerprints are sorted by their rank in the
reflected Gray code, so that neighbours share many bits. Upper nodes of the index hold the bits that all of a group
share (a value and a mask). Two groups are compared by the shared bits alone: differences counted there hold for every
pair below, so whole groups are pruned as soon as the count passes the limit, and further bits are counted going down.
Groups that already lie in one component are skipped too, since only connectivity is asked for; each task returns a
star for each of its components and never a list of all pairs. The stars are then joined to components by alternating
large-star and small-star steps.

Defined results: null or blank text gives fingerprint zero, linked like any other; a very long text is hashed in slices,
so its shingles are never held at once; repeated rows have one fingerprint; a component's id is the smallest id in it, rows
without an id not counting, and null if none has one; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.common import BROADCAST_KEYS, Stage, join_split, plain, release, sized, slices, table, trimmed, within, without

BLOCKS, BLOCK_BITS = 4, 16
#: Children of an index node.
FAN = 8
#: Fingerprints of a bucket that one task takes; larger buckets are dealt to tasks by pairs of parts.
PART = 200_000
#: Pairs of nodes expanded at a time.
STEP = 1 << 14
#: Documents whose shingles are counted, and shingles kept, for the order of prefixes.
SAMPLE, FREQUENT = 20_000, 400_000
#: Documents with one shingle in their prefixes that one task takes.
HOT = 5_000
#: Shingles that the prefixes of two documents must share before their sets are compared.
SHARED = 3
#: 64-bit numbers in a set's signature.
SIGNED = 8
#: Pairs that a task counts before it passes them on.
PAIRS = 500_000
#: Bytes of text whose features are made at a time.
SLICE = 1 << 19
#: Edges that one task takes to find their components.
ONE_TASK = 500_000
#: Edges from which those of a node with many neighbours are kept apart in the search for components.
MANY_EDGES = 1_000_000
#: Prints whose pairs are verified before those of the others, which then only join what is still apart.
EARLY = 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        part = w[at : min(n, at + 65536) + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if len(w) >= words else [w]
        h = np.array([digest(b" ".join(s), seed) for s in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_udf(words: int):
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for text in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in text], np.uint64).view(np.int64))
        release()

    return of


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> np.uint64(s))
    return f


class Forest:
    """Disjoint sets over 0..n-1; every root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.up[a], self.up[b]
            m = ra != rb
            a, b, ra, rb = a[m], b[m], ra[m], rb[m]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(nxt := self.up[self.up], self.up):
                self.up = nxt


class GrayIndex:
    """Index over the fingerprints of several buckets, each bucket a tree of its own."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes = order, codes[order]
        group = bucket[order]
        self.forest = Forest(len(codes))
        full = ~np.uint64(0)
        self.levels = [(self.codes, np.full(len(codes), full))]
        self.kids: list[np.ndarray] = []
        self.group = [group]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            first = np.r_[True, group[1:] != group[:-1]]
            at = np.arange(len(group))
            local = at - np.maximum.accumulate(np.where(first, at, 0))
            start = np.flatnonzero(local % FAN == 0)
            value, mask = self.levels[-1]
            every = np.bitwise_and.reduceat(value & mask, start)
            some = np.bitwise_or.reduceat(value | ~mask, start)
            self.levels.append((every, ~(every ^ some)))
            self.kids.append(np.r_[start, len(group)])
            group = group[start]
            self.group.append(group)

    def components(self, most: int) -> np.ndarray:
        """For each code, in index order, the position of the first of its component."""
        for level in range(1, len(self.levels)):
            self._bounds(level)
            edge = self.kids[level - 1]
            size = np.diff(edge)
            for i in range(FAN - 1):
                for j in range(i + 1, FAN):
                    has = np.flatnonzero(size > j)
                    if len(has):
                        self._descend(level - 1, edge[has] + i, edge[has] + j, most)
        return self.forest.up

    def _bounds(self, top: int) -> None:
        """Least and greatest root below each node, up to a level."""
        lo = hi = self.forest.up
        self.roots = [(lo, hi)]
        for k in range(top):
            start = self.kids[k][:-1]
            lo, hi = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
            self.roots.append((lo, hi))

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, most: int) -> None:
        stack = [(level, a[i : i + STEP], b[i : i + STEP]) for i in range(0, len(a), STEP)]
        while stack:
            level, a, b = stack.pop()
            value, mask = self.levels[level]
            near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= most
            lo, hi = self.roots[level] if level else (self.forest.up, self.forest.up)
            near &= ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
            a, b = a[near], b[near]
            if not len(a):
                continue
            if not level:
                self.forest.link(a, b)
                continue
            edge = self.kids[level - 1]
            na, nb = edge[a + 1] - edge[a], edge[b + 1] - edge[b]
            k = np.arange(FAN * FAN)
            i, j = k // FAN, k % FAN
            ok = (i < na[:, None]) & (j < nb[:, None])
            x, y = (edge[a][:, None] + i)[ok], (edge[b][:, None] + j)[ok]
            stack += [(level - 1, x[p : p + STEP], y[p : p + STEP]) for p in range(0, len(x), STEP)]


def stars(frames: Iterator[pd.DataFrame], most: int, chains: bool) -> Iterator[pd.DataFrame]:
    """Frames of (task, print, code) with the rows of a task together -> edges (print, a, b) that join each component of
    a task. A task holds codes of one print. chains: also the edges between neighbours of a component in Gray order."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["code"].to_numpy().view(np.uint64)
        index = GrayIndex(rows["task"].to_numpy(), codes)
        up = index.components(most)
        own = np.flatnonzero(up != np.arange(len(up)))
        a, b = own, up[own]
        if chains:
            line = np.argsort(up, kind="stable")
            same = np.flatnonzero(up[line[1:]] == up[line[:-1]])
            a, b = np.r_[a, line[same + 1]], np.r_[b, line[same]]
        return pd.DataFrame({"print": rows["print"].to_numpy()[index.order[a]], "a": index.codes[a].view(np.int64), "b": index.codes[b].view(np.int64)})

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        if sum(map(len, held)) < 20_000 or frame["task"].iloc[0] == frame["task"].iloc[-1] == held[0]["task"].iloc[0]:
            continue
        rows = pd.concat(held, ignore_index=True)
        open_task = rows["task"] == rows["task"].iloc[-1]
        held = [rows[open_task]]
        if not open_task.all():
            yield solve(rows[~open_task])
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def block(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def link_fingerprints(codes: DataFrame, most: int = 3, part: int = PART, chains: bool = False) -> DataFrame:
    """Edges (print, a, b) whose components are those of the relation "differs in at most `most` bits" (most < BLOCKS)
    on the distinct fingerprints (print, code), within each print. A bucket has one part for each `part` fingerprints;
    with more parts than one, each fingerprint goes to all tasks for pairs of parts that its own part is in."""
    if most >= BLOCKS:
        raise ValueError(f"most must be under {BLOCKS}")
    entries = codes.select("print", "code", F.posexplode(F.array(*(block(F.col("code"), k) for k in range(BLOCKS)))).alias("k", "v"))
    entries = entries.select("print", "code", ((F.col("print") * BLOCKS + F.col("k")) * (1 << BLOCK_BITS) + F.col("v")).alias("bucket"))
    # At most BLOCKS * 2 ** BLOCK_BITS rows for each print, so safe to broadcast at any size of input.
    large = entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).filter("parts > 1")
    dealt = entries.join(F.broadcast(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("code"), F.col("parts")))
    dealt = dealt.select("print", "code", "bucket", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"))
    pair = F.xxhash64("bucket", F.least("p", "q"), F.greatest("p", "q"))
    tasks = dealt.select(F.when((F.col("p") == 0) & (F.col("q") == 0), F.col("bucket").cast("long")).otherwise(pair).alias("task"), "print", "code")
    tasks = tasks.repartition("task").sortWithinPartitions("task")
    return tasks.mapInPandas(lambda it: stars(it, most, chains), "print int, a long, b long").distinct()


def united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges (a, b) -> (node, root) by disjoint sets."""
    rows = pd.concat([pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}), *frames], ignore_index=True)
    nodes, at = np.unique(rows[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    forest = Forest(len(nodes))
    forest.link(at[:, 0], at[:, 1])
    own = np.flatnonzero(forest.up != np.arange(len(nodes)))
    yield pd.DataFrame({"node": nodes[own], "root": nodes[forest.up[own]]})


def components(edges: DataFrame, stage: Stage, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge that reaches a lesser one, root being the least. A count shows whether one
    task can hold all edges; where it can't, alternating large-star and small-star steps find the same, each round staged,
    until a round changes nothing. Among many edges, a node
    with a great share of them gets its least neighbour by broadcast, so that no task holds all edges of one."""
    name = f"edges-{uuid.uuid4().hex[:8]}-"
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def met(left: DataFrame, low: DataFrame, total: int) -> DataFrame:
        return join_split(left, low, "a", total) if total >= MANY_EDGES else left.join(low.drop("n"), "a")

    now = stage.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    seen = mark(now)
    if seen[0] <= ONE_TASK:
        return stage.put(now.coalesce(1).mapInPandas(trimmed(united), "node long, root long"), f"{name}roots")
    for n in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = met(both, least, 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = met(large, down, seen[0]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        now = stage.put(new, f"{name}{n}")
        stage.drop(f"{name}{n - 1}")
        before, seen = seen, mark(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code (the fingerprint as a signed long), component_id for every row."""
    stage = Stage(docs.sparkSession, "simhash")
    rows = stage.put(plain(docs, id_col, text_col).select("doc_id", fingerprint_udf(words)("text").alias("code")), "codes")
    codes = rows.groupBy("code").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held"))
    roots = components(link_fingerprints(codes.select(F.lit(0).alias("print"), "code"), most).select("a", "b"), stage)
    known = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "first", "held", F.coalesce("root", "code").alias("root"))
    known = stage.put(known, "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_split(known, least, "root", known.count()).select("code", "component_id", F.col("held").alias("n"))
    named = stage.put(named, "named")
    stage.drop("known")
    return join_split(rows, named, "code", rows.count()).select("doc_id", "code", "component_id")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For all words of all texts the code of the word and the number of the text; and the words by code. Words are
    parted at ASCII white space, A-Z lower-cased."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    held = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[held], pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[held], coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, start: np.ndarray, words: int) -> np.ndarray:
    """32-bit hashes of the runs of so many words that begin at the given places."""
    out = np.zeros(len(start), np.uint64)
    for k in range(words):
        out = mixed(out ^ h[start + k])
    return out >> np.uint64(32)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def shingles(h: np.ndarray, text: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of n texts, in order by text, and their number by text. h and text: hash and
    text of each word. A text of fewer words is one shingle, one without words has none."""
    start = np.flatnonzero(text[: max(0, len(text) - words + 1)] == text[words - 1 :])
    key = [text[start].astype(np.uint64) << np.uint64(32) | rolled(h, start, words)]
    size = np.bincount(text, minlength=n)
    first = np.cumsum(size) - size
    for short in range(1, words):
        own = np.flatnonzero(size == short)
        key.append(own.astype(np.uint64) << np.uint64(32) | rolled(h, first[own], short))
    every = distinct(np.concatenate(key))
    return every.astype(np.uint32).view(np.int32), np.bincount((every >> np.uint64(32)).astype(np.int64), minlength=n)


def majority(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """rows: 64-bit numbers, several to a row, size[i] rows for text i. For each text the bits that more than half of its
    rows have. The counts of all bits are kept as bit planes and added pair by pair, 64 at a time."""
    planes, now = [rows], size.copy()
    while len(now) and now.max() > 1:
        local = np.arange(now.sum()) - np.repeat(np.cumsum(now) - now, now)
        even = np.flatnonzero(local % 2 == 0)
        pair = (local[even] + 1 < np.repeat(now, now)[even])[:, None]
        other = np.minimum(even + 1, len(local) - 1)
        carry, summed = None, []
        for p in planes:
            a, b = p[even], np.where(pair, p[other], np.uint64(0))
            x = a ^ b
            summed.append(x if carry is None else x ^ carry)
            carry = a & b if carry is None else a & b | x & carry
        planes, now = [*summed, carry], (now + 1) // 2
    full = ~np.uint64(0)
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], full)
    half = (size[size > 0] // 2).astype(np.uint64)
    for k in reversed(range(len(planes))):
        bit = np.where(half >> np.uint64(k) & np.uint64(1) == 1, full, np.uint64(0))[:, None]
        more |= same & planes[k] & ~bit
        same &= ~(planes[k] ^ bit)
    out = np.zeros((len(size), rows.shape[1]), np.uint64)
    out[size > 0] = more
    return out


def word_prints(word: np.ndarray, text: np.ndarray, n: int, h: np.ndarray, prints: int) -> np.ndarray:
    """SimHashes over the distinct words of n texts, each by hashes of its own. A changed word moves few bits of them,
    where it moves `words` times as much of a fingerprint over shingles. h: hash by word."""
    every = distinct(text.astype(np.int64) * max(1, len(h)) + word)
    own, of = every % max(1, len(h)), every // max(1, len(h))
    salt = np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(prints)], np.uint64)
    return majority(mixed(h[:, None] ^ salt)[own], np.bincount(of, minlength=n))


def signatures(every: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each set, given one after another with their sizes, SIGNED numbers of 64 bits: a bit is set if an odd number of
    elements fall on it. An element that only one of two sets has changes one bit at most, so the sets differ in as many
    elements as their signatures in bits, or more."""
    bits = 64 * SIGNED
    cell = np.repeat(np.arange(len(size)), size) * bits + (every.view(np.uint32) % np.uint32(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(size) * bits) & 1).astype(np.uint8).reshape(len(size), bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def features(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """doc_id, set (hashes of the distinct word shingles), key (digest of the set), sig (its signature), codes (SimHashes)
    for every row, in one pass over the texts."""
    listed = lambda values, n, k: pa.ListArray.from_arrays(np.arange(0, (n + 1) * k, k, dtype=np.int32), values.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE):
                n = len(texts)
                word, text, known = words_of(texts)
                h = np.array([xxhash.xxh64_intdigest(x, 42) for x in known.to_numpy(zero_copy_only=False)], np.uint64)
                every, size = shingles(h[word], text, n, words)
                stop = np.r_[0, np.cumsum(size)]
                keys = [xxhash.xxh3_128_digest(every[a:b].tobytes()) for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
                codes = word_prints(word, text, n, h, prints).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.ListArray.from_arrays(stop.astype(np.int32), every), pa.array(keys, pa.binary()), listed(signatures(every, size), n, SIGNED), listed(codes, n, prints)],
                    ["doc_id", "set", "key", "sig", "codes"],
                )
                at += n

    return docs.mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set array<int>, key binary, sig array<long>, codes array<long>")


def shingle_set(text: str | None, words: int) -> list[int]:
    """Distinct hashes of the word shingles of one text."""
    word, of, known = words_of(pa.array([text or ""]))
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in known.to_numpy(zero_copy_only=False)], np.uint64)
    return shingles(h[word], of, 1, words)[0].tolist()


def frequent(sets: DataFrame, stage: Stage) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of a sample of documents hold, sorted, and how many hold them. Only the order of a
    document's shingles is taken from it, so the sample bears on speed and never on which pairs are found. A table of how
    many shingles are held how often gives the least count of which FREQUENT at most reach the driver."""
    step = max(1, sets.count() // SAMPLE)
    held = sets.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.explode("set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = stage.put(held.filter("n > 1"), "frequent")
    least, total = 0, 0
    for n, many in sorted(map(tuple, held.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        total += many
        if total > FREQUENT:
            least = n + 1
            break
    rows = held.filter(F.col("n") >= least).toArrow().sort_by("token")
    stage.drop("frequent")
    return rows.column("token").to_numpy().astype(np.int32), rows.column("n").to_numpy().astype(np.int32)


def shared(similarity: float) -> int:
    """How many shingles prefixes must share: SHARED, or as many as any two unlike sets of the similarity have in common."""
    return max(1, min(SHARED, int(np.ceil(similarity / (1 - similarity) - 1e-9)))) if similarity < 1 else 1


def prefix(sets: pa.ListArray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each set, rarest first, of which two sets that are alike share at least shared(similarity):
    shingle, number of the set, place in it, how often it is held as far as known, and the size of each set. Sets with a Jaccard similarity of t have t times
    the larger one's size in common at least. Of these, all but s - 1 stand behind the s-th, so t * n - s shingles of each
    set can be left out, in any order that is the same for all sets."""
    token, held = common
    s, size = sets.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(sets).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(size)), size)
    n = np.zeros(len(s), np.int32)
    if len(token) and len(s):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        n = np.where(token[at] == s, held[at], 0)
    order = np.lexsort((s, n, of))
    place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
    first = place < (size - np.ceil(similarity * size - 1e-9) + shared(similarity))[of]
    return s[order][first], of[first], place[first], n[order][first], size


def prefix_pairs(frames: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Frames of (task, diagonal, part, doc_id, root, n, pos, sig) with the rows of a task together -> the pairs (a, b)
    that their sizes, the places of the shared shingles and, where there are, the signatures allow, without those of one
    root, and how many shingles they share. Off the diagonal only pairs of different parts. A shingle at place p leaves
    n - p to be shared from there on, and up to shared(similarity) - 1 stand before it."""
    spare = shared(similarity) - 1
    kept, waiting = np.zeros((0, 3), np.int64), [np.zeros((0, 3), np.int64)]

    def merged() -> np.ndarray:
        rows = np.concatenate([kept, *waiting])
        pairs, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
        return np.column_stack([pairs, np.bincount(at.reshape(-1), rows[:, 2], len(pairs)).astype(np.int64)])

    def solve(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        task, root = rows["task"].to_numpy(), rows["root"].to_numpy()
        start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        size = np.diff(np.r_[start, len(task)])
        unlike = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), size)
        if not unlike.any():
            return
        rows = rows[unlike]
        rows = rows.iloc[np.lexsort((rows["n"].to_numpy(), rows["task"].to_numpy()))]
        task, root, n, doc, part, diagonal, pos = (rows[c].to_numpy() for c in ("task", "root", "n", "doc_id", "part", "diagonal", "pos"))
        signed = rows["sig"].notna().to_numpy()
        sig = np.zeros((len(rows), SIGNED), np.uint64)
        sig[signed] = np.frombuffer(b"".join(rows["sig"][signed]), np.uint64).reshape(-1, SIGNED)
        i = np.arange(len(task))
        k = 0
        while True:
            k += 1
            i = i[i + k < len(task)]
            j = i + k
            # Sizes rise within a task: what is too long for one offset is so for all greater ones.
            near = (task[i] == task[j]) & (similarity * n[j] <= n[i] + 1e-9)
            i, j = i[near], j[near]
            if not len(i):
                return
            need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9) - spare
            ok = (root[i] != root[j]) & (diagonal[i] | (part[i] != part[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            x, y = i[ok], j[ok]
            most = np.where(signed[x] & signed[y], (1 - similarity) / (1 + similarity) * (n[x] + n[y]) + 1e-9, np.inf)
            ok = np.bitwise_count(sig[x] ^ sig[y]).sum(1, dtype=np.int64) <= most
            x, y = x[ok], y[ok]
            if len(x):
                yield np.column_stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), np.ones(len(x), np.int64)])

    def taken(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal kept, waiting
        for pairs in solve(rows):
            waiting.append(pairs)
            if sum(map(len, waiting)) > PAIRS:
                kept, waiting = merged(), []
                if len(kept) > PAIRS:
                    yield pd.DataFrame(kept, columns=["a", "b", "n"])
                    kept = kept[:0]

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        if sum(map(len, held)) < 50_000 or frame["task"].iloc[0] == frame["task"].iloc[-1] == held[0]["task"].iloc[0]:
            continue
        rows = pd.concat(held, ignore_index=True)
        open_task = rows["task"] == rows["task"].iloc[-1]
        held = [rows[open_task]]
        if not open_task.all():
            yield from taken(rows[~open_task])
    if held:
        yield from taken(pd.concat(held, ignore_index=True))
    kept = merged()
    if len(kept):
        yield pd.DataFrame(kept, columns=["a", "b", "n"])


def similar_pairs(sets: DataFrame, roots: DataFrame, stage: Stage, similarity: float, part: int = HOT) -> DataFrame:
    """Pairs (a, b) that hold all pairs of documents with a Jaccard similarity of at least `similarity` whose roots
    differ, by prefixes of the shingle sets (doc_id, set, sig), no two of which are equal. A shingle in the prefixes of more than `part` documents is
    dealt to tasks by pairs of parts."""
    common = sets.sparkSession.sparkContext.broadcast(frequent(sets, stage))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, of, place, known, size = prefix(batch.column(1), similarity, common.value)
            doc, root = (batch.column(k).to_numpy(zero_copy_only=False)[of] for k in (0, 2))
            # Shingles that many hold are few and make most pairs; they alone carry the signature along.
            sig = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIGNED)
            sig = [x.tobytes() if k else None for x, k in zip(sig[of], known > 0)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (token, doc, root, size[of].astype(np.int32), place.astype(np.int32))), pa.array(sig, pa.binary())], ["token", "doc_id", "root", "n", "pos", "sig"])

    named = sets.filter(F.size("set") > 0).join(sized(roots.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("doc_id", "set", F.coalesce("root", "doc_id").alias("root"), "sig")
    rows = stage.put(named.mapInArrow(trimmed(tokens), "token int, doc_id long, root long, n int, pos int, sig binary"), "tokens")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # At most one row for each `part` rows, so safe to broadcast.
    large = counts.filter(F.col("c") > part).select("token", F.ceil(F.col("c") / part).alias("parts"))
    dealt = rows.join(F.broadcast(large), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    task = F.when(F.col("parts") == 1, F.col("token").cast("long")).otherwise(F.xxhash64("token", F.least("part", "q"), F.greatest("part", "q")))
    # Rows of part p stand in task (p, p) once and in each task (p, q); a task off the diagonal has no row of p = q.
    dealt = dealt.select(task.alias("task"), (F.col("part") == F.col("q")).alias("diagonal"), "part", "doc_id", "root", "n", "pos", "sig")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    met = dealt.mapInPandas(trimmed(lambda it: prefix_pairs(it, similarity)), "a long, b long, n long").filter("a <> b")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= shared(similarity)).select("a", "b")


def alike(pairs: DataFrame, sets: DataFrame, stage: Stage, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least `similarity`. Two empty sets are alike. Sizes and
    signatures rule most others out; only the sets of documents in a pair that is left are moved."""
    name = f"near-{uuid.uuid4().hex[:8]}"
    one, two = (sets.select(F.col("doc_id").alias(c), F.size("set").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    size = F.col("n_a") + F.col("n_b")
    may = (similarity * F.greatest("n_a", "n_b") <= F.least("n_a", "n_b") + 1e-9) & (apart <= (1 - similarity) / (1 + similarity) * size + 1e-9)
    near = stage.put(pairs.join(one, "a").join(two, "b").filter(may).select("a", "b").distinct(), name)
    few = within(sets.select("doc_id", "set"), near.select("a").union(near.select("b")), stage)
    few = stage.put(few, f"{name}-sets")
    left, right = (few.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    every = F.size("set_a") + F.size("set_b") - both
    return near.join(left, "a").join(right, "b").filter((every == 0) | (both >= similarity * every)).select("a", "b")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified_links(docs: DataFrame, stage: Stage, similarity: float = 0.8, words: int = 5, most: int = 3, prints: int = 16) -> DataFrame:
    """Edges (a, b), a < b, between ids of documents whose shingle sets have a Jaccard similarity of at least
    `similarity`; their components are those of all such pairs. Documents of equal sets are linked to the one of
    smallest id, which stands for them from there on. The pairs that the SimHash index proposes are verified next: in
    each print, documents of equal fingerprints with the one of smallest id, and the linked fingerprints with each other
    by their smallest ids; those of the first EARLY prints, then those of all others that these haven't joined. That joins most of a large group by few edges. All pairs that are still apart and whose prefixes meet
    are then verified. Two empty sets are alike."""
    rows = stage.put(features(plain(docs).filter("doc_id is not null"), words, prints), "features")
    keys = stage.put(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "keys")
    equal = stage.put(join_split(rows.select("doc_id", "key"), keys, "key", rows.count()).filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "equal")
    single = rows.join(sized(keys.select("key", "first"), BROADCAST_KEYS), "key", "left").filter("first is null or first = doc_id").select("doc_id", "set", "sig", "codes")

    codes = single.select("doc_id", F.posexplode("codes").alias("print", "code"))
    first = stage.put(codes.groupBy("print", "code").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    same = join_split(codes, first.filter("n > 1"), ["print", "code"], first.agg(F.sum("n")).first()[0] or 0).filter("doc_id <> first").select("print", *ordered("first", "doc_id"))
    links = link_fingerprints(first.select("print", "code"), most, chains=True)
    one, two = (first.select("print", F.col("code").alias(c), F.col("first").alias(f"doc_{c}")) for c in "ab")
    near = links.join(one, ["print", "a"]).join(two, ["print", "b"]).filter("doc_a <> doc_b").select("print", *ordered("doc_a", "doc_b"))
    pairs = stage.put(same.unionByName(near), "pairs")
    known = stage.put(alike(pairs.filter(F.col("print") < EARLY).select("a", "b").distinct(), single, stage, similarity), "early")
    # Documents with one least neighbour are joined already; the whole components aren't needed to see that.
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stage.put(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")), "low")
    root = lambda c: low.select(F.col("a").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.filter(F.col("print") >= EARLY).select("a", "b").distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = stage.put(apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "apart")
    known = known.unionByName(stage.put(alike(apart, single, stage, similarity), "late"))
    stage.sweep("pairs", "first", "apart", "low")
    rest = stage.put(similar_pairs(single, components(known, stage), stage, similarity), "rest")
    stage.sweep("tokens")
    links = stage.put(equal.unionByName(known).unionByName(alike(rest, single, stage, similarity)), "links")
    stage.sweep("features", "keys", "equal", "early", "late", "rest")
    return links


def survivors(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Pipeline stage: of each group of documents joined by verified links the one with the smallest id stays; so do rows
    without an id. Only a document that is like another one is ever dropped."""
    stage = Stage(docs.sparkSession, "near")
    roots = components(verified_links(docs, stage, similarity, words), stage)
    return without(docs, roots.filter("node <> root").select("node"), stage)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
