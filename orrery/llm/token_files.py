"""Token ids in binary files: frequency-ranked, byte-aligned, of variable length, with separate control bytes.

Ids are counted over all documents and numbered by falling frequency (ties: the smaller id first), so most take one byte.
Four ids share a control byte of four 2-bit lengths less one; the 1 to 4 bytes of each id follow in a stream of their
own, low byte first. A block holds the ids of whole documents, in ascending order of doc_id, until it has BLOCK ids, with
the documents' ids and counts. Blocks are rows of Parquet files, which any store that Spark writes to can hold and whose
commit protocol survives lost executors. A decoder needs the list of ids by rank, kept beside the blocks, and reads the
lengths of all ids with one numpy look-up of the control bytes.

Defined results: null and empty texts have the end id alone; rows without doc_id come first; rows of equal or no doc_id
are ordered by the crc32 of their ids, then by the ids; a very long text is cut at blanks where that can't change its ids;
a tokenizer that doesn't part texts at blanks gets whole texts; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import Stage, kept, plain, rows_of, slices, table, trimmed

BLOCK = 1 << 20
BATCH = 500
#: Bytes of text encoded at a time; longer texts are cut at blanks.
SLICE = 8 << 20
#: Words given to the tokenizer as one text.
JOINED = 400
#: Units in a worker's table before it starts afresh.
CACHE = 800_000
OTHER, LETTERS, ASCII, EMPTY = range(4)
# Marks that are taken from the ends of words.
TAIL = ".,;:!?"
# ASCII white space, at which texts are parted, and pieces of which the tokenizer must show that it can be.
BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "\r\n"]
PROBES = ["a", "Ab", "\u00e9", "e\u0301", "\u6f22\u5b57", "7", "12", "!", "...", "'", "'s", "x'll", "_", "-", "\u00a0", "\u2003", "\U0001f600", "\u0301", "a1!b", "<|endoftext|>"]
# Marks of which one may be a token of its own, to stand between words.
MARKS = "^`~\\{}<>=+"

LENGTHS = np.array([[(b >> 2 * k & 3) + 1 for k in range(4)] for b in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((-(-len(v) // 4), 4), np.uint8)
    four.reshape(-1)[: len(v)] = extra
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(length) - length
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = d[at]
    for k in range(1, 4):
        m = length > k
        out[m] |= d[at[m] + k] << np.uint32(8 * k)
    return out


def width(most: int) -> str:
    """Type of staged ids: two bytes where all fit."""
    return "<u2" if most < 1 << 16 else "<u4"


def gathered(flat: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[first[r] : first[r + 1]] for all rows one after another, and the length of each."""
    size = first[rows + 1] - first[rows]
    stop = np.cumsum(size)
    at = np.repeat(first[rows] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    return flat[at], size


class Encoder:
    """The tokenizers library, given each distinct word of a slice of texts once, less the marks at its end; what words
    have is kept in a bounded table. That is right where a text's ids are those of its words one after another, which is
    tried out on pairs of pieces around all blanks; a tokenizer that fails gets whole texts. Many words go to the library
    as one text. Words of letters are parted by the tokens that end a word, others by a mark that is a token of its own.
    Lower-cased ASCII letters need none of the tokenizer's own steps before its model, if that shows on its vocabulary."""

    def __init__(self, spec: str, end: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(end, *vocabulary.values()) + 1
        self.kind, self.end = width(self.size - 1), end
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        own = [self._library(list(x)) for x in (PROBES, MARKS, TAIL)]
        self.by_word = self._parts_at_blanks(dict(zip(PROBES, own[0])))
        self.tails = self.by_word and self._parts_tails()
        self.mark, self.mark_id = next(((m, ids[0]) for m, ids in zip(MARKS, own[1]) if len(ids) == 1), ("", -1))
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = sorted({w for t in vocabulary if (w := t.removesuffix("</w>")).isascii() and w.isalpha()})
        letters = [f(w) for w in letters[:: max(1, len(letters) // 4000)] for f in (str, str.upper, lambda w: w + w[::-1])]
        if not letters or self._library(letters) != [e.ids for e in self.bare.encode_batch_fast([w.lower() for w in letters], add_special_tokens=False)]:
            self.bare = None
        self._fresh()

    def _fresh(self) -> None:
        self.row, self.flat, self.first = {"": 0}, np.zeros(0, self.kind), np.zeros(2, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts_at_blanks(self, own: dict[str, list[int]]) -> bool:
        tried = [(p, b, q) for b in BLANKS for p in ["", *PROBES] for q in ["", *PROBES]]
        return all(ids == own.get(p, []) + own.get(q, []) for (p, _, q), ids in zip(tried, self._library([p + b + q for p, b, q in tried])))

    def _parts_tails(self) -> bool:
        """Whether letters and marks at the end of a word are encoded apart, and letters to one closed token at the end."""
        words, tails = ["a", "Ab", "\u00e9", "\u6f22\u5b57", "word"], [*TAIL, "...", "?!", ".,"]
        own = dict(zip(words + tails, self._library(words + tails)))
        whole = self._library([w + t for w in words for t in tails])
        return whole == [own[w] + own[t] for w in words for t in tails] and all(np.flatnonzero(self.closes[own[w]]).tolist() == [len(own[w]) - 1] for w in words)

    def _learn(self, units: list[str], join: str, apart: Callable[[np.ndarray, int], np.ndarray | None], library: object) -> None:
        """Adds units to the table; apart finds the lengths of so many units in the ids of their common text."""
        ids, size = [self.flat], [np.diff(self.first)]
        for at in range(0, len(units), 64 * JOINED):
            parts = [units[i : i + JOINED] for i in range(at, min(len(units), at + 64 * JOINED), JOINED)]
            for part, e in zip(parts, library.encode_batch_fast([join.join(p) for p in parts], add_special_tokens=False)):
                got = np.array(e.ids, self.kind)
                n = apart(got, len(part))
                if n is None:
                    each = self._library(part)
                    ids.append(np.array([x for e in each for x in e], self.kind))
                    size.append(np.array([len(e) for e in each], np.int64))
                else:
                    ids.append(got if n.sum() == len(got) else got[got != self.mark_id])
                    size.append(n)
        self.row.update(zip(units, range(len(self.first) - 1, len(self.first) - 1 + len(units))))
        self.flat = np.concatenate(ids)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(size))])

    def _closed(self, ids: np.ndarray, n: int) -> np.ndarray | None:
        stop = np.flatnonzero(self.closes[ids]) + 1
        return np.diff(stop, prepend=0) if len(stop) == n and stop[-1] == len(ids) else None

    def _marked(self, ids: np.ndarray, n: int) -> np.ndarray | None:
        at = np.flatnonzero(ids == self.mark_id)
        return np.diff(at, prepend=-1, append=len(ids)) - 1 if len(at) == n - 1 and self.mark else None

    def _rows(self, units: pa.Array, kind: np.ndarray) -> np.ndarray:
        """Places in the table, where units that are new are put first. kind: ASCII, LETTERS or OTHER."""
        names = units.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        rows = np.fromiter(map(self.row.get, names, repeat(-1)), np.int64, len(names))
        if len(self.row) + np.count_nonzero(rows < 0) > CACHE:
            self._fresh()
            rows = np.where(kind == EMPTY, 0, -1)
        if not (rows < 0).any():
            return rows
        for k, join, apart, library in ((ASCII, "\n", self._closed, self.bare), (LETTERS, "\n", self._closed, self.tokenizer), (OTHER, f"\n{self.mark}\n", self._marked, self.tokenizer)):
            new = np.flatnonzero((kind == k) & (rows < 0))
            rows[new] = np.arange(len(new)) + len(self.first) - 1
            if len(new):
                self._learn([names[i] for i in new.tolist()], join, apart, library)
        return rows

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        base = pc.utf8_rtrim(words, characters=TAIL)
        plain = pc.utf8_normalize(base, "NFC")
        # What is letters only once it is normalised; the capital I with a dot becomes two characters in lower case.
        letters = flag(pc.utf8_is_alpha(base)) & flag(pc.utf8_is_alpha(plain)) & ~flag(pc.match_substring(plain, "\u0130")) & self.tails
        ascii = letters & flag(pc.string_is_ascii(base)) & (self.bare is not None)
        coded = pc.if_else(pa.array(ascii), pc.ascii_lower(base), pc.if_else(pa.array(letters), base, words)).dictionary_encode()
        code = flag(coded.indices)
        kind = np.zeros(len(coded.dictionary), np.int8)
        kind[code] = np.where(ascii, ASCII, np.where(letters, LETTERS, OTHER))
        kind[flag(pc.equal(coded.dictionary, ""))] = EMPTY
        cut = letters & (flag(pc.binary_length(words)) > flag(pc.binary_length(base)))
        tail = pa.array([w[len(w.rstrip(TAIL)) :] for w in flag(words.filter(pa.array(cut))).tolist()], pa.string()).dictionary_encode()
        apart = pc.index_in(tail.dictionary, coded.dictionary)  # a tail may be a word too
        more = tail.dictionary.filter(pc.is_null(apart))
        rows = self._rows(pa.concat_arrays([coded.dictionary, more]), np.concatenate([kind, np.full(len(more), OTHER, np.int8)]))
        at = flag(pc.fill_null(apart, -1)).astype(np.int64)
        at[at < 0] = len(kind) + np.arange(len(more))
        both = np.full((len(words), 2), -1, np.int64)
        both[:, 0] = rows[code]
        both[cut, 1] = rows[at[flag(tail.indices)]]
        both[both < 0] = self.row[""]
        ids, size = gathered(self.flat, self.first, both.reshape(-1))
        return ids, size.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array, closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id unless closed is off, and how many each has."""
        if not self.by_word:
            tail = [self.end] * closed
            each = [np.array(e + tail, self.kind) for e in self._library(texts.to_pylist())]
            return np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(e) for e in each], np.int64)
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        ids, size = self._words(coded.dictionary)
        n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        if closed:
            code, n = np.insert(code, np.cumsum(n), len(size)), n + 1
        flat = np.concatenate([ids, np.array([self.end], self.kind)])
        out, length = gathered(flat, np.concatenate([[0], np.cumsum(size), [len(flat)]]), code)
        stop = np.concatenate([[0], np.cumsum(length)])
        return out, np.diff(stop[np.concatenate([[0], np.cumsum(n)])])

    def long(self, text: str) -> np.ndarray:
        """Ids of one long text, which is cut at blanks."""
        out, at = [], 0
        while self.by_word and len(text) - at > SLICE:
            cut = max(text.rfind(b, at + 1, at + SLICE) for b in BLANKS[:6])
            if cut < 0:
                cut = min((k for b in BLANKS[:6] if (k := text.find(b, at + SLICE)) >= 0), default=len(text))
            out.append(self.encode(pa.array([text[at:cut]]), False)[0])
            at = cut
        return np.concatenate([*out, self.encode(pa.array([text[at:]]))[0]])


def made(spec: str, end: int) -> Encoder:
    """One encoder for each worker process and vocabulary, on the core of its task alone."""
    mine, key = kept("tokens"), (hash(spec), end)
    if key not in mine:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        mine[key] = Encoder(spec, end)
    return mine[key]


def encode(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned), tie (their crc32), bytes_per_id for every row, and a row for each
    task with only freq, how often it met each id."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "ids", "tie", "bytes_per_id", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(spec.value, end)
        width, kind = np.dtype(encoder.kind).itemsize, pa.int64()
        freq = np.zeros(encoder.size, np.int64)
        for batch in batches:
            kind, at = batch.column(0).type, 0
            for texts in slices(batch.column(1), SLICE):
                ids, n = encoder.encode(texts) if len(texts) > 1 or pc.binary_length(texts[0]).as_py() <= SLICE else ((x := encoder.long(texts[0].as_py())), np.array([len(x)]))
                freq += np.bincount(ids, minlength=encoder.size)
                stop = (np.r_[0, np.cumsum(n)] * width).astype(np.int32)
                raw = pa.py_buffer(ids.tobytes())
                tie = [zlib.crc32(memoryview(raw)[a:b]) for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(stop), raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), binary, pa.array(tie, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
                at += len(n)
        if freq.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([width], pa.int32()), pa.array([freq.tobytes()], pa.binary())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return plain(docs, id_col, text_col).mapInArrow(trimmed(run, "tokens"), f"doc_id {kind}, ids binary, tie long, bytes_per_id int, freq binary")


def frequency_order(ids: DataFrame) -> np.ndarray:
    """All ids that occur, by falling frequency, from what each task counted. Their number is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                more = np.frombuffer(x.as_buffer(), np.int64)
                total = more.copy() if not len(total) else total + more
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    got = ids.select("freq").filter("freq is not null").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([r["id"] for r in got], np.uint32)


BLOCK_SCHEMA = "part int, block long, n_ids long, doc_ids array<{}>, counts array<long>, control binary, data binary"


def write(ids: DataFrame, stage: Stage, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Writes doc_id, ids as blocks in ascending order and the ids by rank; returns both tables as read back."""
    spark = ids.sparkSession
    first = ids.select("bytes_per_id").first()
    stored = f"<u{first[0] if first else 4}"
    order = frequency_order(ids)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    kind = ids.schema["doc_id"].dataType.simpleString()

    size_of = np.dtype(stored).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held_ids: list[pa.Array] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            v = np.frombuffer(b"".join(held), stored)
            control, data = pack(shared.value[v])
            who = pa.concat_arrays(held_ids)
            counts = [len(x) // size_of for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(v)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), who), pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "block", "n_ids", "doc_ids", "counts", "control", "data"],
            )

        for batch in batches:
            begin = 0
            for i, b in enumerate(batch.column(1).to_pylist()):
                held.append(b)
                size += len(b) // size_of
                if size >= block:
                    held_ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield flush()
                    begin, number, size, held, held_ids = i + 1, number + 1, 0, [], []
            if begin < batch.num_rows:
                held_ids.append(batch.column(0).slice(begin))
        if held:
            yield flush()

    # The tie spreads rows of one id, or of none, over several ranges.
    ordered = ids.filter("freq is null").select("doc_id", "tie", "ids").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    blocks = stage.put(ordered.select("doc_id", "ids").mapInArrow(trimmed(run), BLOCK_SCHEMA.format(kind)), "blocks")
    ranks = stage.put(rows_of(spark, ids=[order.astype("<u4").tobytes()]), "ranks")
    return blocks, ranks


def read(blocks: DataFrame, ranks: DataFrame, with_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Every document's part, block, doc_id, offset in the block, n_tokens, ids (binary, little-endian unsigned 32-bit; null
    without with_ids) and their crc32, decoded from the blocks; and the tokens before each part and block, which locate() adds. Where a document starts comes from the
    counts of parts, of blocks within a part and of documents within a block; only parts are summed in one task."""
    order = blocks.sparkSession.sparkContext.broadcast(ranks.first()["ids"])
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(order.value, "<u4")
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                part, block, n, counts, control, data = (row.column(k)[0].as_py() for k in (0, 1, 2, 4, 5, 6))
                who = row.column(3).flatten()
                values = table[unpack(control, data, n)].astype("<u4")
                counts = np.array(counts)
                stop = np.cumsum(counts)
                for i in range(0, len(counts), BATCH):
                    k = slice(i, i + BATCH)
                    m = len(counts[k])
                    own = [values[a:b] for a, b in zip((stop[k] - counts[k]).tolist(), stop[k].tolist())]
                    ids = pa.array([x.tobytes() for x in own], pa.binary()) if with_ids else pa.nulls(m, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * m, pa.int32()), pa.array([block] * m, pa.int64()), who.slice(i, m), pa.array(stop[k] - counts[k]), pa.array(counts[k]), ids, pa.array(map(zlib.crc32, own), pa.int64())],
                        ["part", "block", "doc_id", "offset", "n_tokens", "ids", "ids_crc32"],
                    )

    sums = blocks.select("part", "block", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_base")).join(parts, "part")
    found = blocks.mapInArrow(trimmed(run), f"part int, block long, doc_id {kind}, offset long, n_tokens long, ids binary, ids_crc32 long")
    return found, bases


def locate(found: DataFrame, bases: DataFrame) -> DataFrame:
    """found with start, the number of ids of all documents before, in place of its places in files."""
    met = found.join(bases, ["part", "block"])
    return met.withColumn("start", F.col("part_base") + F.col("block_base") + F.col("offset")).drop("part", "block", "part_base", "block_base", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stage = Stage(spark, "tokens")
    ids = stage.put(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2), "ids")
    blocks, ranks = write(ids, stage)
    stage.sweep("ids")
    found, bases = read(blocks, ranks, with_ids=False)
    return locate(found.drop("ids"), bases).select("doc_id", "start", "n_tokens", "ids_crc32")
