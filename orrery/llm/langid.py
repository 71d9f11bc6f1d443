"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-cased letters, all other characters being one blank. The n-grams of all
languages share one sorted array of keys per order (four 16-bit codes packed in 64 bits, so the hash has no collisions)
with one column of log probabilities per language; contexts have a sorted array of their own for the back-off weights.
A text gets the language of least cross-entropy per character. It is rejected where even that is nearer to what a
uniform model over the language's characters gives than to what calibration texts of the language have.

The models are fitted on a bounded sample: at most PER_LANG texts of each language, by order of a hash of the id.

Defined results: `und`, score 0 and rejected for a null text or one without a letter; ties go to the first language in
alphabetical order; without any learned text every text is `und`; a text of over SLICE characters is scored in slices that
carry their context over; rows are independent of each other, so repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import BROADCAST_KEYS, Stage, id_crc, release, sized, table, trimmed

ORDER = 4
#: Bound of the fitting sample.
PER_LANG = 1200
SLICE = 1 << 18
#: Characters scored at a time, about: bounds a worker's arrays.
AT_ONCE = 1 << 16
BLANK, EDGE, OTHER = 32, 1, 0xFFFF
#: Share of calibration texts whose cross-entropy the clean side of the threshold must hold.
CALIBRATION = 0.999
#: Scale of cross-entropy differences in the score.
SHARPNESS = 10.0

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code of each character below 0x10000: itself for a letter, else BLANK."""
    if not _letters:
        own = np.array([c if chr(c).isalpha() else BLANK for c in range(0x10000)], np.uint64)
        own[EDGE] = EDGE
        _letters.append(own)
    return _letters[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after three EDGE codes and with runs of blanks as one; and the first position of each."""
    joined = "".join("\x01\x01\x01" + t.lower().replace("\x01", " ") for t in texts)
    u = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters()[np.minimum(u, 0xFFFF)]
    for far in np.unique(u[u > 0xFFFF]):
        c[u == far] = OTHER if chr(far).isalpha() else BLANK
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    c = c[keep]
    edge = np.flatnonzero(c == EDGE)
    return c, edge[2::3] + 1


def keys(c: np.ndarray, order: int) -> np.ndarray:
    """For each position the packed n-gram that ends there."""
    out = c.copy()
    for k in range(1, order):
        out[k:] |= c[:-k] << np.uint64(16 * k)
    return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted keys, and which are there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


@dataclass
class Model:
    langs: list[str]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    uniform: np.ndarray | None = None
    limit: np.ndarray | None = None

    @staticmethod
    def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        """From counts of the n-grams of the highest order; lang holds positions in langs."""
        m, size = Model(langs), len(langs)
        grams = {ORDER: np.unique(gram)}
        for n in range(ORDER - 1, 0, -1):
            grams[n] = np.unique(grams[n + 1] & np.uint64((1 << 16 * n) - 1))
        seen = {n: np.zeros((len(grams[n]), size)) for n in grams}
        np.add.at(seen[ORDER], (np.searchsorted(grams[ORDER], gram), lang), count)
        suffix = {}
        for n in range(ORDER - 1, 0, -1):
            suffix[n + 1] = np.searchsorted(grams[n], grams[n + 1] & np.uint64((1 << 16 * n) - 1))
            np.add.at(seen[n], suffix[n + 1], seen[n + 1] > 0)
        below = None
        for n in range(1, ORDER + 1):
            c = seen[n]
            once, twice = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            d = np.clip(d, 0.1, 0.9)
            ctx, at = np.unique(grams[n] >> np.uint64(16), return_inverse=True) if n > 1 else (np.zeros(1, np.uint64), np.zeros(len(c), np.int64))
            total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            spare = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                chars = np.full(size, len(c) + 1.0)
                m.uniform = np.log(chars)
                base = 1 / chars
                m.unseen = np.log(spare[0] * base)
                lower = np.broadcast_to(base, c.shape)
            else:
                lower = below[suffix[n]]
            p = np.maximum(c - d, 0) / np.maximum(total, 1)[at] + spare[at] * lower
            below = p
            m.grams[n], m.logp[n] = grams[n], np.log(p).astype(np.float32)
            m.contexts[n], m.backoff[n] = ctx, np.log(spare).astype(np.float32)
        m.limit = m.uniform.copy()
        return m

    def _logs(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities by language of the codes at some places, given the codes before them."""
        k = {n: keys(c, n) for n in range(1, ORDER + 1)}
        out = np.zeros((len(c), len(self.langs)), np.float32)
        rest = at
        for n in range(ORDER, 1, -1):
            where, hit = find(self.grams[n], k[n][rest])
            out[rest[hit]] += self.logp[n][where[hit]]
            rest = rest[~hit]
            where, hit = find(self.contexts[n], k[n - 1][rest - 1])
            out[rest[hit]] += self.backoff[n][where[hit]]
        where, hit = find(self.grams[1], k[1][rest])
        out[rest[hit]] += self.logp[1][where[hit]]
        out[rest[~hit]] += self.unseen.astype(np.float32)
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of log probabilities by text and language, positions counted, and whether a letter occurs."""
        c, start = codes(texts)
        out = self._logs(c, np.flatnonzero(c != EDGE))
        stop = np.r_[start[1:] - 3, len(c)]
        running = np.zeros((len(c) + 1, len(self.langs)))
        np.cumsum(out, axis=0, dtype=np.float64, out=running[1:])
        letter = np.r_[0, np.cumsum(c > BLANK)]
        return running[stop] - running[start], stop - start, letter[stop] > letter[start]

    def score_long(self, text: str) -> tuple[np.ndarray, int, bool]:
        """The same for one long text, slice by slice. The last codes of a slice stand before the next one, so the result
        is that of the whole text; a slice ends before a blank where it can, so that no word is lower-cased in parts."""
        total, size, letter, before, at = np.zeros(len(self.langs)), 0, False, np.full(3, EDGE, np.uint64), 0
        while at < len(text):
            stop = at + SLICE
            if stop < len(text) and (blank := text.rfind(" ", at + 1, stop)) > 0:
                stop = blank
            c, _ = codes([text[at:stop]])
            first = 4 if before[2] == BLANK and len(c) > 3 and c[3] == BLANK else 3
            c = np.concatenate([before, c[first:]])
            total += self._logs(c, np.arange(3, len(c))).sum(0, dtype=np.float64)
            size, letter, before, at = size + len(c) - 3, letter or bool((c[3:] > BLANK).any()), c[-3:], stop
        return total, size, letter

    def judge(self, texts: pd.Series) -> pd.DataFrame:
        """lang_pred, score, entropy, accepted for each text."""
        n = len(texts)
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * n, "score": 0.0, "entropy": np.full(n, np.nan), "accepted": False})
        total, size, letter = np.zeros((n, len(self.langs))), np.zeros(n), np.zeros(n, bool)
        rows: list[int] = []
        parts: list[str] = []

        def flush() -> None:
            if rows:
                total[rows], size[rows], letter[rows] = self.scores(parts)
                rows.clear()
                parts.clear()

        held = 0
        for i, t in enumerate(texts):
            if t and len(t) > SLICE:
                total[i], size[i], letter[i] = self.score_long(t)
            elif t:
                rows.append(i)
                parts.append(t)
                held += len(t)
                if held >= AT_ONCE:
                    flush()
                    held = 0
        flush()
        h = -total / np.maximum(size, 1)[:, None]
        best = h.argmin(1)
        low = h[np.arange(n), best]
        score = 1 / np.exp(-(h - low[:, None]) * SHARPNESS).sum(1)
        names = np.array(self.langs, dtype=object)[best]
        return pd.DataFrame({"lang_pred": np.where(letter, names, "und"), "score": np.where(letter, score, 0.0), "entropy": np.where(letter, low, np.nan), "accepted": letter & (low <= self.limit[best])})


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, rows in frame.groupby("lang"):
            texts = [t[a : a + SLICE] for t in rows["text"] for a in range(0, len(t), SLICE)]
            if not texts:
                continue
            for i in range(0, len(texts), 64):
                c, _ = codes(texts[i : i + 64])
                got, n = np.unique(keys(c, ORDER)[c != EDGE], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": got.view(np.int64), "n": n})


def sample(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang, calibrate) of at most per_lang documents of each language, picked by a hash of the id. The ids are
    first thinned to about three times as many by their hash, so that the ranking gets few at any size of input."""
    ids = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    share = ids.groupBy("lang").agg((3 * per_lang / F.count(F.lit(1))).alias("share"))
    # One row for each language name; broadcast, so that the ids are thinned where they are read.
    ids = ids.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("thin")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).drop("share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = ids.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select(F.col("doc_id").alias("picked")).distinct()
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["picked"], "left_semi")
    return rows.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 7).alias("calibrate"))


def train(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    """Fits and calibrates on the rows where learn holds. What reaches the driver is bounded by the sample."""
    picked = sample(docs.select("doc_id", "text", "lang"), learn, per_lang).persist()
    grams = picked.filter(~F.col("calibrate")).select("text", "lang").mapInPandas(trimmed(count_grams), "lang string, gram long, n long")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        picked.unpersist()
        return Model([])
    at = {x: i for i, x in enumerate(langs)}
    model = Model.fit(langs, got["lang"].map(at).to_numpy(), got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy())
    calibration = identify(picked.filter("calibrate").select("text", "lang"), model).filter("lang_pred <> 'und'").groupBy("lang_pred")
    for r in calibration.agg(F.expr(f"percentile(entropy, {CALIBRATION})").alias("h")).collect():
        i = at[r["lang_pred"]]
        model.limit[i] = max(r["h"], (r["h"] + model.uniform[i]) / 2)
    picked.unpersist()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, entropy and accepted in place of columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, entropy double, accepted boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for text in texts:
            yield shared.value.judge(text)
        release()

    # A filter on the verdict would else be pushed below and judge every text twice, in two workers.
    judge = judge.asNondeterministic()
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "entropy", "accepted", "_judged")]
    return docs.select(*own, judge(F.col(text_col)).alias("_judged")).select(*own, "_judged.*")


def held_out() -> Column:
    return F.coalesce(id_crc() % 4 == 2, F.lit(False))


def learnable() -> Column:
    return id_crc() % 4 != 2


def accepted(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents whose language is accepted, with their own columns. The verdict hangs on the text
    alone, so rejected texts are noted by digest and no row of docs goes through a worker or a shuffle, unless very many
    are rejected."""
    stage = Stage(docs.sparkSession, "language")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = identify(docs.select("text", digest.alias("_digest")), train(docs, learnable()))
    rejected = stage.put(judged.filter("not accepted").select("_digest").distinct(), "rejected")
    stage.sweep()
    return docs.join(sized(rejected, BROADCAST_KEYS), digest == rejected["_digest"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learnable())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "accepted")
