"""Quality classifier as a sparse ensemble of rules.

Statistics of the whole text are the inputs. Boosted trees over them are grown only for their paths: each path from a
root to a node is a conjunctive rule. A logistic model with a lasso penalty weighs the rules, most weights become zero,
and the rest are compiled to one Spark column expression over the statistics.

The rules are fitted on a bounded sample: at most SAMPLE labelled documents, by order of a hash of the id.

Defined results: null counts as the empty text, which has statistics of zero and is scored like any other; of several
labels for one id the highest counts, null labels don't; without labels of both kinds the score is the share of label 1
(0.5 without any); repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orrery.llm.common import id_crc, plain, table

#: Bound of the fitting sample.
SAMPLE = 20_000
TREES, DEPTH, LEAST, BINS = 40, 3, 20, 32
PENALTY, STEPS = 2e-3, 400
THRESHOLD = 0.3

_SIGNS = b"!#$%&*+/<=>@\\^_|~"
STATS = ["log_chars", "log_words", "word_length", "upper", "digit", "space", "line_ends", "sign", "bang", "bar", "stop", "comma", "beyond_ascii", "distinct_words", "top_word", "sign_words", "upper_words", "long_word", "short_words", "repeated_lines", "line_words"]


def _byte_classes() -> np.ndarray:
    m = np.zeros((256, 11))
    for b in range(256):
        c = bytes([b])
        m[b] = [c.isupper(), c.isdigit(), b == 32, b == 10, c in [bytes([x]) for x in _SIGNS], b == 33, b == 124, b == 46, b == 44, b > 127, c.isalpha()]
    return m


CLASSES = _byte_classes()


def statistics(text: str | None) -> list[float]:
    """The values of STATS for one text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return [0.0] * len(STATS)
    n = len(b)
    upper, digit, space, ends, sign, bang, bar, stop, comma, beyond, _ = (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ CLASSES) / n
    words = b.split()
    k = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    signs = sum(c for w, c in seen.items() if w[-1] in _SIGNS)
    uppers = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(n), np.log1p(len(words)), sizes.sum() / k, upper, digit, space, ends, sign, bang, bar, stop, comma, beyond, len(seen) / k, max(seen.values(), default=0) / k, signs / k, uppers / k,
        float(sizes.max()) if len(words) else 0.0, float((sizes <= 3).sum()) / k, 1 - len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)),
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in text], columns=STATS, dtype=float)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above, threshold)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) == above
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, rule: Rule, out: dict[Rule, None], step: np.ndarray) -> None:
    """Grows one tree on gradients g and curvatures h by halving loss greedily; notes every path and sets the leaves' steps."""
    if rule:
        out[tuple(sorted(rule))] = None
    step[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
    if len(rule) == DEPTH or len(rows) < 2 * LEAST:
        return
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best: tuple[float, int, float] | None = None
    for k, c in enumerate(cuts):
        if not len(c):
            continue
        at = np.searchsorted(c, x[rows, k])  # bin i holds values in (c[i-1], c[i]]
        n = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
        gl, hl = (np.cumsum(np.bincount(at, v[rows], len(c) + 1))[:-1] for v in (g, h))
        gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - whole
        gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
        i = int(gain.argmax())
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = (gain[i], k, float(c[i]))
    if best:
        _, k, t = best
        up = x[rows, k] > t
        grow(x, g, h, cuts, rows[up], (*rule, (k, True, t)), out, step)
        grow(x, g, h, cuts, rows[~up], (*rule, (k, False, t)), out, step)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y) or y.min() == y.max():
        p = (y.mean() if len(y) else 0.5) * 0.998 + 0.001
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(v, np.arange(1, BINS) / BINS)) for v in x.T]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(y))
        grow(x, g, h, cuts, np.sort(rng.choice(len(y), max(1, len(y) * 7 // 10), replace=False)), (), rules, step)
        z += 0.3 * step
    found = list(rules)
    a = np.stack([holds(r, x) for r in found], 1).astype(np.float32) if found else np.zeros((len(y), 0), np.float32)
    mean = a.mean(0)
    a -= mean
    w, b = np.zeros(a.shape[1]), np.log(y.mean() / (1 - y.mean()))
    v, vb, t = w.copy(), b, 1.0
    m = max(1e-9, float(np.linalg.norm(a, 2)) ** 2 / len(y) / 4 + 0.25) if a.size else 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        e = sigmoid(a @ v + vb) - y
        nw = v - (a.T @ e / len(y)) / m
        nw = np.sign(nw) * np.maximum(np.abs(nw) - PENALTY / m, 0)
        nb = vb - e.mean() / m
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b - mean @ w), [(r, float(c)) for r, c in zip(found, w) if c]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], stats: str = "stats") -> Column:
    """The score as one expression over the struct of statistics."""
    z = F.lit(intercept)
    for rule, w in rules:
        test = F.lit(True)
        for k, above, t in rule:
            value = F.col(f"{stats}.{STATS[k]}")
            test = test & ((value > t) if above else (value <= t))
        z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Fits on at most `size` labelled documents where learn holds. Labels are thinned by a hash before they are put in
    order, so that few reach the one task that cuts the list."""
    known = labels.filter(learn & F.col("quality").isNotNull()).select("doc_id", "quality")
    share = min(1.0, 1.5 * size / max(1, known.count()))
    thin = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("thin")), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    picked = thin.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = plain(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "y", stats_of("text").alias("stats"))
    got = rows.select("doc_id", "y", "stats.*").toPandas().sort_values(["doc_id", *STATS])
    return fit(got[STATS].to_numpy(float), got["y"].to_numpy(float))


def classify(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, stats for every row."""
    scored = plain(docs, id_col, text_col).select("doc_id", stats_of("text").alias("stats")).withColumn("score", compile_rules(*model))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "stats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, id_crc() % 5 != 0)
    return classify(docs, model).select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
