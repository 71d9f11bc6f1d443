"""Each stage of the pipeline on what the one before it kept, against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from orrery.llm import byte_bpe
from orrery.llm.common import Stage

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    stage = Stage(spark, "test")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage.put(step(spark, docs, DIR), name)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def texts(steps):
    return [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language(texts):
    before, after = texts[:2]
    lettered = {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
    assert set(after) <= lettered and len(lettered - set(after)) <= 0.01 * len(lettered)


def test_exact(texts):
    before, after = texts[1:3]
    best = {}
    for i, t in before.items():
        key = t.encode().lower()
        best[key] = max(i, best.get(key, i))
    assert set(after) == set(best.values())


def shingle_set(text, words):
    w = (text or "").encode().lower().split()
    return {hash(tuple(w[i : i + words])) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near(texts):
    before, after = texts[2:4]
    sets = {i: set(shingle_set(t, 5)) for i, t in before.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    near = {(i, j) for v in holders.values() if len(v) < 50 for i in v for j in v if i < j}
    near = [(i, j) for i, j in near if similar(sets[i], sets[j])]
    up = {i: i for i in before}
    for _ in range(20):
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    want = {i for i in before if up[i] == i}
    assert want <= set(after)
    assert len(set(after) - want) <= 0.1 * max(1, len(before) - len(want))


def test_decontamination(spark, texts):
    before, after = texts[3:5]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not [i for i, t in after.items() if any(x in t for x in items)]
    grams = {tuple(w[k : k + 6]) for w in (x.lower().split() for x in items) for k in range(len(w) - 5)}
    clean = {i for i, t in before.items() if not any(tuple(w[k : k + 6]) in grams for w in [t.lower().split()] for k in range(len(w) - 5))}
    assert clean <= set(after)


def test_tokens(steps, texts):
    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in steps[-1].collect()}
    assert set(rows) == set(texts[4])
    for i, t in texts[4].items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_run_is_its_stages(spark, steps):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == steps[-1].columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1].collect()))


def test_near_against_all_pairs(texts):
    """As test_near, with shingles of any number of holders and nothing missed."""
    before, after = texts[2:4]
    ids = sorted(before)
    sets = [frozenset(shingle_set(before[i], 5)) for i in ids]
    word = {h: n for n, h in enumerate(sorted(set().union(*sets)))}
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for h in s:
            holders[word[h]].append(n)
    size = np.array([len(s) for s in sets])
    up = list(range(len(ids)))

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for n, s in enumerate(sets):
        both = np.zeros(len(ids), int)
        for h in s:
            both[holders[word[h]]] += 1
        every = size + size[n] - both
        for m in np.flatnonzero((every == 0) | (both >= 0.8 * every)).tolist():
            a, b = root(n), root(m)
            up[max(a, b)] = min(a, b)
    assert {i for n, i in enumerate(ids) if root(n) == n} == set(after)


def test_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and further columns; then no rows at all."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(300)
    own = docs.columns
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    clean = docs.filter("lang = 'en' and length(text) between 800 and 3000").select("text").limit(2).collect()
    odd = [(None, clean[0].text + " alone"), (None, clean[0].text + " alone"), (None, None), (10**12, item), (10**12 + 1, None), (10**12 + 2, clean[1].text + " and more"), (10**12 + 2, clean[1].text + " and more")]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'odd' as source", "cast(length(text) as long) as n_chars")
    every = docs.unionByName(more).selectExpr("*", "doc_id as gone_id", "'x' as digest", "1 as kept", "text as row")
    every.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = Stage(spark, "odd")
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage.put(step(spark, now, str(tmp_path)), name)
        assert now.columns == every.columns
    kept = [r for r in now.collect() if r.source == "odd"]
    assert sum(r.doc_id is None for r in kept) == 2 and not any(r.text is None or r.doc_id == 10**12 for r in kept)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == now.count() and set(own) <= set(every.columns)
    every.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{DIR}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
