import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from orrery.llm import simhash


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(codes, most=3):
    up = {c: c for c in codes}

    def find(c):
        while up[c] != c:
            c = up[c]
        return c

    cs = list(codes)
    for i, a in enumerate(cs):
        for b in cs[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                up[find(a)] = find(b)
    return {c: find(c) for c in cs}


def same_partition(a, b):
    return len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


def clustered(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        c = rng.choice(seeds)
        for _ in range(rng.randrange(9)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return out


@pytest.mark.parametrize("text", ["", None, "One", "a b", "A b c", "word " * 300, "é Ü x y\tz q\n w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_index_against_all_pairs():
    rng = random.Random(5)
    codes = np.array(sorted(clustered(rng, 900)), np.uint64)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    up = index.components(3)
    got = {int(c): int(index.codes[r]) for c, r in zip(index.codes, up)}
    assert same_partition(got, brute_components([int(c) for c in codes]))


@pytest.mark.parametrize("part", [200_000, 40])
def test_links_with_hot_buckets(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "ONE_TASK", 0 if part == 40 else 500_000)
    rng = random.Random(7)
    codes = clustered(rng, 500)
    rows = pd.DataFrame({"print": 0, "code": np.array(list(codes), np.uint64).view(np.int64)})
    stage = simhash.Stage(spark, "t")
    edges = simhash.link_fingerprints(spark.createDataFrame(rows, "print int, code long"), 3, part).select("a", "b")
    roots = {r.node: r.root for r in simhash.components(edges, stage).collect()}
    got = {c: roots.get(s, s) for c, s in zip(np.array(list(codes), np.uint64).tolist(), rows["code"].tolist())}
    assert same_partition(got, brute_components(codes))


def test_near_duplicates_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    roots = brute_components(set(prints.values()))
    first = {}
    for d, f in sorted(prints.items()):
        first.setdefault(roots[f], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", first[roots[f]]) for d, f in prints.items()}


def test_edges(spark):
    schema = "doc_id long, text string, code string, root long"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(3, None, "x", 1), (1, " ", "y", 2), (1, " ", "y", 2), (7, "one two three four", None, None)], schema)
    got = sorted((r.doc_id, r.code == 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, True, 1), (1, True, 1), (3, True, 1), (7, False, 7)]
    assert simhash.survivors(docs).columns == docs.columns
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == [1, 1, 7]
    assert simhash.survivors(spark.createDataFrame([], schema)).count() == 0


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b, words=5):
    a, b = (shingles(t, words) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_survivors_against_brute_force(spark):
    rng = random.Random(8)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if 1500 < len(r.text or "") < 9000][:120]
    texts = list(base)
    for t in base:
        for _ in range(rng.randrange(3)):
            w = t.split()
            for k in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.002, 0.01, 0.02, 0.03, 0.05])))):
                w[k] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in simhash.survivors(docs).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    up = brute_links(near, len(texts))
    want = {i for i in range(len(texts)) if up[i] == i}
    assert len(want) < len(texts) - 40
    assert want <= left  # nothing is dropped that is like no other
    assert left == want


def brute_links(pairs, n):
    up = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                changed = True
    return up


def near_truth(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    up = brute_links(pairs, len(texts))
    return {i for i in range(len(texts)) if up[i] == i}, pairs


def sentence(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_survivors_with_block_edits(spark):
    """Copies with a block appended, put before or cut off, at 0.80 to 0.95: all pairs, no allowance."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        w = sentence(rng, rng.randrange(80, 300))
        block = sentence(rng, int(len(w) * rng.choice([0.06, 0.12, 0.18, 0.22])))
        texts += [" ".join(w), " ".join(rng.choice([w + block, block + w, w[: len(w) - len(block) * 4 // 5]]))]
    want, pairs = near_truth(texts)
    assert len([1 for i, j in pairs if jaccard(texts[i], texts[j]) < 0.9]) > 30
    got = {r.doc_id for r in simhash.survivors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("groups", [10, 40])
def test_survivors_of_template_groups(spark, groups):
    """Documents that share a template, alike but under 0.8, and copies of some: links must not be lost in the crowd."""
    rng = random.Random(groups)
    template = sentence(rng, 100)
    texts = []
    for _ in range(groups):
        w = template + sentence(rng, rng.randrange(22, 31))
        texts.append(" ".join(w))
        for _ in range(2):
            c = list(w)
            k = rng.randrange(100, len(w) - 8)
            c[k : k + 8] = sentence(rng, 8)
            texts.append(" ".join(c))
    want, _ = near_truth(texts)
    assert groups <= len(want) < len(texts)
    got = {r.doc_id for r in simhash.survivors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_hot_shingle_is_dealt(spark):
    """Pairs by prefixes are the same whether a shingle's documents meet in one task or in pairs of parts."""
    rng = random.Random(3)
    template = sentence(rng, 60)
    texts = [" ".join(template + sentence(rng, 6)) for _ in range(30)]
    sets = [(i, sorted(simhash.shingle_set(t, 5))) for i, t in enumerate(texts)]
    _, pairs = near_truth(texts)
    assert len(pairs) > 100
    sig = [simhash.signatures(np.array(x, np.int32), np.array([len(x)]))[0].tolist() for _, x in sets]
    frame = spark.createDataFrame([(*x, y) for x, y in zip(sets, sig)], "doc_id long, set array<int>, sig array<long>")
    roots = spark.createDataFrame([], "node long, root long")
    got = [{(r.a, r.b) for r in simhash.similar_pairs(frame, roots, simhash.Stage(spark, "t"), 0.8, part).collect()} for part in (5_000, 4)]
    assert got[0] == got[1] >= {(j, i) for i, j in pairs}


def test_null_ids_and_very_long_text(spark):
    """A component is named by the smallest id that there is; a text of millions of words is one row like any other."""
    long = "one two three four five six seven " * 300_000
    rows = [(None, "same text here now"), (None, "same text here now"), (5, "same text here now"), (None, "another text of no id at all"), (9, long)]
    got = sorted(((r.doc_id or 0, r.code, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    prints = {t: int(np.uint64(brute_fingerprint(t)).astype(np.int64)) for _, t in rows[:4]}
    assert [r for r in got if r[0] == 0] == sorted([(0, prints["same text here now"], 5)] * 2 + [(0, prints["another text of no id at all"], None)], key=str)
    assert next(r[2] for r in got if r[0] == 9) == 9
    left = [r.doc_id for r in simhash.survivors(spark.createDataFrame(rows + [(10, long + "end")], "doc_id long, text string")).collect()]
    assert sorted(left, key=str) == [5, 9, None, None, None]


def test_majority_and_sets_against_brute_force():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 2, 3, 7, 0, 64, 1, 130])
    rows = rng.integers(0, 2**63, (size.sum(), 2), dtype=np.int64).astype(np.uint64) & rng.integers(0, 2**63, (size.sum(), 2), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    got, at = simhash.majority(rows, size), 0
    for k, n in enumerate(size):
        for c in range(2):
            bits = [sum(int(x) >> b & 1 for x in rows[at : at + n, c]) * 2 > n for b in range(64)]
            assert int(got[k, c]) == sum(1 << b for b, on in enumerate(bits) if on)
        at += n
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 40, 300)] + [" A\t b\x0bC ", "é ü é ü é ü é ü"]
    for a in texts:
        assert len(simhash.shingle_set(a, 5)) == len(shingles(a))
        for b in texts:
            assert len(set(simhash.shingle_set(a, 5)) & set(simhash.shingle_set(b, 5))) == len(shingles(a) & shingles(b))


@pytest.mark.parametrize(("one", "many"), [(500_000, 1_000_000), (0, 1_000_000), (0, 100)])
def test_hub_of_a_component(spark, monkeypatch, one, many):
    """One task, rounds of joins, and rounds with the hub's least neighbour by broadcast give the same components."""
    monkeypatch.setattr(simhash, "ONE_TASK", one)
    monkeypatch.setattr(simhash, "MANY_EDGES", many)
    edges = [(0, i) for i in range(1, 7000)] + [(7000 + i, 7001 + i) for i in range(50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), simhash.Stage(spark, "hub")).collect()}
    assert got == {i: 0 for i in range(1, 7000)} | {7001 + i: 7000 for i in range(50)}


def test_join_split_is_a_join(spark):
    left = spark.range(6000).selectExpr("id", "if(id < 4000, 1, id % 7) as k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", simhash.F.col("k") * 10)
    got = simhash.join_split(left, right.filter("k <> 3"), "k", 6000)
    want = left.join(right.filter("k <> 3").drop("n"), "k")
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, want.select("id", "k", "v").collect()))


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        pool = rng.integers(-(2**31), 2**31, 900).astype(np.int32)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 600))) for _ in range(2))
        sig = simhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)])).view(np.uint64)
        assert np.bitwise_count(sig[0] ^ sig[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
