import random

import numpy as np

from orrery.llm import decontaminate as d


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(6) for _ in range(rng.randrange(60))]
        assert d.common_length(d.places(a), len(a), b) == brute_lcs(a, b)


def brute_items(text, items):
    """Every item against every place of the text."""
    words, out = d.words_of(text), []
    for i, t in items:
        w = d.words_of(t)
        slack = d.ITEM_STRIDE + max(8, len(w) // 4)
        best = 0.0
        if len(set(w) & set(words)) >= 0.5 * len(set(w)):
            for a in range(-len(w), len(words), d.ITEM_STRIDE):
                region = words[max(0, a - slack) : max(0, a + len(w) + slack)]
                same = brute_lcs(w, region) / len(w)
                if same >= d.SAME or same >= d.PARAPHRASE and brute_lcs(w[-d.ANSWER :], region) == len(w[-d.ANSWER :]):
                    best = max(best, same)
        if best:
            out.append(i)
    return out


def altered(rng, text, share):
    w = text.split()
    return " ".join("changed" + str(rng.randrange(99)) if rng.random() < share else x for x in w)


def test_recall_against_brute_force(spark, sf_dir):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 4000]
    for n in range(90):
        i, t = rng.choice(items)
        host = rng.choice(docs[:100])[1].split()
        k = rng.randrange(len(host) + 1)
        docs.append((10_000 + n, " ".join(host[:k] + [altered(rng, t, rng.choice([0, 0.1, 0.25])).upper()] + host[k:])))
    got = {r.doc_id: r["items"] for r in d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: brute_items(t, items) for i, t in docs}
    pairs = {(i, k) for i, v in want.items() for k in v}
    hits = {(i, k) for i, v in got.items() for k in v}
    assert len(pairs) > 50
    assert hits <= pairs
    assert len(hits) >= 0.97 * len(pairs)


def test_blocks_agree(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = ({r.doc_id: r["items"] for r in d.matches(docs, bench, size=s).collect()} for s in (2000, 9))
    assert one == many and any(one.values())


def test_blocks_with_repeated_ids_and_text_ids(spark, sf_dir):
    """Rows of one id but other texts keep their own results over several blocks; ids of items may be strings."""
    items = [(f"item {r.item_id:03d}", r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "before " + items[0][1] + " after"), (1, items[-1][1] + " " + items[1][1]), (1, "clean"), (None, items[2][1]), (None, items[2][1]), (3, None)], "doc_id long, text string")
    key = lambda r: (r.doc_id or 0, r.contaminated, r.item_id or "", r.similarity or 0, tuple(r["items"]))
    one, many = (sorted(map(key, d.matches(docs, bench, size=s).collect())) for s in (2000, 7))
    assert one == many
    assert [(x[0], x[4]) for x in one if x[1]] == [(0, (items[2][0],)), (0, (items[2][0],)), (1, (items[0][0],)), (1, (items[1][0], items[-1][0]))]
    assert sum(not x[1] for x in one) == 2


def test_words_of_blocks_are_counted_together():
    made = [[(i, f"w{i} w{i + 1} shared")] for i in range(8)]
    assert [len(b) for b, _ in d.together(iter(made), 6)] == [4, 4]
    assert [len(b) for b, _ in d.together(iter(made), 1)] == [1] * 8
    assert list(d.together(iter([]))) == []


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    rows = [rng.integers(1, 20, 16) for _ in range(40)]
    weight = np.r_[0.0, np.ones(19)]
    v = d.randomised_svd(spark, rows, weight, rank=19)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)
    a = np.stack([np.bincount(r, minlength=20) for r in rows]).astype(float)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6)


def test_edges(spark):
    schema = "doc_id long, text string, items string, contaminated string"
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item), (None, "a b c d e f g")], "item_id long, text string")
    rows = [(2**60 + 1, item.upper() + "!", "x", "x"), (2, None, "", ""), (None, "zero " + item, None, None), (4, "clean words only", "", ""), (4, "clean words only", "", ""), (5, "filler " * 50_000 + item, "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.contaminated, r["items"]) for r in d.matches(docs, bench).collect())
    assert got == [(0, True, [1]), (2, False, []), (4, False, []), (4, False, []), (5, True, [1]), (2**60 + 1, True, [1])]
    assert d.clean(docs, bench).columns == docs.columns
    assert sorted(r.doc_id or 0 for r in d.clean(docs, bench).collect()) == [0, 2, 4, 4]
    assert d.matches(spark.createDataFrame([], schema), bench).count() == 0
    assert d.matches(docs, bench.limit(0)).filter("contaminated").count() == 0


def found(spark, docs, items):
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, k) for r in got.collect() for k in r["items"]}


def test_paraphrases_of_heavy_words(spark, sf_dir):
    """The rarest words of an item replaced until 0.6 to 0.7 of it is left, its answer kept: all are found."""
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hosts = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if 500 < len(r.text or "") < 4000]
    held = {}
    for t in hosts:
        for w in set(d.words_of(" ".join(t))):
            held[w] = held.get(w, 0) + 1
    docs = []
    for n in range(120):
        w = [x.decode() for x in d.words_of(rng.choice(items)[1])]
        heavy = sorted(range(len(w) - d.ANSWER), key=lambda i: held.get(w[i].encode(), 0))
        for i in heavy[: int(len(w) * (1 - rng.choice([0.62, 0.7])))]:
            w[i] = f"other{rng.randrange(10**6)}"
        host = rng.choice(hosts)
        k = rng.randrange(len(host) + 1)
        docs.append((n, " ".join(host[:k] + w + host[k:])))
    pairs = {(i, k) for i, t in docs for k in brute_items(t, items)}
    assert len(pairs) >= 100
    assert pairs <= found(spark, docs, items)


def test_short_items_verbatim(spark, sf_dir):
    """Items of 2 to 10 words in the middle of longer documents, all found; those of under MIN_WORDS word for word."""
    rng = random.Random(12)
    texts = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hosts = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if 500 < len(r.text or "") < 4000]
    items, docs = [], []
    for n in range(120):
        w = texts[n % len(texts)][: (2, 3, 4, 5, 6, 8, 10)[n % 7]]
        items.append((n, " ".join(w)))
        host = rng.choice(hosts)
        k = rng.randrange(8, len(host) - 8)
        docs.append((n, " ".join(host[:k] + w + host[k:])))
    got = found(spark, docs, items)
    assert {(n, n) for n in range(120)} <= got
    for i, k in got:
        w, t = (d.words_of(x) for x in (items[k][1], docs[i][1]))
        if len(w) < d.MIN_WORDS:
            assert any(t[a : a + len(w)] == w for a in range(len(t)))
    assert found(spark, [(1, "one of two words"), (2, "two words here"), (3, "words two")], [(7, "two words"), (8, "..")]) == {(1, 7), (2, 7)}
