import numpy as np
from pyspark.sql import functions as F

from orrery.llm import quality as q


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(rows) > 500
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9
    assert rows["score"].between(0, 1).all()
    kept = rows[rows["quality"] == 1]["predicted"].mean()
    assert kept > 0.97


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(q.STATS))).round(2)
    y = (x[:, 3] + (x[:, 5] > 0.3) * 2 + rng.normal(size=400) > 0.5).astype(float)
    b, rules = q.fit(x, y)
    assert rules
    z = b + sum(w * q.holds(r, x) for r, w in rules)
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *q.STATS]).select("i", F.struct(*q.STATS).alias("stats"))
    got = np.array([r.s for r in frame.select("i", q.compile_rules(b, rules).alias("s")).orderBy("i").collect()])
    assert np.allclose(got, q.sigmoid(z))
    assert auc(got, y) > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "a b", "x"), (5, "word " * 200_000, "x"), (1, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (7, 1)], "doc_id long, quality int")
    model = q.train(docs, labels, F.lit(True))
    assert model[1] == []
    rows = q.classify(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == 1 for r in rows)
    assert q.train(docs, labels.limit(0), F.lit(True)) == (0.0, [])
    assert q.classify(docs.limit(0), model).count() == 0


def test_first_split_against_all_cuts(monkeypatch):
    """A tree of one split takes the statistic and threshold of greatest gain among all."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(q, "DEPTH", 1)
    for _ in range(10):
        x = rng.random((200, 4))
        y = (x[:, rng.integers(4)] > rng.uniform(0.3, 0.7)).astype(float)
        p = np.full(200, y.mean())
        g, h = p - y, p * (1 - p)
        cuts = [np.unique(np.quantile(v, np.arange(1, q.BINS) / q.BINS)) for v in x.T]
        rules = {}
        q.grow(x, g, h, cuts, np.arange(200), (), rules, np.zeros(200))
        gain = {}
        for k in range(4):
            for t in cuts[k]:
                up = x[:, k] > t
                if min(up.sum(), (~up).sum()) >= q.LEAST:
                    gain[k, float(t)] = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (up, ~up))
        assert {r[0][::2] for r in rules} == {max(gain, key=gain.get)}


def test_weights_against_plain_descent():
    """The lasso weights are those that slow, plain proximal steps over the same rules end in."""
    rng = np.random.default_rng(6)
    x = rng.random((600, len(q.STATS)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, 600) > 0.8).astype(float)
    b, rules = q.fit(x, y)
    a = np.stack([q.holds(r, x) for r, _ in rules], 1).astype(float)
    w, c = np.zeros(len(rules)), 0.0
    step = 4.0 / (np.linalg.norm(np.c_[a, np.ones(600)], 2) ** 2 / 600)
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(a @ w + c))) - y
        w, c = w - step * (a.T @ e) / 600, c - step * e.mean()
        w = np.sign(w) * np.maximum(np.abs(w) - step * q.PENALTY, 0)
    loss = lambda w, c: np.mean(np.log1p(np.exp(a @ w + c)) - y * (a @ w + c)) + q.PENALTY * np.abs(w).sum()
    assert loss(np.array([v for _, v in rules]), b) <= loss(w, c) + 1e-3
