from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid


def test_held_out_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.join(truth, "doc_id").filter("held_out and lang_pred <> 'und'")
    total, right, clean = held.select(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("accepted")).first()
    assert total > 150 and right / total > 0.97 and clean / total > 0.97
    assert rows.filter("score < 0 or score > 1").count() == 0


def small_model(texts=(["the cat and the hat then that"], ["der hund und die katze der das"])):
    grams, lang = [], []
    for i, own in enumerate(texts):
        c, _ = langid.codes(list(own))
        k = langid.keys(c, 4)[c != langid.EDGE]
        grams += k.tolist()
        lang += [i] * len(k)
    return langid.Model.fit(["de", "en"][::-1], np.array(lang), np.array(grams, np.uint64), np.ones(len(grams)))


def test_probabilities_sum_to_one():
    m = small_model()
    for i in range(2):
        for ctx in m.contexts[2][:5]:
            p = {}
            for ch in m.grams[1].tolist():
                at, hit = langid.find(m.grams[2], np.array([int(ctx) << 16 | ch], np.uint64))
                j, there = langid.find(m.contexts[2], np.array([ctx], np.uint64))
                p[ch] = m.logp[2][at[0], i] if hit[0] else m.backoff[2][j[0], i] + m.logp[1][np.searchsorted(m.grams[1], ch), i]
            in_vocabulary = np.exp(list(p.values())).sum()
            assert 0.85 < in_vocabulary <= 1.0001


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string, accepted string"
    empty = spark.createDataFrame([], schema)
    model = langid.train(empty, langid.learnable())
    assert model.langs == [] and langid.identify(empty, model).count() == 0
    rows = [(i, t, l, "x", "y", "z") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(90, None, "en", "", "", ""), (91, "12 !!", "en", "", "", ""), (92, "", None, "", "", ""), (None, "the dog", "en", "", "", ""), (94, "the dog " * 200_000, None, "", "", ""), (95, "𝒳 the \x01 cat", None, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    model = langid.train(docs, langid.learnable())
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.identify(docs, model).collect()}
    assert got[90] == got[91] == got[92] == ("und", False)
    assert got[None][0] == got[94][0] == got[0][0] == "en" and got[1][0] == "de"
    assert langid.accepted(docs).columns == docs.columns


@pytest.mark.parametrize("text", ["the cat " * 50 + "der hund und die katze " * 200, "x" * 500, " 1 " * 300 + "the" + "!" * 200 + " cat", "ab" + " " * 100 + "cd" * 100])
def test_slices_carry_their_context(monkeypatch, text):
    m = small_model()
    whole = m.judge(pd.Series([text]))
    monkeypatch.setattr(langid, "SLICE", 64)
    cut = m.judge(pd.Series([text]))
    assert whole["lang_pred"][0] == cut["lang_pred"][0]
    assert whole["entropy"][0] == pytest.approx(cut["entropy"][0], rel=1e-9)
    assert m.score_long(text)[1] == m.scores([text])[1][0]


def naive_kneser_ney(texts, order=4):
    """Probability of a character after others, from the texts of one language, by the definition: counts of the highest
    order, continuation counts below, one discount for each order, uniform at last."""
    grams = {order: Counter()}
    for t in texts:
        s = "\x01\x01\x01" + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split(" "))
        for i in range(3, len(s)):
            grams[order][s[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discount = {}
    for n, c in grams.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))

    def p(gram, alphabet):
        if not gram:
            return 1 / (alphabet + 1)
        n, lower = len(gram), p(gram[1:], alphabet)
        rows = {g: v for g, v in grams[n].items() if g[:-1] == gram[:-1]}
        if not rows:
            return lower
        total = sum(rows.values())
        return max(rows.get(gram, 0) - discount[n], 0) / total + discount[n] * len(rows) / total * lower

    return p


def test_against_naive_kneser_ney():
    texts = [["the cat and the hat then that", "a theme"], ["der hund und die katze der das", "ein tag"]]
    m = small_model(texts)
    alphabet = len({c for t in sum(texts, []) for c in t})
    for lang, own in enumerate(texts):
        p = naive_kneser_ney(own)
        for query in ("the hat", "der tag", "q", "an zzz the", "hund"):
            s, total = "\x01\x01\x01" + query, 0.0
            for i in range(3, len(s)):
                total += np.log(p(s[i - 3 : i + 1], alphabet))
            got, n, _ = m.scores([query])
            assert n[0] == len(query)
            assert got[0, lang] == pytest.approx(total, rel=1e-5)
