import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return out


def card(rng, n):
    d = [str(rng.randrange(10)) for _ in range(n - 1)]
    return next("".join(d) + str(c) for c in range(10) if luhn("".join(d) + str(c)))


def fuzz(rng):
    parts = [
        lambda: "".join(rng.choice("ab.@_-%+1") for _ in range(rng.randrange(1, 12))), lambda: ".".join(str(rng.choice([0, 1, 7, 255, 256, 300, "001"])) for _ in range(rng.randrange(2, 9))),
        lambda: card(rng, rng.randrange(12, 22)), lambda: " ".join(re.findall(".{1,4}", card(rng, 16))), lambda: "-".join(re.findall(".{1,4}", card(rng, 16))), lambda: "+" + "".join(rng.choice("0123456789 ().-") for _ in range(rng.randrange(3, 22))),
        lambda: "é😀", lambda: " ", lambda: "x@y.z.@q.r_t@u.v", lambda: "1 - 2", lambda: "12  3", lambda: "\n", lambda: "٣٤",
    ]
    return "".join(rng.choice(parts)() for _ in range(rng.randrange(1, 14)))


def check(rows):
    for r in rows:
        want = brute(r.text)
        got = [x for x in r.spans.split(",") if x and not x.startswith("iban")]
        assert got == want, (r.text[:300], got[:5], want[:5])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PLAIN]


def results(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pii.query(spark, str(tmp_path)).join(texts, "doc_id").collect()


def test_against_plain_patterns(spark, tmp_path):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, fuzz(rng)) for i in range(3000)], "doc_id long, text string")
    check(results(spark, docs, tmp_path))


def test_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = results(spark, docs, tmp_path)
    assert len(rows) == docs.count() and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    check(rows)


def test_iban_scores_and_redaction(spark):
    text = "Pay to IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE88370400440532013000. mail me: a@b.co"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find(docs).first().spans
    assert [s.text for s in spans if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert all(text[s.start : s.end] == s.text for s in spans)
    assert [s.score for s in spans if s.kind == "email"] == [pytest.approx(0.95)]
    assert pii.redact(docs).first().text == "Pay to IBAN <iban> or <iban>, not DE88370400440532013000. mail me: <email>"


def test_edges(spark, tmp_path):
    schema = "doc_id long, text string, spans string, kind string"
    assert pii.find(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "1" * 2000, "", ""), (4, "a" * 2000 + "@", "", ""), (5, "1.2.3.4 " * 3000, "", ""), (6, "+" + " " * 2000, "", ""), (7, "a@b.c", "", "")]
    check(results(spark, spark.createDataFrame(rows, schema), tmp_path))


def test_long_runs_take_linear_time(spark):
    n = 300_000
    rows = [(1, "1" * n), (2, "a" * n + "@"), (3, "+" + " " * n), (4, "a" * n + "@" + "b." * n + "c"), (5, "1." * n), (6, "1 " * n)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == got[6] == []
    assert got[4] == [("email", 0, 3 * n + 2)]
    assert len(got[5]) == n // 4 and got[5][-1] == ("ip", 2 * n - 8, 2 * n - 1)
