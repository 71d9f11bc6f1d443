import hashlib

from orrery.llm.exact_dedup import DigestIndex, deduplicate, fresh_name, survivors

SCHEMA = "doc_id long, text string, digest string, kept string"


def test_groups_and_edges(spark):
    rows = [(1, "Ab", "x", "k"), (2, "aB", None, None), (3, "É", "", ""), (4, "é", "", ""), (5, None, "", ""), (6, "", "", ""), (None, "ab", "", ""), (2, "aB", None, None)]
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True)]
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    assert survivors(spark.createDataFrame(rows, SCHEMA)).columns == ["doc_id", "text", "digest", "kept"]


def test_digest_of_long_text(spark):
    text = "Xy ü" * 300_000
    row = deduplicate(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert bytes(row.digest) == hashlib.sha256(text.replace("X", "x").encode()).digest()


def test_second_batch_meets_the_index(spark):
    index = DigestIndex(spark, fresh_name(), 4)
    index.add(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(spark.createDataFrame([(9, "A"), (10, "c"), (11, "c")], "doc_id long, text string")).collect()}
    assert got == {9: (1, False), 10: (11, False), 11: (11, True)}
    assert index.read().count() == 3


def test_hot_digests_take_the_broadcast_path(spark):
    n = 3000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id < 2500, 'same', cast(id as string)) as text")
    got = deduplicate(docs)
    assert got.count() == n
    assert got.filter("kept").count() == 501
    assert got.filter("keep_id = 2499 and group_size = 2500").count() == 2500


def test_digest_that_turns_hot_later(spark):
    """A batch larger than the index, most of whose rows have a text that an earlier, small batch brought."""
    index = DigestIndex(spark, fresh_name(), 4)
    index.add(spark.createDataFrame([(7, "Same"), (8, "other")], "doc_id long, text string")).collect()
    docs = spark.range(100, 4100).selectExpr("id as doc_id", "if(id < 3100, 'sAME', concat('own ', cast(id as string))) as text")
    rows = index.add(docs).collect()
    assert len(rows) == 4000
    assert sum(r.keep_id == 7 and not r.kept and r.group_size == 1 for r in rows) == 3000
    assert sum(r.kept and r.keep_id == r.doc_id for r in rows) == 1000
    assert index.read().count() == 1002


def test_survivors_of_repeated_ids(spark):
    """An id stays if any of its rows does; rows without an id are judged together."""
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (4, "d"), (None, "d"), (None, None)]
    got = survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == [(0, ""), (0, "d"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (4, "d")]


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
