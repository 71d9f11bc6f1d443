import datetime as dt
import glob
import os

import duckdb

from orrery.llm import url_filter as u

DAY = dt.date


def entries(spark, rows):
    return spark.createDataFrame(rows, u.ENTRY_SCHEMA)


def test_as_of(spark):
    e = entries(spark, [(1, "a", "bad.com", "block", "add", DAY(2024, 1, 10)), (2, "a", "bad.com", "block", "remove", DAY(2024, 2, 1)), (3, "b", "ok.bad.com", "allow", "add", DAY(2024, 1, 15)), (4, "c", "bad.com/x", "block", "add", DAY(2024, 3, 1)), (5, "d", "bad.com/x", "allow", "add", DAY(2024, 4, 1)), (6, "d", "bad.com/x", "allow", "remove", DAY(2024, 4, 1)), (7, "e", None, "block", "add", DAY(2024, 1, 1)), (8, "e", "q.com", "block", "add", None)])
    urls = [("http://bad.com/", DAY(2024, 1, 9)), ("http://Bad.com./x", DAY(2024, 1, 10)), ("https://u:p@www.bad.com:80?q", DAY(2024, 1, 31)), ("http://bad.com", DAY(2024, 2, 1)), ("http://ok.bad.com/x", DAY(2024, 1, 20)), ("http://bad.com/x/y", DAY(2024, 4, 2)), ("http://notbad.com/", DAY(2024, 1, 20)), (None, DAY(2024, 1, 20)), ("nonsense", DAY(2024, 1, 20)), ("http://bad.com/", None), ("http://ok.bad.com/x", DAY(2024, 3, 2))]
    rows = spark.createDataFrame([(i, x, d, "v") for i, (x, d) in enumerate(urls)], "page_id long, url string, fetched date, verdict string")
    got = {r.page_id: (r.verdict, r.entry_id) for r in u.judge(rows, e).collect()}
    assert got == {0: ("none", None), 1: ("block", 1), 2: ("block", 1), 3: ("none", None), 4: ("allow", 3), 5: ("block", 4), 6: ("none", None), 7: ("none", None), 8: ("none", None), 9: ("none", None), 10: ("allow", 3)}
    assert {r.verdict for r in u.judge(rows, e.limit(0)).collect()} == {"none"}
    assert u.judge(rows.limit(0), e).count() == 0
    assert u.judge(rows.union(rows), e).count() == 22


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    rel = con.execute(u.ORACLE)
    names = [c[0] for c in rel.description]
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["page_id"])
    got = sorted((r.asDict() for r in u.query(spark, sf_dir).collect()), key=lambda r: r["page_id"])
    assert got == want and {r["verdict"] for r in got} == {"none", "block", "allow"}


def test_hot_site_and_very_long_url(spark):
    """Captures of one site are judged alike by broadcast and by shuffle; a very long URL has a host like any other."""
    e = entries(spark, [(1, "a", "hot.com", "block", "add", DAY(2024, 1, 10)), (2, "a", "rare.com/p", "block", "add", DAY(2024, 1, 10))])
    rows = spark.range(6000).selectExpr("id as page_id", "case when id < 4000 then 'http://hot.com/x' when id < 5500 then 'http://calm.org/' else concat('http://rare.com/p/', id) end as url", "date'2024-02-01' as fetched")
    more = spark.createDataFrame([(9000, "http://rare.com/p/" + "x" * 2_000_000), (9001, "http://" + "a." * 200 + "hot.com/" + "y" * 500_000)], "page_id long, url string").selectExpr("*", "date'2024-02-01' as fetched")
    got = {r.page_id: r.verdict for r in u.judge(rows.unionByName(more), e).collect()}
    assert len(got) == 6002
    assert all(v == ("none" if 4000 <= i < 5500 else "block") for i, v in got.items())
