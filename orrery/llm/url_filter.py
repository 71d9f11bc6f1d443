"""URL filters by a temporal list join.

Dated list entries (add or remove a key on a list) become validity intervals. A key is a host suffix, or one followed by
the first path segment. The keys that a URL can meet depend on its host and first segment alone, so the lists are joined
once for each distinct pair of these; each capture then takes, as of its fetch time, the entries whose interval holds it.
The most specific entry decides: more labels first, then a path over none, then allow over block, then the list and the
entry of the smallest name and id. Built-in functions only.

Defined results: a null URL or one without scheme and host has host null and verdict `none`; a null fetch time meets no
entry; intervals hold their start and not their end; of entries for one key on one date the one of greatest id counts;
repeated rows are judged alike; empty lists or captures give `none` or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import join_split, rows_of, table

# The list of the query, as (entry, list, key, verdict, action, date).
ENTRIES = [
    (1, "spam", "spam-farm.example.org", "block", "add", "2024-02-01"),
    (2, "spam", "spam-farm.example.org", "block", "remove", "2024-07-15"),
    (3, "spam", "spam-farm.example.org", "block", "add", "2024-10-01"),
    (4, "spam", "cheap-pills.example.com", "block", "add", "2024-01-10"),
    (5, "trusted", "www.cheap-pills.example.com", "allow", "add", "2024-05-01"),
    (6, "trusted", "www.cheap-pills.example.com", "allow", "remove", "2024-06-01"),
    (7, "region", "example.net/de", "block", "add", "2024-03-01"),
    (8, "region", "example.net/de", "block", "remove", "2024-11-30"),
    (9, "trusted", "blog.ththan.example.net", "allow", "add", "2024-01-01"),
    (10, "adult", "ththen.example.com", "block", "add", "2024-04-01"),
    (11, "adult", "ththen.example.com", "block", "remove", "2024-04-01"),
    (12, "adult", "therti.example.org", "block", "add", "2024-08-01"),
    (13, "region", "example.com/es", "block", "add", "2024-09-01"),
    (14, "trusted", "example.com/es", "allow", "add", "2024-12-01"),
]
ENTRY_SCHEMA = "entry_id long, list string, key string, verdict string, action string, date date"
#: Captures have no date of their own in the tables: page n counts as fetched n mod 366 days into 2024.
FETCHED = "date_add(date'2024-01-01', cast(page_id % 366 as int))"


def intervals(entries: DataFrame) -> DataFrame:
    """key, verdict, list, entry_id, valid_from, valid_to (null: open) of every added entry."""
    own = Window.partitionBy("list", "key")
    last = F.row_number().over(Window.partitionBy("list", "key", "date").orderBy(F.desc("entry_id")))
    kept = entries.filter("key is not null and date is not null").withColumn("_last", last).filter("_last = 1")
    lead = kept.withColumn("valid_to", F.lead("date").over(own.orderBy("date")))
    return lead.filter("action = 'add'").select(F.lower("key").alias("key"), "verdict", "list", "entry_id", F.col("date").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def segment(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, host, fetched, verdict (block, allow, none), entry_id, kept for every capture. Sites and keys with many rows
    get their rules by broadcast, so that no task holds all captures of one."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(time_col).alias("fetched"), host(F.col(url_col)).alias("host"), F.coalesce(segment(F.col(url_col)), F.lit("")).alias("segment"))
    total = captures.count()
    hosted = rows.filter("host is not null")
    sites = hosted.groupBy("host", "segment").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), F.col("segment")))
    keys = sites.select("host", "segment", F.explode(F.when(F.col("segment") == "", suffixes).otherwise(F.concat(suffixes, paths))).alias("key"))
    depth = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    rule = F.struct((-depth).alias("depth"), (-F.instr("key", "/").cast("boolean").cast("int")).alias("path"), "verdict", "list", "entry_id", "valid_from", "valid_to")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rules = join_split(keys, intervals(entries).join(held, "key"), "key", total).groupBy("host", "segment").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    found = sites.join(rules, ["host", "segment"], "left")
    met = join_split(hosted, found, ["host", "segment"], total)
    met = met.unionByName(rows.filter("host is null").withColumn("rules", F.lit(None).cast(met.schema["rules"].dataType)))
    active = F.filter("rules", lambda r: (r["valid_from"] <= F.col("fetched")) & (r["valid_to"].isNull() | (F.col("fetched") < r["valid_to"])))
    first = F.get(active, F.lit(0))
    verdict = F.coalesce(first["verdict"], F.lit("none"))
    return met.select("page_id", "host", "fetched", verdict.alias("verdict"), first["entry_id"].alias("entry_id"), (verdict != "block").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    names = ("entry_id", "list", "key", "verdict", "action", "date")
    entries = rows_of(spark, **dict(zip(names, map(list, zip(*ENTRIES)))))
    return judge(pages, entries.withColumn("date", F.col("date").cast("date")))


ORACLE = (
    "WITH e(entry_id, list, key, verdict, action, date) AS (VALUES "
    + ", ".join(f"({i}, '{a}', '{k}', '{v}', '{x}', DATE '{d}')" for i, a, k, v, x, d in ENTRIES)
    + r"""),
last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY list, key, date ORDER BY entry_id DESC) = 1),
spans AS (SELECT *, lead(date) OVER (PARTITION BY list, key ORDER BY date) AS valid_to FROM last),
adds AS (SELECT * FROM spans WHERE action = 'add'),
p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
        lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1)) AS host,
        regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment FROM pages),
m AS (SELECT p.page_id, a.verdict, a.entry_id, row_number() OVER (PARTITION BY p.page_id ORDER BY
          len(string_split(split_part(a.key, '/', 1), '.')) DESC, contains(a.key, '/') DESC, a.verdict, a.list, a.entry_id) AS r
      FROM p JOIN adds a ON (('.' || p.host) LIKE ('%.' || a.key) OR (('.' || p.host || '/' || p.segment) LIKE ('%.' || a.key) AND contains(a.key, '/')))
        AND a.date <= p.fetched AND (a.valid_to IS NULL OR p.fetched < a.valid_to))
SELECT p.page_id, p.host, p.fetched, coalesce(m.verdict, 'none') AS verdict, m.entry_id, coalesce(m.verdict, 'none') <> 'block' AS kept
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""
)
