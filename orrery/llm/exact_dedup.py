"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, the known ones go by a
sort-merge anti-join that needs no shuffle of the index, and what is left is appended.

Defined results: a null text counts as empty; of equal texts in a batch the largest id stays; a text that an earlier
batch brought keeps the id of that batch; rows repeated with one id are members of their group and share its verdict;
null ids lose to any other; an empty batch changes nothing and returns no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.llm.common import Stage, join_split, plain, release, table, without

@F.pandas_udf(T.BinaryType())
def text_digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of the text after lower-casing A-Z only. UTF-8 keeps ASCII bytes apart from all others, so bytes suffice."""
    release()
    for text in texts:
        yield text.map(lambda t: hashlib.sha256((t or "").encode().lower()).digest())
    release()


class DigestIndex:
    """digest -> id that stays, size of its group when it was added. Kept as a bucketed table in the warehouse."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """One file per bucket and batch: the rows are dealt by the same hash as the buckets."""
        (
            groups.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicates docs against the index and itself, appends the new texts, returns doc_id, keep_id, group_size
        (in the batch that brought the text), kept, digest for every row.

        The batch's own groups meet the index in a sort-merge join, one row for each digest on either side. Its rows then
        meet what was found; digests with many rows in this batch, whenever they came to the index, by broadcast."""
        stage = Stage(self.spark, "digests")
        rows = stage.put(plain(docs, id_col, text_col).select("doc_id", text_digest("text").alias("digest")), "rows")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        self.append(groups.join(self.read().hint("merge"), "digest", "left_anti") if self.exists() else groups)
        sizes = groups.select("digest", F.col("group_size").alias("n"))
        known = sizes.join(self.read().hint("merge"), "digest").select("digest", "n", "keep_id", "group_size")
        met = join_split(rows, known, "digest", rows.count()).select("doc_id", "digest", "keep_id", "group_size")
        return met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def fresh_name() -> str:
    return f"digest_index_{uuid.uuid4().hex[:12]}"


def deduplicate(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A batch against a fresh index, which is dropped once the verdicts are written."""
    spark = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = DigestIndex(spark, fresh_name(), buckets)
    try:
        return Stage(spark, "verdicts").put(index.add(docs, id_col, text_col), "verdicts")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index.name}")


def survivors(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents of an id that has a row whose verdict is to stay, with their own columns."""
    gone = deduplicate(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).filter("not stays").select("doc_id")
    return without(docs, gone, Stage(docs.sparkSession, "exact"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
