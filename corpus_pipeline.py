"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, tokens. Each stage works on all that the
one before it kept, read back from the table that it wrote. All but the last return the columns of documents.

Defined results: a document goes where its language is rejected (a null text or one without letters among them), where an
equal text of greater id stays, where it is like one of smaller id (five-word shingles, similarity 0.8 or more, over any
chain of such pairs), or where it holds a benchmark item. What hangs on a null id stays: such rows lose to any other in
exact dedup and are never near duplicates or contaminated. Of rows with one id all stay or go, but for the language, which
is judged for each row. Further columns pass through all stages but the last. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import byte_bpe, decontaminate, exact_dedup, langid, simhash
from orrery.llm.common import Stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The stages hold models, graph closure and byte merges, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
