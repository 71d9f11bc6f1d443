"""Evaluation against ground truth."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.exprs import micros


def auc(df: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """Rank AUC with ties at their mean rank; null where a class is empty. Equal scores are counted first, so ranks are
    sums over distinct scores."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    total = wins.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("wins").alias("_wins"))
    return total.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_wins") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def weighted_auc(aucs: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the groups' AUC by their positives; groups without one don't count."""
    there = aucs.filter(F.col("auc").isNotNull())
    return there.groupBy(*by).agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc"), F.count(F.lit(1)).alias("groups"))


def moments_by_chance(items: DataFrame, size: Column, album: str, gap_us: int) -> DataFrame:
    """items with exact_chance and moment_chance: the probabilities that a random choice of `size` items of the album holds
    the item, and one within the gap of it. Of n items c are that near, so the second is 1 less the product of
    (n - c - i) / (n - i) over the draws."""
    whole = Window.partitionBy(album)
    near = whole.orderBy("_us").rangeBetween(-gap_us, gap_us)
    rows = items.withColumn("_us", micros("taken")).withColumns({"_n": F.count(F.lit(1)).over(whole), "_c": F.count("_us").over(near), "_k": size})
    miss = F.aggregate(F.sequence(F.lit(0), F.col("_k").cast("int") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.col("_n") - F.col("_c") - i, F.lit(0)) / (F.col("_n") - i))
    chance = {"exact_chance": F.col("_k") / F.col("_n"), "moment_chance": F.when(F.col("_k") > 0, 1 - miss).otherwise(0.0)}
    return rows.withColumns(chance).drop("_us", "_n", "_c", "_k")


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def overlap_by_chance(counts: DataFrame, by: str, size: int, draws: int, seed: int = 0) -> DataFrame:
    """by, mean_hits, deviation of how many of `good` among `n` items are in a random choice of `size`. The hits of a draw
    without replacement have the hypergeometric law, so an album costs one row however many items it has; the draws hang
    on the album's value alone."""
    kind = counts.schema[by].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for key, n, good in zip(rows["by"], rows["n"], rows["good"]):
                hits = np.random.default_rng([seed, zlib.crc32(str(key).encode())]).hypergeometric(good, n - good, min(size, n), draws)
                out.append((key, hits.mean(), hits.std()))
            yield pd.DataFrame(out, columns=["by", "mean_hits", "deviation"])

    small = counts.select(F.col(by).alias("by"), "n", "good")
    return small.mapInPandas(draw, f"by {kind}, mean_hits double, deviation double").withColumnRenamed("by", by)
