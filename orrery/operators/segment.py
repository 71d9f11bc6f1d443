"""Cutting a timeline into blocks and naming them."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.exprs import micros
from orrery.operators.scoring import percentile_rank

CHAPTERS = ["start", "ceremony", "portraits", "party"]


def cuts(gaps: list[float], blocks: int, least_gap: float) -> list[int]:
    """gaps[i] lies between items i and i + 1. Takes the largest gaps (of equal ones the later) of at least least_gap,
    each max(1, 3 % of the items) from other cuts and the ends, until blocks - 1 cuts, blocks being the items at most. As
    many cuts as are short are then spread evenly over the whole line; one too near to another cut is left out. Returns
    the first items of blocks but the first."""
    n = len(gaps) + 1
    blocks = max(1, min(blocks, n))
    apart = max(1, int(0.03 * n))
    taken: list[int] = []

    def near(place: int) -> bool:
        i = bisect.bisect_left(taken, place)
        return any(abs(taken[k] - place) < apart for k in (i - 1, i) if 0 <= k < len(taken))

    for gap, place in sorted(((g, i + 1) for i, g in enumerate(gaps)), reverse=True):
        if len(taken) >= blocks - 1 or gap < least_gap:
            break
        if apart <= place <= n - apart and not near(place):
            bisect.insort(taken, place)
    short = blocks - 1 - len(taken)
    for k in range(1, short + 1):
        place = round(n * k / (short + 1))
        if not near(place):
            bisect.insort(taken, place)
    return taken


def day_blocks(df: DataFrame, blocks: int, least_gap_us: int = 60_000_000, album: str = "album") -> DataFrame:
    """album, item_id, block. The greedy choice needs an album's gaps at once; only ids and times are sent there."""
    kind = df.schema[album].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "item_id"], na_position="first")
        places = cuts(rows["us"].diff().fillna(0).tolist()[1:], blocks, least_gap_us)
        return pd.DataFrame({"album": rows["album"], "item_id": rows["item_id"], "block": [bisect.bisect_right(places, i) for i in range(len(rows))]})

    small = df.select(F.col(album).alias("album"), "item_id", micros("taken").alias("us"))
    return small.groupBy("album").applyInPandas(cut, f"album {kind}, item_id long, block int").withColumnRenamed("album", album)


def equal_blocks(df: DataFrame, blocks: int, album: str = "album") -> DataFrame:
    """Blocks of equal count along the time of an album."""
    w = Window.partitionBy(album)
    place = F.row_number().over(w.orderBy("taken", "item_id")) - 1
    return df.withColumn("block", F.floor(place * blocks / F.count(F.lit(1)).over(w)).cast("int"))


def block_features(df: DataFrame, album: str = "album", block: str = "block") -> DataFrame:
    """Mean of the ranks of brightness, faces and sky; shares of couples without others about (three faces at most) and of
    details; mean place in the album from 0 to 1."""
    df = percentile_rank(df, F.col("value"), "_light", album)
    df = percentile_rank(df, F.col("faces"), "_faces", album)
    df = percentile_rank(df, F.col("k"), "_sky", album)
    own = Window.partitionBy(album)
    place = (F.row_number().over(own.orderBy("taken", "item_id")) - 1) / F.greatest(F.count(F.lit(1)).over(own) - 1, F.lit(1))
    df = df.withColumn("_place", place)
    return df.groupBy(album, block).agg(F.avg("_light").alias("light"), F.avg("_faces").alias("crowd"), F.avg("_sky").alias("sky"), F.avg(((F.col("kind") == "couple") & (F.coalesce(F.col("faces"), F.lit(0)) <= 3)).cast("double")).alias("couples"), F.avg((F.col("kind") == "detail").cast("double")).alias("details"), F.avg("_place").alias("place"))


def affinity(chapter: Column) -> Column:
    """How well a block's features fit a chapter; any name but the first three counts as the last."""
    light, crowd, sky, couples, details, place = (F.col(c) for c in ("light", "crowd", "sky", "couples", "details", "place"))
    form = F.when(chapter == "start", 1.2 * (1 - sky) + details + 0.8 * (1 - crowd) + (1 - place))
    form = form.when(chapter == "ceremony", 1.4 * crowd + 0.6 * light + 0.5 * (1 - details))
    form = form.when(chapter == "portraits", 1.6 * couples + sky + 0.8 * (1 - crowd) + 0.6 * light)
    return form.otherwise(1.6 * (1 - light) + 0.9 * crowd + 0.8 * place)


def chapter_affinity(features: DataFrame, chapters: list[str] = CHAPTERS) -> DataFrame:
    names = F.posexplode(F.array(*(F.lit(c) for c in chapters))).alias("n", "chapter")
    return features.select("*", names).withColumn("affinity", F.round(affinity(F.col("chapter")), 6))


def chapter_labels(scores: DataFrame, album: str = "album", block: str = "block") -> DataFrame:
    """Viterbi path over blocks: starts in the first chapter, ends in the last, stays or goes on by one, staying on
    ties. scores: (album, block, n, chapter, affinity). With fewer blocks than chapters the names go in order.

    The sums run along the blocks in an array expression; an album has few blocks and chapters, and nothing leaves the
    JVM."""
    rows = scores.groupBy(album, block).agg(F.array_sort(F.collect_list(F.struct("n", "affinity", "chapter"))).alias("cells"))
    line = rows.groupBy(album).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("block"), "cells"))).alias("line"))
    low = F.lit(-1e18)
    k = F.size(F.get(F.col("line"), F.lit(0))["cells"])

    # State: for each chapter the best sum that ends there and its path, as an array of (sum, path).
    def step(state: Column, b: Column) -> Column:
        def cell(c: Column, j: Column) -> Column:
            stay = F.get(state, j)
            on = F.when(j > 0, F.get(state, j - 1))
            best = F.when(on.isNotNull() & (on["total"] > stay["total"]), on).otherwise(stay)
            return F.named_struct(F.lit("total"), best["total"] + c["affinity"], F.lit("path"), F.concat(best["path"], F.array(j)))

        return F.transform(b["cells"], cell)

    first = F.transform(F.get(F.col("line"), F.lit(0))["cells"], lambda c, j: F.named_struct(F.lit("total"), F.when(j == 0, c["affinity"]).otherwise(low), F.lit("path"), F.array(j)))
    path = F.when(F.size("line") < k, F.transform("line", lambda _, i: i)).otherwise(F.element_at(F.aggregate(F.slice("line", F.lit(2), F.size("line")), first, step), -1)["path"])
    out = line.select(album, F.posexplode("line").alias("i", "b"), path.alias("path"))
    chosen = F.get(F.col("path"), F.col("i"))
    return out.select(album, F.col("b.block").alias(block), F.get(F.col("b.cells"), chosen)["chapter"].alias("chapter"))


def chapter_summary(df: DataFrame, album: str = "album", chapter: str = "chapter") -> DataFrame:
    """One row for each unbroken run of a chapter along time: items, blocks, first and last time."""
    w = Window.partitionBy(album).orderBy("taken", "item_id")
    starts = F.when(F.lag(chapter).over(w).eqNullSafe(F.col(chapter)), 0).otherwise(1)
    numbered = df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(album, "run", chapter).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"), F.min("taken").alias("since"), F.max("taken").alias("until"))
