"""Ordered joins and runs: as-of, interval and range joins, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.exprs import hamming, micros


def time_gaps(df: DataFrame, album: str = "album", order: tuple[str, ...] = ("taken", "item_id")) -> DataFrame:
    """gap_us to the row before in the album; null for the first."""
    us = micros("taken")
    return df.withColumn("gap_us", us - F.lag(us).over(Window.partitionBy(album).orderBy(*order)))


def runs(df: DataFrame, starts: Column, out: str, album: str = "album", order: tuple[str, ...] = ("taken", "item_id")) -> DataFrame:
    """Number of the run a row is in, from 0; a run begins where `starts` holds and at the first row."""
    w = Window.partitionBy(album).orderBy(*order)
    first = F.row_number().over(w) == 1
    df = df.withColumn("_start", F.when(first | F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    return df.withColumn(out, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_start")


def burst_runs(df: DataFrame, gap_us: int, album: str = "album") -> DataFrame:
    """Runs whose neighbours are at most gap_us apart."""
    return runs(time_gaps(df, album), F.col("gap_us") > gap_us, "run", album)


def neighbours(df: DataFrame, album: str = "album") -> DataFrame:
    """gap_us, prev_id and bits: how far the row before in the album is in time, which it is, and how many bits of the hashes
    differ."""
    w = Window.partitionBy(album).orderBy("taken", "item_id")
    return time_gaps(df, album).withColumns({"prev_id": F.lag("item_id").over(w), "bits": hamming(F.col("hash"), F.lag("hash").over(w))})


def burst_edges(df: DataFrame, gap_us: int, bits: int, album: str = "album") -> DataFrame:
    """Neighbours in time that are close in time and in hash."""
    return neighbours(df, album).filter((F.col("gap_us") <= gap_us) & (F.col("bits") <= bits)).select(album, "prev_id", "item_id", "gap_us", "bits")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of least time difference in its group; ties go to the earlier one. Both sides are
    laid in one order and each left row looks back and ahead, so no pair of rows is ever joined."""
    both = left.select(by, "taken", F.col(left_id).alias("l"), F.lit(None).cast("long").alias("r")).unionByName(right.select(by, "taken", F.lit(None).cast("long").alias("l"), F.col(right_id).alias("r")))
    both = both.withColumn("us", micros("taken")).withColumn("s", F.when(F.col("r").isNotNull(), F.struct("us", "r")))
    # At one time right rows stand before left ones; the smallest id is the one next to them.
    w = Window.partitionBy(by).orderBy(F.col("us"), F.col("l").isNotNull(), F.desc("r"), "l")
    back = F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    met = both.withColumns({"back": back, "ahead": ahead}).filter("l is not null")
    d1, d2 = F.col("us") - F.col("back.us"), F.col("ahead.us") - F.col("us")
    first = F.col("ahead").isNull() | (d1 <= d2)
    return met.select(by, F.col("l").alias(left_id), F.when(first, F.col("back.r")).otherwise(F.col("ahead.r")).alias(right_id), F.when(first, d1).otherwise(d2).alias("diff_us"))


def interval_semi(left: DataFrame, right: DataFrame, by: str, within_us: int) -> DataFrame:
    """Left rows with a right row of the group at most within_us away: an equi-join on time buckets and their
    neighbours, then the exact test."""
    us = micros("taken")
    spread = right.select(by, us.alias("_us")).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("_us") / within_us) + k)))
    mine = left.withColumn("_b0", F.floor(us / within_us))
    met = mine.join(spread.withColumnRenamed(by, "_by"), (F.col(by) == F.col("_by")) & (F.col("_b0") == F.col("_b")) & (F.abs(us - F.col("_us")) <= within_us), "left_semi")
    return met.drop("_b0")


def range_candidates(heroes: DataFrame, pool: DataFrame, by: str, within_us: int) -> DataFrame:
    """(hero_id, item_id, diff_us) for pool rows of the group at most within_us from a hero, by time buckets."""
    us = micros("taken")
    h = heroes.select(by, F.col("item_id").alias("hero_id"), us.alias("hero_us")).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("hero_us") / within_us) + k)))
    p = pool.select(by, "item_id", us.alias("us")).withColumn("_b", F.floor(F.col("us") / within_us))
    met = h.join(p, [by, "_b"]).withColumn("diff_us", F.abs(F.col("us") - F.col("hero_us")))
    return met.filter((F.col("diff_us") <= within_us) & (F.col("hero_id") != F.col("item_id"))).select(by, "hero_id", "item_id", "diff_us")


def range_links(rows: DataFrame, by: str, within_us: int) -> DataFrame:
    """range_candidates of all rows with each other, without a row for each pair: a row's place in its group in order of time
    and id, and the places from first_place to last_place of the rows at most within_us from it, which are all there are.
    links: how many of those have another id. class_id: the least id of its stretch of rows with no longer gap.

    Counts run over rows in order of time, so work and result grow as the rows. Rows without group, id or time have no links."""
    rows = rows.select(by, "item_id", "taken")
    known = F.col(by).isNotNull() & F.col("item_id").isNotNull() & F.col("taken").isNotNull()
    us = micros("taken")

    def span(*keys: str) -> tuple[Column, Column]:
        w = Window.partitionBy(*keys).orderBy(us)
        return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, -within_us - 1)), F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, within_us))

    first, end = span(by)
    before, upto = span(by, "item_id")
    place = F.row_number().over(Window.partitionBy(by).orderBy("taken", "item_id")).cast("long") - 1
    mine = burst_runs(rows.filter(known), within_us, by).withColumn("class_id", F.min("item_id").over(Window.partitionBy(by, "run")))
    mine = mine.select(by, "item_id", place.alias("place"), first.alias("first_place"), (end - 1).alias("last_place"), (end - first - (upto - before)).alias("links"), "class_id")
    none = F.lit(None).cast("long")
    alone = rows.filter(~known).select(by, "item_id", none.alias("place"), none.alias("first_place"), none.alias("last_place"), F.lit(0).cast("long").alias("links"), F.col("item_id").alias("class_id"))
    return mine.unionByName(alone)


def time_repair_candidates(df: DataFrame, group: str, jump_us: int, agree_us: int) -> DataFrame:
    """Rows whose time lies more than jump_us from both neighbours in the order of ids, which agree within agree_us:
    with the midpoint that would repair them."""
    w = Window.partitionBy(group).orderBy("item_id")
    us = micros("taken")
    near = df.withColumns({"_us": us, "_prev": F.lag(us).over(w), "_next": F.lead(us).over(w)})
    odd = (F.abs(F.col("_us") - F.col("_prev")) > jump_us) & (F.abs(F.col("_us") - F.col("_next")) > jump_us) & (F.abs(F.col("_next") - F.col("_prev")) <= agree_us)
    return near.filter(odd).select(group, "item_id", F.col("_us").alias("us"), F.floor((F.col("_prev") + F.col("_next")) / 2).alias("repaired_us"))


def backward_share(df: DataFrame, group: str) -> DataFrame:
    """Share of rows whose time lies before that of the row before in the order of ids."""
    w = Window.partitionBy(group).orderBy("item_id")
    back = df.withColumn("_back", F.col("taken") < F.lag("taken").over(w))
    return back.groupBy(group).agg((F.count_if("_back") / F.count(F.lit(1))).alias("backward"))
