"""Apportionment and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SIMILAR, SAME_KIND, LEAST_BITS = 0.55, 0.12, 12


def largest_remainder(units: DataFrame, weight: Column, seats: int, by: str, unit: str) -> DataFrame:
    """seats of each `by` group dealt to its units in proportion to weight: the floor, then by falling remainder, ties
    by unit."""
    total = F.sum("_w").over(Window.partitionBy(by))
    rows = units.withColumn("_w", weight).withColumn("_exact", F.when(total > 0, F.col("_w") * seats / total).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_floor", F.floor(F.round("_exact", 9))).withColumn("_frac", F.round(F.col("_exact") - F.col("_floor"), 9))
    left = F.lit(seats) - F.sum("_floor").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_frac"), unit))
    return rows.withColumn("quota", F.when(total > 0, F.col("_floor") + (place <= left).cast("int")).otherwise(F.lit(0))).drop("_w", "_exact", "_floor", "_frac")


def spill(wanted: list[int], supply: list[int]) -> list[int]:
    """min(wanted, supply), then what is missing goes one by one to the unit of most slack, which is what supply and a cap
    of max(1, round(1.5 wanted)) leave it (ties: the one with fewer, then the first); what fits nowhere is left out."""
    got = [min(w, s) for w, s in zip(wanted, supply)]
    most = [min(s, max(1, round(1.5 * w))) for w, s in zip(wanted, supply)]
    for _ in range(sum(wanted) - sum(got)):
        slack, _, i = max((m - g, -g, -k) for k, (m, g) in enumerate(zip(most, got)))
        if slack <= 0:
            break
        got[-i] += 1
    return got


def quota_spill(units: DataFrame, by: str, unit: str, wanted: str = "quota", supply: str = "supply") -> DataFrame:
    """Quotas that a unit can't fill pass to others of its group; a group has one row for each unit."""
    kind = {f.name: f.dataType.simpleString() for f in units.schema.fields}

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit")
        rows["assigned"] = spill(rows["wanted"].tolist(), rows["supply"].tolist())
        return rows

    small = units.select(F.col(by).alias("by"), F.col(unit).alias("unit"), F.col(wanted).cast("long").alias("wanted"), F.col(supply).cast("long").alias("supply"))
    out = small.groupBy("by").applyInPandas(deal, f"by {kind[by]}, unit {kind[unit]}, wanted long, supply long, assigned long")
    return out.select(F.col("by").alias(by), F.col("unit").alias(unit), "wanted", "supply", "assigned")


def pick_diverse(rows: pd.DataFrame) -> list[int]:
    """Positions picked. rows in order: unit, quota, score, kind, hash (long), v (vector). Unit after unit, quota times:
    the greatest score - SIMILAR * likeness to any pick - SAME_KIND * picks of its kind in the unit; none nearer than
    LEAST_BITS to a pick."""
    v = np.stack([np.asarray(x, float) for x in rows["v"]])
    codes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    score, kind, unit = rows["score"].to_numpy(float), rows["kind"].to_numpy(), rows["unit"].to_numpy()
    like, far = np.zeros(len(rows)), np.ones(len(rows), bool)
    picked: list[int] = []
    for u in sorted(set(unit.tolist())):
        mine = np.flatnonzero(unit == u)
        mine = mine[np.argsort(-score[mine], kind="stable")]
        same = {k: 0 for k in set(kind[mine].tolist())}
        for _ in range(int(rows["quota"].iloc[mine[0]])):
            free = [i for i in mine if far[i] and i not in picked]
            if not free:
                break
            best = max(free, key=lambda i: score[i] - SIMILAR * like[i] - SAME_KIND * same[kind[i]])
            picked.append(int(best))
            same[kind[best]] += 1
            like = np.maximum(like, np.clip((v @ v[best] - 0.5) / 0.3, 0, 1))
            far &= np.bitwise_count(codes ^ codes[best]) >= LEAST_BITS
    return picked


def mmr_pick(df: DataFrame, by: str) -> DataFrame:
    """by, unit, item_id, pick for the diverse pick of each group. Its state crosses units, so a group is one task; only
    the columns that the pick needs are sent."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "item_id"]).reset_index(drop=True)
        at = pick_diverse(rows)
        out = rows.iloc[at][["by", "unit", "item_id"]].copy()
        out["pick"] = range(1, len(at) + 1)
        return out

    small = df.select(F.col(by).alias("by"), "unit", "item_id", "quota", "score", "kind", "hash", "v")
    out = small.groupBy("by").applyInPandas(pick, f"by {kind[by]}, unit {kind['unit']}, item_id {kind['item_id']}, pick long")
    return out.withColumnRenamed("by", by)


def slide_order(df: DataFrame, by: str, hook: bool = True) -> DataFrame:
    """Chronological numbers from 1; with hook the best item comes first."""
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "taken", "item_id")) == 1
    df = df.withColumn("_first", F.when(best & F.lit(hook), 0).otherwise(1))
    return df.withColumn("slide", F.row_number().over(Window.partitionBy(by).orderBy("_first", "taken", "item_id"))).drop("_first")


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, out: str = "rank") -> DataFrame:
    """First n of each group; the plan cuts groups before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)


def paginate(df: DataFrame, by: str, order: list[Column | str], size: int = 36, columns: int = 6) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumns({"page": F.floor(n / size), "cell_row": F.floor(n % size / columns), "cell_column": n % columns})


def ordered_distinct(df: DataFrame, key: Column, order: list[str], by: str | None = None) -> DataFrame:
    """The first row of each key."""
    parts = [key] if by is None else [F.col(by), key]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter("_r = 1").drop("_r")
