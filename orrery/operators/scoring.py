"""Row-local and per-album scores. Every per-album step is one window over the album; no step leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.exprs import clamp, ramp

# Thresholds and weights of the scores.
SHARP_LOW, SHARP_HIGH = 0.12, 0.45
BLOCK_FLOOR = 0.4
BLEND_CONTENT, BLEND_FACES = 0.75, 0.25


def technical_score(df: DataFrame, album: str = "album") -> DataFrame:
    """sharp, p50, p95, clip_hi, contrast -> sharp_rel, score_sharp, score_expo, score_tone, score_technical."""
    typical = F.median("sharp").over(Window.partitionBy(album))
    df = df.withColumn("sharp_rel", F.when(typical == 0, F.lit(1.0)).otherwise(F.col("sharp") / typical))
    expo = (1 - ramp(F.col("p50"), 200, 245)) * (1 - ramp(F.col("p95"), 110, 35)) * (1 - 0.5 * ramp(F.col("clip_hi"), 0.25, 0.6))
    df = df.withColumns({"score_sharp": ramp(F.col("sharp_rel"), SHARP_LOW, SHARP_HIGH), "score_expo": expo, "score_tone": clamp((F.col("contrast") - 0.04) / 0.1)})
    return df.withColumn("score_technical", (0.75 * F.col("score_sharp") + 0.25 * F.col("score_tone")) * F.col("score_expo"))


def final_score(technical: Column, faces: Column, style: Column | None, preference: Column | None, style_weight: float) -> tuple[Column, Column]:
    """(score of the shot, final score). A missing face score counts as 1; style counts only with a weight and a model."""
    shot = technical * F.coalesce(faces, F.lit(1.0))
    if style_weight and style is not None:
        shot = shot * ((1 - style_weight) + style_weight * style)
    shot = F.round(shot, 3)
    final = F.round(shot * (BLOCK_FLOOR + (1 - BLOCK_FLOOR) * preference), 3) if preference is not None else shot
    return shot, final


def face_score(faces: Column, expo: Column) -> Column:
    """faces: array of (px, area, blink), largest first. The worst of the four largest of 60 px and more counts."""
    worst = F.aggregate(F.filter(F.slice(faces, 1, 4), lambda f: f["px"] >= 60), F.lit(0.0), lambda a, f: F.greatest(a, ramp(f["blink"], 0.85, 1.0) * clamp(f["area"] / 0.02)))
    return (1 - 0.75 * worst) * expo


def strength(score: Column, pair: Column, kind: Column) -> Column:
    return score + F.when(pair >= 2, 0.30).otherwise(0.0) + F.when(kind.isin("portrait", "couple"), 0.15).otherwise(0.0)


def percentile_rank(df: DataFrame, value: Column, out: str, album: str = "album", tie: tuple[str, ...] = ("taken", "item_id")) -> DataFrame:
    """(position - 1) / (n - 1) in the order of value within an album; ties by the given columns, so no two are equal."""
    position = F.row_number().over(Window.partitionBy(album).orderBy(value, *tie)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(album))
    return df.withColumn(out, position / F.greatest(n - 1, F.lit(1)))


def preference_blend(df: DataFrame, similarity: str = "similarity", faces: str = "faces") -> DataFrame:
    """Rank of the blended ranks of similarity and of having few faces."""
    df = percentile_rank(df, F.col(similarity), "_content")
    df = percentile_rank(df, -F.log1p(F.coalesce(F.col(faces), F.lit(0)).cast("double")), "_few")
    df = df.withColumn("blend", BLEND_CONTENT * F.col("_content") + BLEND_FACES * F.col("_few"))
    return percentile_rank(df, F.round("blend", 9), "preference").drop("_content", "_few")


def robust_scale(df: DataFrame, value: str, album: str = "album") -> DataFrame:
    """center (median) and scale max(MAD * 1.4826, (p95 - p5) / 4, 0.01) of each album, as two aggregations."""
    mid = df.groupBy(album).agg(F.median(value).alias("center"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    spread = df.join(mid.select(album, "center"), album).groupBy(album).agg((F.median(F.abs(F.col(value) - F.col("center"))) * 1.4826).alias("mad"))
    return mid.join(spread, album).select(album, "center", "mad", F.greatest(F.col("mad"), (F.col("_p")[1] - F.col("_p")[0]) / 4, F.lit(0.01)).alias("scale"))


def standardize(df: DataFrame, value: str, group: str) -> DataFrame:
    """z with the population deviation; one under 1e-6 counts as 1."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd < 1e-6, 1.0).otherwise(sd))


def weighted_histogram(df: DataFrame, group: str, value: Column, weight: Column, low: float, high: float, bins: int) -> DataFrame:
    """Shares of weight by bin; the last bin holds its upper end."""
    b = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    sums = df.select(group, b.alias("bin"), weight.alias("_w")).groupBy(group, "bin").agg(F.sum("_w").alias("_w"))
    return sums.select(group, "bin", (F.col("_w") / F.sum("_w").over(Window.partitionBy(group))).alias("share"))


def day_position(df: DataFrame, micros: Column, album: str = "album") -> DataFrame:
    """Place in the album's span of time, 0 to 1; the span counts as a second at least; 0.5 without a time."""
    w = Window.partitionBy(album)
    first, last = F.min(micros).over(w), F.max(micros).over(w)
    return df.withColumn("position", F.coalesce((micros - first) / F.greatest(last - first, F.lit(1_000_000)), F.lit(0.5)))


def unique_names(df: DataFrame, name: str, order: str, group: str) -> DataFrame:
    """The second and later rows of a name get -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))
