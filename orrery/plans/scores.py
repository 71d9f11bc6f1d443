"""Queries over scores, aggregates and row functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import exprs as x
from orrery.operators import joins, learn, scoring, segment, select
from orrery.plans.registry import query
from orrery.sources.tables import items, table, vectors

METRICS_SQL = """metrics AS (SELECT *, value AS sharp, (item_id * 37 % 256)::DOUBLE AS p50, (item_id * 53 % 256)::DOUBLE AS p95, (item_id * 7 % 100) / 100.0::DOUBLE AS clip_hi, (item_id * 11 % 100) / 400.0::DOUBLE AS contrast FROM items),
tech AS (SELECT *, CASE WHEN median(sharp) OVER (PARTITION BY album) = 0 THEN 1 ELSE sharp / median(sharp) OVER (PARTITION BY album) END AS sharp_rel FROM metrics),
parts AS (SELECT *, greatest(0, least(1, (sharp_rel - 0.12) / (0.45 - 0.12))) AS score_sharp, greatest(0, least(1, (contrast - 0.04) / 0.1)) AS score_tone,
  (1 - greatest(0, least(1, (p50 - 200) / 45))) * (1 - greatest(0, least(1, (p95 - 110) / (35 - 110)))) * (1 - 0.5 * greatest(0, least(1, (clip_hi - 0.25) / (0.6 - 0.25)))) AS score_expo FROM tech),
technical AS (SELECT *, (0.75 * score_sharp + 0.25 * score_tone) * score_expo AS score_technical FROM parts)"""
RANKS_SQL = """ranked AS (SELECT *, (row_number() OVER (PARTITION BY album ORDER BY value, taken, item_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY album) - 1, 1) AS value_rank FROM items)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    return items(spark, d).withColumns({"sharp": F.col("value"), "p50": (i * 37 % 256).cast("double"), "p95": (i * 53 % 256).cast("double"), "clip_hi": (i * 7 % 100) / 100.0, "contrast": (i * 11 % 100) / 400.0})


@query(f"WITH {METRICS_SQL} SELECT item_id, round(sharp_rel, 6) AS sharp_rel, round(score_sharp, 6) AS score_sharp, round(score_expo, 6) AS score_expo, round(score_tone, 6) AS score_tone, round(score_technical, 6) AS score_technical FROM technical")
def technical_score(spark, d):
    out = scoring.technical_score(metrics(spark, d))
    return out.select("item_id", *(F.round(c, 6).alias(c) for c in ("sharp_rel", "score_sharp", "score_expo", "score_tone", "score_technical")))


@query(f"WITH {METRICS_SQL}, shot AS (SELECT item_id, (item_id % 7) / 7.0::DOUBLE AS pref, round(score_technical * coalesce(CASE WHEN item_id % 3 > 0 THEN (item_id % 10) / 10.0::DOUBLE END, 1) * (0.75 + 0.25 * ((item_id % 9) / 9.0::DOUBLE)), 3) AS score_shot FROM technical) SELECT item_id, score_shot, round(score_shot * (0.4 + 0.6 * pref), 3) AS score_final FROM shot")
def final_score(spark, d):
    i = F.col("item_id")
    shot, final = scoring.final_score(F.col("score_technical"), F.when(i % 3 > 0, i % 10 / 10.0), i % 9 / 9.0, i % 7 / 7.0, 0.25)
    return scoring.technical_score(metrics(spark, d)).select("item_id", shot.alias("score_shot"), final.alias("score_final"))


@query("SELECT item_id, CASE WHEN coalesce(faces, 0) = 0 THEN 'detail' WHEN (item_id % 100) / 10000.0::DOUBLE < 0.004 THEN 'far' WHEN faces = 1 THEN 'portrait' WHEN faces = 2 THEN 'couple' ELSE 'group' END AS kind_class FROM items")
def kind_case(spark, d):
    return items(spark, d).select("item_id", x.kind_of(F.col("faces"), F.col("item_id") % 100 / 10000.0).alias("kind_class"))


@query("SELECT album, kind, count(*) AS n, count(*) FILTER (faces >= 2) AS pairs, count(*) FILTER (score < 0.35) AS weak FROM items GROUP BY ALL")
def kind_counts(spark, d):
    return items(spark, d).groupBy("album", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("faces") >= 2).alias("pairs"), F.count_if(F.col("score") < 0.35).alias("weak"))


@query("SELECT user_id, min(taken) AS since, max(taken) AS until, count(DISTINCT event_type) AS cameras, round((epoch_us(max(taken)) - epoch_us(min(taken))) / 3600000000.0::DOUBLE, 6) AS hours, CAST(min(taken) AS DATE) <> CAST(max(taken) AS DATE) AS crosses_midnight FROM items GROUP BY user_id")
def album_span(spark, d):
    span = F.max(x.micros()) - F.min(x.micros())
    return items(spark, d).groupBy("user_id").agg(F.min("taken").alias("since"), F.max("taken").alias("until"), F.count_distinct("event_type").alias("cameras"), F.round(span / 3600000000.0, 6).alias("hours"), (F.min("taken").cast("date") != F.max("taken").cast("date")).alias("crosses_midnight"))


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY ALL")
def robust_percentiles(spark, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(p.alias("p"))
    return out.select("l_returnflag", "l_linestatus", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p05", "p50", "p95"))))


@query("WITH c AS (SELECT album, median(value) AS center, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS width FROM items GROUP BY album), m AS (SELECT album, median(abs(value - center)) * 1.4826 AS mad FROM items JOIN c USING (album) GROUP BY album) SELECT album, round(center, 6) AS center, round(mad, 6) AS mad, round(greatest(mad, width / 4, 0.01), 6) AS scale FROM c JOIN m USING (album)")
def robust_scale(spark, d):
    return scoring.robust_scale(items(spark, d), "value").select("album", *(F.round(c, 6).alias(c) for c in ("center", "mad", "scale")))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / CASE WHEN stddev_pop(p_retailprice) OVER w < 1e-6 THEN 1 ELSE stddev_pop(p_retailprice) OVER w END, 5) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def standardize(spark, d):
    return scoring.standardize(table(spark, d, "part"), "p_retailprice", "p_brand").select("p_partkey", F.round("z", 5).alias("z"))


@query("WITH b AS (SELECT album, CAST(least(greatest(floor(k / (99.0::DOUBLE / 6)), 0), 5) AS INT) AS bin, sum(value) AS w FROM items GROUP BY ALL) SELECT album, bin, round(w / sum(w) OVER (PARTITION BY album), 6) AS share FROM b")
def weighted_histogram(spark, d):
    out = scoring.weighted_histogram(items(spark, d), "album", F.col("k").cast("double"), F.col("value"), 0.0, 99.0, 6)
    return out.withColumn("share", F.round("share", 6))


@query(f"WITH {RANKS_SQL} SELECT item_id, round(value_rank, 9) AS value_rank FROM ranked")
def percentile_rank(spark, d):
    return scoring.percentile_rank(items(spark, d), F.col("value"), "value_rank").select("item_id", F.round("value_rank", 9).alias("value_rank"))


@query("""WITH a AS (SELECT *, greatest(count(*) OVER (PARTITION BY album) - 1, 1) AS n,
  row_number() OVER (PARTITION BY album ORDER BY value, taken, item_id) - 1 AS c, row_number() OVER (PARTITION BY album ORDER BY faces DESC, taken, item_id) - 1 AS f FROM items),
b AS (SELECT *, round(0.75::DOUBLE * (c::DOUBLE / n) + 0.25::DOUBLE * (f::DOUBLE / n), 9) AS blend FROM a)
SELECT item_id, round((row_number() OVER (PARTITION BY album ORDER BY blend, taken, item_id) - 1)::DOUBLE / n, 9) AS preference FROM b""")
def preference_blend(spark, d):
    return scoring.preference_blend(items(spark, d).withColumn("similarity", F.col("value"))).select("item_id", F.round("preference", 9).alias("preference"))


@query("SELECT item_id, round(CASE WHEN taken IS NULL THEN 0.5 ELSE (epoch_us(taken) - min(epoch_us(taken)) OVER w)::DOUBLE / greatest(max(epoch_us(taken)) OVER w - min(epoch_us(taken)) OVER w, 1000000) END, 9) AS position FROM items WINDOW w AS (PARTITION BY album)")
def day_position(spark, d):
    return scoring.day_position(items(spark, d), x.micros()).select("item_id", F.round("position", 9).alias("position"))


@query("WITH n AS (SELECT *, p_name || '-' || p_type AS name, row_number() OVER (PARTITION BY p_brand, p_name || '-' || p_type ORDER BY p_partkey) AS r FROM part) SELECT p_partkey, CASE WHEN r = 1 THEN name ELSE name || '-' || r END AS unique_name FROM n")
def unique_names(spark, d):
    rows = table(spark, d, "part").withColumn("name", F.concat_ws("-", "p_name", "p_type"))
    return scoring.unique_names(rows, "name", "p_partkey", "p_brand").select("p_partkey", "unique_name")


@query("SELECT page_id, regexp_replace(lower(trim(split_part(regexp_extract(url, '^[^?#]*'), '/', -1))), '\\.[a-z0-9]+$', '') AS name FROM pages")
def normalize_name(spark, d):
    return table(spark, d, "pages").select("page_id", x.normalized_name(F.regexp_extract("url", r"^[^?#]*", 0)).alias("name"))


@query("SELECT item_id, round(1 / (1 + exp(-(score * 4 - 2 + faces * 0.1))), 6) AS probability FROM items")
def logistic_score(spark, d):
    return items(spark, d).select("item_id", F.round(x.sigmoid(F.col("score") * 4 - 2 + F.col("faces") * 0.1), 6).alias("probability"))


@query("SELECT album, kind, CAST(sum(CASE kind WHEN 'couple' THEN 1.6 WHEN 'group' THEN 1.2 WHEN 'detail' THEN 0.45 ELSE 1.0 END) * 1000 AS BIGINT) AS weight FROM items GROUP BY ALL")
def bias_lookup(spark, d):
    bias = F.create_map(*(F.lit(v) for kv in (("couple", 1.6), ("group", 1.2), ("detail", 0.45)) for v in kv))
    weight = F.coalesce(F.try_element_at(bias, F.col("kind")), F.lit(1.0))
    return items(spark, d).groupBy("album", "kind").agg(F.round(F.sum(weight) * 1000).cast("long").alias("weight"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_brand, sha256(string_agg(p_type || '=' || n, ',' ORDER BY p_type)) AS signature FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def config_signature(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("p_type", "n"))), lambda s: F.concat_ws("=", s["p_type"], s["n"].cast("string")))
    return rows.groupBy("p_brand").agg(F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("signature"))


@query("SELECT vec_id, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 2] > embedding[i + 1] THEN CAST(pow(2, 62 - i) AS BIGINT) ELSE 0 END)) AS BIGINT) AS hash FROM embeddings")
def gradient_hash(spark, d):
    return vectors(spark, d).select("vec_id", x.gradient_hash(F.col("embedding")).alias("hash"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark, d):
    return joins.cosines(vectors(spark, d), "vec_id", "label", "embedding", 5)


@query("""WITH g AS (SELECT vec_id, label < 5 AS good, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
c AS (SELECT i, median(e) AS center, (quantile_cont(e, 0.95) - quantile_cont(e, 0.05)) / 4 AS width FROM g WHERE good GROUP BY i),
m AS (SELECT i, greatest(median(abs(e - center)) * 1.4826, any_value(width), 0.01) AS scale, any_value(center) AS center FROM g JOIN c USING (i) WHERE good GROUP BY i),
w AS (SELECT i, least(3, greatest(0.15, abs(median((e - center) / scale)))) AS w FROM g JOIN m USING (i) WHERE NOT good GROUP BY i),
z AS (SELECT vec_id, good, list((e - center) / scale ORDER BY i) AS z FROM g JOIN m USING (i) GROUP BY ALL), ws AS (SELECT list(w / (SELECT avg(w) FROM w) ORDER BY i) AS w FROM w),
p AS (SELECT q.vec_id, q.good, r.vec_id AS r_id, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(greatest(-5, least(5, r.z[k] - q.z[k])) * ws.w[k], 2))) / 64) AS dist FROM z q, z r, ws WHERE r.good),
o AS (SELECT vec_id, avg(dist) AS d FROM (SELECT * FROM p WHERE good AND r_id <> vec_id QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, r_id) <= 3) GROUP BY vec_id),
k AS (SELECT vec_id, avg(dist) AS d FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, r_id) <= 3) GROUP BY vec_id)
SELECT vec_id, round(exp(-d / (SELECT median(d) FROM o)), 4) AS style FROM k""")
def style_model_score(spark, d):
    """How alike each vector is to those of labels 0 to 4, by a model that weighs what sets them apart from the others."""
    v = vectors(spark, d).select("vec_id", "label", "embedding")
    model = learn.StyleModel.fit(v.filter("label < 5"), v.filter("label >= 5"), "embedding", "vec_id")
    return model.score(v, "embedding", "vec_id").select("vec_id", "style")


@query("SELECT vec_id, 64 + 11 AS n, round(list_sum(embedding::DOUBLE[]) + ln(1 + vec_id % 5) + sqrt((vec_id % 9) / 100.0::DOUBLE) + 1 + (vec_id % 2) + (label % 2) + 0.5 + 0.25, 5) AS total FROM embeddings")
def feature_vector(spark, d):
    i = F.col("vec_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in learn.KINDS)), (i % 5 + 1).cast("int"))
    f = learn.feature_vector(F.col("embedding"), i % 5, i % 9 / 100.0, kind, i % 2 == 1, F.col("label") % 2 == 1, F.lit(0.5))
    return vectors(spark, d).select("vec_id", f.alias("f")).select("vec_id", F.size("f").alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("WITH u AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS v, count(*) FILTER (o_orderstatus <> 'F') AS h FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN v + h = 0 THEN 0 ELSE greatest(1, least(20, v + h, greatest(CAST(ceil((v * 6 + h * 5) / 10.0) AS BIGINT), CAST(ceil((v + h) / 5.0) AS BIGINT)))) END AS slides FROM u")
def auto_slides(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("v"), F.count_if(F.col("o_orderstatus") != "F").alias("h"))
    return rows.select("o_custkey", x.auto_slides(F.col("v"), F.col("h")).alias("slides"))


@query("SELECT item_id, round(greatest(0.40, least(0.60, (1 / a) / (1 / a + 1 / b))), 6) AS share FROM (SELECT item_id, width::DOUBLE / height AS a, (item_id % 7 + 5) / 8.0::DOUBLE AS b FROM items)")
def adaptive_split(spark, d):
    from orrery.operators import pack

    return items(spark, d).select("item_id", F.round(pack.adaptive_split(F.col("width") / F.col("height"), (F.col("item_id") % 7 + 5) / 8.0), 6).alias("share"))


@query("""WITH b AS (SELECT *, width::DOUBLE AS w, height::DOUBLE AS h, (item_id * 31 % 1000) / 1000.0::DOUBLE * width AS cx, (item_id * 17 % 1000) / 1000.0::DOUBLE * height AS cy FROM items),
c AS (SELECT *, least(w, h * 0.8) AS ww, least(h, w / 0.8) AS wh FROM b),
e AS (SELECT *, greatest(0, least(w - ww, cx - ww / 2)) AS wx, greatest(0, least(h - wh, cy - wh * 0.42)) AS wy FROM c)
SELECT item_id, round(1 - greatest(0, least(cx + 300, wx + ww) - greatest(cx - 300, wx)) * greatest(0, least(cy + 400, wy + wh) - greatest(cy - 400, wy)) / greatest(1, 600.0::DOUBLE * 800), 3) + 0.0 AS cut FROM e""")
def subject_cut(spark, d):
    i = F.col("item_id")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    cx, cy = i * 31 % 1000 / 1000.0 * w, i * 17 % 1000 / 1000.0 * h
    window = x.crop_window(w, h, F.lit(0.8), cx, cy)
    return items(spark, d).select("item_id", x.overlap_cut([cx - 300, cy - 400, F.lit(600.0), F.lit(800.0)], window).alias("cut")).withColumn("cut", F.col("cut") + F.lit(0.0))


@query(f"WITH {RANKS_SQL} SELECT item_id, round(score + CASE WHEN faces >= 2 THEN 0.3 ELSE 0 END + CASE WHEN kind IN ('portrait', 'couple') THEN 0.15 ELSE 0 END, 6) AS strength, (faces >= 2 OR kind IN ('portrait', 'couple')) AS strong, CASE WHEN width > 1.2 * height THEN 'landscape' ELSE 'upright' END AS orientation FROM ranked")
def strength(spark, d):
    return items(spark, d).select("item_id", F.round(scoring.strength(F.col("score"), F.col("faces"), F.col("kind")), 6).alias("strength"), ((F.col("faces") >= 2) | F.col("kind").isin("portrait", "couple")).alias("strong"), F.when(x.landscape(F.col("width"), F.col("height")), "landscape").otherwise("upright").alias("orientation"))


@query("""WITH f AS (SELECT item_id, unnest(range(0, faces)) AS i FROM items),
g AS (SELECT item_id, max(CASE WHEN i < 4 AND (90 - 12 * i) >= 60 THEN greatest(0, least(1, ((item_id * (i + 3) % 100) / 100.0::DOUBLE - 0.85) / (1.0 - 0.85))) * greatest(0, least(1, (0.03 / (i + 1)) / 0.02)) ELSE 0 END) AS worst FROM f GROUP BY item_id)
SELECT item_id, round((1 - 0.75 * coalesce(worst, 0)) * score, 9) AS score_faces FROM items LEFT JOIN g USING (item_id)""")
def face_score(spark, d):
    face = lambda i: F.struct((90 - 12 * i).cast("double").alias("px"), (F.lit(0.03) / (i + 1)).alias("area"), (F.col("item_id") * (i + 3) % 100 / 100.0).alias("blink"))
    faces = F.when(F.col("faces") > 0, F.transform(F.sequence(F.lit(0), F.col("faces") - 1), face)).otherwise(F.array().cast("array<struct<px:double,area:double,blink:double>>"))
    return items(spark, d).select("item_id", F.round(scoring.face_score(faces, F.col("score")), 9).alias("score_faces"))


def blocks(spark: SparkSession, d: str, n: int = 8) -> DataFrame:
    return segment.equal_blocks(items(spark, d), n)


BLOCKS_SQL = "blocks AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY album ORDER BY taken, item_id) - 1) * 8::DOUBLE / count(*) OVER (PARTITION BY album)) AS INT) AS block FROM items)"
FEATURES_SQL = BLOCKS_SQL + """, fr AS (SELECT *, greatest(count(*) OVER (PARTITION BY album) - 1, 1) AS n, row_number() OVER (PARTITION BY album ORDER BY value, taken, item_id) - 1 AS l, row_number() OVER (PARTITION BY album ORDER BY faces, taken, item_id) - 1 AS f, row_number() OVER (PARTITION BY album ORDER BY k, taken, item_id) - 1 AS s, (row_number() OVER (PARTITION BY album ORDER BY taken, item_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY album) - 1, 1) AS p FROM blocks),
features AS (SELECT album, block, avg(l::DOUBLE / n) AS light, avg(f::DOUBLE / n) AS crowd, avg(s::DOUBLE / n) AS sky, avg((kind = 'couple' AND coalesce(faces, 0) <= 3)::INT) AS couples, avg((kind = 'detail')::INT) AS details, avg(p) AS place FROM fr GROUP BY ALL)"""


@query(f"WITH {FEATURES_SQL} SELECT album, block, round(light, 6) AS light, round(crowd, 6) AS crowd, round(sky, 6) AS sky, round(couples, 6) AS couples, round(details, 6) AS details, round(place, 6) AS place FROM features")
def block_features(spark, d):
    return segment.block_features(blocks(spark, d)).select("album", "block", *(F.round(c, 6).alias(c) for c in ("light", "crowd", "sky", "couples", "details", "place")))


AFFINITY_SQL = FEATURES_SQL + """, affinity AS (SELECT album, block, n, chapter, round(CASE n WHEN 0 THEN 1.2::DOUBLE * (1 - sky) + details + 0.8::DOUBLE * (1 - crowd) + (1 - place) WHEN 1 THEN 1.4::DOUBLE * crowd + 0.6::DOUBLE * light + 0.5::DOUBLE * (1 - details)
    WHEN 2 THEN 1.6::DOUBLE * couples + sky + 0.8::DOUBLE * (1 - crowd) + 0.6::DOUBLE * light ELSE 1.6::DOUBLE * (1 - light) + 0.9::DOUBLE * crowd + 0.8::DOUBLE * place END, 6) AS affinity
  FROM features, (VALUES (0, 'start'), (1, 'ceremony'), (2, 'portraits'), (3, 'party')) c(n, chapter))"""


@query(f"WITH {AFFINITY_SQL} SELECT album, block, chapter, affinity FROM affinity")
def chapter_affinity(spark, d):
    return segment.chapter_affinity(segment.block_features(blocks(spark, d))).select("album", "block", "chapter", "affinity")


PATHS_SQL = AFFINITY_SQL + """, names AS (SELECT DISTINCT n, chapter FROM affinity),
paths AS (SELECT album, block, n, affinity AS total, [n] AS path FROM affinity WHERE block = 0 AND n = 0
  UNION ALL SELECT p.album, a.block, a.n, p.total + a.affinity, list_append(p.path, a.n) FROM paths p JOIN affinity a ON a.album = p.album AND a.block = p.block + 1 AND a.n IN (p.n, p.n + 1)),
best AS (SELECT album, path FROM paths WHERE block = 7 AND n = 3 QUALIFY row_number() OVER (PARTITION BY album ORDER BY round(total, 9) DESC, list_reverse(path) DESC) = 1),
chapters AS (SELECT album, b.block::INT AS block, chapter FROM best, range(0, 8) b(block) JOIN names ON names.n = path[b.block + 1])"""


@query(f"WITH {PATHS_SQL} SELECT album, block, chapter FROM chapters")
def chapter_labels(spark, d):
    return segment.chapter_labels(segment.chapter_affinity(segment.block_features(blocks(spark, d))))


def chaptered(spark: SparkSession, d: str) -> DataFrame:
    """Items with a chapter by quarters of their album."""
    names = F.array(*(F.lit(c) for c in segment.CHAPTERS))
    return blocks(spark, d).withColumn("chapter", F.element_at(names, F.floor(F.col("block") / 2).cast("int") + 1))


CHAPTERED_SQL = BLOCKS_SQL + ", chaptered AS (SELECT *, ['start', 'ceremony', 'portraits', 'party'][block // 2 + 1] AS chapter FROM blocks)"


@query(f"WITH {CHAPTERED_SQL} SELECT album, chapter, count(*) AS n, count(DISTINCT block) AS blocks, min(taken) AS since, max(taken) AS until FROM chaptered GROUP BY ALL")
def chapter_summary(spark, d):
    return segment.chapter_summary(chaptered(spark, d)).select("album", "chapter", "n", "blocks", "since", "until")


@query("WITH w AS (SELECT album, kind, count(*) * CASE kind WHEN 'couple' THEN 1.6::DOUBLE WHEN 'group' THEN 1.2 WHEN 'detail' THEN 0.45 ELSE 1.0 END AS weight FROM items GROUP BY album, kind), q AS (SELECT *, weight * 20 / sum(weight) OVER (PARTITION BY album) AS exact FROM w), f AS (SELECT *, floor(round(exact, 9)) AS fl, round(exact - floor(round(exact, 9)), 9) AS frac FROM q) SELECT album, kind, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY album ORDER BY frac DESC, kind) <= 20 - sum(fl) OVER (PARTITION BY album) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def biased_quota(spark, d):
    bias = F.when(F.col("kind") == "couple", 1.6).when(F.col("kind") == "group", 1.2).when(F.col("kind") == "detail", 0.45).otherwise(1.0)
    units = items(spark, d).groupBy("album", "kind").agg(F.count(F.lit(1)).alias("n"))
    return select.largest_remainder(units, F.col("n") * bias, 20, "album", "kind").select("album", "kind", F.col("quota").cast("long").alias("quota"))


@query("WITH w AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL), q AS (SELECT *, n * 100::DOUBLE / sum(n) OVER (PARTITION BY c_mktsegment) AS exact FROM w), f AS (SELECT *, floor(round(exact, 9)) AS fl, round(exact - floor(round(exact, 9)), 9) AS frac FROM q) SELECT c_mktsegment, c_nationkey, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY frac DESC, c_nationkey) <= 100 - sum(fl) OVER (PARTITION BY c_mktsegment) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def largest_remainder(spark, d):
    units = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return select.largest_remainder(units, F.col("n").cast("double"), 100, "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", F.col("quota").cast("long").alias("quota"))

