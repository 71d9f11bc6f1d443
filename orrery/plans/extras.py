"""Queries over the smaller operators: captions, modes, catalogues, label guards, merges, explanations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from orrery.functions import exprs as x
from orrery.operators import joins, pack, select
from orrery.plans.flows import chosen, published, sides
from orrery.plans.registry import query
from orrery.plans.scores import CHAPTERED_SQL, chaptered
from orrery.sources import tables
from orrery.sources.tables import items, table, vectors


@query("SELECT item_id, concat_ws(' ', strftime(taken, '%H:%M'), CASE WHEN faces > 0 THEN 'f' || faces END, CASE WHEN score < 0.35 THEN 'weak' END, CASE WHEN width > height THEN 'wide' END) AS caption FROM items")
def caption(spark, d):
    parts = F.array(F.date_format("taken", "HH:mm"), F.when(F.col("faces") > 0, F.concat(F.lit("f"), F.col("faces").cast("string"))), F.when(F.col("score") < 0.35, "weak"), F.when(F.col("width") > F.col("height"), "wide"))
    return items(spark, d).select("item_id", F.concat_ws(" ", F.filter(parts, lambda p: p.isNotNull())).alias("caption"))


@query("SELECT item_id, CASE WHEN (item_id % 20) / 100.0::DOUBLE > 0.05 OR (width::DOUBLE / height > 1.15 AND NOT (item_id % 10) / 10.0::DOUBLE < 0.5) THEN 'letterbox' ELSE 'crop' END AS mode FROM items")
def slide_mode(spark, d):
    cut, subject = F.col("item_id") % 20 / 100.0, F.col("item_id") % 10 / 10.0
    wide = (F.col("width") / F.col("height") > 1.15) & ~(subject < 0.5)
    return items(spark, d).select("item_id", F.when((cut > 0.05) | wide, "letterbox").otherwise("crop").alias("mode"))


@query("SELECT source, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, count(*) AS total FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING count(*) FILTER (l.doc_id IS NOT NULL) <= 0.5 * count(*)")
def labels_admissible(spark, d):
    """Lists that count as labels: those of half of their source at most. Where all of it was chosen there is no choice."""
    met = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.groupBy("source").agg(F.count("quality").alias("labelled"), F.count(F.lit(1)).alias("total")).filter(F.col("labelled") <= 0.5 * F.col("total"))


@query("SELECT user_id, coalesce(max(taken) FILTER (event_type = 'signup') >= max(taken) FILTER (event_type = 'error'), max(taken) FILTER (event_type = 'error') IS NULL) AS fresh FROM items GROUP BY user_id")
def labels_fresh(spark, d):
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("taken")))
    return items(spark, d).groupBy("user_id").agg(F.coalesce(last("signup") >= last("error"), last("error").isNull()).alias("fresh"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 9 = 0 THEN 10000 ELSE c_custkey % 100 END, '_' || c_name) AS place FROM customer")
def natural_order(spark, d):
    number = F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise((F.col("c_custkey") % 100).cast("string"))
    rows = table(spark, d, "customer").withColumn("name", F.concat(number, F.lit("_"), F.col("c_name")))
    return rows.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*tables.slide_order("name"))).cast("long").alias("place"))


@query("SELECT p_brand, round(corr(p_size, p_retailprice), 5) AS r FROM part GROUP BY p_brand")
def pearson(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 5).alias("r"))


@query("WITH t AS (SELECT album, faces, k, score FROM items QUALIFY row_number() OVER (PARTITION BY album ORDER BY score DESC, item_id) <= 5) SELECT album, round(sum(score * faces) / sum(score), 6) AS cx, round(sum(score * k) / sum(score), 6) AS cy FROM t GROUP BY album")
def weighted_centroid(spark, d):
    top = select.top_n(items(spark, d), ["album"], [F.desc("score"), "item_id"], 5)
    middle = lambda c: F.round(F.sum(F.col("score") * F.col(c)) / F.sum("score"), 6)
    return top.groupBy("album").agg(middle("faces").alias("cx"), middle("k").alias("cy"))


@query("WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(n, 0) AS orders, n IS NOT NULL AS has_orders, last, n_name FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def catalogue_row(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    met = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.col("n").isNotNull().alias("has_orders"), "last", "n_name")


@query("SELECT p_brand, count(DISTINCT lower(p_name)) AS files FROM part GROUP BY p_brand")
def distinct_files(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct(F.lower("p_name")).alias("files"))


@query("SELECT a.vec_id, count(DISTINCT b.label) AS identities FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 GROUP BY a.vec_id")
def identity_match(spark, d):
    """How many identities each vector is like, against all others."""
    return joins.owners_within(*sides(spark, d), 0.2).select(F.col("q_id").alias("vec_id"), F.col("owners").alias("identities"))


@query()
def identity_groups(spark, d):
    """Identities among the references of each owner, an owner having twenty."""
    v = vectors(spark, d).select("vec_id", F.floor(F.col("vec_id") / 20).alias("owner"), "embedding")
    return joins.identities(v, "owner", "vec_id", "embedding", 0.2)


@query("""WITH g AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings), c AS (SELECT label, i, avg(e) AS c FROM g GROUP BY ALL),
r AS (SELECT vec_id, g.i, round(abs(e - c), 6) AS gap FROM g JOIN c ON g.label = c.label AND g.i = c.i) SELECT vec_id, i::INT AS feature, gap FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gap DESC, i) <= 4""")
def style_explain(spark, d):
    g = vectors(spark, d).select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    c = g.groupBy("label", "i").agg(F.avg("e").alias("c"))
    gaps = g.join(c, ["label", "i"]).select("vec_id", F.col("i").alias("feature"), F.round(F.abs(F.col("e") - F.col("c")), 6).alias("gap"))
    return select.top_n(gaps, ["vec_id"], [F.desc("gap"), "feature"], 4).drop("rank")


@query("WITH b AS (SELECT p_partkey AS pos, p_name AS name FROM part WHERE p_partkey < 40), a AS (SELECT p_partkey - 39 AS pos, p_name AS name FROM part WHERE p_partkey >= 40), f AS (SELECT * FROM a WHERE lower(name) NOT IN (SELECT lower(name) FROM b) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY pos) = 1) SELECT pos, name FROM b UNION ALL SELECT pos + (SELECT max(pos) FROM b), name FROM f")
def list_merge(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    base = p.filter("p_partkey < 40").select(F.col("p_partkey").alias("pos"), "name")
    added = p.filter("p_partkey >= 40").select((F.col("p_partkey") - 39).alias("pos"), "name")
    return joins.merge_ordered(base, added, F.lower("name"))


@query("SELECT o_orderkey, 'keep' AS action FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 7 > 0 UNION ALL SELECT o_orderkey, 'compute' FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0")
def incremental_build(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rel"), F.col("o_totalprice").alias("mtime"), F.col("o_custkey").alias("size"))
    known = o.filter("rel % 11 > 0").withColumn("mtime", F.when(F.col("rel") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    kept, todo = tables.split_changed(o, known)
    return kept.select(F.col("rel").alias("o_orderkey"), F.lit("keep").alias("action")).unionByName(todo.select(F.col("rel").alias("o_orderkey"), F.lit("compute").alias("action")))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def cache_missing(spark, d):
    v = vectors(spark, d).select("vec_id")
    return tables.missing_rows(v, v.filter("vec_id % 3 = 0"), "vec_id")


@query("SELECT vec_id, label, false AS fresh FROM embeddings WHERE vec_id % 2 = 0 AND label NOT IN (2, 5) UNION ALL SELECT vec_id, label, true FROM embeddings WHERE vec_id % 2 = 1 AND label IN (2, 5)")
def reference_upsert(spark, d):
    v = vectors(spark, d).select("vec_id", "label")
    old = v.filter("vec_id % 2 = 0").withColumn("fresh", F.lit(False))
    return tables.upsert(old, v.filter("vec_id % 2 = 1 and label in (2, 5)").withColumn("fresh", F.lit(True)), "label")


@query("SELECT p_partkey AS pos, p_name || '_' || p_partkey AS name, p_size % 2 = 0 AS solo, CASE WHEN p_size % 3 = 0 THEN 'g' || p_size END AS grp, CASE WHEN p_size % 5 = 0 THEN 'grid' END AS template FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS p_name, p_size FROM part)")
def chosen_list(spark, d):
    size = F.col("p_size")
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(size % 2 == 0, " solo").otherwise(""), F.when(size % 3 == 0, F.concat(F.lit(" group=g"), size.cast("string"))).otherwise(""), F.when(size % 5 == 0, " template=grid").otherwise(""), F.lit("  # note"))
    return tables.parse_list(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), line.alias("line")))[0]


@query("SELECT p_partkey AS pos, p_size AS slide, p_brand AS what, false AS error FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, NULL, NULL, true FROM part WHERE p_partkey % 5 = 0")
def change_list(spark, d):
    line = F.when(F.col("p_partkey") % 5 > 0, F.concat_ws(" ", "p_size", "p_brand")).otherwise(F.concat(F.lit("bad "), F.col("p_name"), F.lit(" x")))
    line = F.replace(line, F.lit("#"), F.lit("@"))
    good, bad = tables.parse_changes(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), line.alias("line")))
    good = good.select("pos", "slide", F.replace("what", F.lit("@"), F.lit("#")).alias("what"), F.lit(False).alias("error"))
    return good.unionByName(bad.select("pos", F.lit(None).cast("int").alias("slide"), F.lit(None).cast("string").alias("what"), F.lit(True).alias("error")))


@query("SELECT album, item_id FROM items QUALIFY row_number() OVER (PARTITION BY album ORDER BY score DESC, taken, item_id) <= 120")
def capacity_trim(spark, d):
    """Drops the lowest until an album's slides can hold it."""
    return select.top_n(items(spark, d), ["album"], [F.desc("score"), "taken", "item_id"], 20 * pack.MOST).select("album", "item_id")


@query(f"WITH {CHAPTERED_SQL}, m AS (SELECT chapter, max_by(item_id, (score, -item_id)) AS hero, min_by(item_id, (score, item_id)) AS worst, album FROM chaptered GROUP BY ALL) SELECT album, chapter, hero, worst FROM m")
def hero_and_worst(spark, d):
    return chaptered(spark, d).groupBy("album", "chapter").agg(F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("hero"), F.min_by("item_id", F.struct("score", "item_id")).alias("worst"))


@query("WITH published AS (SELECT * FROM items WHERE item_id % 17 = 0), chosen AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY album, kind ORDER BY score DESC, taken, item_id) <= 2) SELECT item_id, 'label' AS source FROM published UNION SELECT c.item_id, 'chosen' FROM chosen c WHERE c.album IN (SELECT album FROM published)")
def label_sources(spark, d):
    """Chosen items extend the labels of albums that have labels, and no others."""
    p = published(spark, d).select("item_id", "album")
    extra = chosen(spark, d).select("item_id", "album").join(p.select("album").distinct(), "album", "left_semi")
    return p.select("item_id", F.lit("label").alias("source")).union(extra.select("item_id", F.lit("chosen").alias("source"))).distinct()


@query("WITH a AS (SELECT album, avg(score) AS a, count(*) FILTER (item_id % 17 = 0) AS w FROM items GROUP BY album) SELECT round(sum(a * w) / sum(w), 6) AS weighted FROM a")
def weighted_mean(spark, d):
    a = items(spark, d).groupBy("album").agg(F.avg("score").alias("a"), F.count_if(F.col("item_id") % 17 == 0).alias("w"))
    return a.agg(F.round(F.sum(F.col("a") * F.col("w")) / F.sum("w"), 6).alias("weighted"))


def keep_apart(boxes: pd.DataFrame, share: float = 0.5) -> list[int]:
    """Best first, positions of boxes (x, y, w, h, score) of which at most `share` lies in a kept one."""
    kept: list[int] = []
    order = boxes["score"].to_numpy().argsort(kind="stable")[::-1]
    x0, y0, w, h = (boxes[c].to_numpy(float) for c in ("x", "y", "w", "h"))
    for i in order:
        cut = [max(0.0, min(x0[i] + w[i], x0[k] + w[k]) - max(x0[i], x0[k])) * max(0.0, min(y0[i] + h[i], y0[k] + h[k]) - max(y0[i], y0[k])) for k in kept]
        if all(c <= share * w[i] * h[i] for c in cut):
            kept.append(int(i))
    return kept


@query()
def overlap_suppression(spark, d):
    """Of the places matched on each slide those that better ones don't cover."""
    i = F.col("item_id")
    boxes = items(spark, d).select("album", "item_id", (i * 7 % 90).cast("double").alias("x"), (i * 13 % 90).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"), "score")

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id").reset_index(drop=True)
        return rows.iloc[keep_apart(rows)][["album", "item_id"]]

    return boxes.groupBy("album").applyInPandas(keep, "album date, item_id long")


@query()
def selection_document(spark, d):
    """One nested JSON document for each album: its slides in order, and spares."""
    slides = select.slide_order(chosen(spark, d), "album")
    rows = slides.groupBy("album").agg(F.array_sort(F.collect_list(F.struct("slide", "item_id", "kind", "score"))).alias("slides"))
    return rows.select("album", F.to_json(F.struct("album", F.size("slides").alias("n"), "slides")).alias("document"))


@query("SELECT item_id, (item_id * 7 % 100) / 1000.0::DOUBLE < 0.06 AS grey FROM items")
def grey(spark, d):
    return items(spark, d).select("item_id", x.is_grey(F.col("item_id") * 7 % 100 / 1000.0).alias("grey"))


@query("SELECT p_partkey, CAST(nullif(regexp_extract(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_name || p_size || '_' || p_partkey || 'x' END, '(\\d+)\\D*$', 1), '') AS BIGINT) AS number FROM part")
def last_number(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", size, F.lit("_"), key, F.lit("x")))
    return table(spark, d, "part").select("p_partkey", x.last_number(name).alias("number"))


@query("SELECT item_id FROM items WHERE item_id % 3 = 0 EXCEPT SELECT item_id FROM items WHERE item_id % 5 = 0")
def marks_removed(spark, d):
    """Solo marks less those of items that a group holds."""
    i = items(spark, d)
    return i.filter("item_id % 3 = 0").select("item_id").subtract(i.filter("item_id % 5 = 0").select("item_id"))


@query("SELECT album, CAST(floor(k / 10.0) AS INT) AS tx, CAST(floor(value / 10) AS INT) AS ty, count(*) AS n, round(max(score) - min(score), 6) AS spread, round(median(score), 6) AS middle FROM items GROUP BY ALL")
def tile_grid(spark, d):
    """Statistics of the cells of a grid."""
    cells = items(spark, d).groupBy("album", F.floor(F.col("k") / 10.0).cast("int").alias("tx"), F.floor(F.col("value") / 10).cast("int").alias("ty"))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.round(F.median("score"), 6).alias("middle"))


@query("WITH trained AS (SELECT DISTINCT label FROM embeddings WHERE vec_id % 50 = 0) SELECT vec_id, CASE WHEN label IN (SELECT label FROM trained) THEN 'likeness' ELSE 'model' END AS scorer FROM embeddings")
def self_label_guard(spark, d):
    """An album that a model has learned from is scored by likeness to the others instead."""
    v = vectors(spark, d).select("vec_id", "label")
    trained = v.filter("vec_id % 50 = 0").select("label", F.lit(True).alias("_t")).distinct()
    return v.join(trained, "label", "left").select("vec_id", F.when(F.col("_t"), "likeness").otherwise("model").alias("scorer"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_retailprice ELSE p_size::DOUBLE END AS taken, p_size % 4 <> 0 AS from_exif, CASE WHEN p_size % 8 >= 4 THEN 4000 ELSE 6000 END AS width, CASE WHEN p_size % 8 >= 4 THEN 6000 ELSE 4000 END AS height FROM part")
def ingest_row(spark, d):
    """Time of a file from its metadata, else its change; a rotation of 90 or 270 degrees swaps the sides."""
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.when(size % 4 != 0, size.cast("double")).alias("exif"), F.col("p_retailprice").alias("mtime"), (size % 8 + 1).alias("orientation"), F.lit(6000).alias("w"), F.lit(4000).alias("h"))
    return tables.ingest(rows, "exif", "mtime", "orientation", "w", "h").select("p_partkey", "taken", "from_exif", "width", "height")
