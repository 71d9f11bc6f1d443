"""Readers, writers and the binding of the item model to the tables at hand."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

EXTENSIONS = ["jpg", "jpeg", "png", "tif", "tiff", "webp", "heic"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored items: an album is a day; kind, faces, frame and hash come from the event's own fields."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'detail' WHEN 'click' THEN 'portrait' WHEN 'signup' THEN 'couple' WHEN 'purchase' THEN 'group' ELSE 'far' END")
    upright = F.col("event_id") % 5 < 2
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("album"), F.col("event_id").alias("item_id"), F.col("ts").alias("taken"), "user_id", "event_type", "value",
        k.alias("k"), kind.alias("kind"), (k % 5).alias("faces"), (F.round(F.col("value") * 100).cast("long") % 10000 / 10000.0).alias("score"),
        F.when(upright, 4000).otherwise(6000).alias("width"), F.when(upright, 6000).otherwise(4000).alias("height"), (F.col("event_id") * 2654435761 % 4294967296).alias("hash"),
    )


#: The same for the SQL side.
ITEMS_SQL = """items AS (
  SELECT CAST(ts AS DATE) AS album, event_id AS item_id, ts AS taken, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE event_type WHEN 'view' THEN 'detail' WHEN 'click' THEN 'portrait' WHEN 'signup' THEN 'couple' WHEN 'purchase' THEN 'group' ELSE 'far' END AS kind,
    CAST(json_extract_string(props, '$.k') AS INT) % 5 AS faces, CAST(round(value * 100) AS BIGINT) % 10000 / 10000.0::DOUBLE AS score,
    CASE WHEN event_id % 5 < 2 THEN 4000 ELSE 6000 END AS width, CASE WHEN event_id % 5 < 2 THEN 6000 ELSE 4000 END AS height,
    event_id * 2654435761 % 4294967296 AS hash
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def scan_files(spark: SparkSession, path: str, extensions: list[str] | None = None, reserved: list[str] | None = None) -> DataFrame:
    """Files below a folder by extension, none below a reserved folder; contents are read only where they are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split(F.lower("path"), "/")
    keep = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(extensions or EXTENSIONS)
    if reserved:
        keep = keep & ~F.arrays_overlap(parts, F.array(*(F.lit(r.lower()) for r in reserved)))
    return files.filter(keep)


def ingest(rows: DataFrame, exif: str, mtime: str, orientation: str, width: str, height: str) -> DataFrame:
    """taken (from metadata, else the time of change), from_exif, and width and height as shown: orientations 5 to 8 lie on
    their side."""
    side = F.coalesce(F.col(orientation) >= 5, F.lit(False))
    w, h = F.col(width), F.col(height)
    return rows.withColumns({"taken": F.coalesce(exif, mtime), "from_exif": F.col(exif).isNotNull(), "width": F.when(side, h).otherwise(w), "height": F.when(side, w).otherwise(h)})


def stable_key(rel: Column) -> Column:
    """64-bit key of a relative path, as hexadecimal text."""
    return F.substring(F.sha2(rel.cast("binary"), 256), 1, 16)


def read_index(spark: SparkSession, path: str, version: int, schema: T.StructType) -> DataFrame:
    """An index whose version column differs is ignored, never migrated; a missing one is empty."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version}") if _has(spark, f"{path}/version={version}") else spark.createDataFrame([], schema)


def _has(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_index(df: DataFrame, path: str, version: int, keep: bool = False) -> None:
    """Replaces the index of a version. keep: what was there stays as <path>/before, in place of what was there."""
    spark, where = df.sparkSession, f"{path}/version={version}"
    jvm = spark._jvm
    new, old, now = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/_new", f"{path}/before", where))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}/_new")  # whole before anything is replaced; df may read the old one
    if fs.exists(now):
        if keep:
            fs.delete(old, True)
            fs.rename(now, old)
        else:
            fs.delete(now, True)
    fs.rename(new, now)


def save_model(spark: SparkSession, path: str, version: int, **parameters: object) -> None:
    """A model's parameters (numbers, lists, names) as one JSON text with its version."""
    text = json.dumps({"version": version, **parameters}, sort_keys=True)
    write_index(spark.createDataFrame([(text,)], "model string"), path, version, keep=True)


def load_model(spark: SparkSession, path: str, version: int) -> dict | None:
    """None where there is no model or one of another version: it must be trained anew."""
    rows = read_index(spark, path, version, T.StructType([T.StructField("model", T.StringType())])).collect()
    model = json.loads(rows[0]["model"]) if rows else None
    return model if model and model.pop("version") == version else None


def split_changed(found: DataFrame, known: DataFrame, key: str = "rel") -> tuple[DataFrame, DataFrame]:
    """Incremental build: (rows of known that are still right, rows of found to compute), by size and time of change."""
    old = known.select(F.col(key).alias("_key"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    same = (F.col(key) == F.col("_key")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    now = found.select(F.col(key).alias("_key"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    return known.join(now, same, "left_semi"), found.join(old, same, "left_anti")


def missing_rows(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """What a cache doesn't hold yet."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, by: str = "album") -> DataFrame:
    """All rows of new, and those of old whose partition new doesn't have."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A log of JSON lines; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_unsigned_hash(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows whose hash may reach 2^64: read as decimal, kept as the long of the same bits."""
    from orrery.functions.exprs import unsigned_to_signed

    df = spark.read.schema(schema).json(path)
    return df.withColumn("hash", unsigned_to_signed(F.col("hash")))


def parse_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen-list grammar over (pos, line): `# comment`, `@slides n|auto`, `name [solo] [group=g] [template=t]`.
    Returns (pos, name, solo, grp, template), the first of names equal but for case, and the slide settings."""
    text = F.trim(F.regexp_replace("line", r"#.*$", ""))
    rows = lines.select("pos", text.alias("text")).filter("text <> ''")
    settings = rows.filter(F.col("text").rlike(r"(?i)^@slides\s+")).select("pos", F.lower(F.regexp_extract("text", r"(?i)^@slides\s+(\S+)", 1)).alias("slides"))
    words = F.split("text", r"\s+")
    mark = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    names = rows.filter(~F.col("text").startswith("@")).select("pos", F.get(words, F.lit(0)).alias("name"), F.array_contains(F.transform(words, F.lower), "solo").alias("solo"), mark(r"(?i)\sgroup=(\S+)").alias("grp"), mark(r"(?i)\stemplate=(\S+)").alias("template"))
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("pos"))
    return names.withColumn("_r", first).filter("_r = 1").drop("_r"), settings


def parse_changes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change commands over (pos, line), strictly `slide what`: (pos, slide, what) and the lines in error."""
    text = F.trim(F.regexp_replace("line", r"#.*$", ""))
    rows = lines.select("pos", text.alias("text")).filter("text <> ''")
    good = F.col("text").rlike(r"^[0-9]+\s+\S+$")
    return rows.filter(good).select("pos", F.split("text", r"\s+")[0].cast("int").alias("slide"), F.split("text", r"\s+")[1].alias("what")), rows.filter(~good)


def slide_order(name: str = "name") -> list[Column]:
    """Natural order: leading number, then the rest; names without one last."""
    return [F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(10_000)), F.regexp_extract(name, r"^\d*(.*)$", 1)]
