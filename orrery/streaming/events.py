"""Streaming forms of the batch operators; extensions, since the batch engine they follow has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def session_bursts(events: DataFrame, gap: str = "120 seconds", late: str = "10 minutes", by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of events at most `gap` apart per key, closed by the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best")).select(by, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n", "best")


def corrections(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """New lines of a correction log; lines that don't parse are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cache_new(stream: DataFrame, target: str, checkpoint: str, key: str = "key"):
    """Appends the rows whose key the target table lacks, once each batch."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
