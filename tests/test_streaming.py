from pyspark.sql import functions as F

from orrery.streaming import events


def test_sessions_and_cache(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    folder = tmp_path / "in"
    folder.mkdir()
    spark.read.parquet(src).write.mode("overwrite").parquet(str(folder / "e"))
    stream = spark.readStream.schema(schema).parquet(str(folder / "e"))
    q = events.session_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = spark.sql("SELECT sum(n) AS n FROM bursts").first().n
    assert 0 < total <= spark.read.parquet(src).count()
    for _ in range(2):
        rows = spark.readStream.schema(schema).parquet(str(folder / "e")).select(F.col("user_id").alias("key"))
        events.cache_new(rows, f"file://{tmp_path}/cache", f"file://{tmp_path}/ck{_}").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == spark.read.parquet(src).select("user_id").distinct().count()
