from pyspark.sql import functions as F

from linklake.streaming import links


def test_streams_follow_the_batch_expressions(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://a.com/?utm_id=1", "Sync ", "2024-01-01 00:10:00"), (2, "https://a.com", "sync", "2024-01-01 00:20:00"), (3, "https://b.com", None, "2024-01-01 02:00:00")], "id int, url string, source string, at string").withColumn("loaded_at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("seen", links.first_seen(stream)), ("arrived", links.arrivals(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").select("norm").distinct().count() == 2 and spark.table("seen").count() == 2
    assert sorted(r["n"] for r in spark.table("arrived").collect()) == [1, 2]
