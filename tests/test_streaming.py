from pyspark.sql import functions as F

from tessella.streaming.incidence import event_stream, windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = windowed_counts(event_stream(spark, "/root/testdata/sf0.001"), "1 day")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    got = spark.table("counted").select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
