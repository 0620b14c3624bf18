from conftest import SMALL
from pyspark.sql import functions as F

from gleaner.streaming.activity import windowed_health


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_health(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"))
    want = sorted((r["window"].start, r.calls, r.failures) for r in batch.collect())
    assert sorted((r.start, r.calls, r.failures) for r in spark.table("health").collect()) == want
