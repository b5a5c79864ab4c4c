"""Streams give what the same functions give on the whole table."""

from pyspark.sql import functions as F

from bagframe.plans.further import stream_rows
from bagframe.streaming import running

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, job, mode, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, job(events).collect()))


def test_class_accuracy(spark, tmp_path):
    def job(df):
        rows = stream_rows(df).withColumn("ts", F.col("ts").cast("timestamp"))
        return running.class_accuracy(rows, "1 hour", "1000 days").select("window.start", "y", "n", "ok")

    got, wanted = streamed(spark, tmp_path, job, "complete", "accuracy")
    assert got == wanted and got


def test_weighted_mean(spark, tmp_path):
    def job(df):
        rows = df.select("event_type", F.round("value").alias("value"), (F.col("user_id") % 7 + 1).alias("n"))
        return running.weighted_mean(rows, "event_type")

    got, wanted = streamed(spark, tmp_path, job, "complete", "means")
    assert got == wanted and got
