"""Running counts and means; each works on a table and on a stream alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_accuracy(preds: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, y, n, ok): rows and right ones of each class by tumbling window of ts; rows later than `late` are not waited for in a stream."""
    ok = F.sum((F.col("y") == F.col("yhat")).cast("long")).alias("ok")
    return preds.withWatermark("ts", late).groupBy(F.window("ts", width), "y").agg(F.count("*").alias("n"), ok)


def weighted_mean(rows: DataFrame, key: str) -> DataFrame:
    """(key, mean): the running sum of value * n over that of n; for a stream in update or complete mode."""
    return rows.groupBy(key).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
