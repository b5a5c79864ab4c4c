"""Seeded order and uniform numbers that any SQL engine can repeat: both come from md5('seed:id')."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *ids) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_uniform(seed: int, *ids) -> Column:
    """In [0, 1)."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def placed(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "r") -> DataFrame:
    """Adds each row's place (from 1) in the order within its keys. `bucket` must rise with the order: rows are numbered within buckets and moved by the
    sizes of those before, so no task holds all rows of a key. Rows with a null key are left out."""
    dealt = df.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    first = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return inside.join(first, [*keys, "__b"]).withColumn(name, F.col("__first") + F.col("__r")).drop("__b", "__r", "__first")


def hash_placed(df: DataFrame, keys: list[str], seed: int, *ids: str, name: str = "r") -> DataFrame:
    """placed() in the order of hash_order, dealt by its first three digits."""
    h = hash_order(seed, *ids)
    return placed(df, keys, F.substring(h, 1, 3), [h, *ids[-1:]], name)
