"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table that is broadcast, and those of a row of a few numbers and digests.
BROADCAST_BYTES, ROW_BYTES = 20_000_000, "100"
#: Bytes of texts, about, and setting by which Arrow sends rows to Python at once.
BATCH_BYTES, BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one on one machine (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-bagframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bagframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: later jobs start from its files, not from its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside send texts to Python a few MB at a time, which bounds what executors and workers hold of them."""
    set_before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, set_before)


def sized(table: DataFrame, row_bytes: str = ROW_BYTES) -> DataFrame:
    """A written table, to be broadcast if its rows, of `row_bytes` (SQL) each, are few bytes in all; otherwise joins shuffle."""
    size = table.agg(F.sum(F.expr(row_bytes)).alias("size")).first()["size"]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table
