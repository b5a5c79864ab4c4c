"""The given tables as bags, slides, predictions and epochs."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    """bag_id, idx, feat, score, label: bags of twenty, so their number grows with the table."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 20 as bag_id", "vec_id % 20 as idx", "embedding as feat", "cast(embedding[0] as double) as score", "label")


def scores(spark, sf_dir) -> DataFrame:
    """bag_id, idx, score, x, y: the lines of orders."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w) - 1)
    return lines.selectExpr("l_orderkey as bag_id", "cast(idx as bigint) as idx", "cast(l_extendedprice as double) as score", "cast(l_partkey as bigint) as x", "cast(l_suppkey as bigint) as y")


def slides(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as slide_id", "o_custkey as case_id", "o_orderstatus as label")


def predictions(spark, sf_dir) -> DataFrame:
    """doc_id, y, p1, yhat of the labels."""
    p = table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(quality as int) as y", "cast((doc_id * 37) % 11 as double) / 10 as p1")
    return p.withColumn("yhat", (F.col("p1") > 0.5).cast("int"))


def epochs(spark, sf_dir) -> DataFrame:
    """run, epoch, value: the events of users."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.col("value").cast("double").alias("value"))


def contours(spark, sf_dir) -> DataFrame:
    """slide_id, cont_id, parent_id, poly: a diamond for each supplier, on its nation's slide, with a hole of half the radius for even keys."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as slide_id", "s_suppkey * 2 as cont_id", "s_suppkey * 2000 + 1000 as cx", "500 + s_nationkey * 20 as r", "s_suppkey % 2 = 0 as holed")
    kinds = F.expr("if(holed, array(0, 1), array(0))")
    s = s.withColumn("hole", F.explode(kinds)).withColumn("r", F.expr("if(hole = 1, r div 2, r)"))
    poly = F.expr("array(struct(cx - r as x, 1000L as y), struct(cx as x, 1000L - r as y), struct(cx + r as x, 1000L as y), struct(cx as x, 1000L + r as y))")
    return s.select("slide_id", (F.col("cont_id") + F.col("hole")).alias("cont_id"), F.expr("if(hole = 1, cont_id, -1L)").alias("parent_id"), poly.alias("poly"))
