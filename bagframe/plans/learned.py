"""Queries of fitted models. SQL cannot fit one: tests compare them with plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_order
from ..operators import models, pooling
from ..sources import tables as T
from .catalogue import DIM, QUERIES, rounded

FOLDS = 5


def labelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Instances in bags of one label, and (bag_id, y, fold, role): folds by the bag's hash, fold 0 is the test."""
    inst = T.table(spark, sf, "embeddings").selectExpr("cast(label as bigint) * 1000000 + vec_id div 100 as bag_id", "vec_id as idx", "embedding as feat", "cast(embedding[0] as double) as score", "cast(label as int) as y")
    bags = inst.groupBy("bag_id").agg(F.first("y").alias("y")).withColumn("fold", F.pmod(F.conv(F.substring(hash_order(3, "bag_id"), 1, 6), 16, 10).cast("int"), F.lit(FOLDS)))
    return inst.drop("y"), bags.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))


def fit_bag_classifier(spark, sf) -> DataFrame:
    """Metrics of the test bags by the model of the training bags."""
    inst, bags = labelled(spark, sf)
    model = models.fit_bag_classifier(inst, bags, DIM)
    return models.long_metrics(models.test_report(model, inst, bags.filter("role = 'test'"))[1])


def report_without_labels(spark, sf) -> DataFrame:
    """Predictions of all bags, softmax-pooled, labels unknown."""
    inst, bags = labelled(spark, sf)
    model = models.fit_bag_classifier(inst, bags, DIM, "softmax")
    return models.test_report(model, inst)[0]


def cv_bag_classifier(spark, sf) -> DataFrame:
    """Mean and deviation of every metric over the folds."""
    inst, bags = labelled(spark, sf)
    return models.cv_bag_classifier(inst, bags, FOLDS, DIM, regs=(0.01, 0.1))[1]


def bag_feature_map(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf)
    label = pooling.patient_label(inst.selectExpr("bag_id as case_id", "label")).selectExpr("case_id as bag_id", "cast(label as int) as label")
    out = models.bag_feature_map(pooling.mean_pool(inst, DIM), DIM).join(label, "bag_id")
    return rounded(out.select("bag_id", "label", "pc1", "pc2"), "pc1", "pc2")


QUERIES.update({f.__name__: f for f in (fit_bag_classifier, report_without_labels, cv_bag_classifier, bag_feature_map)})
