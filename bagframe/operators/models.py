"""Classifiers of pooled bags with MLlib: fitted on a role, cross-validated on given folds, saved, loaded and reported; and a map of bags in the plane."""

import math
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import elementwise, vec_dot
from . import metrics, pooling, select


class BagPool(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Instances (bag_id, feat, with score for softmax) to bags: bag_id, features (a vector) and the columns of `keep`, the same on all rows of a bag."""

    dim = Param(Params._dummy(), "dim", "numbers of a feature", TypeConverters.toInt)
    how = Param(Params._dummy(), "how", "mean, max or softmax", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns of bags that stay", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, dim: int = 1, how: str = "mean", keep: list[str] | None = None):
        super().__init__()
        self._setDefault(how="mean", keep=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dim, how = self.getOrDefault(self.dim), self.getOrDefault(self.how)
        keep = [c for c in self.getOrDefault(self.keep) if c in dataset.columns]  # a label may be unknown when scores are asked for
        kept = [F.first(c).alias(c) for c in keep]
        if how != "softmax":
            pooled = dataset.groupBy("bag_id").agg(elementwise(F.avg if how == "mean" else F.max, "feat", dim).alias("feat"), *kept)
            return pooled.select("bag_id", array_to_vector("feat").alias("features"), *keep)
        bags = pooling.softmax_pool(dataset, dim).select("bag_id", array_to_vector("feat").alias("features"))
        return bags.join(dataset.groupBy("bag_id").agg(*kept), "bag_id") if keep else bags


def classifier(reg: float = 0.01, iterations: int = 50) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=reg, maxIter=iterations, standardization=False, tol=1e-7)


def fit_bag_classifier(inst: DataFrame, bags: DataFrame, dim: int, how: str = "mean", reg: float = 0.01) -> PipelineModel:
    """A pipeline of pooling and logistic regression, fitted on the bags (bag_id, y, role) of the role train; y counts from 0. Bags without label go."""
    train = inst.join(bags.filter("role = 'train' and y is not null").select("bag_id", F.col("y").cast("double").alias("y")), "bag_id")
    return Pipeline(stages=[BagPool(dim=dim, how=how, keep=["y"]), classifier(reg)]).fit(train)


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline to a folder that all executors share; one that is there is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _predictions(scored: DataFrame, *more: str) -> DataFrame:
    return scored.select("bag_id", vector_to_array("probability").alias("probs"), F.col("prediction").cast("int").alias("yhat"), *more)


def test_report(model: PipelineModel, inst: DataFrame, bags: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(predictions, metrics): bag_id, probs, yhat (and y) of each bag; with labels (bag_id, y) also the row of metrics.evaluate_all."""
    if bags is None:
        return _predictions(model.transform(inst)), None
    known = bags.filter("y is not null").select("bag_id", F.col("y").cast("double").alias("y"))
    preds = _predictions(model.transform(inst.join(known, "bag_id")), F.col("y").cast("int").alias("y"))
    return preds, metrics.evaluate_all(preds, model.stages[-1].numClasses)


test_report.__test__ = False  # not a test of pytest's


def long_metrics(row: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value) of the numbers of a row of evaluate_all."""
    names = [c for c, kind in row.dtypes if kind == "double" and c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]))
    return row.select(*keys, pairs.alias("m")).select(*keys, "m.metric", "m.value")


#: Numbers of the features in a partition that models are fitted on (8 MB): each of a fit's fifty passes is a job, with no more tasks than the bags need.
NUMBERS = 1 << 20


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, where Spark has a checkpoint folder, so that plans which hold it many times stay small in the driver; elsewhere df itself."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def cv_bag_classifier(inst: DataFrame, folds: DataFrame, k: int, dim: int, how: str = "mean", regs: tuple[float, ...] = (0.001, 0.01, 0.1)) -> tuple[DataFrame, DataFrame, float]:
    """(fold metrics, their mean and deviation, regularisation chosen) over the folds of (bag_id, y, fold): each fold is scored by the model of the others.

    Bags are pooled once; CrossValidator fits on the given fold column and keeps every fold's model. All folds are scored together. Every fold must have bags.
    """
    known = folds.filter("y is not null").select("bag_id", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"))
    pooled = BagPool(dim=dim, how=how, keep=["y", "fold"]).transform(inst.join(known, "bag_id")).persist()
    try:
        model = classifier()
        grid = ParamGridBuilder().addGrid(model.regParam, list(regs)).build()
        loss = MulticlassClassificationEvaluator(labelCol="y", metricName="logLoss")
        validator = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=loss, numFolds=k, foldCol="fold", collectSubModels=True, parallelism=4)
        few = _cut(pooled.coalesce(math.ceil(pooled.count() * dim / NUMBERS) or 1))
        fitted = validator.fit(few)
        best = min(range(len(regs)), key=lambda i: fitted.avgMetrics[i])
        own = [fitted.subModels[fold][best] for fold in range(k)]
        scored = [_predictions(m.transform(few.filter(F.col("fold") == fold)), F.col("y").cast("int").alias("y"), "fold") for fold, m in enumerate(own)]
        kept = reduce(DataFrame.unionByName, scored).persist()
        preds = _cut(kept)  # read by each metric
        rows = []
        for classes in sorted({m.numClasses for m in own}):
            alike = preds.filter(F.col("fold").isin([fold for fold, m in enumerate(own) if m.numClasses == classes]))
            for row in metrics.evaluate_all(alike, classes, "fold").collect():
                rows += [(row["fold"], name, value) for name, value in row.asDict().items() if name not in ("fold", "confusion")]
        kept.unpersist()
        each = inst.sparkSession.createDataFrame(rows, "fold int, metric string, value double")
    finally:
        pooled.unpersist()
    return each, select.kfold_merge(each), regs[best]


def bag_feature_map(bags: DataFrame, dim: int, k: int = 2) -> DataFrame:
    """bags (bag_id, feat and more) with pc1 to pck: the centred feat along the principal components. The covariance is summed up over the tasks; a component
    points where its largest loading (the first of equal ones) is positive."""
    vectors = bags.withColumn("__v", array_to_vector(F.transform("feat", lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v").fit(vectors)
    mean = bags.agg(elementwise(F.avg, "feat", dim).alias("__mean"))
    out = bags.crossJoin(F.broadcast(mean))  # one row
    for i, axis in enumerate(model.pc.toArray().T):
        top = abs(axis).round(9).argmax()
        axis = F.array(*[F.lit(float(x)) for x in (axis if axis[top] > 0 else -axis)])
        out = out.withColumn(f"pc{i + 1}", vec_dot(F.zip_with("feat", "__mean", lambda x, m: x.cast("double") - m), axis))
    return out.drop("__mean")
