"""Bags from instances: pooling and statistics. Instances have bag_id, idx, and feat (array) or score."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import elementwise


def _bag(*more):
    return Window.partitionBy("bag_id", *more)


def with_softmax(inst: DataFrame, score: str = "score", temp: float = 1.0) -> DataFrame:
    """Adds weight, the softmax of the score within the bag."""
    shifted = (F.col(score) - F.max(score).over(_bag())) / temp
    out = inst.withColumn("__e", F.exp(shifted))
    return out.withColumn("weight", F.col("__e") / F.sum("__e").over(_bag())).drop("__e")


def mean_pool(inst: DataFrame, dim: int) -> DataFrame:
    return inst.groupBy("bag_id").agg(elementwise(F.avg, "feat", dim).alias("feat"))


def max_pool(inst: DataFrame, dim: int) -> DataFrame:
    return inst.groupBy("bag_id").agg(elementwise(F.max, "feat", dim).alias("feat"))


def softmax_pool(inst: DataFrame, dim: int, score: str = "score", temp: float = 1.0) -> DataFrame:
    """The sum of feat weighted by the softmax of the scores."""
    weighted = with_softmax(inst, score, temp)
    return weighted.groupBy("bag_id").agg(elementwise(lambda x: F.sum(x * F.col("weight")), "feat", dim).alias("feat"))


def attention_entropy(inst: DataFrame, score: str = "score") -> DataFrame:
    w = F.col("weight")
    return with_softmax(inst, score).groupBy("bag_id").agg((-F.sum(w * F.log(w + 1e-8))).alias("entropy"))


def top1_instance(inst: DataFrame, score: str = "score") -> DataFrame:
    """The instance with the highest score of each bag; the first of equal ones."""
    return inst.groupBy("bag_id").agg(F.max_by("idx", F.struct(F.col(score), -F.col("idx"))).alias("idx"), F.max(score).alias(score))


def pseudo_bags(inst: DataFrame, g: int, n: int | None = None) -> DataFrame:
    """Contiguous chunks of ceil(n / g) instances; n is each bag's own number, or that of a whole bag, whose chunks shorter bags keep."""
    size = F.ceil(F.count("*").over(_bag()) / g) if n is None else F.lit(-(-n // g))
    return inst.withColumn("chunk", F.floor(F.col("idx") / size))


def two_level_pool(inst: DataFrame, size: int = 512) -> DataFrame:
    """Softmax-weighted mean score of chunks of `size`, then of the chunks' scores."""

    def pool(df: DataFrame, *keys: str) -> DataFrame:
        top = F.max("score").over(Window.partitionBy(*keys))
        e = df.withColumn("e", F.exp(F.col("score") - top))
        return e.groupBy(*keys).agg((F.sum(F.col("e") * F.col("score")) / F.sum("e")).alias("score"))

    return pool(pool(inst.withColumn("chunk", F.floor(F.col("idx") / size)), "bag_id", "chunk"), "bag_id")


def zscore(inst: DataFrame, col: str = "score", by: tuple = ("bag_id",), least: float = 0.0) -> DataFrame:
    """Adds z: standardised within the bag by the population deviation + 1e-8; exactly 0 where all its values are equal, or span `least` or less."""
    w, c = Window.partitionBy(*by), F.col(col)
    scaled = (c - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8)
    return inst.withColumn("z", F.when(F.max(c).over(w) - F.min(c).over(w) <= least, c * 0).otherwise(scaled))


def zscore_feat(inst: DataFrame) -> DataFrame:
    """(bag_id, idx, pos, v, z): each position of feat standardised within the bag."""
    rows = inst.select("bag_id", "idx", F.posexplode("feat").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return zscore(rows, "v", ("bag_id", "pos"))


def global_mix(inst: DataFrame, dim: int) -> DataFrame:
    """feat becomes the mean of itself and the bag's mean."""
    means = mean_pool(inst, dim).withColumnRenamed("feat", "__mean")
    return inst.join(means, "bag_id").withColumn("feat", F.zip_with("feat", "__mean", lambda x, m: (x + m) / 2)).drop("__mean")


def label_summary(slides: DataFrame) -> DataFrame:
    return slides.groupBy("label").agg(F.count("*").alias("slides"), F.countDistinct("case_id").alias("cases"))


def patient_label(slides: DataFrame, how: str = "majority") -> DataFrame:
    """A label for each case: the largest, or the most frequent (the smallest of equally frequent ones)."""
    if how == "max":
        return slides.groupBy("case_id").agg(F.max("label").alias("label"))
    counts = slides.groupBy("case_id", "label").count()
    first = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("count"), "label"))
    return counts.withColumn("r", first).filter("r = 1").select("case_id", "label")


def aggregate_array(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(c).alias("max"), F.min(c).alias("min"), F.sum(c).alias("sum"))


#: Ranges of values that are counted to find a median.
RANGES = 1024


def aggregate_array_median(df: DataFrame, col: str) -> DataFrame:
    """aggregate_array with the exact median: equal values are counted, ranges of values added up, and only the ranges with the middle are put in order.
    Nulls do not count; without values all are null."""
    whole = aggregate_array(df, col).crossJoin(df.agg(F.count(col).alias("__n")))  # one row each
    cells = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ends = cells.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).otherwise(0)
    cells = cells.crossJoin(F.broadcast(ends)).withColumn("b", at)
    sums = cells.groupBy("b").agg(F.sum("c").alias("s"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # RANGES + 1 rows at most
    sums = sums.withColumn("first", F.coalesce(F.sum("s").over(before), F.lit(0)))
    middle = cells.join(F.broadcast(sums), "b").filter("first <= n div 2 and first + s > (n - 1) div 2")
    upto = F.col("first") + F.sum("c").over(Window.partitionBy("b").orderBy("v"))
    middle = middle.withColumn("upto", upto).filter("upto > (n - 1) div 2 and upto - c <= n div 2")
    median = middle.agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    return whole.drop("__n").crossJoin(F.broadcast(median))


def mean_importance(inst: DataFrame, classes: int) -> DataFrame:
    """(bag_id, idx, importance): the mean of each instance's logits, the first `classes` elements of feat."""
    total = F.aggregate(F.slice("feat", 1, classes), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return inst.select("bag_id", "idx", (total / classes).alias("importance"))


def max_instance_pool(inst: DataFrame, dim: int, classes: int) -> DataFrame:
    """(bag_id, logits, feat): each class's highest logit (column logits) and the mean feature of the instances that give them, the first idx of equal ones."""
    each = inst.select("bag_id", "idx", "feat", F.posexplode(F.slice("logits", 1, classes)).alias("class", "v"))
    best = each.groupBy("bag_id", "class").agg(F.max(F.struct("v", (-F.col("idx")).alias("back"), "feat")).alias("m")).select("bag_id", "class", "m.v", "m.feat")
    top = F.transform(F.array_sort(F.collect_list(F.struct("class", "v"))), lambda x: x["v"])
    return best.groupBy("bag_id").agg(top.alias("logits"), elementwise(F.avg, "feat", dim).alias("feat"))


def two_level_vectors(inst: DataFrame, dim: int, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """(bags, importance): softmax-pooled features of chunks of `size` instances, pooled again by the chunks' pooled scores; and each instance's importance,
    the weight of its chunk."""
    chunked = inst.withColumn("chunk", F.floor(F.col("idx") / size))
    e = chunked.withColumn("e", F.exp(F.col("score") - F.max("score").over(_bag("chunk"))))
    weighed = F.sum("e")
    chunks = e.groupBy("bag_id", "chunk").agg((F.sum(F.col("e") * F.col("score")) / weighed).alias("score"), elementwise(lambda x: F.sum(x * F.col("e")) / weighed, "feat", dim).alias("feat"))
    weights = with_softmax(chunks)
    bags = weights.groupBy("bag_id").agg(elementwise(lambda x: F.sum(x * F.col("weight")), "feat", dim).alias("feat"))
    return bags, chunked.join(weights.select("bag_id", "chunk", F.col("weight").alias("importance")), ["bag_id", "chunk"]).select("bag_id", "idx", "importance")
