"""Classification metrics of predictions with y and yhat (class numbers) or y (0/1) and p1."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beside(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """left with the columns of right, which has one row for each group of `by`, or one row without any."""
    return left.join(F.broadcast(right), list(by)) if by else left.crossJoin(F.broadcast(right))


def confusion_matrix(preds: DataFrame, *by: str) -> DataFrame:
    """(y, yhat, n) over the union of true and predicted classes, with zeros; here and below, for each group of the columns `by`, not null."""
    counts = preds.groupBy(*by, "y", "yhat").agg(F.count("*").alias("n"))
    classes = counts.select(*by, "y").union(counts.select(*by, "yhat")).distinct()  # classes squared, not rows
    grid = _beside(classes, classes.withColumnRenamed("y", "yhat"), by)
    return grid.join(counts, [*by, "y", "yhat"], "left").fillna(0, ["n"])


def classification_report(preds: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1 and support of each class; 0 / 0 is 0."""
    return _report(confusion_matrix(preds, *by), by)


def _report(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    n, hit = F.sum("n"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    rows = cells.groupBy(*by, "y").agg(n.alias("support"), hit.alias("hit"))
    cols = cells.groupBy(*by, F.col("yhat").alias("y")).agg(n.alias("predicted"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = rows.join(cols, [*by, "y"]).withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "y", "precision", "recall", "f1", "support")


def report_with_averages(preds: DataFrame) -> DataFrame:
    """classification_report with class as text, and the rows accuracy, macro avg and weighted avg."""
    rows = classification_report(preds)
    share = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    names = ("precision", "recall", "f1")
    n = F.sum("support").alias("support")
    out = rows.select(F.col("y").cast("string").alias("class"), *names, "support")
    out = out.unionByName(rows.agg(*[share("recall").alias(c) for c in names], n).withColumn("class", F.lit("accuracy")))
    out = out.unionByName(rows.agg(*[F.avg(c).alias(c) for c in names], n).withColumn("class", F.lit("macro avg")))
    return out.unionByName(rows.agg(*[share(c).alias(c) for c in names], n).withColumn("class", F.lit("weighted avg")))


def prf_scores(preds: DataFrame, *by: str) -> DataFrame:
    """One row: macro and weighted precision, recall, f1, and accuracy (the micro average of all three), error rate, balanced accuracy."""
    return _rates(confusion_matrix(preds, *by), by)


def _rates(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    report = _report(cells, by)
    share = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    macro = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [share(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.groupBy(*by).agg(*macro, *weighted, share("recall").alias("accuracy"), (1 - share("recall")).alias("error_rate"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def cohen_kappas(preds: DataFrame, powers: dict[str, int], *by: str) -> DataFrame:
    """One row with a kappa for each name: weights 1 (power 0), |i-j| (1) or (i-j)^2 (2) on class positions."""
    return _kappas(confusion_matrix(preds, *by), powers, by)


def _kappas(cells: DataFrame, powers: dict[str, int], by: tuple[str, ...]) -> DataFrame:
    group = Window.partitionBy(*by)
    cells = cells.withColumn("i", F.dense_rank().over(group.orderBy("y"))).withColumn("j", F.dense_rank().over(group.orderBy("yhat")))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    rows = cells.groupBy(*by, "y").agg(F.sum("n").alias("ny"))
    cols = cells.groupBy(*by, "yhat").agg(F.sum("n").alias("nh"))
    apart = lambda p: F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.pow(F.abs(F.col("i") - F.col("j")).cast("double"), F.lit(float(p))))
    all_ = _beside(cells.join(rows, [*by, "y"]).join(cols, [*by, "yhat"]), total, by)
    return all_.groupBy(*by).agg(*[(1 - F.sum(apart(p) * F.col("n")) / F.sum(apart(p) * F.col("ny") * F.col("nh") / F.col("total"))).alias(name) for name, p in powers.items()])


def cohen_kappa(preds: DataFrame, power: int = 0) -> DataFrame:
    return cohen_kappas(preds, {"kappa": power})


def per_class_accuracy(preds: DataFrame) -> DataFrame:
    ok = (F.col("y") == F.col("yhat")).cast("long")
    return preds.groupBy("y").agg(F.count("*").alias("n"), F.sum(ok).alias("correct"), F.avg(ok.cast("double")).alias("acc"))


def accuracy_of_classes(preds: DataFrame, classes: int) -> DataFrame:
    """per_class_accuracy with a row for each of the classes 0 to classes - 1: no rows of a class are n 0 and a null acc."""
    every = preds.sparkSession.range(classes).select(F.col("id").cast("int").alias("y"))
    return every.join(per_class_accuracy(preds), "y", "left").fillna(0, ["n", "correct"])


def ce_loss(preds: DataFrame) -> DataFrame:
    """The mean of log(sum of exp(logits)) - logits[y], shifted by the largest logit."""
    top = F.array_max("logits")
    total = F.aggregate(F.transform("logits", lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda s, x: s + x)
    return preds.agg(F.avg(F.log(total) + top - F.col("logits")[F.col("y")]).alias("loss"))


def _by_score(preds: DataFrame) -> DataFrame:
    y = F.col("y").cast("long")
    return preds.groupBy("p1").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


#: Ranges of scores that are added up before they are ordered.
BUCKETS = 1024


def _dealt(cells: DataFrame, score: str, keys: list[str], sign: int = 1) -> DataFrame:
    """Adds bucket: the range of a score between its key's lowest and highest, rising with it (or falling); scores may be any numbers."""
    ends = cells.groupBy(*keys).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    share = (F.col(score) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    bucket = F.when(F.col("__high") > F.col("__low"), F.floor(share * BUCKETS)).otherwise(0) * sign
    return cells.join(F.broadcast(ends), keys).withColumn("bucket", bucket).drop("__low", "__high")


def auc_by(rows: DataFrame, *groups: str) -> DataFrame:
    """groups, auc, pos and neg of rows (groups, p, hit 0/1): the area with ties averaged, null if one side is empty.

    Scores are counted, dealt to buckets of their range and summed within these; only the buckets' sums are ordered by group.
    """
    keys = list(groups)
    cells = rows.groupBy(*keys, "p").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    cells = _dealt(cells, "p", keys)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(*keys, "bucket").agg(F.sum("neg").alias("n")).select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = cells.withColumn("inner", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(sums, [*keys, "bucket"]).withColumn("below", F.col("first") + F.col("inner"))
    whole = F.sum("pos") * F.sum("neg")
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / whole
    return below.groupBy(*keys).agg(F.when(whole > 0, area).alias("auc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def roc_auc_binary(preds: DataFrame) -> DataFrame:
    """Area under the curve with ties averaged; -1 if the truth has one class."""
    rows = preds.select(F.col("p1").alias("p"), F.col("y").cast("long").alias("hit"), F.lit(1).alias("all"))
    return auc_by(rows, "all").select(F.coalesce("auc", F.lit(-1.0)).alias("auc"))


def softmax_probs(preds: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds probs, the softmax of the array `logits` times scale."""
    scaled = F.transform("logits", lambda x: F.exp((x - F.array_max("logits")) * scale))
    return preds.withColumn("e", scaled).withColumn("probs", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, v: s + v))).drop("e")


def _one_against_rest(preds: DataFrame, *by: str) -> DataFrame:
    each = preds.select(*by, "y", F.posexplode("probs").alias("class", "p"))
    return each.select(*by, "class", "p", (F.col("y") == F.col("class")).cast("long").alias("hit"))


def roc_auc_ovr(preds: DataFrame, *by: str) -> DataFrame:
    """macro, weighted (by the classes' shares) and micro (all columns stacked) areas of y and the array probs; and nanmean, over the classes there are."""
    rows = _one_against_rest(preds, *by)
    each = auc_by(rows, *by, "class")
    stacked = auc_by(rows.withColumn("all", F.lit(1)), *by, "all").select(*by, F.col("auc").alias("micro"))
    whole = F.count("*") == F.count("auc")  # undefined if a class is lacking
    out = each.groupBy(*by).agg(F.when(whole, F.avg("auc")).alias("macro"), F.when(whole, F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("weighted"), F.avg("auc").alias("nanmean"))
    return _beside(out, stacked, by)


def roc_auc_ovo(preds: DataFrame) -> DataFrame:
    """macro area over the pairs of classes, both directions averaged."""
    other = F.filter(F.sequence(F.lit(0), F.size("probs") - 1), lambda c: c != F.col("y"))
    pairs = preds.withColumn("other", F.explode(other))
    own = pairs.select(F.col("y").alias("a"), F.col("other").alias("b"), F.expr("probs[y]").alias("p"), F.lit(1).cast("long").alias("hit"))
    against = pairs.select(F.col("other").alias("a"), F.col("y").alias("b"), F.expr("probs[other]").alias("p"), F.lit(0).cast("long").alias("hit"))
    return auc_by(own.union(against), "a", "b").agg(F.avg("auc").alias("macro"))


def evaluate_all(preds: DataFrame, classes: int | None = None, *by: str) -> DataFrame:
    """One row (for each group of `by`) of every metric of predictions (y, yhat, probs): rates, kappas, areas, and `confusion`, an array of struct(y, yhat, n) in order.

    With two classes (as `classes` says, or else the length of probs) all three areas are that of class 1's probability. All parts are one row a group.
    The confusion matrix is read here, as all but the areas follow from its few cells.
    """
    classes = classes or (preds.select(F.max(F.size("probs"))).first()[0] or 0)
    if classes == 2:
        auc = auc_by(preds.select(*by, F.col("probs")[1].alias("p"), (F.col("y") == 1).cast("long").alias("hit"), F.lit(1).alias("all")), *by, "all")
        areas = auc.groupBy(*by).agg(*[F.max("auc").alias(f"auc_{c}") for c in ("macro", "weighted", "micro")])
    else:
        areas = roc_auc_ovr(preds, *by).select(*by, *[F.col(c).alias(f"auc_{c}") for c in ("macro", "weighted", "micro")])
    cells = confusion_matrix(preds, *by)
    cells = preds.sparkSession.createDataFrame(cells.collect(), cells.schema)  # classes squared
    parts = [_rates(cells, by), areas]
    parts.append(_kappas(cells, {"kappa": 0, "linear_kappa": 1, "quadratic_kappa": 2}, by))
    parts.append(cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "yhat", "n"))).alias("confusion")))
    out = parts[0]
    for part in parts[1:]:
        out = _beside(out, part, by)
    return out


def combined_loss(losses: DataFrame, weight: float = 0.7, share: float = 0.5) -> DataFrame:
    """Means of bag * weight + instance * (1 - weight), of half bag and half max, and of bag - share * entropy."""
    bag = F.col("bag")
    return losses.agg(F.avg(bag * weight + F.col("instance") * (1 - weight)).alias("weighted"), F.avg((bag + F.col("max")) / 2).alias("halves"), F.avg(bag - share * F.col("entropy")).alias("penalised"))


def roc_curve(preds: DataFrame) -> DataFrame:
    """threshold, fpr, tpr of each score: the shares of both sides with that score or more, summed within buckets of the scores' range."""
    cells = _dealt(_by_score(preds).withColumn("all", F.lit(1)), "p1", ["all"], -1)
    before = Window.partitionBy("all").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("all", "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    first = sums.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}") for c in "pn"])
    whole = cells.agg(F.sum("pos").alias("all_p"), F.sum("neg").alias("all_n"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("p1")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.withColumns({"in_p": F.sum("pos").over(inside), "in_n": F.sum("neg").over(inside)}).join(first, "bucket").crossJoin(F.broadcast(whole))  # one row
    rate = lambda c: (F.col(f"first_{c}") + F.col(f"in_{c}")) / F.col(f"all_{c}")
    return out.select(F.col("p1").alias("threshold"), rate("n").alias("fpr"), rate("p").alias("tpr"))


def bce_loss(preds: DataFrame, eps: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col("p1"), F.lit(eps)), F.lit(1 - eps))
    return preds.agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
