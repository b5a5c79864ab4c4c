"""Order-dependent folds and weighted draws, spread over tasks."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order, hash_uniform, placed
from ..functions.vectors import elementwise


def ema_centers(bags: DataFrame, dim: int, m: float = 0.4, start: list[float] | None = None, per: int = 1000) -> DataFrame:
    """(class, n, feat): for each class the vector c after c := m c + (1 - m) feat over its bags (class, seq, feat) in the order of seq.

    The fold is a sum in which the r-th of n bags weighs (1 - m) m^(n - r) and the start (zeros, if none) m^n. Places r come from ranges of `per` numbers
    of seq, whose sizes alone are added up in order, so no task holds a class. Bags without class or seq are left out; equal seq are ordered by feat.
    """
    own = bags.select("class", "seq", "feat").dropna(subset=["class", "seq"])
    ranked = placed(own, ["class"], F.floor(F.col("seq") / per), ["seq", "feat"])
    sizes = own.groupBy("class").agg(F.count("*").alias("n"))
    weighed = ranked.join(sizes, "class").withColumn("w", (1 - m) * F.pow(F.lit(float(m)), F.col("n") - F.col("r")))
    weighed = weighed.withColumn("feat", F.transform("feat", lambda x: x.cast("double") * F.col("w")))
    out = weighed.groupBy("class").agg(F.max("n").alias("n"), elementwise(F.sum, "feat", dim).alias("feat"))
    if start is not None:
        first = F.array(*[F.lit(float(x)) for x in start])
        out = out.withColumn("feat", F.zip_with("feat", first, lambda x, c: x + c * F.pow(F.lit(float(m)), F.col("n"))))
    return out


def weighted_sample(slides: DataFrame, n: int, seed: int = 0, key: str = "slide_id", weight: str = "w") -> DataFrame:
    """(draw, key): n draws with replacement, each row of slides with the chance of its weight, by the inverse of the cumulative weights in hash order.

    Weights are added up within 4,096 ranges of the hash and across them. The interval of each row is posted to the cells of an even grid that it
    touches, about as many cells as rows, and a draw looks into its own cell only. Rows without a positive weight are never drawn; of equal
    keys each has its own chance. No positive weight: no rows.
    """
    own = slides.select(key, F.col(weight).cast("double").alias("w")).filter(F.col("w") > 0).withColumn("h", hash_order(seed, key))
    own = own.withColumn("bucket", F.substring("h", 1, 3))
    sums = own.groupBy("bucket").agg(F.sum("w").alias("s"), F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    firsts = sums.select("bucket", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("first"))
    total, rows = sums.agg(F.sum("s"), F.sum("rows")).first()
    if total is None:
        return slides.select(F.lit(0).cast("long").alias("draw"), key).filter("false")
    cells = 1 << max(12, math.ceil(math.log2(rows)))
    inside = Window.partitionBy("bucket").orderBy("h", key)
    upto = own.withColumn("high", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    spans = upto.join(F.broadcast(firsts), "bucket").select(key, (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    cell = lambda c: F.least(F.floor(c / F.lit(total) * cells), F.lit(cells - 1))
    posted = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    draws = slides.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("t", hash_uniform(seed + 1, "draw") * F.lit(total))
    draws = draws.withColumn("cell", cell(F.col("t")))
    return draws.join(posted, "cell").filter("low <= t and t < high").select("draw", key)
