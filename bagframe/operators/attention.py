"""Instance scores and bag vectors from given weights: gates, class logits, class activation, critical instances."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import elementwise, vec_cosine, vec_dot


def row(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def activation(x: Column, name: str) -> Column:
    """relu, leakyrelu (0.01), sigmoid, tanh, silu, and gelu by its tanh form (no erf in SQL)."""
    kinds = {
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "leakyrelu": lambda: F.when(x > 0, x).otherwise(0.01 * x),
        "sigmoid": lambda: sigmoid(x),
        "tanh": lambda: F.tanh(x),
        "silu": lambda: x * sigmoid(x),
        "gelu": lambda: 0.5 * x * (1 + F.tanh(F.lit((2 / 3.141592653589793) ** 0.5) * (x + 0.044715 * x * x * x))),
    }
    return kinds[name]()


def relevance_score(x: Column, token: Column) -> Column:
    """The cosine to a token, cut to 0 .. 1."""
    return F.least(F.greatest(vec_cosine(x, token), F.lit(0.0)), F.lit(1.0))


def gated_scores(inst: DataFrame, v: list[list[float]], u: list[list[float]], w: list[float], act: str = "tanh") -> DataFrame:
    """Adds score: the sum over k of w[k] act(v[k] . feat) sigmoid(u[k] . feat)."""
    parts = [activation(vec_dot(F.col("feat"), row(a)), act) * sigmoid(vec_dot(F.col("feat"), row(b))) * float(c) for a, b, c in zip(v, u, w)]
    return inst.withColumn("score", sum(parts[1:], parts[0]))


def softmax_weight(score: Column, *by: str) -> Column:
    """exp(score) over its sum in the bag; the bag's maximum is taken off first."""
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def additive_pool(inst: DataFrame, logits: str, classes: int) -> tuple[DataFrame, DataFrame]:
    """(bags with pooled `logits`, instances with `contrib`): logits of instances by softmax(score)."""
    weighted = inst.withColumn("weight", softmax_weight(F.col("score"), "bag_id"))
    contrib = weighted.withColumn("contrib", F.transform(logits, lambda x: x * F.col("weight")))
    return contrib.groupBy("bag_id").agg(elementwise(F.sum, "contrib", classes).alias("logits")), contrib


def critical_attention(inst: DataFrame, logits: str, classes: int, dim: int) -> DataFrame:
    """(bag_id, class, feat): for each class the bag's vector by softmax(feat . critical / sqrt(dim)), critical being the instance of the highest logit
    (of equal ones the lowest idx)."""
    per_class = inst.select("bag_id", "idx", "feat", F.posexplode(F.slice(logits, 1, classes)).alias("class", "logit"))
    top = per_class.groupBy("bag_id", "class").agg(F.max(F.struct("logit", (-F.col("idx")).alias("back"), "feat")).alias("m"))
    top = top.select("bag_id", "class", F.col("m.feat").alias("critical"))
    scored = per_class.join(top, ["bag_id", "class"]).withColumn("s", vec_dot(F.col("feat"), F.col("critical")) / F.lit(dim**0.5))
    # Two aggregates instead of a window: neither needs a bag's rows in one place.
    most = scored.groupBy("bag_id", "class").agg(F.max("s").alias("most"))
    e = scored.join(most, ["bag_id", "class"]).withColumn("e", F.exp(F.col("s") - F.col("most")))
    sums = e.groupBy("bag_id", "class").agg(F.sum("e").alias("whole"), *[F.sum(F.col("e") * F.col("feat")[i]).alias(f"f{i}") for i in range(dim)])
    return sums.select("bag_id", "class", F.array(*[F.col(f"f{i}") / F.col("whole") for i in range(dim)]).alias("feat"))


def cam_scores(inst: DataFrame, attention: Column, weight: list[float]) -> DataFrame:
    """Adds cam: the class weight's product with the instance's feature times its attention."""
    return inst.withColumn("cam", attention * vec_dot(F.col("feat"), row(weight)))
