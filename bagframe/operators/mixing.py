"""Mixed bags: instances of a bag and of its partner, chosen at random or by score."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order, hash_uniform, placed
from .bags import cross_bag_nearest


def _ranked(inst: DataFrame, pairs: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """Both sides with rank r, sizes n1 and n2, and the pair's ratio lambda."""
    w = Window.partitionBy("bag_id")
    ranked = inst.select("bag_id", "idx", F.row_number().over(w.orderBy(*order)).alias("r"))
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n"))
    sized = pairs.join(sizes.withColumnRenamed("n", "n1"), "bag_id").join(sizes.select(F.col("bag_id").alias("partner"), F.col("n").alias("n2")), "partner")
    own = sized.withColumn("source", F.col("bag_id")).join(ranked.withColumnRenamed("bag_id", "source"), "source")
    other = sized.withColumn("source", F.col("partner")).join(ranked.withColumnRenamed("bag_id", "source"), "source")
    return own, other


def insmix(inst: DataFrame, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(pair_id, source, idx): floor(n1 lambda) random instances of the bag and n2 less that of its partner; lambda is uniform by pair."""
    lam = hash_uniform(seed, "bag_id")
    own, other = _ranked(inst, pairs, [hash_order(seed, "bag_id", "idx")])
    taken = F.floor(F.col("n1") * lam)
    both = own.filter(F.col("r") <= taken).unionByName(other.filter(F.col("r") <= F.col("n2") - taken))
    return both.select(F.col("bag_id").alias("pair_id"), "source", "idx")


def rankmix(inst: DataFrame, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(pair_id, source, idx): the floor(n1 lambda) highest scored of the bag and the floor(n2 (1 - lambda)) of its partner."""
    lam = hash_uniform(seed, "bag_id")
    own, other = _ranked(inst, pairs, [F.desc("score"), F.col("idx")])
    both = own.filter(F.col("r") <= F.floor(F.col("n1") * lam)).unionByName(other.filter(F.col("r") <= F.floor(F.col("n2") * (1 - lam))))
    return both.select(F.col("bag_id").alias("pair_id"), "source", "idx")


def _numbered(inst: DataFrame) -> DataFrame:
    """bag_id, idx, feat and r, the place in the bag from 1: no task orders a bag."""
    return placed(inst.select("bag_id", "idx", "feat"), ["bag_id"], F.floor(F.col("idx") / 1000), ["idx"])


def mixup(inst: DataFrame, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(pair_id, idx, feat, ratio): lambda a + (1 - lambda) b of a bag and its partner, lambda (the ratio) uniform by pair.

    The longer bag gives the places in its order; the shorter one is drawn from for each place. Equal lengths meet place by place.
    """
    rows = _numbered(inst)
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n"))
    sized = pairs.select("bag_id", "partner").join(sizes.withColumnRenamed("n", "n1"), "bag_id").join(sizes.select(F.col("bag_id").alias("partner"), F.col("n").alias("n2")), "partner")
    sized = sized.withColumn("long", F.expr("if(n1 >= n2, bag_id, partner)")).withColumn("short", F.expr("if(n1 >= n2, partner, bag_id)"))
    base = sized.join(rows.select(F.col("bag_id").alias("long"), "r", F.col("feat").alias("a")), "long")
    drawn = F.when(F.col("n1") == F.col("n2"), F.col("r")).otherwise(F.floor(hash_uniform(seed + 1, "bag_id", "r") * F.least("n1", "n2")) + 1)
    base = base.withColumn("s", drawn).withColumn("lam", hash_uniform(seed, "bag_id"))
    both = base.join(rows.select(F.col("bag_id").alias("short"), F.col("r").alias("s"), F.col("feat").alias("b")), ["short", "s"])
    share = F.expr("if(n1 >= n2, lam, 1 - lam)")  # of the longer one
    both = both.withColumn("w", share)
    mixed = F.zip_with("a", "b", lambda x, y: x.cast("double") * F.col("w") + y.cast("double") * (1 - F.col("w")))
    return both.select(F.col("bag_id").alias("pair_id"), (F.col("r") - 1).alias("idx"), mixed.alias("feat"), F.col("lam").alias("ratio"))


def remix(inst: DataFrame, pairs: DataFrame, mode: str = "replace", rate: float = 0.3, strength: float = 0.5, seed: int = 0) -> DataFrame:
    """(pair_id, idx, feat, made): the bag with its instances, each with probability `rate` met with the partner's nearest one.

    replace puts that in its place; append adds it, and interpolate adds (1 - strength) own + strength nearest, behind the bag in the order of idx
    (which counts from 0). made: whether the row comes of it. The ratio of such a pair is 0.5.
    """
    near = cross_bag_nearest(inst, pairs)
    other = inst.select(F.col("bag_id").alias("partner"), F.col("idx").alias("nearest"), F.col("feat").alias("b"))
    met = inst.select("bag_id", "idx", "feat").join(near, ["bag_id", "idx"]).join(other, ["partner", "nearest"]).withColumn("drawn", hash_uniform(seed, "bag_id", "idx") <= rate)
    own = met.select(F.col("bag_id").alias("pair_id"), "idx", F.transform("feat", lambda x: x.cast("double")).alias("feat"), F.lit(False).alias("made"))
    if mode == "replace":
        swapped = F.when(F.col("drawn"), F.col("b")).otherwise(F.col("feat"))
        return met.select(F.col("bag_id").alias("pair_id"), "idx", F.transform(swapped, lambda x: x.cast("double")).alias("feat"), F.col("drawn").alias("made"))
    share = {"append": 1.0, "interpolate": strength}[mode]
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n"))
    extra = placed(met.filter("drawn"), ["bag_id"], F.floor(F.col("idx") / 1000), ["idx"]).join(sizes, "bag_id")
    made = F.zip_with("feat", "b", lambda x, y: x.cast("double") * (1 - share) + y.cast("double") * share)
    return own.unionByName(extra.select(F.col("bag_id").alias("pair_id"), (F.col("n") + F.col("r") - 1).alias("idx"), made.alias("feat"), F.lit(True).alias("made")))


def psebmix(inst: DataFrame, pairs: DataFrame, n: int = 30, seed: int = 0) -> DataFrame:
    """(pair_id, source, idx, ratio): of n random pseudo-bags of either side (as many as a smaller side has instances) k of the bag and n - k of its partner,
    k = n lambda cut to 1..n-1. ratio is k / n, or 1 or 0 where only the bag or only its partner gave instances."""
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("size"))
    part = F.floor(hash_uniform(seed + 1, "bag_id", "idx") * F.least(F.col("size"), F.lit(n))).cast("int")
    parts = inst.select("bag_id", "idx").join(sizes, "bag_id").select(F.col("bag_id").alias("source"), "idx", part.alias("part"))
    k = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.floor(hash_uniform(seed, "bag_id") * n)))
    chosen = pairs.select("bag_id", "partner", k.cast("int").alias("k")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sides = []
    for side, keep, salt in (("bag_id", F.col("k"), 2), ("partner", n - F.col("k"), 3)):
        r = F.row_number().over(Window.partitionBy("bag_id").orderBy(hash_order(seed + salt, "bag_id", "part"), "part"))  # n rows a pair
        sides.append(chosen.withColumn("r", r).filter(F.col("r") <= keep).select("bag_id", F.col(side).alias("source"), "part", "k", F.lit(side == "bag_id").alias("own")))
    both = sides[0].unionByName(sides[1]).join(parts, ["source", "part"])
    has = both.groupBy("bag_id").agg(F.max("own").alias("some"), F.max(~F.col("own")).alias("more"))
    ratio = F.when(F.col("some") & F.col("more"), F.col("k") / n).when(F.col("some"), 1.0).otherwise(0.0)
    return both.join(has, "bag_id").select(F.col("bag_id").alias("pair_id"), "source", "idx", ratio.alias("ratio"))


def rankmix_shrink(inst: DataFrame, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(pair_id, source, idx, factor, ratio): the larger bag cut to the size of the smaller by score; features count times factor: lambda in the bag, 1 - lambda in
    its partner. ratio is the bag's share of the instances."""
    own, other = _ranked(inst, pairs, [F.desc("score"), F.col("idx")])
    least, lam = F.least("n1", "n2"), hash_uniform(seed, "bag_id")
    both = own.filter(F.col("r") <= least).withColumn("factor", lam).unionByName(other.filter(F.col("r") <= least).withColumn("factor", 1 - lam))
    return both.select(F.col("bag_id").alias("pair_id"), "source", "idx", "factor", F.lit(0.5).alias("ratio"))
