"""Reworking bags: distilled, recalibrated, padded and joined instances, and relations between instances."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order
from ..functions.vectors import elementwise, vec_l2
from . import blocks
from .pooling import mean_pool, pseudo_bags
from .select import topk_instances


def topj_pool(inst: DataFrame, js: list[int], classes: int) -> DataFrame:
    """(bag_id, j, pos, value): the mean of each class's min(j, n) highest logits, the first `classes` elements of feat."""
    logits = inst.select("bag_id", F.posexplode(F.slice("feat", 1, classes)).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    r = F.row_number().over(Window.partitionBy("bag_id", "pos").orderBy(F.desc("v")))
    top = logits.withColumn("r", r).filter(F.col("r") <= max(js))
    means = top.groupBy("bag_id", "pos").agg(*[F.avg(F.when(F.col("r") <= j, F.col("v"))).alias(str(j)) for j in js])
    return means.unpivot(["bag_id", "pos"], [str(j) for j in js], "j", "value").withColumn("j", F.col("j").cast("int"))


def recalibrate(inst: DataFrame, k: int, dim: int, mode: str = "max") -> DataFrame:
    """feat becomes relu(feat - mean of the bag's k highest scored instances), or of the k lowest (mode min), or of all (mean)."""
    chosen = inst if mode == "mean" else topk_instances(inst, k, mode == "max")
    level = mean_pool(chosen, dim).withColumnRenamed("feat", "__level")
    cut = lambda x, m: F.greatest(x.cast("double") - m, F.lit(0.0))
    return inst.join(level, "bag_id").withColumn("feat", F.zip_with("feat", "__level", cut)).drop("__level")


def distill(inst: DataFrame, g: int, k: int, n: int | None = None) -> DataFrame:
    """(bag_id, chunk, idx, kind): the k highest ('max') and k lowest ('min') scored of each of g pseudo-bags (n: as there); both kinds may hold the same
    instance."""
    w = Window.partitionBy("bag_id", "chunk")
    ranked = pseudo_bags(inst, g, n).withColumn("hi", F.row_number().over(w.orderBy(F.desc("score"), "idx"))).withColumn("lo", F.row_number().over(w.orderBy("score", "idx")))
    kinds = F.filter(F.array(F.when(F.col("hi") <= k, "max"), F.when(F.col("lo") <= k, "min")), lambda x: x.isNotNull())
    return ranked.select("bag_id", "chunk", "idx", F.explode(kinds).alias("kind"))


def distilled_bags(inst: DataFrame, g: int, k: int, dim: int, mode: str = "MaxMinS", n: int | None = None) -> DataFrame:
    """(bag_id, feat): the second tier over g pseudo-bags (n: as there): the mean of what each gives: its k highest and k lowest scored instances
    (MaxMinS), its k highest (MaxS), or its softmax-pooled feature (AFS)."""
    if mode == "AFS":
        parts = pseudo_bags(inst, g, n)
        w = Window.partitionBy("bag_id", "chunk")
        e = parts.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
        given = e.groupBy("bag_id", "chunk").agg(elementwise(lambda x: F.sum(x * F.col("e")) / F.sum("e"), "feat", dim).alias("feat"))
    else:
        kinds = ["max", "min"] if mode == "MaxMinS" else ["max"]
        given = distill(inst, g, k, n).filter(F.col("kind").isin(kinds)).join(inst.select("bag_id", "idx", "feat"), ["bag_id", "idx"])
    return mean_pool(given, dim)


def pad_square_zeros(inst: DataFrame, dim: int) -> DataFrame:
    """Pads a bag to ceil(sqrt(n))^2 instances with rows of zeros."""
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n")).withColumn("side", F.ceil(F.sqrt("n")).cast("long")).filter("side * side > n")
    extra = sizes.select("bag_id", F.explode(F.sequence(F.col("n"), F.col("side") * F.col("side") - 1)).alias("idx"), F.array_repeat(F.lit(0.0), dim).alias("feat"))
    return inst.select("bag_id", "idx", F.transform("feat", lambda x: x.cast("double")).alias("feat")).unionByName(extra)


def _padded(inst: DataFrame, length: Column, source: Column) -> DataFrame:
    """Instances 0 to length - 1 of each bag; those from n on are copies of the instance that `source` names."""
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n"))
    extra = sizes.withColumn("length", length).filter("length > n").withColumn("at", F.explode(F.sequence(F.col("n"), F.col("length") - 1)))
    extra = extra.select("bag_id", F.col("at"), source.alias("idx"))
    copies = inst.join(extra, ["bag_id", "idx"])
    return inst.withColumn("src", F.col("idx")).unionByName(copies.withColumn("src", F.col("idx")).withColumn("idx", F.col("at")).drop("at"))


def pad_square(inst: DataFrame) -> DataFrame:
    """Pads a bag to ceil(sqrt(n))^2 instances by its first ones; src is the copied idx."""
    side = F.ceil(F.sqrt("n")).cast("long")
    return _padded(inst, side * side, (F.col("at") - F.col("n")) % F.col("n"))


def pad_chunks(inst: DataFrame, c: int) -> DataFrame:
    """Fills the last chunk of c instances by repeating the remainder in turn; src is the copied idx."""
    rest = F.col("n") % c
    return _padded(inst, (F.ceil(F.col("n") / c) * c).cast("long"), F.col("n") - rest + (F.col("at") - F.col("n")) % rest)


def quantize_coords(inst: DataFrame, unit: int = 224) -> DataFrame:
    """Adds cell = 300 x' + y', each coordinate's distance to the bag's least in steps of 4 units, halves to even."""
    step = lambda c: F.rint((F.col(c) - F.min(c).over(Window.partitionBy("bag_id"))) / (unit * 4.0))
    return inst.withColumn("cell", (step("x") * 300 + step("y")).cast("long"))


def patient_bags(inst: DataFrame, slides: DataFrame) -> DataFrame:
    """(case_id, idx, slide_id, score): the bags of all slides of a case one after another, numbered anew."""
    own = inst.join(slides.select(F.col("slide_id").alias("bag_id"), "case_id").distinct(), "bag_id")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("bag_id", "idx")) - 1
    return own.select("case_id", place.cast("long").alias("idx"), F.col("bag_id").alias("slide_id"), "score")


def cross_bag_nearest(inst: DataFrame, pairs: DataFrame) -> DataFrame:
    """(bag_id, idx, partner, nearest): the nearest instance of the paired bag, the first of equally near ones. Pairs of unknown bags have no rows."""
    near = blocks.nearest(inst, inst, 1, pairs)
    return near.select("bag_id", F.col("src").alias("idx"), "partner", F.col("dst").alias("nearest"))


def spatial_bias(inst: DataFrame, radius: int) -> DataFrame:
    """(bag_id, src, dst, bias): -trunc(distance) of instances within the radius; buckets of its width meet their neighbours only."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = inst.select("bag_id", F.col("idx").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = inst.select("bag_id", F.col("idx").alias("dst"), "x", "y", around.alias("dx")).withColumn("dy", around)
    b = b.select("bag_id", "dst", "x", "y", (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))
    d2 = F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2)
    near = a.join(b, ["bag_id", "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    return near.select("bag_id", "src", "dst", (-F.floor(F.sqrt("d2"))).cast("long").alias("bias"))


#: Instances of a bag whose pairs are looked at within a row of each, by the task that has the bag; larger bags meet by cells.
WHOLE = 256


def spatial_bias_local(inst: DataFrame, radius: int, whole: int = WHOLE) -> DataFrame:
    """spatial_bias without the farthest value of a bag: pairs beyond the radius, if it has such (they have no rows), or else those of the lowest bias.

    Bags of up to `whole` instances are dealt once, by bag_id: every instance gets the bag's places, and its own pairs stay in its row until the bag's
    lowest bias is known. Nothing is copied to neighbouring cells, and no pair is shuffled. Larger bags, which are counted first, go the way of
    spatial_bias.
    """
    bag = Window.partitionBy("bag_id")
    counted = inst.select("bag_id", "idx", "x", "y").filter("bag_id is not null").withColumn("n", F.count("*").over(bag))
    small, large = counted.filter(F.col("n") <= whole), counted.filter(F.col("n") > whole)
    sizes = inst.groupBy("bag_id").agg(F.count("*").alias("n")).filter(F.col("n") > whole)

    d2 = lambda p: F.pow(F.col("x") - p["x"], F.lit(2)) + F.pow(F.col("y") - p["y"], F.lit(2))
    met = F.transform(F.collect_list(F.struct("idx", "x", "y")).over(bag), lambda p: F.struct(p["idx"].alias("dst"), d2(p).alias("d2")))
    near = F.transform(F.filter("met", lambda p: p["d2"] <= radius * radius), lambda p: F.struct(p["dst"].alias("dst"), (-F.floor(F.sqrt(p["d2"]))).cast("long").alias("bias")))
    own = small.withColumn("met", met).select("bag_id", F.col("idx").alias("src"), "n", near.alias("near"))
    lowest = F.min(F.array_min(F.transform("near", lambda p: p["bias"]))).over(bag)
    ended = own.withColumn("pairs", F.sum(F.size("near")).over(bag)).withColumn("low", lowest)
    left = F.filter("near", lambda p: (F.col("pairs") < F.col("n") * F.col("n")) | (p["bias"] > F.col("low")))
    kept = ended.select("bag_id", "src", F.explode(left).alias("p")).select("bag_id", "src", "p.dst", "p.bias")
    if sizes.count() == 0:
        return kept

    far = spatial_bias(large, radius)
    ends = far.groupBy("bag_id").agg(F.count("*").alias("pairs"), F.min("bias").alias("low")).join(sizes, "bag_id")
    rest = far.join(ends, "bag_id").filter((F.col("pairs") < F.col("n") * F.col("n")) | (F.col("bias") > F.col("low")))
    return kept.unionByName(rest.select("bag_id", "src", "dst", "bias"))


#: Most centres that all go to every task; more meet the instances in blocks.
MOST_CENTRES = 4096


def soft_assign(inst: DataFrame, centres: DataFrame, alpha: float = 1.0, most: int = MOST_CENTRES) -> DataFrame:
    """(bag_id, idx, k, w): Student-t membership of the centres (k, centre)."""
    if centres.limit(most + 1).count() <= most:
        d2 = F.pow(vec_l2(F.col("feat"), F.col("centre")), 2)
        near = inst.join(F.broadcast(centres)).select("bag_id", "idx", "k", F.pow(1 + d2 / alpha, F.lit(-(alpha + 1) / 2)).alias("raw"))
    else:
        of_bag = inst.schema["bag_id"].dataType
        partner = F.lit(0).cast(of_bag)
        own = blocks.blocked(inst)
        pairs = own.select("bag_id", partner.alias("partner")).distinct()
        other = blocks.blocked(centres.select(partner.alias("bag_id"), F.col("k").alias("idx"), F.col("centre").alias("feat")))

        def kernel(idx, a, idx_b, b):
            raw = (1 + blocks._distances(a, b) ** 2 / alpha) ** (-(alpha + 1) / 2)
            return idx.repeat(len(idx_b)), np.tile(idx_b, len(idx)), raw.ravel()

        near = blocks.per_pair(blocks.block_pairs(own, other, pairs), kernel, "idx long, k long, raw double").drop("partner")
    return near.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("bag_id", "idx"))).drop("raw")


def ref_percentile(inst: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Adds pct: (number below + number not above + 1 if these differ) * 50 / n against the reference scores of the same key.

    Both sides are counted by (key, score) before scores are ordered. Without reference scores pct is null.
    """
    some = inst.groupBy(key, "score").agg(F.lit(0).cast("long").alias("n")).unionByName(ref.groupBy(key, "score").agg(F.count("*").alias("n")))
    merged = some.groupBy(key, "score").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("score"))
    total = F.sum("n").over(Window.partitionBy(key))
    pct = (2 * upto - F.col("n") + (F.col("n") > 0).cast("int")) * 50 / F.nullif(total, F.lit(0))
    return inst.join(merged.select(key, "score", pct.alias("pct")), [key, "score"])


def range_sample(inst: DataFrame, k: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """At most k random instances of each bag whose score lies between two quantiles of the bag."""
    bounds = inst.groupBy("bag_id").agg(F.percentile("score", F.lit(low)).alias("__low"), F.percentile("score", F.lit(high)).alias("__high"))
    kept = inst.join(bounds, "bag_id").filter(F.col("score").between(F.col("__low"), F.col("__high"))).drop("__low", "__high")
    r = F.row_number().over(Window.partitionBy("bag_id").orderBy(hash_order(seed, "bag_id", "idx")))
    return kept.withColumn("r", r).filter(F.col("r") <= k).drop("r")
