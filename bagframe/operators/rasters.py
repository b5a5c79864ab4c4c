"""Scores painted on a grid of cells, and pyramid levels by magnification."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heatmap_raster(inst: DataFrame, scale: float, patch: int, size: tuple[int, int], threshold: float | None = None, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(bag_id, cx, cy, value): for each cell that patches cover the mean of their scores / 100, negative ones as 0.

    Patches (x, y, score) and their width are scaled and rounded up; cells lie below size (width, height). region (left, top, right, bottom; both ends
    included) keeps the corners in it, moves them and sets the size. threshold: scores / 100 of it or more count as 1, others as 0, and means are
    rounded (half to even); a negative one stands for 1 / number of the bag's patches. Patches without a place or score are left out.

    Patches of one cell corner are added up before any cell is painted, and cells before the shuffle, so dense cells stay small. Sums are those of the
    scores themselves and divided once, so means of whole scores are exact in whatever order they are added.
    """
    rows = inst.select("bag_id", "x", "y", F.col("score").cast("double").alias("score")).dropna(subset=["x", "y", "score"])
    if region is not None:
        left, top, right, bottom = region
        rows = rows.filter(F.col("x").between(left, right) & F.col("y").between(top, bottom)).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})
        size = (int(right * scale) - int(left * scale), int(bottom * scale) - int(top * scale))
    value = F.col("score") / 100
    if threshold is None:
        value = F.when(value >= 0, F.col("score")).otherwise(0.0)
    else:
        least = F.lit(threshold)
        if threshold < 0:
            rows = rows.join(rows.groupBy("bag_id").agg(F.count("*").alias("n")), "bag_id")
            least = 1 / F.col("n")
        value = F.when(value >= least, 1.0).otherwise(0.0)
    corner = lambda c: F.ceil(F.col(c) * F.lit(float(scale)))
    corners = rows.groupBy("bag_id", corner("x").alias("x"), corner("y").alias("y")).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    wide = int(-(-patch * scale // 1))
    cells = corners.filter(F.col("x").between(0, size[0] - 1) & F.col("y").between(0, size[1] - 1))
    for c, most in (("x", size[0]), ("y", size[1])):
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.col(c), F.least(F.col(c) + wide - 1, F.lit(most - 1)))))
    mean = F.sum("s") / (F.sum("k") * (100 if threshold is None else 1))
    return cells.groupBy("bag_id", "cx", "cy").agg((mean if threshold is None else F.rint(mean)).alias("value"))


def pick_level(slides: DataFrame, patch: int, step: int) -> DataFrame:
    """slides (native, target, downsamples: an array from level 0 on) with level, scale, patch_size, step_size and status.

    Levels have the magnification native / zoom ** k, zoom being how much smaller level 1 is than level 0. The target's own level is taken, or else the
    nearest higher one with scale = its magnification / target, by which patch and step grow (cut to whole numbers). A target above the native
    magnification, or a null, has no level and the status failed_for_mag; others have tbp.
    """
    zoom = F.expr("if(size(downsamples) > 1, cast(downsamples[1] as int) div cast(downsamples[0] as int), 1)")
    out = slides.withColumn("__zoom", zoom).withColumn("__mags", F.expr("transform(sequence(0, size(downsamples) - 1), k -> double(native) / pow(double(__zoom), k))"))
    found: Column = F.expr("case when target > native or target is null or native is null then null when target = native then double(native) when array_contains(__mags, double(target)) then double(target) else array_min(filter(__mags, m -> m > target)) end")
    out = out.withColumn("__mag", found).withColumn("level", F.expr("if(__mag is null, null, cast(array_position(__mags, __mag) - 1 as int))"))
    out = out.withColumn("scale", F.expr("if(__mag = target or target = native, null, __mag / target)"))
    grown = lambda n: F.when(F.col("level").isNull(), None).otherwise((F.lit(n) * F.coalesce("scale", F.lit(1.0))).cast("int"))
    status = F.when(F.col("level").isNull(), "failed_for_mag").otherwise("tbp")
    return out.withColumns({"patch_size": grown(patch), "step_size": grown(step), "status": status}).drop("__zoom", "__mags", "__mag")
