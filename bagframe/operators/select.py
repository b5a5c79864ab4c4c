"""Choosing, ordering and padding instances; epochs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order, placed


def _bag():
    return Window.partitionBy("bag_id")


def to_percentiles(inst: DataFrame, score: str = "score") -> DataFrame:
    """Adds pct: the tie-averaged rank within the bag, in percent."""
    ties = F.count("*").over(Window.partitionBy("bag_id", score))
    return inst.withColumn("pct", (F.rank().over(_bag().orderBy(score)) + (ties - 1) / 2) / F.count("*").over(_bag()) * 100)


def topk_instances(inst: DataFrame, k: int, highest: bool = True) -> DataFrame:
    """The k highest or lowest scored of each bag; the first idx of equal ones."""
    order = F.desc("score") if highest else F.asc("score")
    return inst.withColumn("r", F.row_number().over(_bag().orderBy(order, "idx"))).filter(F.col("r") <= k).drop("r")


def cap_bag(inst: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` random instances of each bag."""
    return inst.withColumn("r", F.row_number().over(_bag().orderBy(hash_order(seed, "bag_id", "idx")))).filter(F.col("r") <= most).drop("r")


def random_mask(inst: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keeps int(n (1 - rate)) random instances of each bag."""
    r = F.row_number().over(_bag().orderBy(hash_order(seed, "bag_id", "idx")))
    return inst.withColumn("r", r).withColumn("n", F.count("*").over(_bag())).filter(F.col("r") <= F.floor(F.col("n") * (1 - rate))).drop("r", "n")


def grid_coords(inst: DataFrame) -> DataFrame:
    """Adds x, y: places in a square of side ceil(sqrt(n))."""
    side = F.ceil(F.sqrt(F.count("*").over(_bag())))
    return inst.withColumn("x", F.col("idx") % side).withColumn("y", F.floor(F.col("idx") / side))


def map_back(capped: DataFrame, inst: DataFrame, score: str = "weight") -> DataFrame:
    """All instances with the score of those that were kept, 0 for the others."""
    kept = capped.select("bag_id", "idx", F.col(score).alias("__score"))
    return inst.join(kept, ["bag_id", "idx"], "left").withColumn(score, F.coalesce("__score", F.lit(0.0))).drop("__score")


def order_coords(tiles: DataFrame, offset: int = 0) -> DataFrame:
    """Adds place: the position by x, then y, from 0; offset is added to both coordinates."""
    if offset:
        tiles = tiles.withColumns({c: F.col(c) + offset for c in "xy"})
    return tiles.withColumn("place", F.row_number().over(_bag().orderBy("x", "y", "idx")) - 1)


def ntile_work(df: DataFrame, n: int, keys: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds part: n contiguous groups of each key's rows in order, larger ones first; groups beyond the rows stay empty. bucket must rise with the order and
    deals rows to tasks (by default thousands of a numeric first column). Rows with a null key or bucket are left out."""
    bucket = F.floor(F.col(order[0]) / 1000) if bucket is None else bucket
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__all"))
    ranked = placed(df.filter(bucket.isNotNull()), keys, bucket, order, "__place").join(sizes, keys)
    part = F.expr(f"if(__place <= (__all % {n}) * (__all div {n} + 1), (__place - 1) div (__all div {n} + 1) + 1, __all % {n} + (__place - 1 - (__all % {n}) * (__all div {n} + 1)) div (__all div {n}) + 1)")
    return ranked.withColumn("part", part.cast("int")).drop("__all", "__place")


def roi_filter(inst: DataFrame, low: tuple[float, float], high: tuple[float, float], shift: bool = False) -> DataFrame:
    """Instances in a box, sides included; shift: coordinates count from its corner."""
    kept = inst.filter(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))
    return kept.withColumns({c: F.col(c) - at for c, at in zip("xy", low)}) if shift else kept


def soft_filter(inst: DataFrame, t: float = 0.5) -> DataFrame:
    """Adds kept: score above t, or true for all of a bag in which none is."""
    passes = F.col("score") > t
    return inst.withColumn("kept", passes | ~F.max(passes).over(_bag()))


def soft_scale(inst: DataFrame, t: float = 0.5) -> DataFrame:
    """soft_filter with feat times the score: kept rows go on, the others (kept false) are the rest."""
    return soft_filter(inst, t).withColumn("feat", F.transform("feat", lambda x: x.cast("double") * F.col("score")))


def range_between(inst: DataFrame, k: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """At most k random instances of each bag whose score lies in [low, high]."""
    return cap_bag(inst.filter(F.col("score").between(low, high)), k, seed)


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The first epoch with the highest value above 0 of each run; 1 if none is."""
    good = F.when(F.col("value") > 0, F.struct("value", -F.col("epoch")))
    return epochs.groupBy("run").agg(F.coalesce(F.max_by("epoch", good), F.lit(1)).alias("epoch"))


def patience_counter(epochs: DataFrame, patience: int, stop_epoch: int = 0) -> DataFrame:
    """Adds waited (epochs since the value last reached the running minimum) and stop: waited so long, after stop_epoch."""
    w = Window.partitionBy("run").orderBy("epoch")
    low = epochs.withColumn("low", F.min("value").over(w))
    last = F.max(F.when(F.col("value") <= F.col("low"), F.col("epoch"))).over(w)
    return low.withColumn("waited", F.col("epoch") - last).withColumn("stop", (F.col("waited") >= patience) & (F.col("epoch") > stop_epoch)).drop("low")


def early_stop_epoch(epochs: DataFrame, patience: int) -> DataFrame:
    """(run, epoch): the first epoch whose value `patience` epochs ago exceeds all since; runs without one have no row."""
    w = Window.partitionBy("run").orderBy("epoch")
    since = F.max("value").over(w.rowsBetween(1 - patience, Window.currentRow))
    marked = epochs.select("run", "epoch", (F.lag("value", patience).over(w) > since).alias("stop"))
    return marked.filter("stop").groupBy("run").agg(F.min("epoch").alias("epoch"))


def kfold_merge(folds: DataFrame) -> DataFrame:
    """(metric, mean, std): over the folds of (fold, metric, value); std of the population."""
    return folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def epoch_log(epochs: DataFrame, metrics: list[str]) -> DataFrame:
    """Long (run, metric, value) rows as one wide row for each run."""
    return epochs.groupBy("run").pivot("metric", metrics).agg(F.avg("value"))


def best_row(log: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of a wide log (run, epoch, ...) at each run's best epoch (run, epoch)."""
    return log.join(best, ["run", "epoch"])
