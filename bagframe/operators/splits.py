"""Splits and sampling weights of slides (slide_id, case_id, label)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_placed, placed


def _ranked(slides: DataFrame, seed: int) -> DataFrame:
    return hash_placed(slides, ["label"], seed, "slide_id")


def stratified_kfold(slides: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: the position in (label, hash) order modulo k. Only the labels' counts are ordered as a whole."""
    sizes = slides.groupBy("label").agg(F.count("*").alias("n"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("label", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return _ranked(slides, seed).join(offsets, "label").withColumn("fold", (F.col("offset") + F.col("r") - 1) % k).drop("r", "offset")


def stratified_split(slides: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds role: shares of each label by falling position; role borders are rounded to the nearest."""
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    ranked = _ranked(slides, seed).join(slides.groupBy("label").agg(F.count("*").alias("n")), "label")
    role, total = None, 0.0
    for name, share in ratios.items():
        total += share
        at = F.col("r") <= F.floor(F.col("n") * round(total, 9) + 0.5)
        role = F.when(at, name) if role is None else role.when(at, name)
    return ranked.withColumn("role", role).drop("r", "n")


def split_descriptor(splits: DataFrame, roles: list[str]) -> DataFrame:
    return splits.groupBy("label").agg(*[F.sum((F.col("role") == r).cast("long")).alias(r) for r in roles])


def balanced_weights(slides: DataFrame) -> DataFrame:
    """Adds w = 1 / count(label); the counts are a small table."""
    counts = slides.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("w"))
    return slides.join(counts, "label")


def map_labels(slides: DataFrame, mapping: dict[str, int], ignore: list[str]) -> DataFrame:
    """Drops ignored labels and replaces the others by numbers; a label without one is an error."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    number = F.create_map(*pairs)[F.col("label")]
    found = F.coalesce(number, F.raise_error(F.concat(F.lit("label without a number: "), F.col("label"))).cast("int"))
    return slides.filter(~F.col("label").isin(ignore)).withColumn("label", found)


def select_role(slides: DataFrame, splits: DataFrame, roles: list[str]) -> DataFrame:
    return slides.join(splits.filter(F.col("role").isin(roles)), "slide_id", "left_semi")


def pipeline_mode(splits: DataFrame) -> DataFrame:
    """One row: which of train, val and test have members; a mode without val and test is an error."""
    has = {r: F.count(F.when(F.col("role") == r, 1)) > 0 for r in ("val", "test")}
    mode = F.when(has["val"] & has["test"], "Train_Val_Test").when(has["val"], "Train_Val").when(has["test"], "Train_Test")
    return splits.agg(F.coalesce(mode, F.raise_error(F.lit("neither val nor test has members")).cast("string")).alias("mode"))


def leakage_check(splits: DataFrame, key: str) -> DataFrame:
    """(a, b, shared): how many keys two roles share; pairs of roles that share none have no row."""
    of = splits.select(key, "role").distinct()
    both = of.withColumnRenamed("role", "a").join(of.withColumnRenamed("role", "b"), key).filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


def quota_split(slides: DataFrame, val_n: int, test_n: int, share: float = 1.0, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(repeat, slide_id, label, role): val_n and test_n random slides of each label, and of the rest the first ceil(share n) by id for training."""
    many = slides.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = hash_placed(many, ["repeat", "label"], seed, "repeat", "slide_id")
    role = F.when(F.col("r") <= val_n, "val").when(F.col("r") <= val_n + test_n, "test").otherwise("train")
    dealt = ranked.withColumn("role", role).drop("r")
    if share >= 1:
        return dealt
    train = dealt.filter("role = 'train'")
    numeric = slides.schema["slide_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    bucket = F.floor(F.col("slide_id") / 1000) if numeric else F.substring(F.col("slide_id").cast("string"), 1, 4)  # both rise with the id
    sizes = train.groupBy("repeat", "label").agg(F.count("*").alias("n"))
    first = placed(train, ["repeat", "label"], bucket, ["slide_id"]).join(sizes, ["repeat", "label"]).filter(F.col("r") <= F.ceil(F.col("n") * share))
    return dealt.filter("role != 'train'").unionByName(first.drop("r", "n"))


def patient_split(slides: DataFrame, cases: DataFrame, val_n: int, test_n: int, seed: int = 0) -> DataFrame:
    """(slide_id, case_id, role): cases (case_id, label) are split by quota; slides follow their case."""
    roles = quota_split(cases.withColumnRenamed("case_id", "slide_id"), val_n, test_n, seed=seed).select(F.col("slide_id").alias("case_id"), "role")
    return slides.select("slide_id", "case_id").join(roles, "case_id")


def holdout_then_kfold(slides: DataFrame, test: float, k: int, seed: int = 0) -> DataFrame:
    """(fold, slide_id, role): a share held out for every fold's test; of the rest, fold f is val and the others train."""
    held = stratified_split(slides, {"rest": 1 - test, "test": test}, seed)
    rest = stratified_kfold(held.filter("role = 'rest'").drop("role"), k, seed).select("slide_id", F.col("fold").cast("long").alias("own"))
    all_ = rest.unionByName(held.filter("role = 'test'").select("slide_id", F.lit(None).cast("long").alias("own")))
    out = all_.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    return out.select("fold", "slide_id", F.when(F.col("own").isNull(), "test").when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("role"))


def kfold_then_val(slides: DataFrame, k: int, val: float, seed: int = 0) -> DataFrame:
    """(fold, slide_id, role): fold f is the test of split f; of the others a share `val` of each label is val and the rest train."""
    own = stratified_kfold(slides, k, seed).withColumnRenamed("fold", "own")
    every = own.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    rest = every.filter("own != fold")
    counts = rest.groupBy("fold", "label").agg(F.count("*").alias("n"))
    ranked = hash_placed(rest, ["fold", "label"], seed + 1, "fold", "slide_id").join(counts, ["fold", "label"])
    role = F.when(F.col("r") <= F.floor(F.col("n") * val + 0.5), "val").otherwise("train")
    return ranked.select("fold", "slide_id", role.alias("role")).union(every.filter("own = fold").select("fold", "slide_id", F.lit("test").alias("role")))


def fold_modes(splits: DataFrame) -> DataFrame:
    """(fold, mode) of each fold of (fold, role): pipeline_mode fold by fold."""
    has = {r: F.count(F.when(F.col("role") == r, 1)) > 0 for r in ("val", "test")}
    mode = F.when(has["val"] & has["test"], "Train_Val_Test").when(has["val"], "Train_Val").when(has["test"], "Train_Test")
    return splits.groupBy("fold").agg(F.coalesce(mode, F.raise_error(F.lit("neither val nor test has members")).cast("string")).alias("mode"))


def quota_split_fixed(slides: DataFrame, fixed: DataFrame, val_n: int, share: float = 1.0, repeats: int = 1, seed: int = 0) -> DataFrame:
    """quota_split of the slides outside `fixed` (slide_id), which are every repeat's test."""
    ids = fixed.select("slide_id").distinct()
    rest = quota_split(slides.join(ids, "slide_id", "left_anti"), val_n, 0, share, repeats, seed)
    held = slides.join(ids, "slide_id", "left_semi").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("role", F.lit("test"))
    return rest.select("repeat", "slide_id", "label", "role").unionByName(held.select("repeat", "slide_id", "label", "role"))


def stratified_split_exact(slides: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """stratified_split with each label's counts by largest remainders: the whole parts of n times the ratios, and what is left to the largest fractions, the
    first of equal ones (nine digits)."""
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    names = list(ratios)
    quotas = F.array(*[F.round(F.col("n") * F.lit(float(r)), 9) for r in ratios.values()])
    counts = slides.groupBy("label").agg(F.count("*").alias("n")).withColumn("q", quotas)
    counts = counts.withColumn("left", F.expr("n - aggregate(q, 0L, (s, x) -> s + cast(floor(x) as bigint))"))
    counts = counts.withColumn("order", F.expr("transform(array_sort(transform(q, (x, i) -> struct(floor(x) - x as f, i as i))), x -> x.i)"))
    counts = counts.withColumn("c", F.expr("transform(q, (x, i) -> cast(floor(x) as bigint) + if(array_position(order, i) <= left, 1L, 0L))"))
    counts = counts.withColumn("ends", F.expr("transform(c, (x, i) -> aggregate(slice(c, 1, i + 1), 0L, (s, y) -> s + y))")).select("label", "ends")
    place = F.expr("size(filter(ends, e -> e < r))")
    return _ranked(slides, seed).join(counts, "label").withColumn("role", F.element_at(F.array(*map(F.lit, names)), place + 1)).drop("r", "ends")
