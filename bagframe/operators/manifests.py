"""Manifests of slides, bags as rows of matrices, coordinates by file name, and wide forms of splits and predictions."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order
from ..functions.vectors import path_stem


def read_manifest(spark: SparkSession, path: str, slide: str = "slide_path", label: str = "label", form: str = "csv") -> DataFrame:
    """(slide_id, label) of a slide table; rows that lack either are dropped."""
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    return reader.format(form).load(path).select(F.col(slide).alias("slide_id"), F.col(label).alias("label")).dropna()


def explode_bags(bags: DataFrame, matrix: str = "features") -> DataFrame:
    """One row for each row of a bag's matrix, with its idx; a leading dimension of one is dropped (array<array<array>>)."""
    depth = bags.schema[matrix].dataType.simpleString().count("array<")
    rows = F.col(matrix)[0] if depth == 3 else F.col(matrix)
    return bags.select("bag_id", F.posexplode(rows).alias("idx", "feat")).withColumn("idx", F.col("idx").cast("long"))


def attach_coords(inst: DataFrame, index: DataFrame, order: str) -> DataFrame:
    """inst (path) with x and y of the index row (path, x, y) of the same file stem; of several the last by `order`. Others have nulls."""
    last = index.withColumn("stem", path_stem(F.col("path"))).groupBy("stem").agg(F.max(F.struct(order, "x", "y")).alias("m")).select("stem", "m.x", "m.y")
    return inst.withColumn("stem", path_stem(F.col("path"))).join(last, "stem", "left").drop("stem")


def bag_label_join(inst: DataFrame, slides: DataFrame) -> DataFrame:
    """Instances of the bags that the manifest has, with their label."""
    return inst.join(slides.select(F.col("slide_id").alias("bag_id"), "label"), "bag_id")


def filter_dict(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Rows whose columns hold one of the values given for each."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isin(v) for c, v in values.items()], F.lit(True)))


def write_split_wide(splits: DataFrame, roles: list[str], buckets: int = 64) -> DataFrame:
    """Long splits (slide_id, label, role) as one row per position with <role>_slide_path and <role>_label; shorter roles end in nulls.

    Positions are numbered within hash buckets of a role and moved by the buckets' sizes, so no task holds a whole role.
    """
    dealt = splits.withColumn("b", F.pmod(F.xxhash64("slide_id"), F.lit(buckets)))
    sizes = dealt.groupBy("role", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("role").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("role", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("role", "b").orderBy("slide_id")
    placed = dealt.withColumn("r", F.row_number().over(inside)).join(moved, ["role", "b"]).withColumn("position", F.col("first") + F.col("r"))
    cells = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{n}") for r in roles for c, n in (("slide_id", "slide_path"), ("label", "label"))]
    return placed.groupBy("position").agg(*cells)


def split_flags(splits: DataFrame, roles: list[str]) -> DataFrame:
    """The boolean form of splits: one row per slide, one column per role."""
    return splits.groupBy("slide_id").agg(*[F.bool_or(F.col("role") == r).alias(r) for r in roles])


def prediction_columns(preds: DataFrame, classes: int) -> DataFrame:
    """slide_id, Y, Y_hat and p_0 .. p_C of the array `probs`."""
    return preds.select("slide_id", F.col("y").alias("Y"), F.col("yhat").alias("Y_hat"), *[F.col("probs")[c].alias(f"p_{c}") for c in range(classes)])


def merge_roles(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Distinct slide ids of both (union) or of the first alone (difference)."""
    ids = a.select("slide_id"), b.select("slide_id")
    return ids[0].union(ids[1]).distinct() if op == "union" else ids[0].join(ids[1], "slide_id", "left_anti").distinct()


def balanced_sample(slides: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n slides without replacement, every label as likely as another: the smallest -ln(u) / w, w one by the label's count, u from a hash."""
    counts = slides.groupBy("label").agg(F.count("*").alias("n"))
    u = (F.conv(F.substring(hash_order(seed, "slide_id"), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32 + 1)
    keyed = slides.join(counts, "label").withColumn("k", -F.log(u) * F.col("n"))
    return keyed.orderBy("k", "slide_id").limit(n).drop("k", "n")


def center_shift(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds shift by overlap: below 0.25 0.375, below 0.95 0.5, else 0.625; 0 if not enabled."""
    shift = F.when(F.col("overlap") < 0.25, 0.375).when(F.col("overlap") < 0.95, 0.5).otherwise(0.625)
    return df.withColumn("shift", shift if enabled else F.lit(0.0))


def scale_area(df: DataFrame, base: int = 512) -> DataFrame:
    """a_t and a_h times the whole number of base squares in a pixel block of sx by sy."""
    times = F.floor(F.lit(float(base**2)) / (F.col("sx") * F.col("sy"))).cast("long")
    return df.withColumns({c: F.col(c) * times for c in ("a_t", "a_h")})


def old_area(df: DataFrame, base: int = 512) -> DataFrame:
    """a_t from an area `a` of older settings: a times the pixels of a block of sx by sy in a base square, cut to a whole number."""
    return df.withColumn("a_t", (F.col("a") * (F.col("sx") * F.col("sy")) / F.lit(float(base**2))).cast("long"))


def save_split_wide(splits: DataFrame, roles: list[str], path: str) -> None:
    """Writes write_split_wide as CSV files with a header, positions in order; what is there is replaced."""
    write_split_wide(splits, roles).orderBy("position").drop("position").write.mode("overwrite").option("header", True).csv(path)


def save_predictions(preds: DataFrame, classes: int, path: str) -> None:
    """Writes prediction_columns as Parquet; what is there is replaced."""
    prediction_columns(preds, classes).write.mode("overwrite").parquet(path)


def save_epoch_log(log: DataFrame, path: str) -> None:
    """Writes a wide log (run, epoch, ...) as Parquet, a folder for each run; what is there is replaced."""
    log.write.mode("overwrite").partitionBy("run").parquet(path)


def list_slides(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, stem, length) of all files below root that end in one of the extensions (with their point, in either case). Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    wanted = F.lower(F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./]*)$", 1))).isin([e.lower() for e in extensions])
    return files.filter(wanted).select("path", path_stem(F.col("path")).alias("stem"), "length")
