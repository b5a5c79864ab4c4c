"""Weighted neighbours, clusters and windows inside bags, instance-level losses, masks and samples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order
from ..functions.vectors import elementwise, vec_cosine, vec_dot, vec_norm
from .blocks import most_alike


def affinity_graph(inst: DataFrame, k: int, dim: int) -> DataFrame:
    """(bag_id, src, dst, w): the k instances (itself too) of the highest feat . feat / sqrt(dim), softmax over these; of equal ones the lowest idx."""
    own = Window.partitionBy("bag_id", "src")
    top = most_alike(inst, k, dim)
    e = F.exp(F.col("s") - F.max("s").over(own))
    return top.withColumn("e", e).select("bag_id", "src", "dst", (F.col("e") / F.sum("e").over(own)).alias("w"))


def neighbour_aggregate(edges: DataFrame, inst: DataFrame, dim: int) -> DataFrame:
    """(bag_id, idx, feat): the sum of the neighbours' features by the edges' weights w."""
    joined = edges.join(inst.select("bag_id", F.col("idx").alias("dst"), "feat"), ["bag_id", "dst"])
    weighted = joined.withColumn("feat", F.transform("feat", lambda x: x * F.col("w")))
    return weighted.groupBy("bag_id", F.col("src").alias("idx")).agg(elementwise(F.sum, "feat", dim).alias("feat"))


def soft_cluster_pool(memb: DataFrame, inst: DataFrame, dim: int) -> DataFrame:
    """(bag_id, k, feat): the sum of features by the membership (bag_id, idx, k, w)."""
    weighted = memb.join(inst.select("bag_id", "idx", "feat"), ["bag_id", "idx"]).withColumn("feat", F.transform("feat", lambda x: x * F.col("w")))
    return weighted.groupBy("bag_id", "k").agg(elementwise(F.sum, "feat", dim).alias("feat"))


def bag_prototypes(inst: DataFrame, dim: int) -> DataFrame:
    """(bag_id, cluster, feat): the mean feature of each cluster of a bag."""
    return inst.groupBy("bag_id", "cluster").agg(elementwise(F.avg, "feat", dim).alias("feat"))


def split_large_clusters(inst: DataFrame, size: int) -> DataFrame:
    """Adds window (from 0): a cluster (bag_id) of n >= 2 size is cut, in order of idx, into n div size windows, the larger ones first."""
    w = Window.partitionBy("bag_id")
    out = inst.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("idx")) - 1)
    out = out.withColumn("parts", F.expr(f"greatest(1, if(n >= {2 * size}, n div {size}, 1))")).withColumn("base", F.expr("n div parts")).withColumn("more", F.expr("n % parts"))
    place = F.expr("if(r < more * (base + 1), r div (base + 1), more + (r - more * (base + 1)) div base)")
    return out.withColumn("window", place).drop("n", "r", "parts", "base", "more")


def attention_diversity(attention: DataFrame) -> DataFrame:
    """(bag_id, diversity): the mean cosine of the attentions (bag_id, head, idx, a) of two heads."""
    a = attention.select("bag_id", "idx", F.col("head").alias("i"), F.col("a").alias("x"))
    b = attention.select("bag_id", "idx", F.col("head").alias("j"), F.col("a").alias("y"))
    pairs = a.join(b, ["bag_id", "idx"]).filter("i < j").groupBy("bag_id", "i", "j")
    cosine = pairs.agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("c"))
    return cosine.groupBy("bag_id").agg(F.avg("c").alias("diversity"))


def triplet_loss(triples: DataFrame, margin: float = 1.0) -> DataFrame:
    """The mean of max(0, dist(a, p) - dist(a, n) + margin) by cosine distances."""
    return triples.agg(F.avg(F.greatest(F.lit(0.0), vec_cosine(F.col("a"), F.col("n")) - vec_cosine(F.col("a"), F.col("p")) + margin)).alias("loss"))


def bag_importance(inst: DataFrame, bags: DataFrame) -> DataFrame:
    """Adds importance, the product of an instance's feature and its bag's."""
    return inst.join(bags.select("bag_id", F.col("feat").alias("bag_feat")), "bag_id").withColumn("importance", vec_dot(F.col("feat"), F.col("bag_feat"))).drop("bag_feat")


def instance_eval(inst: DataFrame, prob: Column, k: int) -> DataFrame:
    """(bag_id, n, loss, accuracy) over the k highest scored instances, as class 1, and the k lowest, as class 0; prob: the probability of class 1.

    A bag of fewer than 2k instances has some in both."""
    w = Window.partitionBy("bag_id")
    ranked = inst.withColumn("p", prob).withColumn("up", F.row_number().over(w.orderBy(F.desc("score"), "idx"))).withColumn("down", F.row_number().over(w.orderBy("score", "idx")))
    both = ranked.filter(F.col("up") <= k).select("bag_id", "p", F.lit(1).alias("y")).union(ranked.filter(F.col("down") <= k).select("bag_id", "p", F.lit(0).alias("y")))
    loss = -F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    right = ((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")
    return both.groupBy("bag_id").agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("accuracy"))


def instance_eval_out(inst: DataFrame, prob: Column, k: int) -> DataFrame:
    """(bag_id, n, loss, accuracy) of a class that is not the bag's: the k highest scored instances should be class 0; prob: the probability of class 1."""
    r = F.row_number().over(Window.partitionBy("bag_id").orderBy(F.desc("score"), "idx"))
    top = inst.withColumn("p", prob).withColumn("r", r).filter(F.col("r") <= k)
    return top.groupBy("bag_id").agg(F.count("*").alias("n"), F.avg(-F.log(1 - F.col("p"))).alias("loss"), F.avg((F.col("p") <= 0.5).cast("double")).alias("accuracy"))


def class_importance(inst: DataFrame, bags: DataFrame, weights: list[list[float]], temp: float = 2.0) -> DataFrame:
    """(bag_id, idx, importance): the softmax over a bag (temperature temp, 1e-8 below) of feat . w, w being the weights of the bag's class (bags: bag_id, yhat)."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    dots = inst.join(bags.select("bag_id", "yhat"), "bag_id").select("bag_id", "idx", (vec_dot(F.col("feat"), F.element_at(table, F.col("yhat").cast("int") + 1)) / temp).alias("s"))
    w = Window.partitionBy("bag_id")
    e = dots.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("bag_id", "idx", (F.col("e") / (F.sum("e").over(w) + 1e-8)).alias("importance"))


def stochastic_topk_mask(inst: DataFrame, n: int, share: float, seed: int = 0) -> DataFrame:
    """Adds masked and weight: of a bag's n highest scores floor(n share) by a hash get weight 0, the others softmax(score); null where all are masked."""
    w = Window.partitionBy("bag_id")
    top = F.row_number().over(w.orderBy(F.desc("score"), "idx")) <= n
    out = inst.withColumn("top", top).withColumn("draw", F.row_number().over(Window.partitionBy("bag_id", "top").orderBy(hash_order(seed, "bag_id", "idx"))))
    out = out.withColumn("masked", F.col("top") & (F.col("draw") <= int(n * share)))
    kept = F.when(~F.col("masked"), F.col("score"))
    e = F.coalesce(F.exp(kept - F.max(kept).over(w)), F.lit(0.0))
    return out.withColumn("e", e).withColumn("weight", F.try_divide(F.col("e"), F.sum("e").over(w))).drop("top", "draw", "e")


def sample_patches(inst: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n random instances of each bag."""
    r = F.row_number().over(Window.partitionBy("bag_id").orderBy(hash_order(seed, "bag_id", "idx")))
    return inst.withColumn("r", r).filter(F.col("r") <= n).drop("r")


def parse_patch_name(name: Column) -> Column:
    """struct(x, y) of 'X_Y.ext'; nulls where there are no such numbers."""
    part = lambda i: F.regexp_extract(name, r"^(-?\d+)_(-?\d+)\.", i).try_cast("bigint")
    return F.struct(part(1).alias("x"), part(2).alias("y"))


def parse_ids(text: Column) -> Column:
    """The numbers of '1,2'; 'none', null and empty texts have none."""
    return F.when(text.isNull() | F.lower(F.trim(text)).isin("none", ""), F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x).cast("bigint")))


def init_process_list(slides: DataFrame, defaults: dict) -> DataFrame:
    """Adds the parameters that are lacking and fills their nulls with the defaults; process is 1 and status 'tbp'."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in slides.columns else F.lit(v) for c, v in defaults.items()}
    return slides.withColumns(filled).withColumn("process", F.lit(1)).withColumn("status", F.lit("tbp"))


def pending_work(proc: DataFrame, done: DataFrame, most_area: float = 1e8, lacking: str = "failed_for_level") -> DataFrame:
    """Sets status: already_exist for slides of `done`, `lacking` (failed_for_mag where levels come from magnifications) without a level, failed_seg where the level's area is above most_area, else tbp."""
    seen = done.select("slide_id").distinct().withColumn("seen", F.lit(True))
    status = F.when(F.col("seen"), "already_exist").when(F.col("level").isNull(), lacking).when(F.col("area") > most_area, "failed_seg").otherwise("tbp")
    return proc.join(seen, "slide_id", "left").withColumn("status", status).drop("seen")


def representatives(inst: DataFrame) -> DataFrame:
    """(bag_id, cluster, idx, feat): the instance of each cluster with the highest score, the first of equal ones."""
    best = F.max(F.struct("score", (-F.col("idx")).alias("back"), "feat")).alias("m")
    return inst.groupBy("bag_id", "cluster").agg(best).select("bag_id", "cluster", (-F.col("m.back")).alias("idx"), "m.feat")


def representative_graph(reps: DataFrame) -> DataFrame:
    """(bag_id, src, dst, similarity): from each cluster's representative (bag_id, cluster, feat) the edge to the other one of the bag with the highest cosine
    (nine digits; the lowest cluster of equal ones). Bags have few clusters; one alone has no edge."""
    a = reps.select("bag_id", F.col("cluster").alias("src"), F.col("feat").alias("a"))
    b = reps.select("bag_id", F.col("cluster").alias("dst"), F.col("feat").alias("b"))
    met = a.join(b, "bag_id").filter("src != dst").select("bag_id", "src", "dst", F.round(vec_cosine(F.col("a"), F.col("b")), 9).alias("s"))
    return met.groupBy("bag_id", "src").agg(F.max(F.struct("s", (-F.col("dst")).alias("back"))).alias("m")).select("bag_id", "src", (-F.col("m.back")).alias("dst"), F.col("m.s").alias("similarity"))


def zero_shot_logits(prompts: DataFrame, inst: DataFrame, dim: int) -> DataFrame:
    """inst with logits: the dot products of its normalised feature and each class's vector, in the order of class.

    A class's vector is the mean of the normalised vectors of its prompts (class, feat), normalised again. Zero vectors stay zero. The classes' vectors
    are one row that every task gets; prompts are added up by class first.
    """
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.nullif(vec_norm(v), F.lit(0.0)))
    whole = lambda v: F.transform(unit(v), lambda x: F.coalesce(x, F.lit(0.0)))
    means = prompts.select("class", whole(F.col("feat")).alias("feat")).groupBy("class").agg(elementwise(F.avg, "feat", dim).alias("feat"))
    row = means.select("class", whole(F.col("feat")).alias("feat")).agg(F.array_sort(F.collect_list(F.struct("class", "feat"))).alias("__classes"))
    scored = inst.crossJoin(F.broadcast(row)).withColumn("__unit", whole(F.col("feat")))  # one row
    return scored.withColumn("logits", F.transform("__classes", lambda c: vec_dot(F.col("__unit"), c["feat"]))).drop("__classes", "__unit")


def override_params(proc: DataFrame, defaults: dict, preset: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """proc (slide_id and more) with a column for each default: the slide's value of `rows` (slide_id, ...), else the preset's (its first row), else the
    default's. Nulls and empty strings do not count; values are cast to the default's type; unknown columns are ignored. Of several rows of
    a slide the greatest counts."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    out, layers = proc, []
    names = list(defaults)
    if rows is not None:
        own = [c for c in names if c in rows.columns]
        one = rows.groupBy("slide_id").agg(F.max(F.struct(*own)).alias("__row")) if own else None
        if one is not None:
            out, layers = out.join(one, "slide_id", "left"), [("__row", own)]
    if preset is not None:
        own = [c for c in names if c in preset.columns]
        if own:
            out = out.crossJoin(F.broadcast(preset.limit(1).select(F.struct(*own).alias("__preset"))))  # one row
            layers.append(("__preset", own))
    for name, value in defaults.items():
        kind = kinds[type(value)]
        given = [F.nullif(F.col(f"{at}.{name}").cast("string"), F.lit("")).cast(kind) for at, own in layers if name in own]
        out = out.withColumn(name, F.coalesce(*given, F.lit(value).cast(kind)))
    return out.drop("__row", "__preset")


def drop_blank_patches(inst: DataFrame, sat_t: float = 5, rgb_t: float = 40) -> DataFrame:
    """Patches (sat, r, g, b: means) that are neither white (saturation below sat_t) nor black (all three below rgb_t). Those without a mean go."""
    return inst.filter((F.col("sat") >= sat_t) & ~((F.col("r") < rgb_t) & (F.col("g") < rgb_t) & (F.col("b") < rgb_t)))


def drop_blank_pixels(inst: DataFrame, dark: int = 20, dark_share: float = 0.05, bright: int = 220, bright_share: float = 0.2) -> DataFrame:
    """Patches whose pixels (an array of struct r, g, b) are dark in all colours in no more than dark_share of places and bright in no more than bright_share.
    A patch without pixels stays."""
    share = lambda test: F.size(F.filter("pixels", test))
    black = share(lambda p: (p["r"] < dark) & (p["g"] < dark) & (p["b"] < dark)) > F.size("pixels") * dark_share
    white = share(lambda p: (p["r"] > bright) & (p["g"] > bright) & (p["b"] > bright)) > F.size("pixels") * bright_share
    return inst.filter(F.coalesce(~(black | white), F.lit(True)))


def grid_place(inst: DataFrame, by_coords: bool = True, steps: int = 100) -> DataFrame:
    """(bag_id, row, col, idx): the cell of each instance in its bag's grid; of several in a cell the last idx.

    By coordinates: x and y from smallest to largest onto 0..steps in single precision, cut to whole numbers; a side without extent is one cell wide.
    Otherwise a square just large enough, row by row of idx.
    """
    if not by_coords:
        sizes = inst.groupBy("bag_id").agg(F.ceil(F.sqrt(F.count("*").cast("double"))).alias("side"))
        return inst.select("bag_id", "idx").join(sizes, "bag_id").selectExpr("bag_id", "idx div side as row", "idx % side as col", "idx")
    ends = inst.groupBy("bag_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    at = lambda c: F.expr(f"cast(cast(float({c} - low_{c}) / float(float(high_{c} - low_{c}) + float(1e-8)) as float) * float(if(high_{c} > low_{c}, {steps}, 0)) as bigint)")
    cells = inst.join(ends, "bag_id").select("bag_id", at("x").alias("row"), at("y").alias("col"), "idx")
    return cells.groupBy("bag_id", "row", "col").agg(F.max("idx").alias("idx"))
