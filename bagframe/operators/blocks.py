"""Work on pairs of instances of a bag, or of two bags, in blocks: no task holds a bag, and no row is made for a pair.

A bag's instances are gathered in blocks of BLOCK rows. Pairs of blocks meet by (bag, block, block), so a bag's pairs are spread over all tasks; numpy
goes through the pairs of one pair of blocks at a time and gives out a few numbers for each instance, which Spark merges. The work stays n x n for a
bag of n, the rows n x n / BLOCK.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Instances of a block.
BLOCK = 256


def blocked(inst: DataFrame, size: int = BLOCK) -> DataFrame:
    """(bag_id, block, n_blocks, idx, feat): blocks of `size` instances of a bag in the order of idx, as arrays. Numbers are dealt by ranges of idx, so
    no task orders a bag. Rows without bag or idx are left out."""
    rows = inst.select("bag_id", F.col("idx").cast("long").alias("idx"), F.transform("feat", lambda x: x.cast("double")).alias("feat"))
    rows = rows.filter("bag_id is not null and idx is not null and feat is not null")
    grouped = rows.groupBy("bag_id", F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "feat"))).alias("r"))
    # Repeated idx can fill a block further: it is cut again.
    parts = grouped.select("bag_id", "block", F.posexplode(F.expr(f"transform(sequence(0, (size(r) - 1) div {size}), i -> slice(r, i * {size} + 1, {size}))")).alias("part", "r"))
    return parts.select("bag_id", F.struct("block", "part").alias("block"), F.col("r.idx").alias("idx"), F.col("r.feat").alias("feat"))


def block_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(bag_id, partner, idx, feat, idx_b, feat_b): each block of a bag beside each block of its partner (itself without `pairs`: bag_id, partner).

    Only block names are joined bag by bag; blocks then go to their pairs by (bag, block, block).
    """
    names, partners = left.select("bag_id", "block"), right.select(F.col("bag_id").alias("partner"), F.col("block").alias("block_b"))
    names = names.join(pairs.select("bag_id", "partner").distinct(), "bag_id") if pairs is not None else names.withColumn("partner", F.col("bag_id"))
    met = names.join(partners, "partner")
    other = right.select(F.col("bag_id").alias("partner"), F.col("block").alias("block_b"), F.col("idx").alias("idx_b"), F.col("feat").alias("feat_b"))
    return met.join(left, ["bag_id", "block"]).join(other, ["partner", "block_b"]).select("bag_id", "partner", "idx", "feat", "idx_b", "feat_b")


def _matrix(column, row: int) -> np.ndarray:
    values = column[row].values
    return np.asarray(values.flatten()).reshape(len(values), -1)


def per_pair(pairs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Runs kernel(idx, a, idx_b, b) on each pair of blocks; it gives columns with a row for each instance (or chosen pair) of a. schema: those columns."""
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[p.split()[1]] for p in schema.split(", ")]
    of_bag = pairs.schema["bag_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                idx, idx_b = np.asarray(batch.column(2)[row].values), np.asarray(batch.column(4)[row].values)
                out = kernel(idx, _matrix(batch.column(3), row), idx_b, _matrix(batch.column(5), row))
                arrays = [pa.array(list(x) if t == pa.list_(pa.float64()) else x, t) for x, t in zip(out, types)]
                keys = [pa.array([batch.column(k)[row].as_py()] * len(arrays[0]), batch.column(k).type) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], names=["bag_id", "partner", *names])

    return pairs.mapInArrow(run, f"bag_id {of_bag}, partner {of_bag}, {schema}")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("id,jd->ij", a, b)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: no digits are lost among near vectors."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        total += np.square(x[:, None] - y[None, :])
    return np.sqrt(total)


def _first(keys: np.ndarray, idx_b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of keys, the places of the k smallest; equal ones by idx_b."""
    order = np.lexsort((np.broadcast_to(idx_b, keys.shape), keys), axis=1)[:, :k]
    return np.repeat(np.arange(len(keys)), order.shape[1]), order.ravel()


def nearest(left: DataFrame, right: DataFrame, k: int, pairs: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """(bag_id, partner, src, dst, dist): for each instance the k nearest of its bag other than itself, or of its partner; equal ones by dst. Distances
    are rounded to nine digits."""
    within = pairs is None

    def kernel(idx, a, idx_b, b):
        d = np.round(_distances(a, b), 9)
        if within:
            d[idx[:, None] == idx_b[None, :]] = np.inf
        i, j = _first(d, idx_b, k)
        keep = np.isfinite(d[i, j])
        i, j = i[keep], j[keep]
        return idx[i], idx_b[j], d[i, j]

    found = per_pair(block_pairs(blocked(left, size), blocked(right, size), pairs), kernel, "src long, dst long, dist double")
    r = F.row_number().over(Window.partitionBy("bag_id", "partner", "src").orderBy("dist", "dst"))
    return found.withColumn("r", r).filter(F.col("r") <= k).drop("r")


def most_alike(inst: DataFrame, k: int, dim: int, size: int = BLOCK) -> DataFrame:
    """(bag_id, src, dst, s): for each instance the k of its bag (itself too) with the highest feat . feat / sqrt(dim), rounded to nine digits."""

    def kernel(idx, a, idx_b, b):
        s = np.round(_dots(a, b) / np.sqrt(dim), 9)
        i, j = _first(-s, idx_b, k)
        return idx[i], idx_b[j], s[i, j]

    blocks = blocked(inst, size)
    found = per_pair(block_pairs(blocks, blocks), kernel, "src long, dst long, s double")
    r = F.row_number().over(Window.partitionBy("bag_id", "src").orderBy(F.desc("s"), "dst"))
    return found.withColumn("r", r).filter(F.col("r") <= k).select("bag_id", "src", "dst", "s")


def _attended(pairs: DataFrame, dim: int, score: Callable) -> DataFrame:
    """(bag_id, idx, feat): for each instance the mean of the vectors that it meets, weighted by the softmax of score(a, b).

    A pair of blocks gives each instance the highest score, the sum of the exponentials below it and the sum of the vectors they weigh; such parts merge
    in any order, so no bag's scores exist at once.
    """

    def kernel(idx, a, idx_b, b):
        s = score(a, b)
        top = s.max(axis=1)
        e = np.exp(s - top[:, None])
        return idx, top, e.sum(axis=1), np.einsum("ij,jd->id", e, b)

    parts = per_pair(pairs, kernel, "idx long, top double, weight double, feat array<double>")
    best = parts.groupBy("bag_id", "idx").agg(F.max("top").alias("best"))
    scaled = parts.join(best, ["bag_id", "idx"]).withColumn("by", F.exp(F.col("top") - F.col("best")))
    whole = F.sum(F.col("weight") * F.col("by"))
    return scaled.groupBy("bag_id", "idx").agg(F.array(*[F.sum(F.col("feat")[i] * F.col("by")) / whole for i in range(dim)]).alias("feat"))


def context_attention(inst: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """(bag_id, idx, feat): every instance as the mean of its bag's, weighted by the softmax of feat . feat / sqrt(dim). A bag of one keeps its feature;
    repeated (bag_id, idx) share one row."""
    blocks = blocked(inst, size)
    return _attended(block_pairs(blocks, blocks), dim, lambda a, b: _dots(a, b) / np.sqrt(dim))


def nearest_center_context(inst: DataFrame, centres: DataFrame, dim: int, metric: str = "l2", hard: bool = True, scale: float = 1.0, size: int = BLOCK) -> DataFrame:
    """(bag_id, idx, feat): each instance with its centre of (k, centre) added: the nearest one, or that with the highest dot product (metric dot; the lowest
    k of equal ones, by nine digits); with hard off, the centres' mean by the softmax of -distance (or dot product) / scale. No centres: no rows."""
    of_bag = inst.schema["bag_id"].dataType
    own = blocked(inst, size)
    partner = F.lit(0).cast(of_bag)
    pairs = own.select("bag_id", partner.alias("partner")).distinct()
    other = blocked(centres.select(partner.alias("bag_id"), F.col("k").alias("idx"), F.col("centre").alias("feat")), size)
    met = block_pairs(own, other, pairs)
    score = (lambda a, b: -_distances(a, b)) if metric == "l2" else _dots

    def best(idx, a, idx_b, b):
        s = np.round(score(a, b), 9)
        place = np.lexsort((np.broadcast_to(idx_b, s.shape), -s), axis=1)[:, 0]
        return idx, s[np.arange(len(idx)), place], idx_b[place]

    if hard:
        found = per_pair(met, best, "idx long, top double, k long").groupBy("bag_id", "idx").agg(F.max(F.struct("top", -F.col("k"))).alias("m"))
        found = found.select("bag_id", "idx", (-F.col("m.col2")).alias("k")).join(centres, "k").select("bag_id", "idx", F.col("centre").alias("context"))
    else:
        found = _attended(met, dim, lambda a, b: score(a, b) / scale).withColumnRenamed("feat", "context")
    both = inst.select("bag_id", "idx", "feat").join(found, ["bag_id", "idx"])
    return both.select("bag_id", "idx", F.zip_with("feat", "context", lambda x, c: x.cast("double") + c).alias("feat"))
