"""Neighbours inside bags and pairs of bags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_placed, hash_uniform, placed
from .blocks import nearest


def knn_graph(inst: DataFrame, k: int = 5) -> DataFrame:
    """(bag_id, src, dst, dist): the k nearest others of each instance within its bag; the first idx of equally near ones. A bag of one has no edges."""
    return nearest(inst, inst, k).select("bag_id", "src", "dst", "dist")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverse ones; duplicates are kept."""
    return edges.unionAll(edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)) for c in edges.columns]))


def pair_bags(bags: DataFrame, seed: int = 0) -> DataFrame:
    """A random partner for each bag, whose ids are numbers (a permutation)."""
    ids = bags.select("bag_id").distinct().withColumn("all", F.lit(1))
    own = placed(ids, ["all"], F.floor(F.col("bag_id") / 1000), ["bag_id"])
    other = hash_placed(ids, ["all"], seed, "bag_id").select(F.col("bag_id").alias("partner"), "r")
    return own.select("bag_id", "r").join(other, "r").drop("r")


def chosen_pairs(bags: DataFrame, prob: float = 0.5, seed: int = 0) -> DataFrame:
    """pair_bags with `mixed`: true with probability prob, by a draw for each bag; never for a bag that is its own partner."""
    drawn = hash_uniform(seed + 1, "bag_id") < prob
    return pair_bags(bags, seed).withColumn("mixed", drawn & (F.col("bag_id") != F.col("partner")))
