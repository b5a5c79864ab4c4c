"""Pooling operators on small bags."""

from bagframe.operators import pooling
from bagframe.plans import QUERIES


def test_zscore_of_equal_values(spark):
    rows = [(1, 0, 0.1), (1, 1, 0.1), (1, 2, 0.1), (2, 0, 5.0), (3, 0, 1.0), (3, 1, 1.5)]
    out = pooling.zscore(spark.createDataFrame(rows, "bag_id long, idx long, score double")).collect()
    z = {(r["bag_id"], r["idx"]): r["z"] for r in out}
    assert len(z) == 6 and all(z[k] == 0 for k in z if k[0] < 3) and abs(z[3, 1] - 1) < 1e-6


def test_zscore_returns_all_instances(spark):
    sf = "/root/testdata/sf0.01"
    assert QUERIES["zscore_scores"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert QUERIES["zscore_positions"](spark, sf).count() == 64 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
