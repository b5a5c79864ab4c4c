"""Small cases that the tables do not hold: bags of one, k above the bag, equal scores, lacking classes, empty sides, ratios that give no rows."""

import pytest
from pyspark.sql import functions as F

from bagframe.functions.rand import hash_order, hash_placed
from bagframe.operators import attention, clusters, graphs, manifests, metrics, pooling, splits


@pytest.fixture(scope="module")
def inst(spark):
    rows = [(1, 0, [1.0, 0.0], 2.0), (2, 0, [0.0, 0.0], 1.0), (2, 1, [0.0, 2.0], 1.0), (2, 2, [3.0, 1.0], 1.0)]
    return spark.createDataFrame(rows, "bag_id long, idx long, feat array<double>, score double")


def test_bag_of_one_and_equal_scores(inst):
    z = {(r["bag_id"], r["idx"]): r["z"] for r in pooling.zscore(inst).collect()}
    assert set(z.values()) == {0.0}
    edges = clusters.affinity_graph(inst, 10, 2).collect()
    assert sum(r["bag_id"] == 1 for r in edges) == 1 and sum(r["bag_id"] == 2 for r in edges) == 9
    assert all(abs(r["w"] - 1) < 1e-9 for r in edges if r["bag_id"] == 1)
    bags, contrib = attention.additive_pool(inst.withColumn("logits", F.col("feat")), "logits", 2)
    assert {r["bag_id"]: r["logits"] for r in bags.collect()}[1] == [1.0, 0.0] and contrib.count() == 4
    assert clusters.stochastic_topk_mask(inst, 10, 1.0).filter("weight is not null").count() == 0


def test_critical_instance_of_ties(inst):
    out = attention.critical_attention(inst.withColumn("logits", F.array(F.lit(1.0))), "logits", 1, 2)
    assert {r["bag_id"] for r in out.collect()} == {1, 2}  # ties: the first instance, a zero vector, attends to all alike
    assert next(r["feat"] for r in out.collect() if r["bag_id"] == 2) == pytest.approx([1.0, 1.0])


def test_lacking_classes(spark):
    preds = spark.createDataFrame([(0, 0, [0.7, 0.2, 0.1]), (0, 2, [0.1, 0.2, 0.7]), (1, 1, [0.2, 0.5, 0.3])], "y int, yhat int, probs array<double>")
    row = metrics.roc_auc_ovr(preds).first()
    assert row["macro"] is None and row["nanmean"] is not None  # class 2 is predicted, never true
    assert metrics.evaluate_all(preds).count() == 1
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p1 double")
    assert metrics.roc_auc_binary(one).first()["auc"] == -1.0


def test_places(spark):
    ids = spark.range(0, 5000).selectExpr("id as slide_id", "id % 2 as label")
    got = [r["slide_id"] for r in hash_placed(ids, ["label"], 3, "slide_id").filter("label = 1").orderBy("r").collect()]
    want = [r["slide_id"] for r in ids.filter("label = 1").orderBy(hash_order(3, "slide_id")).collect()]
    assert got == want
    few = ids.filter("slide_id < 3")
    assert splits.stratified_kfold(few, 5).count() == 3
    assert splits.stratified_split(few, {"train": 0.9, "val": 0.1}).filter("role = 'val'").count() == 0
    assert splits.kfold_then_val(few, 2, 0.5).groupBy("fold").count().count() == 2
    pairs = graphs.pair_bags(ids.selectExpr("slide_id as bag_id")).collect()
    assert len({r["partner"] for r in pairs}) == len(pairs) == 5000


def test_manifest_and_wide_form(spark, tmp_path):
    (tmp_path / "m.csv").write_text("slide_path,label\na/b.svs,1\nc.svs,\n,0\n")
    assert [tuple(r) for r in manifests.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("a/b.svs", "1")]
    long = spark.createDataFrame([("a", 0, "train"), ("b", 1, "train"), ("c", 0, "test")], "slide_id string, label int, role string")
    wide = manifests.write_split_wide(long, ["train", "val", "test"]).orderBy("position").collect()
    assert [r["train_slide_path"] is not None for r in wide] == [True, True] and [r["val_label"] for r in wide] == [None, None]
    coords = spark.createDataFrame([("x/p.jpg", 1, 5, 6), ("y/p.png", 2, 7, 8)], "path string, nth int, x int, y int")
    found = manifests.attach_coords(spark.createDataFrame([("q/p.h5",), ("z.h5",)], "path string"), coords, "nth").orderBy("path").collect()
    assert [(r["x"], r["y"]) for r in found] == [(7, 8), (None, None)]
