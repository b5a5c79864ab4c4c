"""Mixed bags, representatives, prompts, settings, grid places, reports and splits: bags of one, ties, zero vectors, empty sides, classes without rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.functions.rand import hash_uniform
from bagframe.operators import bags, clusters, manifests, metrics, mixing, pooling, select, splits
from bagframe.plans import ORACLE_SQL, QUERIES
from bagframe.sources import tables


@pytest.fixture(scope="module")
def inst(spark):
    draw = np.random.default_rng(8)
    rows = [(b, i, [float(x) for x in draw.normal(size=2)], float(draw.normal())) for b, n in ((1, 1), (2, 4), (3, 9), (4, 4)) for i in range(n)]
    return spark.createDataFrame(rows, "bag_id long, idx long, feat array<double>, score double").persist()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, 3), (2, 4), (3, 2), (4, 99)], "bag_id long, partner long")


def features(inst):
    return {(r["bag_id"], r["idx"]): np.array(r["feat"]) for r in inst.collect()}


def test_mixup(inst, pairs):
    f = features(inst)
    got = mixing.mixup(inst, pairs, 3).collect()
    lam = {r["bag_id"]: r["u"] for r in pairs.select("bag_id", hash_uniform(3, "bag_id").alias("u")).collect()}
    sizes = {1: 9, 2: 4, 3: 9}  # the longer bag's; a pair of an unknown bag has no rows
    assert {b: sum(r["pair_id"] == b for r in got) for b in (1, 2, 3, 4)} == {**sizes, 4: 0}
    for r in got:
        b, i, w = r["pair_id"], r["idx"], lam[r["pair_id"]]
        assert r["ratio"] == pytest.approx(w)
        partner = {1: 3, 2: 4, 3: 2}[b]
        options = [w * x + (1 - w) * y for (p, j), x in f.items() if p == b and (j == i or b == 1) for (q, k), y in f.items() if q == partner and (k == i or b == 3)]
        assert any(np.allclose(r["feat"], o) for o in options)


@pytest.mark.parametrize("rate,made", [(0.0, 0), (1.0, 14)])
def test_remix(inst, pairs, rate, made):
    """Rates of 0 and 1: nothing and every instance of the bags 1, 2 and 3 is met."""
    f = features(inst)
    for mode, more in (("replace", 0), ("append", made), ("interpolate", made)):
        got = mixing.remix(inst, pairs, mode, rate, 0.25).collect()
        assert len(got) == 14 + more and sum(r["made"] for r in got) == made
        assert len({(r["pair_id"], r["idx"]) for r in got}) == len(got)
        for r in got:
            if not r["made"]:
                assert np.allclose(r["feat"], f[r["pair_id"], r["idx"]])


def test_psebmix(inst, pairs):
    got = mixing.psebmix(inst, pairs, 2, 1).collect()
    assert len({(r["pair_id"], r["source"], r["idx"]) for r in got}) == len(got)
    for b in (1, 2, 3):
        own = [r for r in got if r["pair_id"] == b]
        sides = {r["source"] for r in own}
        want = 0.5 if len(sides) == 2 else float(sides == {b}) if sides else None
        assert all(r["ratio"] == want for r in own)


def test_shrink(inst, pairs):
    got = mixing.rankmix_shrink(inst, pairs, 2).collect()
    assert {b: sum(r["pair_id"] == b for r in got) for b in (1, 2, 3)} == {1: 2, 2: 8, 3: 8}
    assert all(r["ratio"] == 0.5 for r in got)


def test_representatives(spark):
    rows = [(1, 0, 0, [1.0, 0.0], 2.0), (1, 1, 0, [9.0, 9.0], 2.0), (1, 2, 1, [0.0, 0.0], 1.0), (1, 3, 2, [2.0, 0.1], 1.0), (2, 0, 0, [1.0, 1.0], 0.0)]
    reps = clusters.representatives(spark.createDataFrame(rows, "bag_id long, idx long, cluster long, feat array<double>, score double"))
    assert {(r["bag_id"], r["cluster"]): r["idx"] for r in reps.collect()} == {(1, 0): 0, (1, 1): 2, (1, 2): 3, (2, 0): 0}
    edges = {(r["bag_id"], r["src"]): r["dst"] for r in clusters.representative_graph(reps).collect()}
    assert edges == {(1, 0): 2, (1, 1): 0, (1, 2): 0}  # a zero vector is like none: the lowest; a lone cluster has no edge


def test_prompts(spark):
    prompts = spark.createDataFrame([("b", [0.0, 2.0]), ("a", [3.0, 0.0]), ("a", [0.0, 5.0]), ("c", [0.0, 0.0])], "class string, feat array<double>")
    patch = spark.createDataFrame([(1, 0, [0.0, 4.0]), (1, 1, [0.0, 0.0])], "bag_id long, idx long, feat array<double>")
    got = {r["idx"]: r["logits"] for r in clusters.zero_shot_logits(prompts, patch, 2).collect()}
    assert np.allclose(got[0], [math.sqrt(0.5), 1, 0]) and got[1] == [0, 0, 0]


def test_settings(spark):
    proc = spark.createDataFrame([(1,), (2,), (3,)], "slide_id long")
    rows = spark.createDataFrame([(1, 7.0, ""), (2, None, "basic")], "slide_id long, a_t double, contour_fn string")
    preset = spark.createDataFrame([(60.0, None)], "a_t double, vis int")
    got = {r["slide_id"]: (r["a_t"], r["contour_fn"], r["vis"]) for r in clusters.override_params(proc, {"a_t": 50.0, "contour_fn": "four_pt", "vis": -1}, preset, rows).collect()}
    assert got == {1: (7.0, "four_pt", -1), 2: (60.0, "basic", -1), 3: (60.0, "four_pt", -1)}
    assert clusters.override_params(proc, {"a_t": 50.0}).select("a_t").distinct().collect() == [(50.0,)]


def test_blank_patches(spark):
    rows = [(1, 4.0, 90.0, 90.0, 90.0), (2, 9.0, 39.0, 39.0, 39.0), (3, 9.0, 39.0, 39.0, 41.0), (4, 5.0, 40.0, 0.0, 0.0), (5, None, 90.0, 90.0, 90.0)]
    inst = spark.createDataFrame(rows, "id int, sat double, r double, g double, b double")
    assert sorted(r["id"] for r in clusters.drop_blank_patches(inst).collect()) == [3, 4]
    pixel = lambda n, dark, bright: [(1, 1, 1)] * dark + [(230, 230, 230)] * bright + [(100, 10, 240)] * (n - dark - bright)
    pixels = spark.createDataFrame([(1, pixel(20, 1, 4)), (2, pixel(20, 2, 0)), (3, pixel(20, 0, 5)), (4, [])], "id int, pixels array<struct<r:int,g:int,b:int>>")
    assert sorted(r["id"] for r in clusters.drop_blank_pixels(pixels).collect()) == [1, 4]


def test_grid_place(spark):
    rows = [(1, 0, 5, 5), (2, 0, 0, 0), (2, 1, 10, 20), (2, 2, 10, 20), (2, 3, 5, 10), (3, 0, 7, 0), (3, 1, 7, 8)]
    inst = spark.createDataFrame(rows, "bag_id int, idx int, x int, y int")
    got = {(r["bag_id"], r["row"], r["col"]): r["idx"] for r in clusters.grid_place(inst).collect()}
    assert got == {(1, 0, 0): 0, (2, 0, 0): 0, (2, 100, 100): 2, (2, 50, 50): 3, (3, 0, 0): 0, (3, 0, 100): 1}
    square = {(r["bag_id"], r["row"], r["col"]) for r in clusters.grid_place(inst, False).collect()}
    assert square == {(1, 0, 0), (2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1), (3, 0, 0), (3, 0, 1)}


def test_groups_and_quotas(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(9)], "slide_id long, label string")
    got = {}
    for r in select.ntile_work(rows, 3, ["label"], ["slide_id"]).collect():
        got.setdefault((r["label"], r["part"]), []).append(r["slide_id"])
    assert {k: sorted(v) for k, v in got.items()} == {("a", 1): [0, 1, 2], ("a", 2): [3, 4], ("a", 3): [5, 6], ("b", 1): [7], ("b", 2): [8]}
    fixed = splits.quota_split_fixed(rows, rows.filter("slide_id in (0, 8)"), 1, 0.5, 2).collect()
    assert {r["slide_id"] for r in fixed if r["role"] == "test"} == {0, 8} and all(sum(r["role"] == "val" and r["repeat"] == k for r in fixed) == 2 for k in (0, 1))
    exact = splits.stratified_split_exact(rows, {"x": 0.5, "y": 0.25, "z": 0.25}).groupBy("label", "role").count().collect()
    assert {(r["label"], r["role"]): r["count"] for r in exact} == {("a", "x"): 3, ("a", "y"): 2, ("a", "z"): 2, ("b", "x"): 1, ("b", "y"): 1}
    with pytest.raises(ValueError):
        splits.stratified_split_exact(rows, {"x": 0.5})


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 1.0, 100.0, -7.5], [2.0] * 5, [float(x * x % 37) for x in range(40)] + [None], []])
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = [v for v in values if v is not None]
    got = pooling.aggregate_array_median(df, "v").first()
    assert got["median"] == (float(np.median(own)) if own else None) and got["max"] == (max(own) if own else None)


def test_scores_of_any_range(spark):
    """Areas and curves of logits: scores need not lie between 0 and 1."""
    draw = np.random.default_rng(0)
    p, y = np.round(draw.normal(size=300) * 1e6, -4), draw.integers(2, size=300)
    preds = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p1 double, y int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert metrics.roc_auc_binary(preds).first()["auc"] == pytest.approx(want)
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in metrics.roc_curve(preds).collect()}
    assert all(points[t] == pytest.approx(((p[y == 0] >= t).mean(), (p[y == 1] >= t).mean())) for t in set(p))


def test_reports(spark):
    preds = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, yhat int")
    rows = {r["class"]: r for r in metrics.report_with_averages(preds).collect()}
    assert rows["2"]["recall"] == 0 and rows["accuracy"]["f1"] == pytest.approx(2 / 3) and rows["macro avg"]["recall"] == pytest.approx(0.5)
    assert {r["y"]: (r["n"], r["acc"]) for r in metrics.accuracy_of_classes(preds, 4).collect()} == {0: (2, 0.5), 1: (1, 1.0), 2: (0, None), 3: (0, None)}
    logits = spark.createDataFrame([(0, [1000.0, 0.0]), (1, [0.0, 0.0])], "y int, logits array<double>")
    assert metrics.ce_loss(logits).first()["loss"] == pytest.approx(math.log(2) / 2)


def test_written(spark, tmp_path):
    """What the save functions write comes back."""
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "a", "val")], "slide_id long, label string, role string")
    manifests.save_split_wide(rows, ["train", "val"], str(tmp_path / "wide"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "wide"))
    assert wide.columns == ["train_slide_path", "train_label", "val_slide_path", "val_label"] and wide.count() == 2
    assert {r["val_slide_path"] for r in wide.collect()} == {"3", None}
    preds = spark.createDataFrame([(1, 0, 1, [0.25, 0.75])], "slide_id long, y int, yhat int, probs array<double>")
    manifests.save_predictions(preds, 2, str(tmp_path / "preds"))
    assert spark.read.parquet(str(tmp_path / "preds")).first().asDict() == {"slide_id": 1, "Y": 0, "Y_hat": 1, "p_0": 0.25, "p_1": 0.75}
    log = spark.createDataFrame([("r1", 1, 0.5), ("r2", 1, 0.7)], "run string, epoch int, auc double")
    manifests.save_epoch_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("run = 'r2'").first()["auc"] == 0.7


def test_pools_of_one(inst):
    one = inst.filter("bag_id = 1")
    value = one.first()["feat"]
    for mode in ("MaxS", "MaxMinS", "AFS"):
        assert bags.distilled_bags(one, 4, 2, 2, mode).first()["feat"] == pytest.approx(value)
    vectors, importance = pooling.two_level_vectors(one, 2, 2)
    assert vectors.first()["feat"] == pytest.approx(value) and importance.first()["importance"] == 1.0
    assert pooling.max_instance_pool(one.withColumn("logits", F.col("feat")), 2, 2).first()["feat"] == pytest.approx(value)
    assert bags.pad_square_zeros(inst.filter("bag_id = 4"), 2).count() == 4 and bags.pad_square_zeros(one, 2).count() == 1


def test_distilled_last_bag(spark, tmp_path):
    """A last bag of sixteen, of two and of one vector keeps the chunks of a bag of twenty, as the SQL says."""
    for n in (36, 22, 1):
        rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(F.col("vec_id") < n).collect()]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / f"{n}/embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/{n}/embeddings.parquet/*.parquet')")
        want = {r[:3]: r[3] for r in con.execute(f"SELECT mode, bag_id, pos, value FROM ({ORACLE_SQL['distilled_bags']})").fetchall()}
        got = {(r["mode"], r["bag_id"], r["pos"]): r["value"] for r in QUERIES["distilled_bags"](spark, str(tmp_path / str(n))).collect()}
        assert got == pytest.approx(want, abs=2e-6)


def test_local_bias_of_bags_of_any_size(spark):
    """Small bags, large ones and both at once give the pairs of plain arithmetic: wide bags, narrow ones (the lowest bias goes), one of equal places."""
    draw = np.random.default_rng(6)
    rows = [(b, i, int(x), int(y)) for b, n, span in ((1, 1, 9), (2, 12, 60), (3, 12, 6), (4, 30, 50), (5, 30, 5), (6, 9, 1)) for i, (x, y) in enumerate(draw.integers(-span, span, size=(n, 2)))]
    want = set()
    for b in range(1, 7):
        own = [(i, x, y) for a, i, x, y in rows if a == b]
        found = [(b, i, j, -math.isqrt((x - u) ** 2 + (y - v) ** 2) if (x - u) ** 2 + (y - v) ** 2 <= 400 else None) for i, x, y in own for j, u, v in own]
        low = min((f[3] for f in found), default=0) if all(f[3] is not None for f in found) else -math.inf
        want |= {f for f in found if f[3] is not None and f[3] > low}
    rows += [(None, 0, 1, 1), (None, 1, 1, 1), (7, 0, 1, 1), (7, 1, None, 1)]  # no bag; a place that is unknown is far from all
    want.add((7, 0, 0, 0))
    inst = spark.createDataFrame(rows, "bag_id long, idx long, x long, y long")
    for whole in (256, 12, 1):
        got = [tuple(r) for r in bags.spatial_bias_local(inst, 20, whole).collect()]
        assert len(got) == len(want) and set(got) == want


def test_small_bags_are_dealt_once(spark):
    """Neither pairs nor copies for neighbouring cells are shuffled."""
    status, threshold = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled(df):
        before = status.statusStore().executorList(True).head().totalShuffleWrite()
        df().write.format("noop").mode("overwrite").save()
        status.listenerBus().waitUntilEmpty()
        return status.statusStore().executorList(True).head().totalShuffleWrite() - before

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        own = shuffled(lambda: tables.scores(spark, "/root/testdata/sf0.01"))
        assert 0 < shuffled(lambda: QUERIES["spatial_bias_local"](spark, "/root/testdata/sf0.01")) < 1.5 * own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
