"""Fitted models against NumPy: the optimum's gradient, saved and loaded pipelines, folds, principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.operators import metrics, models
from bagframe.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    """Three classes of bags of one to four instances."""
    draw = np.random.default_rng(0)
    rows, bags = [], []
    for b in range(90):
        y = b % 3
        for i in range(1 + b % 4):
            rows.append((b, i, [float(x) for x in draw.normal(size=2) + [y, -y]], float(draw.normal())))
        bags.append((b, y, b // 3 % 5, "test" if b // 3 % 5 == 0 else "train"))
    bags.append((1000, None, 1, "train"))
    rows.append((1000, 0, [9.0, 9.0], 0.0))
    inst = spark.createDataFrame(rows, "bag_id long, idx long, feat array<double>, score double").persist()
    return inst, spark.createDataFrame(bags, "bag_id long, y int, fold int, role string").persist()


def means(inst):
    return {r["bag_id"]: np.mean(r["f"], axis=0) for r in inst.groupBy("bag_id").agg(F.collect_list("feat").alias("f")).collect()}


def test_gradient_is_zero(data):
    inst, bags = data
    model = models.fit_bag_classifier(inst, bags, 2, reg=0.05)
    own, mean = bags.filter("role = 'train' and y is not null").collect(), means(inst)
    x, y = np.array([mean[r["bag_id"]] for r in own]), np.array([r["y"] for r in own])
    w, b = model.stages[-1].coefficientMatrix.toArray(), model.stages[-1].interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    off = p - np.eye(3)[y]
    assert np.abs(off.T @ x / len(x) + 0.05 * w).max() < 1e-4 and np.abs(off.mean(axis=0)).max() < 1e-4


def test_saved_and_reported(data, tmp_path):
    inst, bags = data
    model = models.fit_bag_classifier(inst, bags, 2)
    models.save(model, str(tmp_path / "model"))
    models.save(model, str(tmp_path / "model"))  # replaces
    again = models.load(str(tmp_path / "model"))
    test = bags.filter("role = 'test'")
    preds, row = models.test_report(again, inst, test)
    got = {r["bag_id"]: r for r in preds.collect()}
    assert set(got) == {r["bag_id"] for r in test.collect()}
    right = np.mean([r["yhat"] == r["y"] for r in got.values()])
    row = row.first()
    assert row["accuracy"] == pytest.approx(right) and sum(c["n"] for c in row["confusion"]) == len(got)
    unlabelled, none = models.test_report(again, inst)
    assert none is None and unlabelled.count() == 91 and "y" not in unlabelled.columns
    same = {r["bag_id"]: r["probs"] for r in unlabelled.collect()}
    assert all(np.allclose(same[b], r["probs"]) for b, r in got.items())


@pytest.mark.parametrize("how", ["max", "softmax"])
def test_pools(data, how):
    inst, bags = data
    out = {r["bag_id"]: r for r in models.BagPool(dim=2, how=how, keep=["role", "absent"]).transform(inst.join(bags, "bag_id")).collect()}
    rows = {}
    for r in inst.collect():
        rows.setdefault(r["bag_id"], []).append(r)
    for b, own in rows.items():
        f, s = np.array([r["feat"] for r in own]), np.array([r["score"] for r in own])
        w = np.exp(s - s.max())
        want = f.max(axis=0) if how == "max" else w @ f / w.sum()
        assert np.allclose(out[b]["features"].toArray(), want)


def test_folds(data):
    inst, bags = data
    each, merged, reg = models.cv_bag_classifier(inst, bags, 5, 2, regs=(0.01, 0.1))
    rows = each.collect()
    assert {r["fold"] for r in rows} == set(range(5)) and reg in (0.01, 0.1)
    values = [r["value"] for r in rows if r["metric"] == "accuracy"]
    got = {r["metric"]: r for r in merged.collect()}["accuracy"]
    assert got["mean"] == pytest.approx(np.mean(values)) and got["std"] == pytest.approx(np.std(values))
    # A fold's model has not seen the fold: it is the model fitted on the others.
    for fold in (3,):
        own = bags.withColumn("role", F.when(F.col("fold") == fold, "test").otherwise("train"))
        row = models.test_report(models.fit_bag_classifier(inst, own, 2, reg=reg), inst, own.filter("role = 'test'"))[1].first()
        assert row["accuracy"] == pytest.approx(next(r["value"] for r in rows if r["fold"] == fold and r["metric"] == "accuracy"))


def test_two_classes(spark):
    """All three areas are that of class 1, and a lacking class gives none."""
    preds = spark.createDataFrame([(0, 0, [0.8, 0.2]), (1, 0, [0.6, 0.4]), (1, 1, [0.1, 0.9]), (0, 1, [0.4, 0.6])], "y int, yhat int, probs array<double>")
    row = metrics.evaluate_all(preds).first()
    assert row["auc_macro"] == row["auc_weighted"] == row["auc_micro"] == 0.75
    assert [tuple(c) for c in row["confusion"]] == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    assert metrics.evaluate_all(preds.filter("y = 1")).first()["auc_micro"] is None


def test_principal_components(spark, data):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 4)) @ np.diag([3.0, 2.0, 0.5, 0.1]) + [5, 0, 0, 1]
    bags = spark.createDataFrame([(i, [float(v) for v in r], "a") for i, r in enumerate(x)], "bag_id long, feat array<double>, label string")
    got = {r["bag_id"]: (r["pc1"], r["pc2"], r["label"]) for r in models.bag_feature_map(bags, 4).collect()}
    values, axes = np.linalg.eigh(np.cov(x.T))
    for k, axis in enumerate(axes.T[::-1][:2]):
        axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
        assert np.allclose([got[i][k] for i in range(60)], (x - x.mean(axis=0)) @ axis)


@pytest.mark.parametrize("name", ["fit_bag_classifier", "report_without_labels", "cv_bag_classifier", "bag_feature_map", "list_slides"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fits_on_few_partitions(spark, data, monkeypatch):
    """However many partitions shuffles make, a pass over few bags is few tasks; with more than fit into one, the results are the same."""
    inst, bags = data
    seen, fit, before = [], models.CrossValidator.fit, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(models.CrossValidator, "fit", lambda self, d: seen.append(d.rdd.getNumPartitions()) or fit(self, d))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        one = {(r["fold"], r["metric"]): r["value"] for r in models.cv_bag_classifier(inst, bags, 5, 2, regs=(0.01,))[0].collect()}
        monkeypatch.setattr(models, "NUMBERS", 64)
        more = {(r["fold"], r["metric"]): r["value"] for r in models.cv_bag_classifier(inst, bags, 5, 2, regs=(0.01,))[0].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [1, 3] and len(one) == 75 and more == pytest.approx(one)


def test_evaluated_by_groups(spark):
    """All groups at once as each by itself: three classes, of which one group lacks one; two classes."""
    draw = np.random.default_rng(4)
    for classes in (3, 2):
        p = draw.dirichlet(np.ones(classes), size=60).round(2)
        y = [int(draw.integers(classes if i % 3 else classes - 1)) for i in range(60)]
        rows = [(i % 3, y[i], int(p[i].argmax()), [float(x) for x in p[i]]) for i in range(60)]
        preds = spark.createDataFrame(rows, "fold int, y int, yhat int, probs array<double>")
        got = {r["fold"]: r.asDict() for r in metrics.evaluate_all(preds, classes, "fold").collect()}
        for fold in range(3):
            want = metrics.evaluate_all(preds.filter(F.col("fold") == fold).drop("fold"), classes).first().asDict()
            assert {k: v for k, v in got[fold].items() if k not in ("fold", "confusion")} == pytest.approx({k: v for k, v in want.items() if k != "confusion"})
            assert got[fold]["confusion"] == want["confusion"]
        assert (got[0]["auc_macro"] is None) and got[1]["auc_macro"] is not None
