"""Pairs in blocks, rasters, levels, ordered folds, draws and listings against NumPy: bags of one, large bags, ties, blocks of one, empty inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.functions.rand import hash_uniform
from bagframe.operators import bags, blocks, clusters, folds, graphs, manifests, rasters


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    out = {1: draw.normal(size=(1, 3)), 2: draw.normal(size=(7, 3)), 3: np.repeat(draw.normal(size=(3, 3)), 3, axis=0), 4: np.zeros((2, 3))}
    return out


@pytest.fixture(scope="module")
def inst(spark, vectors):
    rows = [(b, i, [float(x) for x in v]) for b, f in vectors.items() for i, v in enumerate(f)]
    return spark.createDataFrame(rows + [(None, 0, [1.0] * 3), (5, None, [1.0] * 3)], "bag_id long, idx long, feat array<double>")


@pytest.mark.parametrize("size", [1, 2, 256])
def test_attention(inst, vectors, size):
    got = {(r["bag_id"], r["idx"]): r["feat"] for r in blocks.context_attention(inst, 3, size).collect()}
    assert len(got) == sum(map(len, vectors.values()))
    for b, f in vectors.items():
        s = f @ f.T / math.sqrt(3)
        w = np.exp(s - s.max(axis=1, keepdims=True))
        want = w / w.sum(axis=1, keepdims=True) @ f
        assert all(np.allclose(got[b, i], want[i]) for i in range(len(f)))


@pytest.mark.parametrize("size", [2, 256])
def test_nearest(spark, inst, vectors, size):
    got = {}
    for r in blocks.nearest(inst, inst, 3, size=size).collect():
        got.setdefault((r["bag_id"], r["src"]), []).append((r["dist"], r["dst"]))
    for b, f in vectors.items():
        for i in range(len(f)):
            d = sorted((round(float(np.linalg.norm(f[i] - f[j])), 9), j) for j in range(len(f)) if j != i)[:3]
            assert sorted(got.get((b, i), [])) == d
    pairs = spark.createDataFrame([(2, 3), (3, 1), (4, 99)], "bag_id long, partner long")
    near = {(r["bag_id"], r["idx"]): (r["partner"], r["nearest"]) for r in bags.cross_bag_nearest(inst, pairs).collect()}
    assert len(near) == len(vectors[2]) + len(vectors[3])
    for i, v in enumerate(vectors[2]):
        assert near[2, i] == (3, min(range(9), key=lambda j: (round(float(np.linalg.norm(v - vectors[3][j])), 9), j)))
    assert graphs.knn_graph(inst.filter("false")).count() == 0


def test_affinity_of_ties(inst):
    edges = clusters.affinity_graph(inst, 5, 3).collect()
    assert [r["w"] for r in edges if r["bag_id"] == 4] == pytest.approx([0.5] * 4) and [r["w"] for r in edges if r["bag_id"] == 1] == [1.0]


def test_large_bag(spark):
    """A bag of 5,000: no task makes its 25 million pairs as rows."""
    n = 5000
    feat = F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)])
    large = spark.range(n).select(F.lit(7).cast("long").alias("bag_id"), F.col("id").alias("idx"), feat.alias("feat"))
    x = np.sin(np.arange(n)[:, None] * np.arange(1, 5)[None, :])
    got = {r["idx"]: r["feat"] for r in blocks.context_attention(large, 4, 512).filter("idx % 997 = 3").collect()}
    for i, value in got.items():
        w = np.exp(x @ x[i] / 2)
        assert np.allclose(value, w @ x / w.sum())
    assert len(got) == 6
    near = {r["src"]: r["dst"] for r in blocks.nearest(large, large, 1, size=512).filter("src % 997 = 3").collect()}
    for i, j in near.items():
        d = np.round(np.linalg.norm(x - x[i], axis=1), 9)
        d[i] = np.inf
        assert j == int(d.argmin())


def test_many_centres(spark, inst):
    centres = spark.createDataFrame([(k, [float(k), 0.0, 1.0]) for k in range(6)], "k long, centre array<double>")
    few, many = bags.soft_assign(inst.dropna(), centres, 2.0), bags.soft_assign(inst.dropna(), centres, 2.0, most=3)
    key = lambda r: (r["bag_id"], r["idx"], r["k"])
    a, b = sorted(few.collect(), key=key), sorted(many.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and np.allclose([r["w"] for r in a], [r["w"] for r in b])


@pytest.mark.parametrize("threshold,region", [(None, None), (0.3, None), (-1.0, (10, 5, 60, 47)), (None, (10, 5, 60, 47))])
def test_raster(spark, threshold, region):
    draw = np.random.default_rng(3)
    rows = [(int(draw.integers(2)), int(draw.integers(80)), int(draw.integers(60)), float(draw.integers(-20, 100))) for _ in range(300)] + [(0, 5, 5, None), (0, None, 1, 3.0), (0, 500, 5, 7.0)]
    scale, patch, size = 0.3, 10, (20, 15)
    if region:
        size = (int(region[2] * scale) - int(region[0] * scale), int(region[3] * scale) - int(region[1] * scale))
    wide, want = math.ceil(patch * scale), {}
    for b in (0, 1):
        own = [r for r in rows if r[0] == b and None not in r and (not region or (region[0] <= r[1] <= region[2] and region[1] <= r[2] <= region[3]))]
        total, count = np.zeros(size[::-1]), np.zeros(size[::-1])
        least = 0 if threshold is None else 1 / len(own) if threshold < 0 else threshold
        for _, x, y, s in own:
            x, y = (math.ceil((v - (region[k] if region else 0)) * scale) for k, v in enumerate((x, y)))
            value = (s / 100 if threshold is None else 1.0) if s / 100 >= least else 0.0
            total[y : y + wide, x : x + wide] += value
            count[y : y + wide, x : x + wide] += 1
        for y, x in zip(*np.nonzero(count)):
            v = total[y, x] / count[y, x]
            want[b, int(x), int(y)] = v if threshold is None else np.around(v)
    inst = spark.createDataFrame(rows, "bag_id int, x int, y int, score double")
    got = {(r["bag_id"], r["cx"], r["cy"]): r["value"] for r in rasters.heatmap_raster(inst, scale, patch, size, threshold, region).collect()}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))
    assert rasters.heatmap_raster(inst.filter("false"), scale, patch, size, threshold, region).count() == 0


def test_raster_means_are_exact(spark):
    """Means that end in a half of the sixth decimal (F1): those of exact integers, whatever the order of the rows."""
    draw = np.random.default_rng(11)
    scores = draw.integers(0, 98, (400, 32))
    scores[:, -1] += 1 - scores.sum(axis=1) % 2  # means are odd multiples of 312.5 millionths
    rows = [(b, 0, 0, float(s)) for b, own in enumerate(scores.tolist()) for s in own]
    want = {b: (2 * s * 10_000 + 32) // 64 / 1e6 for b, s in enumerate(scores.sum(axis=1).tolist())}
    for order in (rows, rows[::-1]):
        inst = spark.createDataFrame(order, "bag_id int, x int, y int, score double").repartition(3)
        got = rasters.heatmap_raster(inst, 0.5, 2, (4, 4)).select("bag_id", F.round("value", 6).alias("value")).collect()
        assert {r["bag_id"]: r["value"] for r in got} == want


def test_levels(spark):
    rows = [(1, 40, 40.0, [1.0, 4.0]), (2, 40, 10.0, [1.0, 4.0]), (3, 40, 20.0, [1.0, 4.0]), (4, 20, 40.0, [1.0, 2.0]), (5, 20, 3.0, [1.0, 2.0, 4.0]), (6, 20, 7.0, [1.0]), (7, 20, None, [1.0])]
    slides = spark.createDataFrame(rows, "slide_id int, native int, target double, downsamples array<double>")
    got = {r["slide_id"]: (r["level"], r["scale"], r["patch_size"], r["step_size"], r["status"]) for r in rasters.pick_level(slides, 256, 100).collect()}
    assert got == {1: (0, None, 256, 100, "tbp"), 2: (1, None, 256, 100, "tbp"), 3: (0, 2.0, 512, 200, "tbp"), 4: (None, None, None, None, "failed_for_mag"), 5: (2, 5 / 3, 426, 166, "tbp"), 6: (0, 20 / 7, 731, 285, "tbp"), 7: (None, None, None, None, "failed_for_mag")}


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_ema(spark, per):
    draw = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", 10 * i, [float(x) for x in draw.normal(size=2)]) for i in range(40)] + [(None, 3, [1.0, 1.0]), ("a", None, [1.0, 1.0])]
    bag = spark.createDataFrame(rows, "class string, seq long, feat array<double>")
    got = {r["class"]: r for r in folds.ema_centers(bag, 2, 0.4, [1.0, -1.0], per).collect()}
    for name in ("a", "b"):
        c, n = np.array([1.0, -1.0]), 0
        for label, seq, f in rows:
            if label == name and seq is not None:
                c, n = 0.4 * c + 0.6 * np.array(f), n + 1
        assert np.allclose(got[name]["feat"], c) and got[name]["n"] == n
    assert folds.ema_centers(bag.filter("false"), 2).count() == 0


def test_draws(spark):
    """Each draw falls on the row whose part of the cumulative weights holds it; the counts follow the weights."""
    slides = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 1.0, 0.0, 96.0, 2.0, -3.0, None])], "slide_id long, w double")
    got = folds.weighted_sample(slides, 2000, 1).collect()
    times = {i: sum(r["slide_id"] == i for r in got) for i in range(7)}
    assert len(got) == 2000 == len({r["draw"] for r in got}) and times[2] == times[5] == times[6] == 0
    assert abs(times[3] - 1920) < 60 and times[0] + times[1] + times[4] > 40
    order = [r["slide_id"] for r in slides.filter("w > 0").orderBy(F.md5(F.concat(F.lit("1:"), "slide_id"))).collect()]
    ends = np.cumsum([{0: 1, 1: 1, 3: 96, 4: 2}[i] for i in order])
    u = {r["id"]: r["u"] for r in spark.range(2000).select("id", hash_uniform(2, "id").alias("u")).collect()}
    assert all(r["slide_id"] == order[int(np.searchsorted(ends, u[r["draw"]] * 100, "right"))] for r in got)
    assert folds.weighted_sample(slides.filter("w < 0"), 10).count() == 0
    one = folds.weighted_sample(slides.filter("slide_id = 3"), 10).collect()
    assert [r["slide_id"] for r in one] == [3] * 10


def test_listing(spark, tmp_path):
    for name in ("a/one.SVS", "a/b/two.svs", "a/b/three.txt", "four.tar.svs", "svs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = manifests.list_slides(spark, str(tmp_path), [".svs"])
    assert {(r["stem"], r["length"]) for r in found.collect()} == {("one", 5), ("two", 5), ("four.tar", 5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # contents are pruned
