"""Contours and tiles against plain Python: concave polygons, places on sides, holes, regions, odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from bagframe.functions import polygons
from bagframe.operators import contours

SCHEMA = "slide_id long, cont_id long, parent_id long, poly array<struct<x:long,y:long>>"
STAR = [(0, 0), (400, 120), (800, 0), (640, 400), (800, 800), (400, 650), (0, 800), (150, 400)]
HOLE = [(300, 300), (500, 300), (500, 500), (300, 500)]
COMB = [(2000, 0), (2600, 0), (2600, 600), (2500, 600), (2500, 100), (2400, 100), (2400, 600), (2000, 600)]


def side(poly, x, y):
    """1, 0 or -1 with fractions only."""
    odd = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        turn = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if turn == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and (turn > 0) == (by > ay):
            odd = not odd
    return 1 if odd else -1


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 0, -1, STAR), (1, 1, 0, HOLE), (1, 2, -1, COMB), (2, 0, -1, HOLE), (2, 7, -1, [(5, 5), (5, 5)]), (3, 1, -1, []), (None, 4, -1, STAR), (4, 4, -1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_points(spark):
    draw = random.Random(1)
    points = [(x, y) for x in range(-50, 900, 50) for y in range(-50, 900, 50)] + STAR + [(draw.randint(0, 800), draw.randint(0, 800)) for _ in range(200)]
    df = spark.createDataFrame([(STAR, x, y) for x, y in points], "poly array<struct<x:long,y:long>>, x long, y long")
    got = df.select("x", "y", polygons.point_in_poly(F.col("poly"), F.col("x"), F.col("y")).alias("p")).collect()
    assert all(r["p"] == side(STAR, r["x"], r["y"]) for r in got) and {r["p"] for r in got} == {-1, 0, 1}
    empty = spark.createDataFrame([([], 1, 1)], df.schema)
    assert empty.select(polygons.point_in_poly(F.col("poly"), F.col("x"), F.col("y")), polygons.poly_area(F.col("poly"))).first()[:] == (-1, 0.0)
    assert df.limit(1).select(polygons.scale_contour(F.col("poly"), 0.333, -0.5).alias("p")).first()["p"][1][:] == (133, -60)


@pytest.mark.parametrize("check", ["basic", "center", "four_pt", "four_pt_hard"])
def test_tiles(table, check):
    size, step = 100, 50
    tiles = contours.tile_candidates(table, step, size)
    grid = {(r["slide_id"], r["cont_id"], r["x"], r["y"]) for r in tiles.collect()}
    boxes = {(1, 0): (0, 0, 800, 800), (1, 2): (2000, 0, 2600, 600), (2, 0): (300, 300, 500, 500), (2, 7): (5, 5, 5, 5), (None, 4): (0, 0, 800, 800)}
    assert grid == {(s, c, x, y) for (s, c), (x0, y0, x1, y1) in boxes.items() for x in range(x0, x1 + 1, step) for y in range(y0, y1 + 1, step)}
    polys = {(1, 0): (STAR, [HOLE]), (1, 2): (COMB, []), (2, 0): (HOLE, []), (2, 7): ([(5, 5), (5, 5)], [])}
    offsets = {"basic": [(0, 0)], "center": [(50, 50)]}.get(check, [(25, 25), (75, 75), (75, 25), (25, 75)])
    want = set()
    for s, c, x, y in grid:
        if s is None:
            continue
        poly, holes = polys[s, c]
        places = [side(poly, x + dx, y + dy) >= 0 for dx, dy in offsets]
        if (all if check == "four_pt_hard" else any)(places) and not any(side(h, x + 50, y + 50) > 0 for h in holes):
            want.add((s, c, x, y))
    twice = tiles.unionByName(tiles)
    got = [(r["slide_id"], r["cont_id"], r["x"], r["y"]) for r in contours.tile_in_contour(twice, table, size, check).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert contours.tile_in_contour(tiles.filter("false"), table, size, check).count() == 0


def test_region(table):
    roi, dims = (100, 50, 2300, 500), (2350, 700)
    got = {(r["slide_id"], r["cont_id"], r["x"], r["y"]) for r in contours.tile_candidates(table.filter("slide_id = 1"), 60, 100, roi, dims).collect()}
    want = {(1, 0, x, y) for x in range(100, 801, 60) for y in range(50, 500, 60)} | {(1, 2, x, y) for x in range(2000, 2251, 60) for y in range(50, 500, 60)}
    assert got == want
    assert contours.tile_candidates(table, 60, 100, (5000, 0, 6000, 100)).count() == 0


def test_one_contour_many_tasks(spark):
    """A huge contour's columns are dealt to many partitions."""
    huge = spark.createDataFrame([(1, 0, -1, [(0, 0), (60_000, 0), (60_000, 600), (0, 600)])], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = contours.tile_candidates(huge, 10, 10).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 6001 * 61 and len(sizes) > 1


def test_filter(spark):
    square = lambda n: [(0, 0), (n, 0), (n, n), (0, n)]
    rows = [(1, 0, -1, square(100)), (1, 1, 0, square(60)), (1, 2, 0, square(30)), (1, 3, 0, square(30)), (1, 4, 0, square(5)), (1, 5, -1, square(40)), (1, 6, 5, square(40)), (1, 7, -1, square(50)), (2, 0, -1, square(10))]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r["slide_id"], r["cont_id"], r["nth"]) for r in contours.contour_filter(table, 100, 100, 2).collect()}
    assert got == {(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 7, 1)}  # 5 has no area of its own, slide 2's is not above 100
    assert {r["cont_id"] for r in contours.contour_filter(table, 100, 100, 2, keep=[1]).collect()} == {7}
    assert {r["cont_id"] for r in contours.contour_filter(table, 100, 100, 9, drop=[1]).collect()} == {0, 1, 2, 3}
    assert {r["cont_id"] for r in contours.contour_filter(table, 100, 100, 0).collect()} == {0, 7}
    assert contours.contour_filter(table.filter("false"), 1, 1, 1).count() == 0
