"""Queries of contours, tiles and rasters, each beside its SQL. The suppliers' diamonds let SQL tell places by the sum of two distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygons
from ..operators import contours
from ..sources import tables as T
from .catalogue import query

DIAMONDS = """c AS (SELECT s_nationkey AS slide_id, s_suppkey * 2 AS cont_id, s_suppkey * 2000 + 1000 AS cx, 500 + s_nationkey * 20 AS r, s_suppkey % 2 = 0 AS holed FROM supplier)"""
CHECKS = ("basic", "center", "four_pt", "four_pt_hard")
STEP, SIZE = 150, 200
ROI = (0, 400, 150_000, 1500)


@query(f"""WITH {DIAMONDS}, p AS (SELECT slide_id, cont_id, cx, r, i, CASE i WHEN 0 THEN 0 WHEN 1 THEN r WHEN 2 THEN r // 2 WHEN 3 THEN r ELSE -r + 1 END AS dx, CASE i WHEN 2 THEN r - r // 2 WHEN 3 THEN 1 ELSE 0 END AS dy FROM c, range(0, 5) t(i))
 SELECT slide_id, cont_id, CAST(i AS INT) AS i, CAST(2 * r * r AS DOUBLE) AS area, cx - r AS left, 1000 - r AS top, 2 * r + 1 AS width, CAST(sign(r - abs(dx) - abs(dy)) AS INT) AS place FROM p""")
def polygon_functions(spark, sf) -> DataFrame:
    """Area and box of each diamond, and the place of five points: the centre, a vertex, on a side, next to a vertex outside and inside."""
    c = T.contours(spark, sf).filter("parent_id = -1").withColumn("area", polygons.poly_area(F.col("poly"))).withColumn("b", polygons.poly_bbox(F.col("poly")))
    c = c.withColumn("r", F.expr("(b.w - 1) div 2")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    dx = F.expr("case i when 0 then 0 when 1 then r when 2 then r div 2 when 3 then r else -r + 1 end")
    dy = F.expr("case i when 2 then r - r div 2 when 3 then 1 else 0 end")
    place = polygons.point_in_poly(F.col("poly"), F.col("b.x") + F.col("r") + dx, F.col("b.y") + F.col("r") + dy)
    return c.select("slide_id", "cont_id", "i", "area", F.col("b.x").alias("left"), F.col("b.y").alias("top"), F.col("b.w").alias("width"), place.alias("place"))


@query(f"""WITH {DIAMONDS}, v AS (SELECT slide_id, cont_id, i, cx + CASE i WHEN 0 THEN -r WHEN 2 THEN r ELSE 0 END AS x, 1000 + CASE i WHEN 1 THEN -r WHEN 3 THEN r ELSE 0 END AS y FROM c, range(0, 4) t(i))
 SELECT slide_id, cont_id, CAST(i AS INT) AS i, CAST(trunc(x * 0.37::DOUBLE) AS INT) AS x, CAST(trunc(y * 1.9::DOUBLE) AS INT) AS y FROM v""")
def scale_contour(spark, sf) -> DataFrame:
    c = T.contours(spark, sf).filter("parent_id = -1").select("slide_id", "cont_id", F.posexplode(polygons.scale_contour(F.col("poly"), 0.37, 1.9)).alias("i", "p"))
    return c.select("slide_id", "cont_id", "i", "p.x", "p.y")


@query(f"""WITH {DIAMONDS}, k AS (SELECT *, 2 * r * r - CASE WHEN holed THEN r * r // 2 ELSE 0 END AS net FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY cont_id) - 1 AS nth FROM k WHERE net > 700000), f AS (SELECT * FROM n WHERE nth != 1)
 SELECT slide_id, cont_id, -1 AS parent_id, CAST(2 * r * r AS DOUBLE) AS area, CAST(nth AS INT) AS nth FROM f
 UNION ALL SELECT slide_id, cont_id + 1, cont_id, r * r / 2.0::DOUBLE, CAST(nth AS INT) FROM f WHERE holed AND r * r / 2.0 > 250000""")
def contour_filter(spark, sf) -> DataFrame:
    return contours.contour_filter(T.contours(spark, sf), 700_000, 250_000, 8, drop=[1]).select("slide_id", "cont_id", "parent_id", "area", "nth")


def candidates_sql(left: str, top: str, right: str, bottom: str) -> str:
    return f"""b AS (SELECT *, {left} AS x0, {top} AS y0, {right} AS x1, {bottom} AS y1 FROM c), gx AS (SELECT *, UNNEST(range(x0, x1, {STEP})) AS x FROM b WHERE x0 < x1 AND y0 < y1),
 t AS (SELECT slide_id, cont_id, cx, r, holed, x, UNNEST(range(y0, y1, {STEP})) AS y FROM gx)"""


@query(f"""WITH {DIAMONDS}, {candidates_sql(f"greatest(cx - r, {ROI[0]})", f"greatest(1000 - r, {ROI[1]})", f"least(cx + r + 1, 180000 - {SIZE} + 1, {ROI[2]})", f"least(1000 + r + 1, 1900 - {SIZE} + 1, {ROI[3]})")} SELECT slide_id, cont_id, x, y FROM t""")
def tile_candidates(spark, sf) -> DataFrame:
    """Without padding and within a region."""
    return contours.tile_candidates(T.contours(spark, sf), STEP, SIZE, ROI, (180_000, 1900))


def _check_sql(check: str) -> str:
    at = lambda dx, dy: f"abs(x + {dx} - cx) + abs(y + {dy} - 1000) <= r"
    four = [at(dx, dy) for dx in (50, 150) for dy in (50, 150)]
    inside = {"basic": at(0, 0), "center": at(100, 100), "four_pt": " OR ".join(four), "four_pt_hard": " AND ".join(four)}[check]
    return f"SELECT '{check}' AS kind, slide_id, cont_id, x, y FROM t WHERE ({inside}) AND NOT (holed AND abs(x + 100 - cx) + abs(y + 100 - 1000) < r // 2)"


@query(f"WITH {DIAMONDS}, {candidates_sql('cx - r', '1000 - r', 'cx + r + 1', '1000 + r + 1')} " + " UNION ALL ".join(map(_check_sql, CHECKS)))
def tile_in_contour(spark, sf) -> DataFrame:
    """All four checks over every contour's grid."""
    c = T.contours(spark, sf)
    tiles = contours.tile_candidates(c, STEP, SIZE)
    found = [contours.tile_in_contour(tiles, c, SIZE, k).select(F.lit(k).alias("kind"), "slide_id", "cont_id", "x", "y") for k in CHECKS]
    return reduce(DataFrame.unionByName, found)
