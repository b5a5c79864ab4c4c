"""Polygons as array<struct<x, y>> columns; the last vertex is joined to the first one. Coordinates count as doubles, so whole numbers stay exact."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def poly_edges(poly: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of the sides; empty for an empty polygon, null for null."""
    following = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    side = lambda a, b: F.struct(*[v[c].cast("double").alias(f"{n}{c}") for n, v in (("a", a), ("b", b)) for c in "xy"])
    return F.zip_with(poly, following, side)


def poly_area(poly: Column) -> Column:
    """The area by the shoelace sum; 0 for fewer than three vertices."""
    twice = F.aggregate(poly_edges(poly), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return F.abs(twice) / 2


def poly_bbox(poly: Column) -> Column:
    """struct(x, y, w, h): the smallest box of whole places that holds every vertex, so w is the largest x less the smallest plus one."""
    low = lambda c: F.array_min(F.transform(poly, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(poly, lambda p: p[c]))
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x") - low("x") + 1).alias("w"), (high("y") - low("y") + 1).alias("h"))


def point_in_edges(edges: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on a side, -1 outside, by the parity of sides crossed by a ray to the right. Sides that do not reach y may be left out."""
    x, y = x.cast("double"), y.cast("double")

    def step(s, e):
        turn = (e["bx"] - e["ax"]) * (y - e["ay"]) - (x - e["ax"]) * (e["by"] - e["ay"])
        within = x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        crossed = (e["ay"] > y) != (e["by"] > y)
        right = F.when(e["by"] > e["ay"], turn > 0).otherwise(turn < 0)
        return F.struct((s["on"] | ((turn == 0) & within)).alias("on"), (s["odd"] != (crossed & right)).alias("odd"))

    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("odd"))
    return F.aggregate(edges, start, step, lambda s: F.when(s["on"], 0).when(s["odd"], 1).otherwise(-1))


def point_in_poly(poly: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on a side or vertex, -1 outside (also of an empty polygon)."""
    return point_in_edges(poly_edges(poly), x, y)


def scale_contour(poly: Column, sx, sy) -> Column:
    """Vertices times (sx, sy), truncated to whole numbers."""
    return F.transform(poly, lambda p: F.struct((p["x"] * sx).cast("int").alias("x"), (p["y"] * sy).cast("int").alias("y")))
