"""Tiles from contours: (slide_id, cont_id, parent_id, poly) rows, of which those with parent_id -1 are tissue and the others holes of their parent."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polygons import point_in_edges, poly_area, poly_bbox, poly_edges

#: Columns of tiles of a contour that make one task's share.
BLOCK = 64
#: Cells of the join of points and contours are so many tiles wide.
CELL_TILES = 16


def contour_filter(contours: DataFrame, least_area: float, least_hole: float, most_holes: int, keep: Iterable[int] = (), drop: Iterable[int] = ()) -> DataFrame:
    """(slide_id, cont_id, parent_id, poly, area, nth): the tissue contours whose area without their holes is above least_area, and their holes.

    Of a contour's holes the most_holes largest stay (equal ones by cont_id) if larger than least_hole. A contour without area of its own goes.
    nth numbers a slide's kept contours from 0 by cont_id (holes have their parent's); keep (all, if empty) less drop tells which numbers stay.
    Contours of null slides or ids are left out.
    """
    sized = contours.select("slide_id", "cont_id", "parent_id", "poly", poly_area(F.col("poly")).alias("area")).filter("slide_id is not null and cont_id is not null")
    holes = sized.filter("parent_id != -1")
    inner = holes.groupBy("slide_id", F.col("parent_id").alias("cont_id")).agg(F.sum("area").alias("inner"))
    own = sized.filter("parent_id = -1").join(inner, ["slide_id", "cont_id"], "left").withColumn("net", F.col("area") - F.coalesce("inner", F.lit(0.0)))
    own = own.filter((F.col("net") != 0) & (F.col("net") > least_area))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("slide_id").orderBy("cont_id")) - 1)
    keep, drop = list(keep), list(drop)
    if keep:
        own = own.filter(F.col("nth").isin(keep))
    if drop:
        own = own.filter(~F.col("nth").isin(drop))
    largest = F.row_number().over(Window.partitionBy("slide_id", "parent_id").orderBy(F.desc("area"), "cont_id"))
    holes = holes.withColumn("r", largest).filter((F.col("r") <= most_holes) & (F.col("area") > least_hole))
    holes = holes.join(own.select("slide_id", F.col("cont_id").alias("parent_id"), "nth"), ["slide_id", "parent_id"])
    columns = ["slide_id", "cont_id", "parent_id", "poly", "area", "nth"]
    return own.select(*columns).unionByName(holes.select(*columns))


def tile_candidates(contours: DataFrame, step: int, size: int, roi: tuple[int, int, int, int] | None = None, dims: tuple[int, int] | None = None) -> DataFrame:
    """(slide_id, cont_id, x, y): a grid of tile corners over each tissue contour's box, from its corner on.

    roi: (left, top, right, bottom) cuts the box, right and bottom left out. dims: the slide's width and height; with them (no padding) tiles end inside the slide.
    A box that nothing is left of has no tiles, nor has an
    empty or null polygon. Large boxes are dealt out in blocks of columns.
    """
    box = contours.filter("parent_id = -1 and size(poly) > 0").select("slide_id", "cont_id", poly_bbox(F.col("poly")).alias("b"))
    stop = {"x": F.col("b.x") + F.col("b.w"), "y": F.col("b.y") + F.col("b.h")}
    start = {"x": F.col("b.x"), "y": F.col("b.y")}
    if dims is not None:
        stop = {c: F.least(stop[c], F.lit(d - size + 1)) for c, d in zip("xy", dims)}
    if roi is not None:
        stop = {c: F.least(stop[c], F.lit(r)) for c, r in zip("xy", roi[2:])}
        start = {c: F.greatest(start[c], F.lit(r)) for c, r in zip("xy", roi[:2])}
    box = box.select("slide_id", "cont_id", *[start[c].cast("long").alias(f"{c}0") for c in "xy"], *[stop[c].cast("long").alias(f"{c}1") for c in "xy"]).filter("x0 < x1 and y0 < y1")
    columns = box.withColumn("n", F.expr(f"(x1 - x0 - 1) div {step} + 1")).withColumn("block", F.explode(F.expr(f"sequence(0, (n - 1) div {BLOCK})")))
    columns = columns.repartition("slide_id", "cont_id", "block")
    columns = columns.withColumn("x", F.explode(F.expr(f"sequence(x0 + block * {BLOCK * step}, least(x1 - 1, x0 + (block * {BLOCK} + {BLOCK - 1}) * {step}), {step})")))
    return columns.select("slide_id", "cont_id", "x", F.explode(F.expr(f"sequence(y0, y1 - 1, {step})")).alias("y"))


def _cells(contours: DataFrame, cell: int) -> DataFrame:
    """Each contour in every cell of its box, with the sides that reach the cell's rows."""
    low, high = F.col("cy") * cell, (F.col("cy") + 1) * cell
    reach = F.filter("edges", lambda e: (F.least(e["ay"], e["by"]) <= high) & (F.greatest(e["ay"], e["by"]) >= low))
    box = contours.select("slide_id", "cont_id", "parent_id", poly_edges(F.col("poly")).alias("edges"), poly_bbox(F.col("poly")).alias("b")).filter("size(edges) > 0")
    rows = box.withColumn("cy", F.explode(F.expr(f"sequence(cast(floor(b.y / {cell}) as bigint), cast(floor((b.y + b.h - 1) / {cell}) as bigint))"))).withColumn("edges", reach)
    return rows.withColumn("cx", F.explode(F.expr(f"sequence(cast(floor(b.x / {cell}) as bigint), cast(floor((b.x + b.w - 1) / {cell}) as bigint))"))).drop("b")


def points_located(points: DataFrame, contours: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """points (slide_id, px, py and more) with cont_id, parent_id and place (1 inside, 0 on a side) of each contour they lie in or on; keys: columns that
    must agree besides the cell. Points and contours meet by grid cell, never slide by slide."""
    at = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    met = at.join(_cells(contours, cell), [*keys, "cx", "cy"])
    return met.withColumn("place", point_in_edges(F.col("edges"), F.col("px"), F.col("py"))).filter("place >= 0").drop("edges", "cx", "cy")


def tile_in_contour(tiles: DataFrame, contours: DataFrame, size: int, check: str = "four_pt", shift: float = 0.5) -> DataFrame:
    """The tiles (slide_id, cont_id, x, y) that lie in their contour and whose centre is not inside one of its holes.

    check: basic (the corner), center, four_pt (one of four points around the centre) or four_pt_hard (all of them); a point on the contour's side is
    inside it, one on a hole's side is not in the hole. Equal tiles count once. Tiles without a contour go.
    """
    half = size // 2
    by = int(half * shift)
    around = [(half - by, half - by), (half + by, half + by), (half + by, half - by), (half - by, half + by)] if by else [(half, half)]
    offsets = {"basic": [(0, 0)], "center": [(half, half)], "four_pt": around, "four_pt_hard": around}[check]
    needed = len(offsets) if check == "four_pt_hard" else 1
    cell, own = size * CELL_TILES, ["slide_id", "cont_id", "x", "y"]
    tiles = tiles.select(*own).distinct()
    shifted = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    points = tiles.withColumn("d", F.explode(shifted)).select(*own, (F.col("x") + F.col("d.dx")).alias("px"), (F.col("y") + F.col("d.dy")).alias("py"))
    inside = points_located(points, contours.filter("parent_id = -1"), ["slide_id", "cont_id"], cell)
    kept = inside.groupBy(*own).agg(F.count("*").alias("n")).filter(F.col("n") >= needed).select(*own)
    centres = kept.withColumn("px", F.col("x") + size / 2).withColumn("py", F.col("y") + size / 2).withColumnRenamed("cont_id", "parent_id")
    holes = points_located(centres, contours.filter("parent_id != -1"), ["slide_id", "parent_id"], cell).filter("place > 0")
    gone = holes.select("slide_id", F.col("parent_id").alias("cont_id"), "x", "y").distinct()
    return kept.join(gone, own, "left_anti")
