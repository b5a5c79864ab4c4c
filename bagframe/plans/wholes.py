"""Queries of pairs in blocks, rasters, levels, folds in order, draws, listings and two-class evaluation, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, folds, manifests, metrics, pooling, rasters, splits
from ..sources import tables as T
from .catalogue import DIM, INST, POS, QUERIES, REPORT, SLIDES, query, rounded
from .further import uniform
from .more import AREA, RANK


@query(f"""WITH {INST}, {POS}, s AS (SELECT a.bag_id, a.idx, b.idx AS other, list_inner_product(a.feat::DOUBLE[], b.feat::DOUBLE[]) / 8 AS s FROM inst a JOIN inst b USING (bag_id)),
 e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY bag_id, idx)) AS e FROM s)
 SELECT e.bag_id, e.idx, CAST(pos AS INT) AS pos, round(sum(e * v) / sum(e), 6) AS value FROM e JOIN pos ON pos.bag_id = e.bag_id AND pos.idx = other GROUP BY e.bag_id, e.idx, pos""")
def context_attention(spark, sf) -> DataFrame:
    out = blocks.context_attention(T.vectors(spark, sf), DIM)
    return rounded(out.select("bag_id", "idx", F.posexplode("feat").alias("pos", "value")), "value")


PLACES = "p AS (SELECT l_suppkey % 10 AS bag_id, CAST(l_partkey AS BIGINT) AS x, CAST(l_orderkey % 1000 AS BIGINT) AS y, CAST(l_quantity AS DOUBLE) * 2 - 3 AS score FROM lineitem)"
RASTERS = [("mean", None, None), ("cut", 0.4, None), ("share", -1.0, (64, 100, 1500, 800))]


def _raster_sql(kind: str, threshold: float | None, region) -> str:
    left, top, right, bottom = region or (0, 0, 0, 0)
    wide, high = ((right // 32) - (left // 32), (bottom // 32) - (top // 32)) if region else (60, 30)
    where = f"WHERE x BETWEEN {left} AND {right} AND y BETWEEN {top} AND {bottom}" if region else ""
    least = "1.0 / count(*) OVER (PARTITION BY bag_id)" if threshold == -1.0 else threshold
    value = "greatest(score / 100, 0)" if threshold is None else f"CASE WHEN score / 100 >= {least} THEN 1.0 ELSE 0.0 END"
    mean = "avg(v)" if threshold is None else "round_even(avg(v), 0)"
    return f"""SELECT '{kind}' AS kind, bag_id, CAST(x0 + i AS BIGINT) AS cx, CAST(y0 + j AS BIGINT) AS cy, round({mean}, 6) AS value
 FROM (SELECT bag_id, CAST(ceil((x - {left}) / 32.0) AS BIGINT) AS x0, CAST(ceil((y - {top}) / 32.0) AS BIGINT) AS y0, CAST({value} AS DOUBLE) AS v FROM p {where}), range(0, 4) a(i), range(0, 4) b(j)
 WHERE x0 + i < {wide} AND y0 + j < {high} GROUP BY ALL"""


@query(f"WITH {PLACES} " + " UNION ALL ".join(_raster_sql(*r) for r in RASTERS))
def heatmap_raster(spark, sf) -> DataFrame:
    """All lines as patches 100 wide on a 32 times smaller grid: means, ones at a threshold, ones at 1 / n within a region."""
    inst = T.table(spark, sf, "lineitem").selectExpr("l_suppkey % 10 as bag_id", "cast(l_partkey as bigint) as x", "cast(l_orderkey % 1000 as bigint) as y", "cast(l_quantity as double) * 2 - 3 as score")
    found = [rasters.heatmap_raster(inst, 1 / 32, 100, (60, 30), t, region).select(F.lit(kind).alias("kind"), "bag_id", "cx", "cy", "value") for kind, t, region in RASTERS]
    return rounded(reduce(DataFrame.unionByName, found), "value")


TARGETS = [10.0, 40.0, 20.0, 8.0, 2.5, 0.5, 30.0, 5.0]


@query(f"""WITH q AS (SELECT c_custkey AS slide_id, CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 20 END AS native, list_extract({TARGETS}, CAST(c_custkey % 8 + 1 AS BIGINT))::DOUBLE AS target, 4 AS zoom FROM customer),
 m AS (SELECT slide_id, native, target, k, native / power(zoom, k) AS mag FROM q, range(0, 4) t(k)), b AS (SELECT slide_id, arg_min(k, mag) AS level, min(mag) AS mag FROM m WHERE mag >= target GROUP BY slide_id)
 SELECT slide_id, CAST(level AS INT) AS level, CASE WHEN mag > target THEN mag / target END AS scale, CAST(trunc(256 * mag / target) AS INT) AS patch_size, CAST(trunc(200 * mag / target) AS INT) AS step_size,
 CASE WHEN level IS NULL THEN 'failed_for_mag' ELSE 'tbp' END AS status FROM q LEFT JOIN b USING (slide_id)""")
def pick_level(spark, sf) -> DataFrame:
    target = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    slides = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("slide_id"), F.expr("if(c_custkey % 2 = 0, 40, 20)").alias("native"), target.alias("target"), F.expr("array(1, 4, 16, 64)").alias("downsamples"))
    return rasters.pick_level(slides, 256, 200).select("slide_id", "level", "scale", "patch_size", "step_size", "status")


@query(f"""WITH RECURSIVE {INST}, {POS}, b AS (SELECT bag_id, pos, avg(v) AS v FROM pos GROUP BY bag_id, pos), c AS (SELECT CASE WHEN bag_id % 3 = 0 THEN 'normal' ELSE 'abnormal' END AS class, pos, v, row_number() OVER (PARTITION BY bag_id % 3 = 0, pos ORDER BY bag_id) AS r FROM b),
 f(class, pos, r, center) AS (SELECT class, pos, CAST(0 AS BIGINT), CAST(0.5 AS DOUBLE) FROM c WHERE r = 1 UNION ALL SELECT f.class, f.pos, c.r, 0.4::DOUBLE * center + 0.6::DOUBLE * v FROM f JOIN c ON c.class = f.class AND c.pos = f.pos AND c.r = f.r + 1)
 SELECT class, CAST(pos AS INT) AS pos, round(arg_max(center, r), 6) AS value FROM f GROUP BY class, pos""")
def class_centers_ema(spark, sf) -> DataFrame:
    """Centres of two classes of bags after all bag means, bag by bag; SQL goes step by step."""
    bags = pooling.mean_pool(T.vectors(spark, sf), DIM).select(F.expr("if(bag_id % 3 = 0, 'normal', 'abnormal')").alias("class"), F.col("bag_id").alias("seq"), "feat")
    out = folds.ema_centers(bags, DIM, start=[0.5] * DIM)
    return rounded(out.select("class", F.posexplode("feat").alias("pos", "value")), "value")


@query(f"""WITH {SLIDES}, w AS (SELECT slide_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS w, md5('5:' || slide_id) AS h FROM sl), c AS (SELECT slide_id, sum(w) OVER (ORDER BY h, slide_id) AS high, w FROM w),
 d AS (SELECT i AS draw, {uniform(6, "i")} * (SELECT max(high) FROM c) AS t FROM range(0, (SELECT count(*) FROM sl)) r(i))
 SELECT draw, slide_id FROM d JOIN c ON t >= high - w AND t < high""")
def balanced_draws(spark, sf) -> DataFrame:
    """As many draws with replacement as there are slides, each label alike."""
    slides = splits.balanced_weights(T.slides(spark, sf))
    return folds.weighted_sample(slides, slides.count(), 5).select("draw", "slide_id")


@query(f"""WITH {REPORT}, t AS (SELECT sum(n) AS t FROM cm), k AS (SELECT y, yhat, n, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER (PARTITION BY yhat) AS nh FROM cm), a AS (SELECT {AREA} AS auc FROM (SELECT p1 AS p, y = 1 AS hit, {RANK.format('1')} FROM (SELECT p1, y, p1 AS p FROM pr)))
 SELECT (SELECT round(auc, 6) FROM a) AS auc_macro, (SELECT round(auc, 6) FROM a) AS auc_weighted, (SELECT round(auc, 6) FROM a) AS auc_micro, round(avg(f1), 6) AS macro_f1, (SELECT round(1 - sum((y != yhat)::INT * n) / (sum((y != yhat)::INT * ny * nh) / max(t)), 6) FROM k, t) AS kappa,
 (SELECT string_agg(y || ':' || yhat || ':' || n, ',' ORDER BY y, yhat) FROM cm) AS confusion FROM rep""")
def evaluate_two_classes(spark, sf) -> DataFrame:
    preds = T.predictions(spark, sf).withColumn("probs", F.array(1 - F.col("p1"), F.col("p1")))
    out = metrics.evaluate_all(preds, 2)
    text = F.array_join(F.transform("confusion", lambda c: F.concat_ws(":", c["y"].cast("string"), c["yhat"].cast("string"), c["n"].cast("string"))), ",")
    return rounded(out.select("auc_macro", "auc_weighted", "auc_micro", "macro_f1", "kappa"), "auc_macro", "auc_weighted", "auc_micro", "macro_f1", "kappa").crossJoin(F.broadcast(out.select(text.alias("confusion"))))


def list_slides(spark, sf) -> DataFrame:
    """The Parquet files of the given tables: rows only, as SQL has no table of them."""
    return manifests.list_slides(spark, sf, [".parquet"])


QUERIES["list_slides"] = list_slides
