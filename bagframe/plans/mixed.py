"""Queries of mixed bags, representatives, centres, prompts, settings, blank patches and grid places, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, clusters, graphs, mixing, pooling
from ..sources import tables as T
from .catalogue import DIM, INST, LINES, POS, SLIDES, query, rounded
from .further import uniform

#: Bags of 1, 3, 5, 7 and so on instances.
UNEVEN = """u0 AS (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS bag_id, vec_id, embedding AS feat FROM embeddings), un AS (SELECT bag_id, vec_id - bag_id * bag_id AS idx, feat FROM u0),
 up AS (SELECT bag_id, idx, UNNEST(range(0, 64)) AS pos, CAST(UNNEST(feat) AS DOUBLE) AS v FROM un), n AS (SELECT bag_id, count(*) AS n FROM un GROUP BY bag_id)"""
CHOSEN = f"""{UNEVEN}, o AS (SELECT bag_id, row_number() OVER (ORDER BY bag_id) AS r FROM n), h AS (SELECT bag_id AS partner, row_number() OVER (ORDER BY md5('3:' || bag_id), bag_id) AS r FROM n),
 pa AS (SELECT o.bag_id, h.partner, a.n AS n1, b.n AS n2, {uniform(9, "o.bag_id")} AS lam FROM o JOIN h USING (r) JOIN n a ON a.bag_id = o.bag_id JOIN n b ON b.bag_id = h.partner WHERE {uniform(4, "o.bag_id")} < 0.5 AND o.bag_id != h.partner)"""


def uneven(spark, sf) -> DataFrame:
    rows = T.table(spark, sf, "embeddings").selectExpr("cast(floor(sqrt(vec_id)) as bigint) as bag_id", "vec_id", "embedding as feat")
    return rows.selectExpr("bag_id", "vec_id - bag_id * bag_id as idx", "feat")


def chosen(inst: DataFrame) -> DataFrame:
    return graphs.chosen_pairs(inst.select("bag_id"), 0.5, 3).filter("mixed")


@query(f"""WITH {CHOSEN}, p AS (SELECT *, UNNEST(range(0, greatest(n1, n2))) AS i FROM pa), q AS (SELECT *, {uniform(10, "bag_id || ':' || (i + 1)")} AS u FROM p),
 s AS (SELECT *, CASE WHEN n1 >= n2 THEN i ELSE CAST(floor(u * n1) AS BIGINT) END AS i1, CASE WHEN n2 >= n1 THEN i ELSE CAST(floor(u * n2) AS BIGINT) END AS i2 FROM q)
 SELECT s.bag_id AS pair_id, i AS idx, CAST(a.pos AS INT) AS pos, round(lam * a.v + (1 - lam) * b.v, 6) AS value, round(lam, 6) AS ratio FROM s JOIN up a ON a.bag_id = s.bag_id AND a.idx = i1 JOIN up b ON b.bag_id = s.partner AND b.idx = i2 AND b.pos = a.pos""")
def mixup(spark, sf) -> DataFrame:
    inst = uneven(spark, sf)
    out = mixing.mixup(inst, chosen(inst), 9)
    return rounded(out.select("pair_id", "idx", F.posexplode("feat").alias("pos", "value"), "ratio"), "value", "ratio")


@query(f"""WITH {CHOSEN}, nn AS (SELECT a.bag_id, a.idx, pa.partner, c.idx AS nearest, {uniform(9, "a.bag_id || ':' || a.idx")} <= 0.3 AS drawn FROM un a JOIN pa ON pa.bag_id = a.bag_id JOIN un c ON c.bag_id = pa.partner
 QUALIFY row_number() OVER (PARTITION BY a.bag_id, a.idx ORDER BY round(list_distance(a.feat::DOUBLE[], c.feat::DOUBLE[]), 9), c.idx) = 1),
 m AS (SELECT nn.*, a.pos, a.v AS own, b.v AS other FROM nn JOIN up a ON a.bag_id = nn.bag_id AND a.idx = nn.idx JOIN up b ON b.bag_id = nn.partner AND b.idx = nn.nearest AND b.pos = a.pos),
 x AS (SELECT m.bag_id, n - 1 + dense_rank() OVER (PARTITION BY m.bag_id ORDER BY idx) AS idx, pos, own, other FROM m JOIN n ON n.bag_id = m.bag_id WHERE drawn)
 SELECT 'replace' AS mode, bag_id AS pair_id, idx, CAST(pos AS INT) AS pos, round(CASE WHEN drawn THEN other ELSE own END, 6) AS value, drawn AS made FROM m
 UNION ALL SELECT mode, bag_id, idx, pos, round(own, 6), false FROM m, (SELECT UNNEST(['append', 'interpolate']) AS mode) UNION ALL SELECT 'append', bag_id, idx, pos, round(other, 6), true FROM x
 UNION ALL SELECT 'interpolate', bag_id, idx, pos, round(0.75 * own + 0.25 * other, 6), true FROM x""")
def remix(spark, sf) -> DataFrame:
    inst = uneven(spark, sf)
    pairs = chosen(inst)
    found = [mixing.remix(inst, pairs, mode, 0.3, 0.25, 9).select(F.lit(mode).alias("mode"), "pair_id", "idx", F.posexplode("feat").alias("pos", "value"), "made") for mode in ("replace", "append", "interpolate")]
    return rounded(reduce(DataFrame.unionByName, found), "value")


@query(f"""WITH {CHOSEN}, pt AS (SELECT un.bag_id AS source, idx, CAST(floor({uniform(10, "un.bag_id || ':' || idx")} * least(n, 30)) AS INT) AS part FROM un JOIN n ON n.bag_id = un.bag_id),
 c AS (SELECT bag_id, partner, greatest(1, least(29, CAST(floor({uniform(9, "bag_id")} * 30) AS INT))) AS k, part FROM pa, range(0, 30) t(part)),
 s AS (SELECT bag_id, bag_id AS source, part, k, true AS own FROM c QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('11:' || bag_id || ':' || part), part) <= k
  UNION ALL SELECT bag_id, partner, part, k, false FROM c QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('12:' || bag_id || ':' || part), part) <= 30 - k)
 SELECT bag_id AS pair_id, source, idx, round(CASE WHEN bool_or(own) OVER w AND bool_or(NOT own) OVER w THEN k / 30.0 WHEN bool_or(own) OVER w THEN 1 ELSE 0 END, 6) AS ratio FROM s JOIN pt USING (source, part) WINDOW w AS (PARTITION BY bag_id)""")
def psebmix(spark, sf) -> DataFrame:
    inst = uneven(spark, sf)
    return rounded(mixing.psebmix(inst, chosen(inst), 30, 9), "ratio")


@query(f"""WITH {INST}, r AS (SELECT bag_id, idx % 4 AS cluster, idx, feat::DOUBLE[] AS feat FROM inst QUALIFY row_number() OVER (PARTITION BY bag_id, idx % 4 ORDER BY score DESC, idx) = 1)
 SELECT a.bag_id, a.cluster AS src, b.cluster AS dst, round(list_cosine_similarity(a.feat, b.feat), 6) AS similarity FROM r a JOIN r b ON a.bag_id = b.bag_id AND a.cluster != b.cluster
 QUALIFY row_number() OVER (PARTITION BY a.bag_id, a.cluster ORDER BY round(list_cosine_similarity(a.feat, b.feat), 9) DESC, b.cluster) = 1""")
def representative_graph(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf).withColumn("cluster", F.col("idx") % 4)
    return rounded(clusters.representative_graph(clusters.representatives(inst)), "similarity")


CONTEXTS = [("l2", True), ("dot", True), ("l2", False), ("dot", False)]
SCORES = {"l2": "-sqrt(sum((v - m) * (v - m)))", "dot": "sum(v * m)"}


def _context_sql(metric: str, hard: bool) -> str:
    name = f"{metric}-{'hard' if hard else 'soft'}"
    score = f"SELECT bag_id, idx, k, {SCORES[metric]} AS s FROM pos JOIN c USING (pos) GROUP BY bag_id, idx, k"
    if hard:
        picked = f"SELECT bag_id, idx, k, 1.0 AS w FROM ({score}) QUALIFY row_number() OVER (PARTITION BY bag_id, idx ORDER BY round(s, 9) DESC, k) = 1"
    else:
        picked = f"SELECT bag_id, idx, k, e / sum(e) OVER (PARTITION BY bag_id, idx) AS w FROM (SELECT *, exp((s - max(s) OVER (PARTITION BY bag_id, idx)) / 2.0) AS e FROM ({score}))"
    return f"SELECT '{name}' AS kind, t.bag_id, t.idx, CAST(p.pos AS INT) AS pos, round(any_value(p.v) + sum(w * m), 6) AS value FROM ({picked}) t JOIN pos p ON p.bag_id = t.bag_id AND p.idx = t.idx JOIN c ON c.k = t.k AND c.pos = p.pos GROUP BY t.bag_id, t.idx, p.pos"


@query(f"WITH {INST}, {POS}, lp AS (SELECT label, UNNEST(range(0, 64)) AS pos, CAST(UNNEST(feat) AS DOUBLE) AS v FROM inst), c AS (SELECT label AS k, pos, avg(v) AS m FROM lp GROUP BY label, pos) " + " UNION ALL ".join(_context_sql(*c) for c in CONTEXTS))
def nearest_center_context(spark, sf) -> DataFrame:
    """The classes' mean vectors as centres: by distance and dot product, hard and soft."""
    inst = T.vectors(spark, sf)
    centres = pooling.mean_pool(inst.select(F.col("label").alias("bag_id"), "feat"), DIM).toDF("k", "centre")
    found = [blocks.nearest_center_context(inst, centres, DIM, m, hard, 2.0).select(F.lit(f"{m}-{'hard' if hard else 'soft'}").alias("kind"), "bag_id", "idx", F.posexplode("feat").alias("pos", "value")) for m, hard in CONTEXTS]
    return rounded(reduce(DataFrame.unionByName, found), "value")


@query(f"""WITH {INST}, q AS (SELECT label, UNNEST(range(0, 64)) AS pos, UNNEST(list_transform(feat::DOUBLE[], lambda x: x / sqrt(list_inner_product(feat::DOUBLE[], feat::DOUBLE[])))) AS v FROM inst), m AS (SELECT label, pos, avg(v) AS v FROM q GROUP BY label, pos),
 c AS (SELECT label, list(v ORDER BY pos) AS cv FROM m GROUP BY label)
 SELECT bag_id, idx, CAST(row_number() OVER (PARTITION BY bag_id, idx ORDER BY c.label) - 1 AS INT) AS class, round(list_cosine_similarity(feat::DOUBLE[], cv), 6) AS logit FROM inst, c""")
def zero_shot_classifier(spark, sf) -> DataFrame:
    """Every embedding as a prompt of its label, and as a patch."""
    inst = T.vectors(spark, sf)
    out = clusters.zero_shot_logits(inst.select(F.col("label").alias("class"), "feat"), inst, DIM)
    return rounded(out.select("bag_id", "idx", F.posexplode("logits").alias("class", "logit")), "logit")


@query(f"""WITH {SLIDES} SELECT slide_id, coalesce(CASE WHEN slide_id % 3 = 0 AND slide_id % 2 = 0 THEN slide_id % 7 END, (SELECT max(r_regionkey) * 10 FROM region))::DOUBLE AS a_t, CASE WHEN slide_id % 3 = 0 THEN slide_id % 5 ELSE 8 END::DOUBLE AS a_h,
 CASE WHEN slide_id % 3 = 0 AND slide_id % 5 > 0 THEN 'fn' || (slide_id % 5) ELSE 'four_pt' END AS contour_fn, true AS use_padding, 2 AS seg_level FROM sl""")
def override_params(spark, sf) -> DataFrame:
    """Defaults under a preset of one row under settings for every third slide, some null or empty."""
    slides = T.slides(spark, sf)
    rows = slides.filter("slide_id % 3 = 0").selectExpr("slide_id", "if(slide_id % 2 = 0, slide_id % 7, null) as a_t", "slide_id % 5 as a_h", "if(slide_id % 5 > 0, concat('fn', slide_id % 5), '') as contour_fn")
    preset = T.table(spark, sf, "region").agg((F.max("r_regionkey") * 10).alias("a_t"), F.lit("").alias("contour_fn"), F.lit(2).alias("seg_level"))
    defaults = {"a_t": 50.0, "a_h": 8.0, "contour_fn": "four_pt", "use_padding": True, "seg_level": -1}
    return clusters.override_params(slides.select("slide_id"), defaults, preset, rows)


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT {KEYS} FROM lineitem WHERE l_quantity / 2.0 >= 5 AND NOT (l_discount * 1000 < 40 AND l_tax * 1000 < 40 AND l_linenumber * 10 < 40)")
def drop_blank_patches(spark, sf) -> DataFrame:
    inst = T.table(spark, sf, "lineitem").selectExpr(*KEYS.split(", "), "l_quantity / 2.0 as sat", "l_discount * 1000 as r", "l_tax * 1000 as g", "l_linenumber * 10 as b")
    return clusters.drop_blank_patches(inst).select(*KEYS.split(", "))


@query("""WITH p AS (SELECT vec_id, i, CAST(floor(embedding[3 * i + 1]::DOUBLE * 100 + 120) AS INT) AS r, CAST(floor(embedding[3 * i + 2]::DOUBLE * 100 + 120) AS INT) AS g, CAST(floor(embedding[3 * i + 3]::DOUBLE * 100 + 120) AS INT) AS b FROM embeddings, range(0, 21) t(i))
 SELECT vec_id FROM p GROUP BY vec_id HAVING count(*) FILTER (r < 60 AND g < 60 AND b < 60) <= 21 * 0.05::DOUBLE AND count(*) FILTER (r > 140 AND g > 140 AND b > 140) <= 21 * 0.1::DOUBLE""")
def drop_blank_pixels(spark, sf) -> DataFrame:
    """Embeddings as 21 pixels of three colours."""
    colour = "cast(floor(double(embedding[3 * i + {}]) * 100 + 120) as int)".format
    inst = T.table(spark, sf, "embeddings").select("vec_id", F.expr(f"transform(sequence(0, 20), i -> named_struct('r', {colour(0)}, 'g', {colour(1)}, 'b', {colour(2)}))").alias("pixels"))
    return clusters.drop_blank_pixels(inst, 60, 0.05, 140, 0.1).select("vec_id")


def _place_sql(c: str) -> str:
    return f"CAST(trunc((CAST({c} - l{c} AS FLOAT) / (CAST(h{c} - l{c} AS FLOAT) + 1e-8::FLOAT)) * CASE WHEN h{c} > l{c} THEN 100 ELSE 0 END::FLOAT) AS BIGINT)"


@query(f"""WITH {LINES}, e AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, CAST(ceil(sqrt(count(*) OVER w)) AS BIGINT) AS side FROM sc WINDOW w AS (PARTITION BY bag_id))
 SELECT true AS by_coords, bag_id, {_place_sql('x')} AS row, {_place_sql('y')} AS col, max(idx) AS idx FROM e GROUP BY ALL UNION ALL SELECT false, bag_id, idx // side, idx % side, idx FROM e""")
def grid_place(spark, sf) -> DataFrame:
    inst = T.scores(spark, sf)
    found = [clusters.grid_place(inst, by).select(F.lit(by).alias("by_coords"), "bag_id", "row", "col", "idx") for by in (True, False)]
    return found[0].unionByName(found[1])
