"""Queries of manifests, given-weight scores, many-class metrics and samples, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attention, clusters, manifests, metrics, pooling, splits
from ..sources import tables as T
from .catalogue import DIM, INST, LINES, POS, SLIDES, long, query, rounded

ROLES = f"{SLIDES}, ro AS (SELECT *, CASE slide_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS role FROM sl)"
WEIGHTS = "(o_orderkey * 7 % 101 + 1) AS w0, (o_orderkey * 13 % 97 + 1) AS w1, (o_orderkey * 19 % 89 + 1) AS w2"
PREDS3 = f"""q AS (SELECT o_orderkey AS slide_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, {WEIGHTS} FROM orders),
 p3 AS (SELECT slide_id, y, w0, w1, w2, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS yhat, w0 / (w0 + w1 + w2) AS a0, w1 / (w0 + w1 + w2) AS a1, w2 / (w0 + w1 + w2) AS a2 FROM q),
 ex AS (SELECT slide_id, y, 0 AS c, a0 AS p FROM p3 UNION ALL SELECT slide_id, y, 1, a1 FROM p3 UNION ALL SELECT slide_id, y, 2, a2 FROM p3)"""
#: The area from ranks: ties share their mean rank.
AREA = """(sum(CASE WHEN hit THEN rk ELSE 0 END) - sum(hit::INT) * (sum(hit::INT) + 1) / 2.0) / (sum(hit::INT) * sum((NOT hit)::INT))"""
RANK = "rank() OVER (PARTITION BY {0} ORDER BY p) + (count(*) OVER (PARTITION BY {0}, p) - 1) / 2.0 AS rk"
OVR = f"""ovr AS (SELECT c, sum(hit::INT) AS n, {AREA} AS auc FROM (SELECT c, p, y = c AS hit, {RANK.format('c')} FROM ex) GROUP BY c),
 mic AS (SELECT {AREA} AS micro FROM (SELECT p, y = c AS hit, {RANK.format('1')} FROM ex)), ovr1 AS (SELECT avg(auc) AS macro, sum(auc * n) / sum(n) AS weighted FROM ovr)"""


def roles(spark, sf) -> DataFrame:
    return T.slides(spark, sf).withColumn("role", F.expr("case slide_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end"))


def preds3(spark, sf) -> DataFrame:
    """slide_id, y, yhat and probs of three classes from orders."""
    out = T.table(spark, sf, "orders").selectExpr("o_orderkey as slide_id", "case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y", *WEIGHTS.replace(" AS", " as").split(", "))
    probs = F.array(*[F.col(f"w{c}") / (F.col("w0") + F.col("w1") + F.col("w2")) for c in range(3)])
    best = F.expr("cast(case when w0 >= w1 and w0 >= w2 then 0 when w1 >= w2 then 1 else 2 end as int)")
    return out.select("slide_id", "y", best.alias("yhat"), probs.alias("probs"), F.array(*[F.col(f"w{c}").cast("double") for c in range(3)]).alias("weights"))


@query("SELECT o_orderkey AS slide_id, o_orderstatus AS label FROM orders WHERE o_orderstatus IS NOT NULL")
def read_manifest(spark, sf) -> DataFrame:
    return manifests.read_manifest(spark, f"{sf}/orders.parquet", "o_orderkey", "o_orderstatus", "parquet")


@query("SELECT vec_id AS bag_id, CAST(i AS BIGINT) AS idx, round(list_sum(CAST(embedding[i * 16 + 1 : i * 16 + 16] AS DOUBLE[])), 6) AS total FROM embeddings, range(0, 4) t(i)")
def explode_bags(spark, sf) -> DataFrame:
    """Each embedding as a bag of four rows of 16 numbers, within a leading dimension of one."""
    bags = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("bag_id"), F.expr("array(transform(sequence(0, 3), i -> slice(embedding, i * 16 + 1, 16)))").alias("features"))
    out = manifests.explode_bags(bags)
    return out.select("bag_id", "idx", F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


STEM = r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@query(f"""WITH s AS (SELECT page_id, {STEM} AS stem FROM pages), k AS (SELECT stem, max(page_id) AS m FROM s WHERE page_id % 3 > 0 GROUP BY stem)
 SELECT page_id, m % 10 AS x, m // 10 AS y FROM s LEFT JOIN k USING (stem)""")
def attach_coords(spark, sf) -> DataFrame:
    """Pages with the coordinates of the last indexed page (ids not divisible by three) of their file stem."""
    pages = T.table(spark, sf, "pages")
    index = pages.filter("page_id % 3 > 0").selectExpr("url as path", "page_id as nth", "page_id % 10 as x", "page_id div 10 as y")
    return manifests.attach_coords(pages.select("page_id", F.col("url").alias("path")), index, "nth").select("page_id", "x", "y")


@query(f"WITH {LINES}, {SLIDES} SELECT bag_id, idx, score, label FROM sc JOIN sl ON bag_id = slide_id")
def bag_label_join(spark, sf) -> DataFrame:
    return manifests.bag_label_join(T.scores(spark, sf), T.slides(spark, sf)).select("bag_id", "idx", "score", "label")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src3')")
def filter_dict(spark, sf) -> DataFrame:
    return manifests.filter_dict(T.table(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": ["en", "de"], "source": ["src0", "src3"]})


@query(f"""WITH {ROLES}, n AS (SELECT role, count(*) AS n, sum(slide_id) AS ids FROM ro GROUP BY role)
 SELECT (SELECT max(n) FROM n) AS rows, (SELECT n FROM n WHERE role = 'train') AS train, (SELECT n FROM n WHERE role = 'val') AS val, (SELECT n FROM n WHERE role = 'test') AS test,
 CAST((SELECT ids FROM n WHERE role = 'val') AS BIGINT) AS val_ids, CAST((SELECT max(n) FROM n) AS BIGINT) AS last""")
def write_split_wide(spark, sf) -> DataFrame:
    """What the wide form holds: its rows, each role's slides, the sum of one role's ids, its last position."""
    wide = manifests.write_split_wide(roles(spark, sf), ["train", "val", "test"])
    counts = [F.count(f"{r}_slide_path").alias(r) for r in ("train", "val", "test")]
    return wide.agg(F.count("*").alias("rows"), *counts, F.sum("val_slide_path").alias("val_ids"), F.max("position").alias("last"))


@query(f"WITH {ROLES} SELECT slide_id, role = 'train' AS train, role = 'val' AS val, role = 'test' AS test FROM ro")
def split_flags(spark, sf) -> DataFrame:
    return manifests.split_flags(roles(spark, sf), ["train", "val", "test"])


@query(f"WITH {PREDS3} SELECT slide_id, y AS Y, yhat AS Y_hat, round(a0, 6) AS p_0, round(a1, 6) AS p_1, round(a2, 6) AS p_2 FROM p3")
def write_predictions(spark, sf) -> DataFrame:
    return rounded(manifests.prediction_columns(preds3(spark, sf), 3), "p_0", "p_1", "p_2")


@query(f"WITH {ROLES} SELECT slide_id, 'union' AS op FROM ro WHERE role IN ('val', 'test') UNION ALL SELECT slide_id, 'difference' FROM ro WHERE role <> 'val'")
def merge_roles(spark, sf) -> DataFrame:
    slides = roles(spark, sf)
    val, test = slides.filter("role = 'val'"), slides.filter("role = 'test'")
    both = manifests.merge_roles(val, test, "union").withColumn("op", F.lit("union"))
    return both.union(manifests.merge_roles(slides, val, "difference").withColumn("op", F.lit("difference")))


@query(f"""WITH {SLIDES}, n AS (SELECT label, count(*) AS n FROM sl GROUP BY label),
 k AS (SELECT slide_id, label, -ln((CAST('0x' || left(md5('0:' || slide_id), 8) AS BIGINT) + 1) / 4294967297.0) * n AS k FROM sl JOIN n USING (label))
 SELECT slide_id, label FROM k ORDER BY k, slide_id LIMIT 300""")
def balanced_sample(spark, sf) -> DataFrame:
    return manifests.balanced_sample(T.slides(spark, sf), 300).select("slide_id", "label")


@query("""SELECT l_orderkey AS bag_id, l_linenumber AS line, count(*) AS n, CASE WHEN l_discount * 10 < 0.25 THEN 0.375 WHEN l_discount * 10 < 0.95 THEN 0.5 ELSE 0.625 END AS shift
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) GROUP BY ALL""")
def center_shift(spark, sf) -> DataFrame:
    lines = T.table(spark, sf, "lineitem").selectExpr("l_orderkey as bag_id", "l_linenumber as line", "cast(l_discount as double) * 10 as overlap")
    return manifests.center_shift(lines).groupBy("bag_id", "line", "shift").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS part, 100 * CAST(floor(262144.0 / (s * s)) AS BIGINT) AS a_t, 16 * CAST(floor(262144.0 / (s * s)) AS BIGINT) AS a_h FROM (SELECT p_partkey, p_size AS s FROM part)""")
def scale_area(spark, sf) -> DataFrame:
    params = T.table(spark, sf, "part").selectExpr("p_partkey as part", "p_size as sx", "p_size as sy", "100L as a_t", "16L as a_h")
    return manifests.scale_area(params).select("part", "a_t", "a_h")


GATES = 3
V = [[((k * 64 + j) % 5 - 2) / 4 for j in range(DIM)] for k in range(GATES)]
U = [[((k * 3 + j) % 7 - 3) / 5 for j in range(DIM)] for k in range(GATES)]
W = [(k + 1) / 3 for k in range(GATES)]


@query(f"""WITH {INST}, {POS}, d AS (SELECT bag_id, idx, k, sum(v * ((k * 64 + pos) % 5 - 2) / 4.0) AS a, sum(v * ((k * 3 + pos) % 7 - 3) / 5.0) AS b FROM pos, range(0, {GATES}) t(k) GROUP BY ALL)
 SELECT bag_id, idx, round(sum((k + 1) / 3.0 * tanh(a) / (1 + exp(-b))), 6) AS score FROM d GROUP BY bag_id, idx""")
def gated_scores(spark, sf) -> DataFrame:
    return rounded(attention.gated_scores(T.vectors(spark, sf), V, U, W).select("bag_id", "idx", "score"), "score")


ATTENTION = "att AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS a FROM inst WINDOW w AS (PARTITION BY bag_id))"


@query(f"""WITH {INST}, {ATTENTION} SELECT bag_id, idx, round(a * feat[1], 6) AS c0, round(a * feat[2], 6) AS c1, round(sum(a * feat[1]) OVER w, 6) AS b0, round(sum(a * feat[2]) OVER w, 6) AS b1
 FROM att WINDOW w AS (PARTITION BY bag_id)""")
def additive_pool(spark, sf) -> DataFrame:
    """Contributions of instances and the bags' sums; the logits are the first two elements."""
    inst = T.vectors(spark, sf).withColumn("logit", F.expr("transform(slice(feat, 1, 2), x -> cast(x as double))"))
    bags, contrib = attention.additive_pool(inst, "logit", 2)
    out = contrib.join(bags.withColumnRenamed("logits", "b"), "bag_id").selectExpr("bag_id", "idx", "contrib[0] as c0", "contrib[1] as c1", "b[0] as b0", "b[1] as b1")
    return rounded(out, "c0", "c1", "b0", "b1")


@query(f"""WITH {INST}, {POS}, c AS (SELECT bag_id, k AS class, arg_max(idx, (feat[k + 1], -idx)) AS top FROM inst, range(0, 3) t(k) GROUP BY ALL),
 s AS (SELECT p.bag_id, c.class, p.idx, sum(p.v * q.v) / 8 AS s FROM pos p JOIN c ON p.bag_id = c.bag_id JOIN pos q ON q.bag_id = c.bag_id AND q.idx = c.top AND q.pos = p.pos GROUP BY ALL),
 e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY bag_id, class)) AS e FROM s)
 SELECT e.bag_id, CAST(class AS INT) AS class, CAST(pos AS INT) AS pos, round(sum(e * v) / sum(e), 6) AS value FROM e JOIN pos ON e.bag_id = pos.bag_id AND e.idx = pos.idx GROUP BY ALL""")
def critical_attention(spark, sf) -> DataFrame:
    """Bag vectors of three classes; the logits are the first three elements."""
    out = attention.critical_attention(T.vectors(spark, sf).withColumn("logit", F.slice("feat", 1, 3)), "logit", 3, DIM)
    return out.select("bag_id", "class", F.posexplode("feat").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {INST}, {POS}, {ATTENTION}, d AS (SELECT bag_id, idx, sum(v * ((pos % 9) - 4) / 3.0) AS d FROM pos GROUP BY ALL) SELECT bag_id, idx, round(a * d, 6) AS cam FROM att JOIN d USING (bag_id, idx)""")
def cam_scores(spark, sf) -> DataFrame:
    weight = attention.softmax_weight(F.col("score"), "bag_id")
    inst = T.vectors(spark, sf).withColumn("attention", weight)
    return rounded(attention.cam_scores(inst, F.col("attention"), [((j % 9) - 4) / 3 for j in range(DIM)]).select("bag_id", "idx", "cam"), "cam")


@query(f"WITH {INST}, {POS}, d AS (SELECT bag_id, idx, sum(v * ((pos % 9) - 4)) AS d, sqrt(sum(v * v)) AS n, sqrt(sum(((pos % 9) - 4) ** 2)) AS m FROM pos GROUP BY ALL) SELECT bag_id, idx, round(least(greatest(d / (n * m), 0), 1), 6) AS relevance FROM d")
def relevance_score(spark, sf) -> DataFrame:
    token = attention.row([(j % 9) - 4 for j in range(DIM)])
    return T.vectors(spark, sf).select("bag_id", "idx", F.round(attention.relevance_score(F.col("feat"), token), 6).alias("relevance"))


@query("""SELECT vec_id, round(greatest(x, 0), 6) AS relu, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) AS leakyrelu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh,
 round(x / (1 + exp(-x)), 6) AS silu, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""")
def activations(spark, sf) -> DataFrame:
    x = F.expr("cast(embedding[0] as double)")
    kinds = ("relu", "leakyrelu", "sigmoid", "tanh", "silu", "gelu")
    return T.table(spark, sf, "embeddings").select("vec_id", *[F.round(attention.activation(x, k), 6).alias(k) for k in kinds])


@query(f"""WITH {PREDS3}, e AS (SELECT slide_id, exp(w0 / 20.0) AS e0, exp(w1 / 20.0) AS e1, exp(w2 / 20.0) AS e2 FROM p3)
 SELECT slide_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e""")
def softmax_probs(spark, sf) -> DataFrame:
    out = metrics.softmax_probs(preds3(spark, sf).drop("probs").withColumnRenamed("weights", "logits"), 0.05)
    return out.select("slide_id", *[F.round(F.col("probs")[c], 6).alias(f"p{c}") for c in range(3)])


@query(f"WITH {PREDS3}, {OVR} SELECT round(macro, 6) AS macro, round(weighted, 6) AS weighted, round(micro, 6) AS micro, round(macro, 6) AS nanmean FROM ovr1, mic")
def roc_auc_ovr(spark, sf) -> DataFrame:
    return rounded(metrics.roc_auc_ovr(preds3(spark, sf)), "macro", "weighted", "micro", "nanmean")


@query(f"""WITH {PREDS3}, o AS (SELECT a.c AS a, b.c AS b, ex.p, ex.y = a.c AS hit FROM (VALUES (0), (1), (2)) a(c), (VALUES (0), (1), (2)) b(c), ex WHERE a.c <> b.c AND ex.y IN (a.c, b.c) AND ex.c = a.c),
 r AS (SELECT a, b, {AREA} AS auc FROM (SELECT *, {RANK.format('a, b')} FROM o) GROUP BY a, b) SELECT round(avg(auc), 6) AS macro FROM r""")
def roc_auc_ovo(spark, sf) -> DataFrame:
    return rounded(metrics.roc_auc_ovo(preds3(spark, sf)), "macro")


CELLS3 = "c3 AS (SELECT a.c AS y, b.c AS yhat, (SELECT count(*) FROM p3 WHERE p3.y = a.c AND p3.yhat = b.c) AS n FROM (VALUES (0), (1), (2)) a(c), (VALUES (0), (1), (2)) b(c))"
KAPPA = "(SELECT 1 - sum({w} * n) / (sum({w} * ny * nh) / max(t)) FROM (SELECT y, yhat, n, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER (PARTITION BY yhat) AS nh, sum(n) OVER () AS t FROM c3))"
KAPPAS = ", ".join(f"round({KAPPA.format(w=w)}, 6) AS {n}" for w, n in (("(y <> yhat)::INT", "kappa"), ("abs(y - yhat)", "linear_kappa"), ("(y - yhat) ** 2", "quadratic_kappa")))


@query(f"""WITH {PREDS3}, {OVR}, {CELLS3}, s AS (SELECT y, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS hit FROM c3 GROUP BY y), h AS (SELECT yhat AS y, sum(n) AS predicted FROM c3 GROUP BY yhat),
 r AS (SELECT support, hit / predicted AS p, hit / support AS r, 2 * hit / (predicted + support) AS f FROM s JOIN h USING (y))
 SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall,
 round(sum(f * support) / sum(support), 6) AS weighted_f1, round(sum(r * support) / sum(support), 6) AS accuracy, round(1 - sum(r * support) / sum(support), 6) AS error_rate, round(avg(r), 6) AS balanced_accuracy,
 {KAPPAS}, (SELECT round(macro, 6) FROM ovr1) AS auc_macro, (SELECT round(weighted, 6) FROM ovr1) AS auc_weighted, (SELECT round(micro, 6) FROM mic) AS auc_micro FROM r""")
def evaluate_all(spark, sf) -> DataFrame:
    out = metrics.evaluate_all(preds3(spark, sf)).drop("confusion")
    return rounded(out, *out.columns)


@query("""SELECT round(avg(b * 0.7 + i * 0.3), 6) AS weighted, round(avg((b + m) / 2), 6) AS halves, round(avg(b - 0.5 * e), 6) AS penalised
 FROM (SELECT CAST(l_quantity AS DOUBLE) / 50 AS b, CAST(l_tax AS DOUBLE) AS i, CAST(l_discount AS DOUBLE) AS m, CAST(l_linenumber AS DOUBLE) / 7 AS e FROM lineitem)""")
def combined_loss(spark, sf) -> DataFrame:
    losses = T.table(spark, sf, "lineitem").selectExpr("cast(l_quantity as double) / 50 as bag", "cast(l_tax as double) as instance", "cast(l_discount as double) as max", "cast(l_linenumber as double) / 7 as entropy")
    return rounded(metrics.combined_loss(losses), "weighted", "halves", "penalised")


HASH = "md5('{0}:' || {1})"


@query(f"""WITH {SLIDES}, r AS (SELECT *, row_number() OVER (ORDER BY label, {HASH.format(0, 'slide_id')}, slide_id) - 1 AS r FROM sl), e AS (SELECT f AS fold, slide_id, label, r % 4 AS own FROM r, range(0, 4) t(f)),
 k AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY {HASH.format(1, "fold || ':' || slide_id")}, slide_id) AS n, count(*) OVER (PARTITION BY fold, label) AS m FROM e WHERE own <> fold)
 SELECT fold, slide_id, CASE WHEN n <= floor(m * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS role FROM k UNION ALL SELECT fold, slide_id, 'test' FROM e WHERE own = fold""")
def kfold_then_val(spark, sf) -> DataFrame:
    return splits.kfold_then_val(T.slides(spark, sf), 4, 0.2)


AFFINE = """af AS (SELECT a.bag_id, a.idx AS src, b.idx AS dst, round(list_inner_product(a.feat::DOUBLE[], b.feat::DOUBLE[]) / 8, 9) AS s FROM inst a JOIN inst b ON a.bag_id = b.bag_id),
 tk AS (SELECT * FROM af QUALIFY row_number() OVER (PARTITION BY bag_id, src ORDER BY s DESC, dst) <= 10),
 ed AS (SELECT bag_id, src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY bag_id, src) AS w FROM tk)"""


@query(f"WITH {INST}, {AFFINE} SELECT bag_id, src, dst, round(w, 6) AS w FROM ed")
def affinity_graph(spark, sf) -> DataFrame:
    return rounded(clusters.affinity_graph(T.vectors(spark, sf), 10, DIM), "w")


@query(f"WITH {INST}, {POS}, {AFFINE} SELECT ed.bag_id, src AS idx, CAST(pos AS INT) AS pos, round(sum(w * v), 6) AS value FROM ed JOIN pos ON ed.bag_id = pos.bag_id AND ed.dst = pos.idx GROUP BY ALL")
def neighbour_aggregate(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf)
    out = clusters.neighbour_aggregate(clusters.affinity_graph(inst, 10, DIM), inst, DIM)
    return out.select("bag_id", "idx", F.posexplode("feat").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {INST}, {POS} SELECT bag_id, idx % 3 AS k, CAST(pos AS INT) AS pos, round(sum(v / (idx + 1)), 6) AS value FROM pos GROUP BY ALL")
def soft_cluster_pool(spark, sf) -> DataFrame:
    """Clusters idx % 3 with membership 1 / (idx + 1)."""
    inst = T.vectors(spark, sf)
    out = clusters.soft_cluster_pool(inst.selectExpr("bag_id", "idx", "idx % 3 as k", "1.0D / (idx + 1) as w"), inst, DIM)
    return out.select("bag_id", "k", F.posexplode("feat").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {INST} SELECT bag_id, label AS cluster, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM (SELECT bag_id, label, UNNEST(range(0, 64)) AS pos, CAST(UNNEST(feat) AS DOUBLE) AS v FROM inst) GROUP BY ALL")
def bag_prototypes(spark, sf) -> DataFrame:
    out = clusters.bag_prototypes(T.vectors(spark, sf).withColumnRenamed("label", "cluster"), DIM)
    return out.select("bag_id", "cluster", F.posexplode("feat").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("""WITH r AS (SELECT o_custkey AS bag_id, o_orderkey AS idx, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)),
 p AS (SELECT *, CASE WHEN n >= 8 THEN n // 4 ELSE 1 END AS parts FROM r), q AS (SELECT *, n // parts AS base, n % parts AS more FROM p)
 SELECT bag_id, idx, CASE WHEN r < more * (base + 1) THEN r // (base + 1) ELSE more + (r - more * (base + 1)) // base END AS "window" FROM q""")
def split_large_clusters(spark, sf) -> DataFrame:
    orders = T.table(spark, sf, "orders").selectExpr("o_custkey as bag_id", "o_orderkey as idx")
    return clusters.split_large_clusters(orders, 4)


@query(f"""WITH {INST}, hd AS (SELECT bag_id, idx, h, exp(feat[h + 1]) / sum(exp(feat[h + 1])) OVER (PARTITION BY bag_id, h) AS a FROM inst, range(0, 4) t(h)),
 c AS (SELECT x.bag_id, x.h AS i, y.h AS j, sum(x.a * y.a) / sqrt(sum(x.a * x.a) * sum(y.a * y.a)) AS c FROM hd x JOIN hd y ON x.bag_id = y.bag_id AND x.idx = y.idx AND x.h < y.h GROUP BY ALL)
 SELECT bag_id, round(avg(c), 6) AS diversity FROM c GROUP BY bag_id""")
def attention_diversity(spark, sf) -> DataFrame:
    """Four heads: the softmax of each of the first four elements."""
    heads = T.vectors(spark, sf).select("bag_id", "idx", F.posexplode(F.slice("feat", 1, 4)).alias("head", "s"))
    heads = heads.withColumn("a", attention.softmax_weight(F.col("s").cast("double"), "bag_id", "head"))
    return rounded(clusters.attention_diversity(heads), "diversity")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
 SELECT round(avg(greatest(0, list_cosine_similarity(a.v, n.v) - list_cosine_similarity(a.v, p.v) + 1)), 6) AS loss FROM e a JOIN e p ON p.vec_id = a.vec_id + 1 JOIN e n ON n.vec_id = a.vec_id + 2""")
def triplet_loss(spark, sf) -> DataFrame:
    """Each embedding with the next one as positive and the one after as negative."""
    e = T.table(spark, sf, "embeddings")
    side = lambda name, shift: e.select((F.col("vec_id") - shift).alias("vec_id"), F.col("embedding").alias(name))
    return rounded(clusters.triplet_loss(side("a", 0).join(side("p", 1), "vec_id").join(side("n", 2), "vec_id")), "loss")


@query(f"WITH {INST}, {POS}, m AS (SELECT bag_id, pos, avg(v) AS m FROM pos GROUP BY ALL) SELECT bag_id, idx, round(sum(v * m), 6) AS importance FROM pos JOIN m USING (bag_id, pos) GROUP BY bag_id, idx")
def bag_importance(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf)
    return rounded(clusters.bag_importance(inst, pooling.mean_pool(inst, DIM)).select("bag_id", "idx", "importance"), "importance")


@query(f"""WITH {LINES}, p AS (SELECT *, 1 / (1 + exp(-(score - 30000) / 20000)) AS p FROM sc), r AS (SELECT bag_id, p, 1 AS y FROM p QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) <= 2
 UNION ALL SELECT bag_id, p, 0 FROM p QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY score, idx) <= 2)
 SELECT bag_id, count(*) AS n, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS loss, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r GROUP BY bag_id""")
def instance_eval(spark, sf) -> DataFrame:
    prob = attention.sigmoid((F.col("score") - 30000) / 20000)
    return rounded(clusters.instance_eval(T.scores(spark, sf), prob, 2), "loss", "accuracy")


@query(f"""WITH {LINES}, t AS (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) <= 4 AS top FROM sc),
 d AS (SELECT *, top AND row_number() OVER (PARTITION BY bag_id, top ORDER BY md5('5:' || bag_id || ':' || idx)) <= 2 AS masked FROM t),
 k AS (SELECT *, CASE WHEN masked THEN NULL ELSE score / 10000 END AS s FROM d), e AS (SELECT *, coalesce(exp(s - max(s) OVER (PARTITION BY bag_id)), 0) AS e FROM k)
 SELECT bag_id, idx, masked, CASE WHEN sum(e) OVER w = 0 THEN NULL ELSE round(e / sum(e) OVER w, 6) END AS weight FROM e WINDOW w AS (PARTITION BY bag_id)""")
def stochastic_topk_mask(spark, sf) -> DataFrame:
    """Bags whose instances are all masked have no weights."""
    inst = T.scores(spark, sf).withColumn("score", F.col("score") / 10000)
    return rounded(clusters.stochastic_topk_mask(inst, 4, 0.5, 5).select("bag_id", "idx", "masked", "weight"), "weight")


@query(f"WITH {LINES} SELECT bag_id, idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('6:' || bag_id || ':' || idx)) <= 3")
def sample_patches(spark, sf) -> DataFrame:
    return clusters.sample_patches(T.scores(spark, sf), 3, 6).select("bag_id", "idx", "score")


@query("SELECT s_suppkey, s_suppkey * 2 AS x, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE -s_nationkey END AS y FROM supplier WHERE s_suppkey % 7 > 0 UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 7 = 0")
def parse_patch_name(spark, sf) -> DataFrame:
    """Names made of two keys; every seventh is none."""
    name = F.expr("if(s_suppkey % 7 = 0, 'cover.jpg', concat(s_suppkey * 2, '_', -s_nationkey, '.jpg'))")
    return T.table(spark, sf, "supplier").select("s_suppkey", clusters.parse_patch_name(name).alias("p")).select("s_suppkey", "p.x", "p.y")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey + s_nationkey END AS total FROM supplier")
def parse_ids(spark, sf) -> DataFrame:
    """How many numbers a text of two keys holds and their sum; every fifth is 'none'."""
    text = F.expr("if(s_suppkey % 5 = 0, 'none', concat(s_suppkey, ', ', s_nationkey))")
    ids = T.table(spark, sf, "supplier").select("s_suppkey", clusters.parse_ids(text).alias("ids"))
    total = F.when(F.size("ids") > 0, F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x))
    return ids.select("s_suppkey", F.size("ids").alias("n"), total.alias("total"))


@query("SELECT o_orderkey AS slide_id, CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE o_orderkey % 10 END AS sthresh, 512 AS a_t, 1 AS process, 'tbp' AS status FROM orders")
def init_process_list(spark, sf) -> DataFrame:
    slides = T.table(spark, sf, "orders").selectExpr("o_orderkey as slide_id", "if(o_orderkey % 3 = 0, null, o_orderkey % 10) as sthresh")
    return clusters.init_process_list(slides, {"sthresh": 8, "a_t": 512})


@query("""SELECT o_orderkey AS slide_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5) THEN 'already_exist' WHEN o_orderkey % 11 = 0 THEN 'failed_for_level'
 WHEN CAST(o_totalprice AS DOUBLE) * 1000 > 1e8 THEN 'failed_seg' ELSE 'tbp' END AS status FROM orders""")
def pending_work(spark, sf) -> DataFrame:
    """Orders as slides: done if they have a fifth line, without a level if divisible by 11, their price as area."""
    proc = T.table(spark, sf, "orders").selectExpr("o_orderkey as slide_id", "if(o_orderkey % 11 = 0, null, 1) as level", "cast(o_totalprice as double) * 1000 as area")
    done = T.table(spark, sf, "lineitem").filter("l_linenumber = 5").select(F.col("l_orderkey").alias("slide_id"))
    return clusters.pending_work(proc, done).select("slide_id", "status")
