"""Each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import path_stem, vec_cosine, vec_dot, vec_l2, vec_norm
from ..operators import graphs, metrics, pooling, select, splits
from ..sources import tables as T

DIM = 64
INST = "inst AS (SELECT vec_id // 20 AS bag_id, vec_id % 20 AS idx, embedding AS feat, CAST(embedding[1] AS DOUBLE) AS score, label FROM embeddings)"
POS = "pos AS (SELECT bag_id, idx, score, UNNEST(range(0, 64)) AS pos, CAST(UNNEST(feat) AS DOUBLE) AS v FROM inst)"
LINES = """sc AS (SELECT l_orderkey AS bag_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx,
 CAST(l_extendedprice AS DOUBLE) AS score, CAST(l_partkey AS BIGINT) AS x, CAST(l_suppkey AS BIGINT) AS y FROM lineitem)"""
SLIDES = "sl AS (SELECT o_orderkey AS slide_id, o_custkey AS case_id, o_orderstatus AS label FROM orders)"
PREDS = "pr AS (SELECT doc_id, y, p1, CAST(p1 > 0.5 AS INT) AS yhat FROM (SELECT doc_id, CAST(quality AS INT) AS y, CAST((doc_id * 37) % 11 AS DOUBLE) / 10 AS p1 FROM labels))"
EPOCHS = "ep AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch, value FROM events)"
CELLS = f"""{PREDS}, cls AS (SELECT y AS c FROM pr UNION SELECT yhat FROM pr),
 cm AS (SELECT a.c AS y, b.c AS yhat, (SELECT count(*) FROM pr WHERE pr.y = a.c AND pr.yhat = b.c) AS n FROM cls a, cls b)"""
REPORT = f"""{CELLS}, s AS (SELECT y, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS hit FROM cm GROUP BY y),
 q AS (SELECT yhat AS y, sum(n) AS predicted FROM cm GROUP BY yhat),
 r AS (SELECT s.y, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r, support FROM s JOIN q ON s.y = q.y),
 rep AS (SELECT y, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, support FROM r)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def long(df: DataFrame) -> DataFrame:
    return df.select("bag_id", F.posexplode("feat").alias("pos", "value")).select("bag_id", "pos", F.round("value", 6).alias("value"))


@query(f"""WITH {INST}, {POS}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY bag_id)) AS e FROM pos WHERE pos < 10),
 b AS (SELECT bag_id, pos, sum(e * v) / sum(e) AS v FROM e GROUP BY bag_id, pos), h AS (SELECT bag_id, arg_max(pos, v) AS yhat FROM b GROUP BY bag_id),
 l AS (SELECT bag_id, label, count(*) AS n FROM inst GROUP BY ALL), m AS (SELECT bag_id, label FROM l QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY n DESC, label) = 1)
 SELECT h.bag_id, CAST(m.label AS INT) AS y, CAST(yhat AS INT) AS yhat, m.label = yhat AS correct FROM h JOIN m USING (bag_id)""")
def flagship(spark, sf) -> DataFrame:
    """Softmax-pooled bags, their class by the largest of the first ten elements, and their majority label."""
    inst = T.vectors(spark, sf)
    pooled = pooling.softmax_pool(inst, 10).withColumn("yhat", F.expr("cast(array_position(feat, array_max(feat)) - 1 as int)"))
    label = pooling.patient_label(inst.selectExpr("bag_id as case_id", "label")).selectExpr("case_id as bag_id", "cast(label as int) as y")
    return pooled.join(label, "bag_id").select("bag_id", "y", "yhat", (F.col("y") == F.col("yhat")).alias("correct"))


@query(f"WITH {INST}, {POS} SELECT bag_id, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM pos GROUP BY bag_id, pos")
def mean_pool(spark, sf) -> DataFrame:
    return long(pooling.mean_pool(T.vectors(spark, sf), DIM))


@query(f"WITH {INST}, {POS} SELECT bag_id, CAST(pos AS INT) AS pos, round(max(v), 6) AS value FROM pos GROUP BY bag_id, pos")
def max_pool(spark, sf) -> DataFrame:
    return long(pooling.max_pool(T.vectors(spark, sf), DIM))


@query(f"""WITH {INST}, {POS}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY bag_id)) AS e FROM pos)
 SELECT bag_id, CAST(pos AS INT) AS pos, round(sum(e * v) / sum(e), 6) AS value FROM e GROUP BY bag_id, pos""")
def softmax_pool(spark, sf) -> DataFrame:
    return long(pooling.softmax_pool(T.vectors(spark, sf), DIM))


@query(f"""WITH {INST}, {POS} SELECT bag_id, idx, CAST(pos AS INT) AS pos, round((v + avg(v) OVER (PARTITION BY bag_id, pos)) / 2, 6) AS value FROM pos""")
def global_mix(spark, sf) -> DataFrame:
    mixed = pooling.global_mix(T.vectors(spark, sf), DIM)
    return mixed.select("bag_id", "idx", F.posexplode("feat").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {LINES}, w AS (SELECT bag_id, exp((score - max(score) OVER (PARTITION BY bag_id)) / 10000) AS e FROM sc), p AS (SELECT bag_id, e / sum(e) OVER (PARTITION BY bag_id) AS p FROM w)
 SELECT bag_id, round(-sum(p * ln(p + 1e-8)), 6) AS entropy FROM p GROUP BY bag_id""")
def attention_entropy(spark, sf) -> DataFrame:
    inst = T.scores(spark, sf).withColumn("score", F.col("score") / 10000)
    return rounded(pooling.attention_entropy(inst), "entropy")


@query(f"WITH {LINES} SELECT bag_id, idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) = 1")
def top1_instance(spark, sf) -> DataFrame:
    return pooling.top1_instance(T.scores(spark, sf))


@query(f"WITH {LINES} SELECT bag_id, idx, CAST(floor(idx / ceil(count(*) OVER (PARTITION BY bag_id) / 3)) AS BIGINT) AS chunk FROM sc")
def pseudo_bags(spark, sf) -> DataFrame:
    return pooling.pseudo_bags(T.scores(spark, sf), 3).select("bag_id", "idx", "chunk")


@query(f"""WITH {LINES}, a AS (SELECT bag_id, idx // 4 AS chunk, score / 10000 AS s FROM sc),
 b AS (SELECT bag_id, chunk, exp(s - max(s) OVER (PARTITION BY bag_id, chunk)) AS e, s FROM a), c AS (SELECT bag_id, sum(e * s) / sum(e) AS s FROM b GROUP BY bag_id, chunk),
 d AS (SELECT bag_id, exp(s - max(s) OVER (PARTITION BY bag_id)) AS e, s FROM c) SELECT bag_id, round(sum(e * s) / sum(e), 6) AS score FROM d GROUP BY bag_id""")
def two_level_pool(spark, sf) -> DataFrame:
    return rounded(pooling.two_level_pool(T.scores(spark, sf).withColumn("score", F.col("score") / 10000), 4), "score")


@query(f"""WITH {LINES} SELECT bag_id, idx, CASE WHEN max(score) OVER w - min(score) OVER w <= 1 THEN 0 ELSE round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8), 4) END AS z FROM sc WINDOW w AS (PARTITION BY bag_id)""")
def zscore_features(spark, sf) -> DataFrame:
    """Lines of all bags; scores of a bag that span 1 or less count as equal (z 0)."""
    return pooling.zscore(T.scores(spark, sf), least=1.0).select("bag_id", "idx", F.round("z", 4).alias("z"))


@query(f"WITH {SLIDES} SELECT label, count(*) AS slides, count(DISTINCT case_id) AS cases FROM sl GROUP BY label")
def label_summary(spark, sf) -> DataFrame:
    return pooling.label_summary(T.slides(spark, sf))


@query(f"WITH {SLIDES} SELECT case_id, label FROM (SELECT case_id, label, count(*) AS n FROM sl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, label) = 1")
def patient_label(spark, sf) -> DataFrame:
    return pooling.patient_label(T.slides(spark, sf))


@query(f"WITH {EPOCHS} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, min(value) AS min, round(sum(value), 2) AS sum FROM ep")
def aggregate_array(spark, sf) -> DataFrame:
    return rounded(pooling.aggregate_array(T.epochs(spark, sf), "value"), "mean", "std").withColumn("sum", F.round("sum", 2))


@query(f"WITH {CELLS} SELECT y, yhat, n FROM cm")
def confusion_matrix(spark, sf) -> DataFrame:
    return metrics.confusion_matrix(T.predictions(spark, sf))


@query(f"WITH {REPORT} SELECT y, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep")
def classification_report(spark, sf) -> DataFrame:
    return rounded(metrics.classification_report(T.predictions(spark, sf)), "precision", "recall", "f1")


@query(f"""WITH {REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round((SELECT avg(CAST(y = yhat AS INT)) FROM pr), 6) AS accuracy,
 round((SELECT avg(CAST(y != yhat AS INT)) FROM pr), 6) AS error_rate, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy FROM rep""")
def prf_scores(spark, sf) -> DataFrame:
    out = metrics.prf_scores(T.predictions(spark, sf))
    return rounded(out, *out.columns)


@query(f"""WITH {PREDS}, t AS (SELECT count(*) AS n, avg(CAST(y = yhat AS INT)) AS po FROM pr), a AS (SELECT y AS c, count(*) AS n FROM pr GROUP BY y), b AS (SELECT yhat AS c, count(*) AS n FROM pr GROUP BY yhat),
 pe AS (SELECT sum(a.n * b.n) AS s FROM a JOIN b USING (c)) SELECT round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM t, pe""")
def cohen_kappa(spark, sf) -> DataFrame:
    return rounded(metrics.cohen_kappa(T.predictions(spark, sf)), "kappa")


@query(f"WITH {PREDS} SELECT y, count(*) AS n, CAST(sum(CAST(y = yhat AS INT)) AS BIGINT) AS correct, round(avg(CAST(y = yhat AS INT)), 6) AS acc FROM pr GROUP BY y")
def per_class_accuracy(spark, sf) -> DataFrame:
    return rounded(metrics.per_class_accuracy(T.predictions(spark, sf)), "acc")


@query(f"WITH {PREDS} SELECT round(avg(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0.0 END), 6) AS auc FROM pr a JOIN pr b ON a.y = 1 AND b.y = 0")
def roc_auc_binary(spark, sf) -> DataFrame:
    return rounded(metrics.roc_auc_binary(T.predictions(spark, sf)), "auc")


@query(f"""WITH {PREDS}, g AS (SELECT p1 AS threshold, sum(CAST(y = 0 AS INT)) AS neg, sum(CAST(y = 1 AS INT)) AS pos FROM pr GROUP BY p1)
 SELECT threshold, round(sum(neg) OVER (ORDER BY threshold DESC) / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER (ORDER BY threshold DESC) / sum(pos) OVER (), 6) AS tpr FROM g""")
def roc_curve(spark, sf) -> DataFrame:
    return rounded(metrics.roc_curve(T.predictions(spark, sf)), "fpr", "tpr")


@query(f"WITH {PREDS}, c AS (SELECT y, least(greatest(p1, 1e-6), 1 - 1e-6) AS p FROM pr) SELECT round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loss FROM c")
def bce_loss(spark, sf) -> DataFrame:
    return rounded(metrics.bce_loss(T.predictions(spark, sf)), "loss")


@query(f"""WITH {LINES} SELECT bag_id, idx, round((rank() OVER (PARTITION BY bag_id ORDER BY score) + (count(*) OVER (PARTITION BY bag_id, score) - 1) / 2) / count(*) OVER (PARTITION BY bag_id) * 100, 6) AS pct FROM sc""")
def to_percentiles(spark, sf) -> DataFrame:
    return select.to_percentiles(T.scores(spark, sf)).select("bag_id", "idx", F.round("pct", 6).alias("pct"))


@query(f"WITH {LINES} SELECT bag_id, idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) <= 3")
def topk_instances(spark, sf) -> DataFrame:
    return select.topk_instances(T.scores(spark, sf), 3).select("bag_id", "idx", "score")


@query(f"WITH {LINES} SELECT bag_id, idx FROM sc QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('7:' || bag_id || ':' || idx)) <= 2")
def cap_bag(spark, sf) -> DataFrame:
    return select.cap_bag(T.scores(spark, sf), 2, 7).select("bag_id", "idx")


@query(f"WITH {LINES} SELECT bag_id, idx FROM sc QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('7:' || bag_id || ':' || idx)) <= floor(count(*) OVER (PARTITION BY bag_id) * 0.5)")
def random_mask(spark, sf) -> DataFrame:
    return select.random_mask(T.scores(spark, sf), 0.5, 7).select("bag_id", "idx")


@query(f"WITH {INST}, s AS (SELECT bag_id, idx, CAST(ceil(sqrt(count(*) OVER (PARTITION BY bag_id))) AS BIGINT) AS side FROM inst) SELECT bag_id, idx, idx % side AS x, idx // side AS y FROM s")
def grid_coords(spark, sf) -> DataFrame:
    return select.grid_coords(T.vectors(spark, sf)).select("bag_id", "idx", "x", "y")


@query(f"WITH {LINES} SELECT bag_id, idx, CAST(row_number() OVER (PARTITION BY bag_id ORDER BY x, y, idx) - 1 AS INT) AS place FROM sc")
def order_coords(spark, sf) -> DataFrame:
    return select.order_coords(T.scores(spark, sf)).select("bag_id", "idx", "place")


@query(f"WITH {SLIDES} SELECT slide_id, CAST(ntile(8) OVER (PARTITION BY label ORDER BY slide_id) AS INT) AS part FROM sl")
def ntile_work(spark, sf) -> DataFrame:
    return select.ntile_work(T.slides(spark, sf), 8, ["label"], ["slide_id"]).select("slide_id", "part")


@query(f"WITH {LINES} SELECT bag_id, idx, x, y FROM sc WHERE x BETWEEN 100 AND 900 AND y BETWEEN 10 AND 60")
def roi_filter(spark, sf) -> DataFrame:
    return select.roi_filter(T.scores(spark, sf), (100, 10), (900, 60)).select("bag_id", "idx", "x", "y")


@query(f"WITH {LINES} SELECT bag_id, idx, score > 50000 OR max(score) OVER (PARTITION BY bag_id) <= 50000 AS kept FROM sc")
def soft_filter(spark, sf) -> DataFrame:
    return select.soft_filter(T.scores(spark, sf), 50000).select("bag_id", "idx", "kept")


@query(f"WITH {EPOCHS}, g AS (SELECT run, epoch FROM ep WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1) SELECT a.run, coalesce(g.epoch, 1) AS epoch FROM (SELECT DISTINCT run FROM ep) a LEFT JOIN g ON a.run = g.run")
def best_epoch(spark, sf) -> DataFrame:
    return select.best_epoch(T.epochs(spark, sf))


@query(f"""WITH {EPOCHS}, a AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch) AS low FROM ep), b AS (SELECT *, max(CASE WHEN value <= low THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS l FROM a)
 SELECT run, epoch, epoch - l AS waited, epoch - l >= 5 AS stop FROM b""")
def patience_counter(spark, sf) -> DataFrame:
    return select.patience_counter(T.epochs(spark, sf), 5).select("run", "epoch", "waited", "stop")


@query(f"WITH {SLIDES} SELECT slide_id, label, (row_number() OVER (ORDER BY label, md5('42:' || slide_id), slide_id) - 1) % 5 AS fold FROM sl")
def stratified_kfold(spark, sf) -> DataFrame:
    return splits.stratified_kfold(T.slides(spark, sf), 5, 42).select("slide_id", "label", F.col("fold").cast("long").alias("fold"))


ROLES = f"""{SLIDES}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || slide_id), slide_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM sl),
 rl AS (SELECT slide_id, case_id, label, CASE WHEN r <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * 0.85::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS role FROM rk)"""
RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


@query(f"WITH {ROLES} SELECT slide_id, label, role FROM rl")
def stratified_split(spark, sf) -> DataFrame:
    return splits.stratified_split(T.slides(spark, sf), RATIOS, 42).select("slide_id", "label", "role")


@query(f"WITH {ROLES} SELECT label, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'val') AS val, count(*) FILTER (role = 'test') AS test FROM rl GROUP BY label")
def split_descriptor(spark, sf) -> DataFrame:
    return splits.split_descriptor(splits.stratified_split(T.slides(spark, sf), RATIOS, 42), list(RATIOS))


@query(f"WITH {SLIDES} SELECT slide_id, label, round(1.0 / count(*) OVER (PARTITION BY label), 9) AS w FROM sl")
def balanced_weights(spark, sf) -> DataFrame:
    return splits.balanced_weights(T.slides(spark, sf)).select("slide_id", "label", F.round("w", 9).alias("w"))


@query(f"""WITH {INST}, d AS (SELECT a.bag_id, a.idx AS src, b.idx AS dst, round(list_distance(a.feat::DOUBLE[], b.feat::DOUBLE[]), 9) AS dist FROM inst a JOIN inst b ON a.bag_id = b.bag_id AND a.idx != b.idx)
 SELECT bag_id, src, dst FROM d QUALIFY row_number() OVER (PARTITION BY bag_id, src ORDER BY dist, dst) <= 5""")
def knn_graph(spark, sf) -> DataFrame:
    return graphs.knn_graph(T.vectors(spark, sf), 5).select("bag_id", "src", "dst")


@query(f"""WITH {SLIDES}, b AS (SELECT DISTINCT case_id AS bag_id FROM sl), o AS (SELECT bag_id, row_number() OVER (ORDER BY bag_id) AS r FROM b), h AS (SELECT bag_id AS partner, row_number() OVER (ORDER BY md5('3:' || bag_id), bag_id) AS r FROM b)
 SELECT o.bag_id, h.partner FROM o JOIN h USING (r)""")
def pair_bags(spark, sf) -> DataFrame:
    return graphs.pair_bags(T.slides(spark, sf).select(F.col("case_id").alias("bag_id")), 3)


@query(f"""WITH {INST}, p AS (SELECT a.bag_id, a.idx, a.feat::DOUBLE[] AS a, b.feat::DOUBLE[] AS b FROM inst a JOIN inst b ON a.bag_id = b.bag_id AND b.idx = 0)
 SELECT bag_id, idx, round(list_dot_product(a, b), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_distance(a, b), 6) AS l2, round(list_cosine_similarity(a, b), 6) AS cosine FROM p""")
def vector_functions(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf)
    first = inst.filter("idx = 0").select("bag_id", F.col("feat").alias("b"))
    a, b = F.col("feat"), F.col("b")
    out = inst.join(first, "bag_id").select("bag_id", "idx", vec_dot(a, b).alias("dot"), vec_norm(a).alias("norm"), vec_l2(a, b).alias("l2"), vec_cosine(a, b).alias("cosine"))
    return rounded(out, "dot", "norm", "l2", "cosine")


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages")
def path_stems(spark, sf) -> DataFrame:
    return T.table(spark, sf, "pages").select("page_id", path_stem(F.col("url")).alias("stem"))
