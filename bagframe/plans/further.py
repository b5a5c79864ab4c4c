"""More queries of the catalogue beside their SQL: reworked and mixed bags, roles, epochs, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash_order
from ..operators import bags, graphs, mixing, pooling, select, splits
from ..sources import tables as T
from ..streaming import running
from .catalogue import DIM, EPOCHS, INST, LINES, ORACLE_SQL, POS, RATIOS, ROLES, SLIDES, query, rounded

JS = [1, 5, 10]
EVENTS = ["click", "error", "purchase", "signup", "view"]
SIZES = f"{LINES}, n AS (SELECT bag_id, count(*) AS n FROM sc GROUP BY bag_id)"


def uniform(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def mix_pairs(inst: DataFrame) -> DataFrame:
    return graphs.pair_bags(inst.select("bag_id"), 3)


MIXED = f"""{SIZES}, o AS (SELECT bag_id, row_number() OVER (ORDER BY bag_id) AS r FROM n), h AS (SELECT bag_id AS partner, row_number() OVER (ORDER BY md5('3:' || bag_id), bag_id) AS r FROM n),
 pa AS (SELECT o.bag_id, h.partner, a.n AS n1, b.n AS n2, {uniform(9, "o.bag_id")} AS lam FROM o JOIN h USING (r) JOIN n a ON a.bag_id = o.bag_id JOIN n b ON b.bag_id = h.partner)"""


@query(f"""WITH {INST}, {POS}, r AS (SELECT bag_id, pos, v, row_number() OVER (PARTITION BY bag_id, pos ORDER BY v DESC) AS r FROM pos WHERE pos < 10)
 SELECT bag_id, CAST(j AS INT) AS j, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM r JOIN (SELECT UNNEST([1, 5, 10]) AS j) ON r <= j GROUP BY bag_id, j, pos""")
def topj_pool(spark, sf) -> DataFrame:
    return rounded(bags.topj_pool(T.vectors(spark, sf), JS, 10), "value")


@query(f"""WITH {INST}, {POS}, t AS (SELECT bag_id, idx FROM inst QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) <= 3),
 l AS (SELECT bag_id, pos, avg(v) AS m FROM pos JOIN t USING (bag_id, idx) GROUP BY bag_id, pos)
 SELECT bag_id, idx, CAST(pos AS INT) AS pos, round(greatest(v - m, 0), 6) AS value FROM pos JOIN l USING (bag_id, pos)""")
def recalibrate(spark, sf) -> DataFrame:
    out = bags.recalibrate(T.vectors(spark, sf), 3, DIM)
    return rounded(out.select("bag_id", "idx", F.posexplode("feat").alias("pos", "value")), "value")


@query(f"""WITH {LINES}, c AS (SELECT bag_id, idx, score, CAST(floor(idx / ceil(count(*) OVER (PARTITION BY bag_id) / 2)) AS BIGINT) AS chunk FROM sc)
 SELECT bag_id, chunk, idx, 'max' AS kind FROM c QUALIFY row_number() OVER (PARTITION BY bag_id, chunk ORDER BY score DESC, idx) <= 1
 UNION ALL SELECT bag_id, chunk, idx, 'min' FROM c QUALIFY row_number() OVER (PARTITION BY bag_id, chunk ORDER BY score, idx) <= 1""")
def distill(spark, sf) -> DataFrame:
    return bags.distill(T.scores(spark, sf), 2, 1)


@query(f"""WITH {SIZES}, p AS (SELECT bag_id, n, UNNEST(range(0, CAST(ceil(sqrt(n)) * ceil(sqrt(n)) AS BIGINT))) AS place FROM n), q AS (SELECT bag_id, place, CASE WHEN place < n THEN place ELSE (place - n) % n END AS src FROM p)
 SELECT q.bag_id, place AS idx, src, score FROM q JOIN sc ON sc.bag_id = q.bag_id AND sc.idx = src""")
def pad_square(spark, sf) -> DataFrame:
    return bags.pad_square(T.scores(spark, sf)).select("bag_id", "idx", "src", "score")


@query(f"""WITH {SIZES}, p AS (SELECT bag_id, n, UNNEST(range(0, CAST(ceil(n / 3) * 3 AS BIGINT))) AS place FROM n), q AS (SELECT bag_id, place, CASE WHEN place < n THEN place ELSE n - n % 3 + (place - n) % (n % 3) END AS src FROM p)
 SELECT q.bag_id, place AS idx, src, score FROM q JOIN sc ON sc.bag_id = q.bag_id AND sc.idx = src""")
def pad_chunks(spark, sf) -> DataFrame:
    return bags.pad_chunks(T.scores(spark, sf), 3).select("bag_id", "idx", "src", "score")


@query(f"""WITH {LINES}, m AS (SELECT *, min(x) OVER (PARTITION BY bag_id) AS mx, min(y) OVER (PARTITION BY bag_id) AS my FROM sc)
 SELECT bag_id, idx, CAST(round_even((x - mx) / 896.0::DOUBLE, 0) * 300 + round_even((y - my) / 896.0::DOUBLE, 0) AS BIGINT) AS cell FROM m""")
def quantize_coords(spark, sf) -> DataFrame:
    return bags.quantize_coords(T.scores(spark, sf)).select("bag_id", "idx", "cell")


@query(f"WITH {LINES}, {SLIDES} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY bag_id, idx) - 1 AS idx, bag_id AS slide_id, score FROM sc JOIN (SELECT DISTINCT slide_id, case_id FROM sl) ON bag_id = slide_id")
def patient_bags(spark, sf) -> DataFrame:
    return bags.patient_bags(T.scores(spark, sf), T.slides(spark, sf))


@query(f"""WITH {INST}, b AS (SELECT DISTINCT bag_id FROM inst), o AS (SELECT bag_id, row_number() OVER (ORDER BY bag_id) AS r FROM b), h AS (SELECT bag_id AS partner, row_number() OVER (ORDER BY md5('3:' || bag_id), bag_id) AS r FROM b)
 SELECT a.bag_id, a.idx, h.partner, c.idx AS nearest FROM inst a JOIN o ON o.bag_id = a.bag_id JOIN h ON h.r = o.r JOIN inst c ON c.bag_id = h.partner
 QUALIFY row_number() OVER (PARTITION BY a.bag_id, a.idx ORDER BY round(list_distance(a.feat::DOUBLE[], c.feat::DOUBLE[]), 9), c.idx) = 1""")
def cross_bag_nearest(spark, sf) -> DataFrame:
    inst = T.vectors(spark, sf)
    return bags.cross_bag_nearest(inst, mix_pairs(inst))


@query(f"""WITH {LINES}, d AS (SELECT a.bag_id, a.idx AS src, b.idx AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM sc a JOIN sc b USING (bag_id))
 SELECT bag_id, src, dst, CAST(-floor(sqrt(d2)) AS BIGINT) AS bias FROM d WHERE d2 <= 10000""")
def spatial_bias(spark, sf) -> DataFrame:
    return bags.spatial_bias(T.scores(spark, sf), 100)


@query(f"""WITH {INST}, {POS}, lp AS (SELECT label, UNNEST(range(0, 64)) AS pos, CAST(UNNEST(feat) AS DOUBLE) AS v FROM inst), c AS (SELECT label AS k, pos, avg(v) AS m FROM lp GROUP BY label, pos),
 d AS (SELECT bag_id, idx, k, 1 / (1 + sum((v - m) * (v - m))) AS w FROM pos JOIN c USING (pos) GROUP BY bag_id, idx, k)
 SELECT bag_id, idx, k, round(w / sum(w) OVER (PARTITION BY bag_id, idx), 6) AS w FROM d""")
def soft_assign(spark, sf) -> DataFrame:
    """Membership of the classes' mean vectors: ten centres, whatever the number of instances."""
    inst = T.vectors(spark, sf)
    centres = pooling.mean_pool(inst.select(F.col("label").alias("bag_id"), "feat"), DIM).toDF("k", "centre")
    return rounded(bags.soft_assign(inst, centres), "w")


@query(f"""WITH {LINES}, u AS (SELECT y, score, CAST(idx = 0 AS INT) AS n FROM sc), m AS (SELECT y, score, sum(n) AS n FROM u GROUP BY ALL),
 p AS (SELECT y, score, n, sum(n) OVER (PARTITION BY y ORDER BY score) AS upto, sum(n) OVER (PARTITION BY y) AS total FROM m)
 SELECT bag_id, idx, CASE WHEN total > 0 THEN round((2 * upto - n + CAST(n > 0 AS INT)) * 50 / total, 6) END AS pct FROM sc JOIN p USING (y, score)""")
def ref_percentile(spark, sf) -> DataFrame:
    inst = T.scores(spark, sf)
    return rounded(bags.ref_percentile(inst, inst.filter("idx = 0"), "y").select("bag_id", "idx", "pct"), "pct")


@query(f"""WITH {INST}, q AS (SELECT bag_id, quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM inst GROUP BY bag_id)
 SELECT bag_id, idx FROM inst JOIN q USING (bag_id) WHERE score BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('7:' || bag_id || ':' || idx)) <= 5""")
def range_sample(spark, sf) -> DataFrame:
    return bags.range_sample(T.vectors(spark, sf), 5, 0.25, 0.75, 7).select("bag_id", "idx")


@query(f"""WITH {MIXED}, rk AS (SELECT bag_id AS source, idx, row_number() OVER (PARTITION BY bag_id ORDER BY md5('9:' || bag_id || ':' || idx)) AS r FROM sc)
 SELECT bag_id AS pair_id, source, idx FROM pa JOIN rk ON source = bag_id WHERE r <= floor(n1 * lam) UNION ALL SELECT bag_id, source, idx FROM pa JOIN rk ON source = partner WHERE r <= n2 - floor(n1 * lam)""")
def insmix(spark, sf) -> DataFrame:
    inst = T.scores(spark, sf)
    return mixing.insmix(inst, mix_pairs(inst), 9)


@query(f"""WITH {MIXED}, rk AS (SELECT bag_id AS source, idx, row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, idx) AS r FROM sc)
 SELECT bag_id AS pair_id, source, idx FROM pa JOIN rk ON source = bag_id WHERE r <= floor(n1 * lam) UNION ALL SELECT bag_id, source, idx FROM pa JOIN rk ON source = partner WHERE r <= floor(n2 * (1 - lam))""")
def rankmix(spark, sf) -> DataFrame:
    inst = T.scores(spark, sf)
    return mixing.rankmix(inst, mix_pairs(inst), 9)


@query(f"WITH {SLIDES} SELECT slide_id, CASE label WHEN 'F' THEN 0 ELSE 1 END AS label FROM sl WHERE label != 'P'")
def map_labels(spark, sf) -> DataFrame:
    return splits.map_labels(T.slides(spark, sf), {"F": 0, "O": 1}, ["P"]).select("slide_id", "label")


@query(f"WITH {ROLES} SELECT slide_id, label FROM rl WHERE role IN ('train', 'val')")
def select_role(spark, sf) -> DataFrame:
    slides = T.slides(spark, sf)
    return splits.select_role(slides, splits.stratified_split(slides, RATIOS, 42), ["train", "val"]).select("slide_id", "label")


@query(f"WITH {ROLES} SELECT CASE WHEN count(*) FILTER (role = 'val') > 0 AND count(*) FILTER (role = 'test') > 0 THEN 'Train_Val_Test' WHEN count(*) FILTER (role = 'val') > 0 THEN 'Train_Val' ELSE 'Train_Test' END AS mode FROM rl")
def pipeline_mode(spark, sf) -> DataFrame:
    return splits.pipeline_mode(splits.stratified_split(T.slides(spark, sf), RATIOS, 42))


@query(f"WITH {ROLES}, d AS (SELECT DISTINCT case_id, role FROM rl) SELECT a.role AS a, b.role AS b, count(*) AS shared FROM d a JOIN d b ON a.case_id = b.case_id AND a.role < b.role GROUP BY ALL")
def leakage_check(spark, sf) -> DataFrame:
    return splits.leakage_check(splits.stratified_split(T.slides(spark, sf), RATIOS, 42), "case_id")


@query(f"""WITH {SLIDES}, r AS (SELECT repeat, slide_id, label, row_number() OVER (PARTITION BY repeat, label ORDER BY md5('5:' || repeat || ':' || slide_id), slide_id) AS r FROM sl, (SELECT UNNEST(range(0, 3)) AS repeat)),
 q AS (SELECT repeat, slide_id, label, CASE WHEN r <= 40 THEN 'val' WHEN r <= 100 THEN 'test' ELSE 'train' END AS role FROM r)
 SELECT CAST(repeat AS INT) AS repeat, slide_id, label, role FROM q QUALIFY role != 'train' OR row_number() OVER (PARTITION BY repeat, label, role ORDER BY slide_id) <= ceil(count(*) OVER (PARTITION BY repeat, label, role) * 0.5)""")
def quota_split(spark, sf) -> DataFrame:
    return splits.quota_split(T.slides(spark, sf), 40, 60, 0.5, 3, 5).select("repeat", "slide_id", "label", "role")


@query(f"""WITH {SLIDES}, c AS (SELECT case_id, max(label) AS label FROM sl GROUP BY case_id), r AS (SELECT case_id, row_number() OVER (PARTITION BY label ORDER BY md5('5:0:' || case_id), case_id) AS r FROM c)
 SELECT slide_id, case_id, CASE WHEN r <= 30 THEN 'val' WHEN r <= 60 THEN 'test' ELSE 'train' END AS role FROM sl JOIN r USING (case_id)""")
def patient_split(spark, sf) -> DataFrame:
    slides = T.slides(spark, sf)
    return splits.patient_split(slides, pooling.patient_label(slides, "max"), 30, 30, 5)


@query(f"""WITH {SLIDES}, h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || slide_id), slide_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE + 0.5) AS rest FROM sl),
 k AS (SELECT slide_id, (row_number() OVER (ORDER BY label, md5('42:' || slide_id), slide_id) - 1) % 5 AS own FROM h WHERE rest)
 SELECT fold, slide_id, CASE WHEN NOT rest THEN 'test' WHEN own = fold THEN 'val' ELSE 'train' END AS role FROM h LEFT JOIN k USING (slide_id), (SELECT UNNEST(range(0, 5)) AS fold)""")
def holdout_then_kfold(spark, sf) -> DataFrame:
    return splits.holdout_then_kfold(T.slides(spark, sf), 0.2, 5, 42)


@query(f"""WITH {EPOCHS}, m AS (SELECT run, epoch, lag(value, 3) OVER (PARTITION BY run ORDER BY epoch) > max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stop FROM ep)
 SELECT run, min(epoch) AS epoch FROM m WHERE stop GROUP BY run""")
def early_stop_epoch(spark, sf) -> DataFrame:
    return select.early_stop_epoch(T.epochs(spark, sf), 3)


@query("""WITH f AS (SELECT user_id % 5 AS fold, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL)
 SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM f GROUP BY metric""")
def kfold_merge(spark, sf) -> DataFrame:
    folds = T.table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return rounded(select.kfold_merge(folds), "mean", "std")


@query("SELECT user_id AS run, " + ", ".join(f"round(avg(value) FILTER (event_type = '{e}'), 6) AS {e}" for e in EVENTS) + " FROM events GROUP BY user_id")
def epoch_log(spark, sf) -> DataFrame:
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    return rounded(select.epoch_log(rows, EVENTS), *EVENTS)


def stream_rows(events: DataFrame) -> DataFrame:
    """ts, y, yhat of events: their type, and one drawn by the event's hash."""
    drawn = F.element_at(F.array(*map(F.lit, EVENTS)), (F.ascii(hash_order(0, "event_id")) % 5 + 1).cast("int"))
    return events.select("ts", F.col("event_type").alias("y"), drawn.alias("yhat"))


@query(f"""WITH p AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type AS y, list_extract({EVENTS}, ascii(md5('0:' || event_id)) % 5 + 1) AS yhat FROM events)
 SELECT start, y, count(*) AS n, CAST(sum(CAST(y = yhat AS INT)) AS BIGINT) AS ok FROM p GROUP BY start, y""")
def stream_class_accuracy(spark, sf) -> DataFrame:
    out = running.class_accuracy(stream_rows(T.table(spark, sf, "events")))
    return out.select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', window.start)").alias("start"), "y", "n", "ok")


@query("SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS mean FROM events GROUP BY event_type")
def stream_weighted_mean(spark, sf) -> DataFrame:
    rows = T.table(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 7 + 1).alias("n"))
    return rounded(running.weighted_mean(rows, "event_type"), "mean")


def zscore_sql(v: str) -> str:
    return f"round(CASE WHEN min({v}) OVER w = max({v}) OVER w THEN 0 ELSE ({v} - avg({v}) OVER w) / (stddev_pop({v}) OVER w + 1e-8) END, 4) AS z"


@query(f"WITH {LINES} SELECT bag_id, idx, {zscore_sql('score')} FROM sc WINDOW w AS (PARTITION BY bag_id)")
def zscore_scores(spark, sf) -> DataFrame:
    """zscore_features of all bags, those of equal scores too."""
    return pooling.zscore(T.scores(spark, sf)).select("bag_id", "idx", F.round("z", 4).alias("z"))


@query(f"WITH {INST}, {POS} SELECT bag_id, idx, CAST(pos AS INT) AS pos, {zscore_sql('v')} FROM pos WINDOW w AS (PARTITION BY bag_id, pos)")
def zscore_positions(spark, sf) -> DataFrame:
    return pooling.zscore_feat(T.vectors(spark, sf)).select("bag_id", "idx", "pos", F.round("z", 4).alias("z"))


@query(f"WITH e AS ({ORACLE_SQL['knn_graph']}) SELECT bag_id, src, dst FROM e UNION ALL SELECT bag_id, dst, src FROM e")
def knn_graph_both(spark, sf) -> DataFrame:
    return graphs.both_ways(graphs.knn_graph(T.vectors(spark, sf), 5)).select("bag_id", "src", "dst")


ALL_JS = [1, 5, 10, 50, 100]


@query(f"""WITH {INST}, {POS}, r AS (SELECT bag_id, pos, v, row_number() OVER (PARTITION BY bag_id, pos ORDER BY v DESC) AS r FROM pos),
 m AS (SELECT bag_id, j, pos, avg(v) AS value FROM r JOIN (SELECT UNNEST({ALL_JS}) AS j) ON r <= j GROUP BY bag_id, j, pos)
 SELECT bag_id, CAST(j AS INT) AS j, CAST(pos AS INT) AS pos, round(value, 6) AS value, row_number() OVER (PARTITION BY bag_id, j ORDER BY round(value, 9) DESC, pos) = 1 AS best FROM m""")
def topj_pool_all(spark, sf) -> DataFrame:
    """All elements of feat as logits, all j, and the class of the highest mean (the first of equal ones)."""
    r = F.row_number().over(Window.partitionBy("bag_id", "j").orderBy(F.desc(F.round("value", 9)), "pos"))
    return rounded(bags.topj_pool(T.vectors(spark, sf), ALL_JS, DIM).withColumn("best", r == 1), "value")


@query(f"""WITH {EPOCHS} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, min(value) AS min, round(sum(value), 2) AS sum,
 round(median(value), 6) AS median FROM ep""")
def aggregate_array_median(spark, sf) -> DataFrame:
    return rounded(pooling.aggregate_array_median(T.epochs(spark, sf), "value"), "mean", "std", "median").withColumn("sum", F.round("sum", 2))


@query(f"""WITH {SLIDES}, b AS (SELECT DISTINCT case_id AS bag_id FROM sl), o AS (SELECT bag_id, row_number() OVER (ORDER BY bag_id) AS r FROM b), h AS (SELECT bag_id AS partner, row_number() OVER (ORDER BY md5('3:' || bag_id), bag_id) AS r FROM b)
 SELECT bag_id, partner, {uniform(4, "bag_id")} < 0.5 AND bag_id != partner AS mixed FROM o JOIN h USING (r)""")
def chosen_pairs(spark, sf) -> DataFrame:
    return graphs.chosen_pairs(T.slides(spark, sf).selectExpr("case_id as bag_id"), 0.5, 3)
