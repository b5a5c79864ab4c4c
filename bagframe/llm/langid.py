"""Language identification in two steps: the family of related languages first, then one-versus-one linear support vector machines within it.

Texts are bags of hashed byte n-grams of lower-cased letters (everything else of ASCII is a space). Languages whose mean n-gram profiles are alike form
a family: average-link clustering of the profiles down to about the square root of their number. A naive Bayes model tells families apart by all
n-grams of a text; each pair of languages of a family has a linear machine, trained in a Spark task of its own by dual coordinate descent. The language
with the most won pairs is predicted.

The model is learned from a bounded sample (PER_LANGUAGE distinct texts of each of the MOST_LANGUAGES most frequent languages, the first in hash order);
every text is scored whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scan import LOWER, blocks
from .store import sized, written
from .toxicity import held_out, sigmoid

BITS = 16
#: Bytes of an n-gram.
ORDERS = (2, 3, 4)
#: Distinct texts of a language that are learned from, and most languages.
PER_LANGUAGE, MOST_LANGUAGES = 500, 64
#: Shares of n-grams are multiplied by SCALE, so a text's vector has a length of about 1.
SCALE, COST, EPOCHS = 15.0, 10.0, 15
#: N-grams of a text that count towards the certainty of its family.
CERTAIN = 60
NONE = 1 << BITS
SPACED = LOWER.copy()
SPACED[[i for i in range(128) if not chr(i).isalpha()]] = 32


def numbered(data: np.ndarray, offs: np.ndarray):
    """For each order, the number of the n-gram that begins at each byte; NONE where it leaves its text or begins with two spaces."""
    low = SPACED[data].astype(np.uint32)
    n = len(low)
    blank = np.zeros(n, bool)
    blank[: n - 1] = (low[:-1] == 32) & (low[1:] == 32)
    for order in ORDERS:
        f = np.full(n, order, np.uint32)
        for k in range(order):
            f[: n - k] = (f[: n - k] + low[k:]) * np.uint32(0x9E3779B1)
        f = ((f ^ (f >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32)
        out = blank.copy()
        for k in range(1, order):  # the last places of each text
            at = offs[1:] - k
            out[at[at >= offs[:-1]]] = True
        f[out] = NONE
        yield f


def summed(rows: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; 0 for an empty text."""
    out = np.zeros((len(offs) - 1, *rows.shape[1:]))
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(rows, offs[full], axis=0, dtype=np.float64)
    return out


def shares(column):
    """For each text, its distinct n-gram numbers and the share of each among all."""
    for _, data, offs in blocks(column):
        found = list(numbered(data, offs))
        for a, b in zip(offs[:-1], offs[1:]):
            f = np.concatenate([x[a:b] for x in found])
            numbers, times = np.unique(f[f != NONE], return_counts=True)
            yield numbers.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)


def machine(rows: list, sides: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss) by dual coordinate descent; sides: 1 or -1."""
    w = np.zeros((1 << BITS) + 1)  # the last one is the bias
    rows = [(np.append(i, NONE), np.append(SCALE * x, 1.0)) for i, x in rows]
    squares = np.array([float(x @ x) for _, x in rows])
    weight = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            step = (sides[k] * float((w[i] * x).sum()) - 1) / squares[k]
            new = min(max(weight[k] - step, 0.0), cost)
            if new != weight[k]:
                w[i] += (new - weight[k]) * sides[k] * x
                weight[k] = new
    return w[:-1], float(w[-1])


def families(profiles: np.ndarray, wanted: int | None = None) -> list[list[int]]:
    """Groups of the rows of profiles by average-link clustering of their cosines, down to `wanted` groups (about the square root of the rows)."""
    unit = profiles - profiles.mean(axis=0)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    like = np.array([[float((a * b).sum()) for b in unit] for a in unit])
    groups = [[i] for i in range(len(profiles))]
    wanted = wanted or math.ceil(math.sqrt(len(groups)))
    while len(groups) > wanted:
        pairs = [(like[np.ix_(groups[i], groups[j])].mean(), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        _, i, j = max(pairs)
        groups[-i] += groups.pop(-j)
    return [sorted(g) for g in groups]


def sample(docs: DataFrame, lang_col: str, text_col: str, per: int, most: int) -> DataFrame:
    """(lang, i, x): n-gram shares of at most `per` distinct texts of each of the `most` most frequent languages, the first in hash order."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")).filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
    known = written(known, "langs")
    langs = known.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    first = known.join(F.broadcast(langs.select("lang")), "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per)
    first = written(first.select("lang", "h"), "sample")

    def extract(batches):
        for batch in batches:
            found = list(shares(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["lang", "h", "i", "x"])

    chosen = rows.join(sized(first), ["lang", "h"]).select("lang", "h", "text")
    features = chosen.mapInArrow(extract, "lang string, h long, i binary, x binary")
    return written(features.groupBy("lang", "h").agg(F.max(F.struct("i", "x")).alias("r")).select("lang", "h", "r.i", "r.x"), "profiles")


def _opened(i: bytes, x: bytes):
    return np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)


def _profile(key, pdf):
    """The sum of a language's rows, as bytes."""
    import pandas as pd

    total = np.zeros(1 << BITS)
    for i, x in zip(pdf["i"], pdf["x"]):
        numbers, values = _opened(i, x)
        total[numbers] += values
    return pd.DataFrame({"lang": [key[0]], "n": [len(pdf)], "profile": [total.astype(np.float32).tobytes()]})


def _machine(key, pdf):
    """The machine of a pair of languages: positive for the first."""
    import pandas as pd

    pdf = pdf.sort_values(["lang", "h"])
    w, bias = machine([_opened(i, x) for i, x in zip(pdf["i"], pdf["x"])], np.where(pdf["lang"] == key[0], 1.0, -1.0))
    return pd.DataFrame({"first": [key[0]], "second": [key[1]], "weights": [w.astype(np.float32).tobytes()], "bias": [bias]})


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> dict:
    """The model as arrays: languages, families (lists of their places), and tables with a row for each n-gram number: one column for each family, and
    for each pair of a family's languages. At most MOST_LANGUAGES ** 1.5 / 2 pairs of 256 KB. Rows without text, letter or language are left out."""
    rows = sample(docs, lang_col, text_col, per, most)
    spark = docs.sparkSession
    found = sorted(rows.groupBy("lang").applyInPandas(_profile, "lang string, n long, profile binary").collect(), key=lambda r: r["lang"])  # `most` rows
    langs = [r["lang"] for r in found]
    if not langs:
        return {"langs": []}
    profiles = np.stack([np.frombuffer(r["profile"], np.float32) / r["n"] for r in found]).astype(float)
    groups = families(np.sqrt(profiles))
    likely = np.stack([profiles[g].mean(axis=0) for g in groups], axis=1)
    table = np.zeros(((1 << BITS) + 1, len(groups)), np.float32)
    table[:-1] = np.log(likely + 1e-6) - np.log(likely + 1e-6).mean(axis=1, keepdims=True)
    pairs = [(langs[a], langs[b]) for g in groups for k, a in enumerate(g) for b in g[k + 1 :]]
    machines = []
    if pairs:
        of = spark.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "lang string, first string, second string")
        trained = rows.join(F.broadcast(of), "lang").groupBy("first", "second").applyInPandas(_machine, "first string, second string, weights binary, bias double")
        machines = {(r["first"], r["second"]): (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in trained.toLocalIterator()}
    within = []
    for g in groups:
        own = [(a, b) for k, a in enumerate(g) for b in g[k + 1 :]]
        columns = np.zeros(((1 << BITS) + 1, len(own)), np.float32)
        for k, (a, b) in enumerate(own):
            columns[:-1, k] = machines[langs[a], langs[b]][0] * SCALE
        within.append((own, columns, np.array([machines[langs[a], langs[b]][1] for a, b in own])))
    return {"langs": langs, "families": groups, "table": table, "within": within}


#: Numbers of a table that are held at once.
AT_ONCE = 1 << 22


def _means(found: list[np.ndarray], offs: np.ndarray, table: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, the mean of the table's rows over its n-grams."""
    total = np.zeros((len(offs) - 1, table.shape[1]))
    step = max(1, AT_ONCE // max(1, table.shape[1]))
    for f in found:
        for at in range(0, len(f), step):
            part = np.clip(offs, at, at + step) - at
            total += summed(table[f[at : at + step]], np.minimum(part, len(f) - at))
    return total / np.maximum(count, 1)[:, None]


def predicted(column, model: dict) -> tuple[list, np.ndarray]:
    """The language of each text and its score."""
    names, scores = [], []
    for _, data, offs in blocks(column):
        found = list(numbered(data, offs))
        count = sum(summed((f != NONE).astype(np.int8), offs) for f in found)
        logs = _means(found, offs, model["table"], count) * np.minimum(count, CERTAIN)[:, None]
        family = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        best, sure = np.zeros(len(family), np.int64), np.ones(len(family))
        for k, group in enumerate(model["families"]):
            own = np.flatnonzero(family == k)
            if not len(own):
                continue
            pairs, table, bias = model["within"][k]
            best[own] = group[0]
            if not pairs:
                continue
            sizes = np.diff(offs)[own]
            if len(own) < len(family):
                mine = np.repeat(family == k, np.diff(offs))
                inner = [f[mine] for f in found]
            else:
                inner = found
            margin = _means(inner, np.concatenate([[0], np.cumsum(sizes)]), table, count[own]) + bias
            won, lead = np.zeros((len(own), len(group))), np.full((len(own), len(group)), np.inf)
            place = {g: i for i, g in enumerate(group)}
            for j, (a, b) in enumerate(pairs):
                for side, x in ((1, place[a]), (-1, place[b])):
                    won[:, x] += side * margin[:, j] > 0
                    lead[:, x] = np.minimum(lead[:, x], side * margin[:, j])
            order = won + sigmoid(lead) / 2  # pairs won, then the narrowest of its margins
            choice = order.argmax(axis=1)
            best[own] = np.array(group)[choice]
            sure[own] = sigmoid(2 * lead[np.arange(len(own)), choice])
        names += [model["langs"][i] for i in best]
        scores.append(share * sure)
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, `und` where the text is null or has no letter or nothing was learned) and score (0 to 1; 0 of `und`).

    Equal texts get equal rows. Repeated rows stay, an empty table stays empty, columns named lang_pred and score are replaced, others stay.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*names)
    if not model["langs"]:
        return kept.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index(text_col)

    def predict(batches):
        for batch in batches:
            langs, scores = predicted(batch.column(place), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = kept.mapInArrow(predict, schema)
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    return out.withColumn("score", F.when(letters, F.col("score")).otherwise(0.0)).withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise("und"))


def op13_language(spark, sf_dir: str) -> DataFrame:
    """All documents by the model of those outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
