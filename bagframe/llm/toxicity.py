"""Toxicity: FTRL-proximal logistic regression over hashed unigrams, bigrams and skip-grams of words and of word stems with count buckets.

Features are extracted in Arrow batches by Spark tasks. The learner sees a bounded sample of labelled rows (MOST_LABELLED, the first in hash order), so
the driver holds that sample's features only; its weights are at most 2**BITS numbers, of which the L1 term leaves few. They are broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scan import NOT_ALNUM, STEPS, blocks, mix, words
from .tokens import forget

BITS = 20
#: Bytes of a word's stem, and the last count bucket (1, 2, 3 or more).
STEM, MOST_TIMES = 5, 3
#: Bytes of texts whose features are made at once.
FEATURED = 1 << 18
#: Most labelled rows that are learned from; more bring no further words of note.
MOST_LABELLED = 8_000
#: BITS, STEM and L1 were chosen by fourfold cross-validation within the labels that are learned from (sf0.1), not by the held-out quarter.
ALPHA, BETA, L1, L2, EPOCHS = 0.15, 1.0, 8.0, 0.5, 3


def _numbered(h, doc, kept) -> np.ndarray:
    """Keys (document, feature number) of single words, pairs of neighbours, and pairs with one word between; kept: booleans of the numbers wanted."""
    out = []
    for gap in (0, 1, 2):
        f = mix(h if gap == 0 else h[:-gap] * STEPS[0] + h[gap:] * STEPS[gap]) >> np.uint64(64 - BITS)
        first = doc[: len(f)]
        here = first == doc[gap:]
        if kept is not None:
            here &= kept[f]
        out.append((first[here].astype(np.uint64) << np.uint64(BITS)) | f[here])
    return np.concatenate(out)


def _moved(f, times: int):
    """The number of a stem's feature where it stands more than `times` times."""
    return mix(f * STEPS[3] + np.uint64(times)) >> np.uint64(64 - BITS)


def stems_wanted(wanted: np.ndarray) -> np.ndarray:
    """The numbers of stems' features that are wanted, or whose number for a second or third time is."""
    every = np.arange(1 << BITS, dtype=np.uint64)
    return wanted | np.any([wanted[_moved(every, times)] for times in range(1, MOST_TIMES)], axis=0)


def text_features(column, wanted=None, first=None):
    """For each text, its distinct feature numbers: words, pairs of neighbours, pairs with one word between; the same of stems, each with a number more
    for the second and for the third time it stands there (inflected words share a stem, and one stem by chance is weaker than three).

    wanted: 2**BITS booleans; other numbers may be left out. first: stems_wanted() of them.
    """
    mask = np.uint64((1 << BITS) - 1)
    for _, data, offs in blocks(column, FEATURED):
        h, doc, _, _ = words(data, offs, NOT_ALNUM)
        keys = [_numbered(h, doc, wanted)]
        h, doc, _, _ = words(data, offs, NOT_ALNUM, stem=STEM)
        stems = np.sort(_numbered(h * STEPS[4], doc, first))
        keys.append(stems)
        for times in range(1, MOST_TIMES):
            again = stems[times:][stems[times:] == stems[:-times]]
            keys.append((again & ~mask) | _moved(again & mask, times))
        key = np.unique(np.concatenate(keys))
        at = np.searchsorted(key, np.arange(len(offs), dtype=np.uint64) << np.uint64(BITS))
        low = (key & mask).astype(np.uint32)
        for a, b in zip(at[:-1], at[1:]):
            yield low[a:b]


def squeezed(numbers: np.ndarray) -> bytes:
    """Rising numbers as compressed steps; the driver holds the sample in this form."""
    return zlib.compress(np.diff(numbers, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def opened(row: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(row), "<u4"))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list, labels: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows are arrays of feature numbers, or squeezed() ones. Feature numbers with weights other than 0, these weights, and the bias (learned without L1). Per-coordinate rates alpha / (beta + sqrt(n))."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i):
        zi = z[i]
        out = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        out[np.abs(zi) <= l1] = 0
        free = i == bias
        out[free] = -zi[free] / ((beta + np.sqrt(n[i[free]])) / alpha + l2)
        return out

    for _ in range(epochs):
        for x, y in zip(rows, labels):
            i = np.append(opened(x) if isinstance(x, bytes) else x, bias).astype(np.int64)
            w = weights(i)
            g = sigmoid(w.sum()) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    seen = np.append(np.flatnonzero(n[:-1]), bias)  # the others have no weight
    w = weights(seen)
    found = np.flatnonzero(w[:-1])
    return seen[found], w[found], float(w[-1])


#: The model of no labelled row: every score is 0.1.
NOTHING = (np.zeros(0, np.int64), np.zeros(0), float(np.log(0.1 / 0.9)))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most: int = MOST_LABELLED):
    """The model of ftrl() from at most `most` labelled rows: the first by a hash of their id. Rows without id or label are left out."""
    order = F.xxhash64(F.lit("order"), "id")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(order, "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def extract(batches):
        forget()
        for batch in batches:
            found = [squeezed(x) for x in text_features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "y", "x"])

    joined = texts.join(F.broadcast(known), "id").select("id", "y", "text")
    rows = joined.mapInArrow(extract, "id long, y int, x binary").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").orderBy(order, "id")
    held, marks = [], []
    for r in rows.toLocalIterator():  # `most` rows, part by part
        held.append(bytes(r["x"]))
        marks.append(r["y"])
    return ftrl(held, np.array(marks, float)) if held else NOTHING


def scored(docs: DataFrame, model, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold). Null and empty texts have the bias's score; other columns stay as they are."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*names)
    place = names.index(text_col)

    def score(batches):
        forget()
        found, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[found] = weights
        wanted = dense != 0
        first = stems_wanted(wanted)
        for batch in batches:
            values = [sigmoid(bias + dense[x].sum()) for x in text_features(batch.column(place), wanted, first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, "score"])

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return kept.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text is 2 modulo 4; a null id counts as text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of the labels outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
