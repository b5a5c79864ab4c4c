"""Packing token sequences: cutting-stock column generation over the histogram of piece lengths.

A document is cut into full pieces of the sequence size and one remainder. Spark counts the remainders by length class (lengths rounded up to GRAIN
tokens, so at most size / GRAIN classes however many documents there are). The driver solves the linear program over that histogram: a basis of
patterns (how many pieces of each class share a sequence), new patterns priced by a knapsack over the classes' dual prices, until none improves it.
Patterns are rounded down and the few pieces left are placed first-fit by falling length. Spark then ranks the pieces of each class and a piece's rank tells its
pattern, copy and sequence.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .tokens import encoder, groups, vocabulary

GRAIN = 8
#: Rows that one ranking task gets, about.
RANKED = 50_000
#: The linear program ends when it is known to be within this share of its optimum.
GAP = 5e-4
#: Most columns that are priced; the linear program ends long before that, and ending early costs padding only.
MOST_COLUMNS = 5_000


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes of the given sizes that is worth most."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(prices > 1e-12)
    use = use[np.argsort(sizes[use], kind="stable")]
    own, price = sizes[use], prices[use]
    fits = np.searchsorted(own, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best, n = worth[c - 1], fits[c]
        if n:
            value = price[:n] + worth[c - own[:n]]
            k = value.argmax()
            if value[k] > best + 1e-12:
                best, last[c] = value[k], use[k]
        worth[c] = best
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(worth[capacity]), out


def times_vector(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x by numpy's own loops: BLAS and LAPACK threads were seen to hang in a driver that has started a JVM."""
    return np.einsum("ij,j->i", a, x)


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, m:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly the demand. sizes: distinct, from 1 to capacity."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / (capacity // sizes).astype(float))
    amount = times_vector(inverse, demand)
    bound = demand @ sizes / capacity
    for turn in range(MOST_COLUMNS):
        if turn % 200 == 199:
            inverse = inverted(basis)
            amount = np.maximum(times_vector(inverse, demand), 0)
        worth, column = best_pattern(sizes, inverse.sum(axis=0), capacity)
        bound = max(bound, amount.sum() / worth)  # no packing needs fewer sequences
        if amount.sum() <= bound * (1 + GAP):
            break
        step = times_vector(inverse, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        if not np.isfinite(theta):
            break
        amount = np.maximum(amount - theta * step, 0)
        amount[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    times = np.floor(amount + 1e-7).astype(np.int64)
    while True:  # rounding errors must not hold more than there is
        left = demand - times_vector(basis, times).round().astype(np.int64)
        short = np.flatnonzero(left < 0)
        if not len(short):
            break
        times[np.flatnonzero((basis[short[0]] > 0) & (times > 0))[0]] -= 1
    found = [(basis[:, p].round().astype(np.int64), int(times[p])) for p in range(m) if times[p]]
    return found + [(p, 1) for p in first_fit(sizes, left, capacity)]


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """First-fit by falling size; a class goes on filling its sequences as far as they reach."""
    rooms, patterns = np.zeros(0, np.int64), []
    for k in np.argsort(-sizes):
        n = int(left[k])
        for j in np.flatnonzero(rooms >= sizes[k]):
            put = min(n, int(rooms[j] // sizes[k]))
            patterns[j][k] += put
            rooms[j] -= put * sizes[k]
            n -= put
        while n > 0:
            put = min(n, int(capacity // sizes[k]))
            patterns.append(np.zeros(len(sizes), np.int64))
            patterns[-1][k] = put
            rooms = np.append(rooms, capacity - put * sizes[k])
            n -= put
    return patterns


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary_path: str | None, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of each document."""

    def cut(batches):
        path, end = vocabulary_path or vocabulary(), struct.pack("<I", end_id)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in groups(texts):
                rows: list[tuple] = []
                for key, blob in zip(keys[a:b], encoder(path).encode(texts[a:b])):
                    blob += end
                    view, n = memoryview(blob), len(blob) // 4
                    rows += [(key, s, min(size, n - s), zlib.crc32(view[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary_path: str | None = None, end_id: int = 1, grain: int = GRAIN) -> DataFrame:
    """Whole texts as token ids with end_id, packed into sequences of at most `size` tokens; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset. Every id lies in one piece; the
    pieces of a sequence follow each other from 0. Null and empty texts are one id. Null ids and repeated rows are packed like others; other columns
    are ignored. An empty table gives no rows.
    """
    if size % grain:
        raise ValueError("grain must divide size")
    spark = docs.sparkSession
    capacity = size // grain
    with small_batches(spark):
        cut = written(pieces(docs, id_col, text_col, size, vocabulary_path, end_id), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    sizes = np.array(sorted(counts), np.int64)
    plan, at, first = [], dict.fromkeys(counts, 0), 0
    for pattern, times in cutting_stock(sizes, np.array([counts[int(s)] for s in sizes], np.int64), capacity) if total else []:
        for s, n in zip(sizes.tolist(), pattern.tolist()):
            if n:
                plan.append((s, at[s], at[s] + n * times, n, first))
                at[s] += n * times
        first += times
    # Rows of the plan: a few for each class, whatever the number of documents.
    ranges = F.broadcast(spark.createDataFrame(plan, "class int, low long, high long, each int, first long"))
    salts = max(1, math.ceil(total / RANKED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("class", "salt").agg(F.count("*").alias("n")).select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(bases, ["class", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(ranges, (ranked["class"] == ranges["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id")
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("rank")


def op9_packed_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
