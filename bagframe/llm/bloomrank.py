"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds an entry for each of its terms and each power of two that the term's frequency reaches, as HASHES bits of it. Documents of
like numbers of entries form blocks, and a block is stored by bit: one bitmap over its documents for each signature bit. ANDing the bitmaps of a term's
bits gives every document that holds the term so often, and some that don't, so weighted sums over an item's terms bound the documents' scores from
above. Exact scores of the documents with the highest bounds give a threshold for each item, and all documents whose bound reaches it are scored
exactly by their texts, so none is missed.

The index has every document, its number of terms, and each block's document frequencies; it does not depend on the items. Items are worked off in
portions of about MOST_TERMS terms, which bounds what is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import NOT_ALNUM, STEPS, blocks, mix, utf8, words
from .store import sized, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Bits of an entry, and bits of a signature for each entry that its class has room for.
HASHES, ROOM = 3, 12
#: Most documents of a block, and about the most bits.
MOST_DOCS, MOST_BITS = 2048, 1 << 23
#: Most terms of the items that are worked off together.
MOST_TERMS = 200_000
#: Terms that are looked up in a block at once.
AT_ONCE = 4096


def positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The HASHES places of each entry (a term's hash and a level) in a signature of so many bits."""
    seeds = [np.uint64((level * int(STEPS[1]) + i * int(STEPS[2])) % (1 << 64)) for i in range(HASHES)]
    return np.stack([((mix(hashes + seed) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32) for seed in seeds]).astype(np.int64)


def factor(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Builder:
    """Collects documents by class and gives out full blocks."""

    def __init__(self):
        self.open: dict[int, list] = defaultdict(list)

    def add(self, uid: bytes, doc_id, n: int, terms: np.ndarray, tf: np.ndarray):
        levels = np.frexp(tf)[1]  # how many powers of two each frequency reaches
        size = max(16, 1 << (int(levels.sum()) - 1).bit_length())
        self.open[size].append((uid, doc_id, n, terms, levels))
        if len(self.open[size]) >= min(MOST_DOCS, max(8, MOST_BITS // (ROOM * size) // 8 * 8)):
            yield self.block(size, self.open.pop(size))

    def rest(self):
        for size in list(self.open):
            yield self.block(size, self.open.pop(size))

    @staticmethod
    def block(size: int, docs: list):
        bits, wide = ROOM * size, -(-len(docs) // 8)
        matrix = np.zeros((bits, 8 * wide), bool)
        for j, (_, _, _, terms, levels) in enumerate(docs):
            for level in range(int(levels.max())):
                matrix[positions(terms[levels > level], level, bits).ravel(), j] = True
        terms, df = np.unique(np.concatenate([d[3] for d in docs]), return_counts=True)
        packed = np.packbits(matrix, axis=1, bitorder="little").tobytes()
        return {"bits": bits, "uids": [d[0] for d in docs], "ids": [d[1] for d in docs], "sizes": [d[2] for d in docs], "slices": packed, "terms": terms.view(np.int64), "df": df.astype(np.int32)}


INDEX = "bits long, uids array<binary>, ids array<long>, sizes array<long>, slices binary, terms array<long>, df array<int>"
_schema = pa.schema([("bits", pa.int64()), ("uids", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("terms", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])


def _indexed(batches):
    builder = Builder()

    def row(block):
        return pa.RecordBatch.from_arrays([pa.array([block[f.name]], f.type) for f in _schema], schema=_schema)

    for batch in batches:
        uids, ids = batch.column(0), batch.column(1)
        for first, data, offs in blocks(batch.column(2)):
            h, doc, at, _ = words(data, offs, NOT_ALNUM)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.append(new, len(h)))
            terms, cut = h[new], np.searchsorted(doc[new], np.arange(len(offs)))
            for k in range(len(offs) - 1):
                a, b = cut[k], cut[k + 1]
                if b > a:
                    for block in builder.add(uids[first + k].as_py(), ids[first + k].as_py(), int(at[k + 1] - at[k]), terms[a:b], tf[a:b]):
                        yield row(block)
    for block in builder.rest():
        yield row(block)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, text): uid is the text's SHA-256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.unhex(F.sha2("text", 256)).alias("uid"), "id", "text")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents that have terms, as a written table."""
    return written(keyed(docs, id_col, text_col).mapInArrow(_indexed, INDEX), "signatures")


class Portion:
    """Items of a portion with their terms' weights: item k has the terms where[k] (places in hashes), each of weight[k] in all its repeats."""

    def __init__(self, items: list[list[str]], hashes: dict[str, int], df: dict[int, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = []
        known = {h: i for i, h in enumerate(sorted(df))}
        self.hashes = np.array(sorted(df), np.int64).view(np.uint64)
        self.where, self.weight = [], []
        for terms in items:
            times = [(t, hashes[t], c) for t, c in Counter(terms).items() if hashes[t] in df]
            weights = [c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[h] + 1))) for _, h, c in times]
            self.items.append({t: w for (t, _, _), w in zip(times, weights)})
            self.where.append(np.array([known[h] for _, h, _ in times], np.int64))
            self.weight.append(np.array(weights, np.int64))

    def spread(self, n):
        """m of documents of n terms."""
        return 100 - 75 + (75 * n * self.n_docs) // self.n_terms

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes):
        """(item, bounds of the block's documents) of every item that may have a document there."""
        matrix = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m = self.spread(sizes)
        top = 1
        found, place = [], np.full(len(self.hashes), -1, np.int64)
        for at in range(0, len(self.hashes), AT_ONCE):
            h = self.hashes[at : at + AT_ONCE]
            p = positions(h, 0, bits)
            rows = matrix[p[0]] & matrix[p[1]] & matrix[p[2]]
            here = np.flatnonzero(rows.any(axis=1))
            place[at + here] = np.arange(len(here)) + sum(map(len, found))
            level = np.unpackbits(rows[here], axis=1, count=len(sizes), bitorder="little")
            rest, rows, depth = here, rows[here], 1
            where = np.arange(len(here))
            while len(rest):
                p = positions(h[rest], depth, bits)
                rows = rows & matrix[p[0]] & matrix[p[1]] & matrix[p[2]]
                still = np.flatnonzero(rows.any(axis=1))
                rest, rows, where = rest[still], rows[still], where[still]
                level[where] += np.unpackbits(rows, axis=1, count=len(sizes), bitorder="little")
                depth += 1
            top = max(top, depth)
            found.append(level)
        levels = np.concatenate(found) if found else np.zeros((0, len(sizes)), np.uint8)
        # A frequency that reaches `depth` powers of two is below the next one.
        table = np.stack([factor(np.int64((1 << depth) - 1), m) if depth else np.zeros(len(sizes), np.int64) for depth in range(top + 1)])
        share = table[levels, np.arange(len(sizes))]
        for k, (where, weight) in enumerate(zip(self.where, self.weight)):
            own = place[where]
            held = own >= 0
            if held.any():
                yield k, weight[held] @ share[own[held]]

    def score(self, k: int, n: int, tf: dict[str, int]) -> int:
        m = self.spread(n)
        return sum(w * int(factor(tf[t], m)) for t, w in self.items[k].items() if t in tf)


def _best(shared, most: int):
    """For each task and item, the documents with the highest bounds."""

    def find(batches):
        best: dict[int, list] = defaultdict(list)
        for batch in batches:
            for bits, uids, sizes, slices in zip(*(batch.column(i) for i in range(4))):
                uids = uids.as_py()
                for k, bound in shared.value.bounds(bits.as_py(), np.array(sizes.as_py(), np.int64), slices.as_py()):
                    least = best[k][-1][0] if len(best[k]) == most else 0
                    new = np.flatnonzero(bound > least)
                    if len(new):
                        new = new[np.argsort(-bound[new], kind="stable")[:most]]
                        best[k] = sorted(best[k] + [(int(bound[j]), uids[j]) for j in new], reverse=True)[:most]
        rows = [(k, uid, bound) for k, x in best.items() for bound, uid in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["k", "uid", "bound"])

    return find


def _reaching(shared, least):
    """All documents whose bound reaches their item's threshold; equal texts of a block once."""

    def find(batches):
        for batch in batches:
            for bits, uids, sizes, slices in zip(*(batch.column(i) for i in range(4))):
                uids, rows = uids.as_py(), set()
                for k, bound in shared.value.bounds(bits.as_py(), np.array(sizes.as_py(), np.int64), slices.as_py()):
                    rows.update((k, uids[j]) for j in np.flatnonzero(bound >= max(1, least.value.get(k, 0))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary()))], names=["k", "uid"])

    return find


def _exact(shared):
    def score(batches):
        for batch in batches:
            rows = []
            for uid, text, ks in zip(*(batch.column(i) for i in range(3))):
                terms = TERM.findall(text.as_py().translate(LOWER))
                tf = Counter(terms)
                rows += [(k, uid.as_py(), s) for k in ks.as_py() if (s := shared.value.score(k, len(terms), tf)) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["k", "uid", "score"])

    return score


def exact(texts: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """(k, uid, score) of the wanted (k, uid) with a score above 0; a text with copies is scored once."""
    of = written(wanted.groupBy("uid").agg(F.collect_set("k").alias("ks")), "wanted")  # no more than the portion's items
    found = texts.select("uid", "text").join(sized(of), "uid").dropDuplicates(["uid"]).select("uid", "text", "ks")
    return written(found.mapInArrow(_exact(shared), "k long, uid binary, score long"), "scores")


def term_hashes(texts: list[str]) -> list[dict[str, int]]:
    """The terms of each text, in order, with the hashes that the index has for them."""
    out = []
    data, offs = utf8(pa.array(texts, pa.string()))
    for a, b, text in zip(offs[:-1], offs[1:], texts):
        h, _, _, _ = words(data[a:b], np.array([0, b - a]), NOT_ALNUM)
        out.append((TERM.findall(text.translate(LOWER)), h.view(np.int64).tolist()))
    return out


def portion(blocks_table: DataFrame, texts: DataFrame, items: list[str], most: int, totals) -> DataFrame:
    """(k, id, score, rank) of the items (k is the place in the list)."""
    spark = blocks_table.sparkSession
    found = term_hashes(items)
    hashes = {t: h for terms, hs in found for t, h in zip(terms, hs)}
    # Portions are small: at most MOST_TERMS terms, or a single item.
    wanted = spark.createDataFrame([(h,) for h in sorted(set(hashes.values()))], "term long")
    counts = blocks_table.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    counts = counts.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counts.toLocalIterator()}
    shared = spark.sparkContext.broadcast(Portion([t for t, _ in found], hashes, df, totals[0], totals[1]))
    signatures = blocks_table.select("bits", "uids", "sizes", "slices")

    high = signatures.mapInArrow(_best(shared, most), "k long, uid binary, bound long")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("bound"), "uid"))
    high = written(high.withColumn("r", place).filter(F.col("r") <= most).select("k", "uid"), "highest")
    tried = high.join(exact(texts, high.distinct(), shared), ["k", "uid"])  # a row for each copy
    least = tried.groupBy("k").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= most)
    least = spark.sparkContext.broadcast({r["k"]: r["least"] for r in least.toLocalIterator()})

    reach = written(signatures.mapInArrow(_reaching(shared, least), "k long, uid binary").distinct(), "reaching")
    scores = exact(texts, reach, shared)
    # Of equal texts the first ids are enough.
    ids = blocks_table.select(F.explode(F.arrays_zip("uids", "ids")).alias("x")).select(F.col("x.uids").alias("uid"), F.col("x.ids").alias("id"))
    own = written(scores.select("uid").distinct(), "scored")
    nth = F.row_number().over(Window.partitionBy("uid").orderBy(F.asc_nulls_last("id")))
    ids = ids.join(sized(own), "uid").withColumn("r", nth).filter(F.col("r") <= most).select("uid", "id")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid"))
    return scores.join(ids, "uid").withColumn("rank", rank).filter(F.col("rank") <= most).select("k", "id", "score", "rank")


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", portion_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items, the `most` rows of docs with the highest scores above 0, equal scores by ascending id.

    Null and empty texts have no terms; items without terms have no rows. Repeated rows of docs count each; null ids come last among equal scores.
    Repeated items are answered each. Other columns are ignored; without documents or items there are no rows. Document frequencies go by 64-bit
    hashes of terms, scores by the terms themselves.
    """
    spark = docs.sparkSession
    table = index(docs, id_col, text_col)
    totals = table.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.expr("aggregate(sizes, 0L, (s, x) -> s + x)")).alias("l")).first()
    lower = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), lower.alias("text"), F.monotonically_increasing_id().alias("nth"))
    asked = written(asked.withColumn("terms", F.length("text") / 2), "asked")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    total = asked.agg(F.sum("terms")).first()[0]
    if not totals["n"] or total is None:
        return out
    portions = math.ceil(total / portion_terms) or 1
    texts = keyed(docs, id_col, text_col)
    for i in range(portions):
        own = asked.filter(F.pmod(F.xxhash64("nth"), F.lit(portions)) == i).select("item_id", "text").collect()  # about portion_terms terms
        if not own:
            continue
        found = portion(table, texts, [r["text"] for r in own], most, (totals["n"], totals["l"]))
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)], "k long, item_id long")
        found = written(found.join(F.broadcast(names), "k").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked")
        out = out.union(found)
    return out


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SEARCH_SQL = r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 q AS (SELECT item_id, w, count(*) AS c FROM i GROUP BY ALL), s AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM t WHERE len(ws) > 0),
 u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM t), f AS (SELECT doc_id, n, w, count(*) AS tf FROM u WHERE w IN (SELECT w FROM q) GROUP BY ALL), d AS (SELECT w, count(*) AS df FROM f GROUP BY w),
 x AS (SELECT item_id, doc_id, CAST(sum(c * CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * f.n * s.n) // l AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN f USING (w) JOIN d USING (w), s GROUP BY item_id, doc_id)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10"""
