"""Benchmark decontamination with DataFrame functions only.

Windows of whole blocks of words are fingerprinted by 64-bit SimHash: bit counts of a block are summed side by side in the bytes of eight numbers,
so a window's counts are sums of its blocks'. Texts have a window from every block on (every STEP words); items have one from every word on, so a
passage that holds an item has windows that start where one of the item's does. An item's windows are of the classes of LENGTHS between a fifth of it
and as much of it as surely has a block's start. Fingerprints are looked up by multi-index Hamming blocks: cut into radius + 1 parts, two within the
radius agree in one part at least, so the lookup, which alone proposes candidates, misses none within it. For many item windows keys are two or more parts of a finer cut, with the same
guarantee. A candidate is a place where an item may stand; it is
verified by the exact weighted share of the item's word shingles that stand there.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import sized, written

SHINGLE, THRESHOLD, STEP = 5, 0.8, 8
#: Words of a window, and bits that its fingerprint may differ in. Shorter windows hold an edit or none, so they need no radius.
LENGTHS = {1: 0, 2: 0, 4: 0, 8: 1, 16: 2, 32: 4, 64: 4}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def shingle_list(words: str, n: int):
    """Hashes of the n-word shingles of an array column, in order; empty if it has fewer words."""
    grams = f"transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64({', '.join(f'{words}[i - 1 + {k}]' for k in range(n))}))"
    return F.expr(f"if(size({words}) >= {n}, {grams}, cast(array() as array<bigint>))")


def _each(n: str, body: str, empty: str) -> str:
    """SQL of an array of body over i from 0 to n - 1."""
    return f"if({n} > 0, transform(sequence(0, {n} - 1), i -> {body}), cast(array() as {empty}))"


def block_counts(hashes: str, step: int) -> str:
    """SQL: for each whole block of `step` (at most 8) hashes, how many have each bit, in the bytes of eight numbers."""
    # Four hashes fill half bytes without reaching the sign.
    groups = [range(a, min(a + 4, step)) for a in range(0, step, 4)]
    nibbles = [" + ".join(f"(shiftrightunsigned(w[{j}], {b}) & 1229782938247303441L)" for j in g) for g in groups for b in range(4)]
    mask = "1085102592571150095L"
    low = [" + ".join(f"(n[{4 * g + b}] & {mask})" for g in range(len(groups))) for b in range(4)]
    high = [" + ".join(f"(shiftrightunsigned(n[{4 * g + b}], 4) & {mask})" for g in range(len(groups))) for b in range(4)]
    halves = "array(" + ", ".join(x for pair in zip(low, high) for x in pair) + ")"
    body = f"transform(array(slice({hashes}, i * {step} + 1, {step})), w -> transform(array(array({', '.join(nibbles)})), n -> {halves})[0])[0]"
    return _each(f"size({hashes}) div {step}", body, "array<array<bigint>>")


def doubled_counts(counts: str) -> str:
    """SQL: the counts of blocks twice as long: of each first and second block together."""
    first, second = (f"filter(slice({counts}, 1, size({counts}) div 2 * 2), (x, i) -> i % 2 = {odd})" for odd in (0, 1))
    body = "array(" + ", ".join(f"x[{k}] + y[{k}]" for k in range(8)) + ")"
    return f"zip_with({first}, {second}, (x, y) -> {body})"


def joined_counts(counts: str, apart: int) -> str:
    """SQL: the counts of windows twice as long: each window's with those of the one `apart` blocks on."""
    body = "array(" + ", ".join(f"x[{k}] + y[{k}]" for k in range(8)) + ")"
    return f"zip_with(slice({counts}, 1, greatest(size({counts}) - {apart}, 0)), slice({counts}, {1 + apart}, greatest(size({counts}), {1 + apart})), (x, y) -> {body})"


def simhash(counts: str, length: int) -> str:
    """SQL of the fingerprint of a window: the bits that more than half of its words have."""
    add = (63 - length // 2) * 0x0101010101010101  # the sums stay below 128
    # Bit 6 of each byte, moved to bit k.
    parts = [f"shiftrightunsigned({counts}[{k}] + {add}L, {6 - k}) & {0x0101010101010101 << k}L" for k in range(7)]
    return " | ".join(f"({p})" for p in [*parts, f"shiftleft({counts}[7] + {add}L, 1) & {(0x0101010101010101 << 7) - (1 << 64)}L"])


def agreeing(radius: int, windows: int) -> int:
    """How many parts of a fingerprint make a key, so that keys and the windows met by chance, of so many item windows, are fewest.

    Of radius + k parts, two fingerprints within the radius agree in k at least, so every k finds the same pairs; more parts make more and wider keys.
    """
    return min(range(1, 5), key=lambda k: comb(radius + k, k) * (1 + windows / 2 ** (64 * k / (radius + k))))


def parts_of(fingerprint: str, length: int, agree: int = 1) -> str:
    """SQL of the keys of a fingerprint: for each choice of `agree` of its radius + `agree` parts, a number that tells the class, the choice and the bits."""
    n = LENGTHS[length] + agree
    edges = [64 * i // n for i in range(n + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(bits, agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return f"array({', '.join(f'xxhash64({length}, {i}, {fingerprint} & {m}L)' for i, m in enumerate(signed))})"


def with_windows(rows: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """rows with `windows`: at (its first word), length, print of every window of each length that begins at a block."""
    out = rows.withColumn("__h", F.expr(f"transform({words}, w -> xxhash64(w))"))
    steps = sorted({min(x, STEP) for x in lengths})
    for s in steps:
        out = out.withColumn(f"__{s}", F.expr(doubled_counts(f"__{s // 2}") if s // 2 in steps else block_counts("__h", s)))
    longest, at = max(lengths), STEP
    while at < longest:
        out = out.withColumn(f"__{2 * at}", F.expr(joined_counts(f"__{at}", at // STEP)))
        at *= 2
    found = [f"transform(__{x}, (c, i) -> named_struct('at', i * {min(x, STEP)}, 'length', {x}, 'print', {simhash('c', x)}))" for x in lengths]
    return out.withColumn("windows", F.expr(f"concat({', '.join(found)})")).drop("__h", *{f"__{2**k}" for k in range(8)})


def places(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(h, item, start): where in the texts (h, words) an item (item, item_words) may begin, in words (negative: before the text)."""
    size = F.size("item_words")
    fits = F.expr("filter(array({}), x -> x + least(x, {}) - 1 <= size(item_words) and 5 * x >= least(size(item_words), 64))".format(", ".join(map(str, LENGTHS)), STEP))
    cut = items.select("item", "item_words", F.explode(fits).alias("length")).select("item", "item_words", "length", F.explode(F.sequence(F.lit(0), size - F.col("length"))).alias("offset"))
    cut = written(cut.select("item", "length", "offset", F.expr("slice(item_words, offset + 1, length)").alias("w")), "item-windows")
    many = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row for each of LENGTHS
    lengths = [x for x in LENGTHS if x in many]
    parts = "case " + " ".join(f"when {{0}}.length = {x} then {parts_of('{0}.print', x, agreeing(LENGTHS[x], many[x]))}" for x in lengths) + " end"
    own = [with_windows(cut.filter(F.col("length") == x), "w", [x]).select("item", "offset", F.explode_outer("windows").alias("i")).filter("i is not null") for x in lengths]
    index = reduce(DataFrame.union, own).select("item", "offset", F.col("i.length").alias("length"), F.col("i.print").alias("item_print"), F.explode_outer(F.expr(parts.format("i"))).alias("part"))
    index = written(index, "item-index")
    # explode() would ask for non-empty arrays first, by the whole expression once more.
    seen = with_windows(texts, "words", lengths).select("h", F.explode_outer("windows").alias("x")).filter("x is not null")
    seen = seen.select("h", "x.at", "x.length", "x.print", F.explode_outer(F.expr(parts.format("x"))).alias("part"))
    radius = F.expr("case " + " ".join(f"when length = {x} then {LENGTHS[x]}" for x in lengths) + " end")
    # Parts tell the class, too; one number is looked up faster than two.
    same = F.col("length") == F.col("item_length")
    near = seen.join(sized(index.withColumnRenamed("length", "item_length")), "part").filter(same & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius))
    return near.select("h", "item", (F.col("at") - F.col("offset")).alias("start")).distinct()


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col="text", item_id="item_id", item_text="text", threshold=THRESHOLD, n=SHINGLE) -> DataFrame:
    """(digest, items, similarity): SHA-256 of each distinct text that holds items, their ids, and the highest similarity."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), word_list(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0)
    items = written(items.withColumn("n", F.least(F.lit(n), F.size("item_words"))), "items")
    lengths = [k for k in range(1, n + 1) if not items.filter(F.col("n") == k).isEmpty()]
    if not lengths:
        return docs.sparkSession.createDataFrame([], "digest string, items array<bigint>, similarity double")

    def shingled(rows: DataFrame, words: str, keep: list[str]) -> DataFrame:
        return reduce(DataFrame.union, [rows.filter(F.col("n") == k).select(*keep, F.explode(F.array_distinct(shingle_list(words, k))).alias("shingle")) for k in lengths])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = written(places(texts.select("h", word_list(F.col("text")).alias("words")), items), "places")
    hits = written(found.select("h").distinct(), "hits")
    margin = F.greatest(F.lit(2), F.floor(F.col("words") / 8))
    spans = items.select("item", "n", F.size("item_words").alias("words")).select("item", "n", "words", margin.alias("margin"))
    spans = found.join(sized(written(spans, "spans")), "item").select("h", "item", "start", "n", F.greatest(F.lit(0), F.col("start") - F.col("margin")).alias("first"), (F.col("start") + F.col("words") + F.col("margin")).alias("end"))
    # Words are split once a text; the window of each place is cut as the join gives it, so no row holds all places of a text.
    held = texts.join(sized(hits), "h", "left_semi").select("h", F.sha2("text", 256).alias("digest"), word_list(F.col("text")).alias("words"))
    window = F.expr("slice(words, cast(first as int) + 1, cast(greatest(0, end - first) as int))")
    windows = held.join(sized(written(spans, "places-cut")), "h").select("digest", "item", "start", "n", window.alias("window"))
    windows = written(windows.distinct(), "windows")

    # A shingle weighs more the fewer items have it.
    own = shingled(items, "item_words", ["item"])
    total = items.count()
    weights = own.groupBy("shingle").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("weight"))
    weighted = written(own.join(weights, "shingle"), "weights")
    sums = weighted.groupBy("item").agg(F.sum("weight").alias("whole"))
    shared = shingled(windows, "window", ["digest", "item", "start"]).join(sized(weighted), ["item", "shingle"])
    shared = shared.groupBy("digest", "item", "start").agg(F.sum("weight").alias("part"))
    similar = shared.join(sums, "item").withColumn("similarity", F.col("part") / F.col("whole")).filter(F.col("similarity") >= threshold - 1e-9)
    return similar.groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """docs with `contaminated` (boolean), `items` (ids of the items it holds; empty if none) and `similarity` (the highest weighted share; 0 if none).

    A text holds an item if THRESHOLD of the weight of the item's shingles stand in a window of the item's words and an eighth more at either end.
    Items of fewer than five words are one shingle. Null and empty texts hold nothing, nor does anything hold an empty item. Equal texts are judged
    once; repeated rows all stay, an empty table stays empty. Columns of docs named like the three new ones, or __digest, are replaced.
    """
    found = written(contaminated_texts(docs, benchmark, text_col, **options), "contaminated")
    kept = docs.drop("contaminated", "items", "similarity", "__digest")
    found = sized(found.select(F.col("digest").alias("__digest"), "items", "similarity"), "100 + 8 * size(items)")
    out = kept.withColumn("__digest", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).join(found, "__digest", "left").drop("__digest")
    out = out.withColumn("contaminated", F.col("items").isNotNull())
    return out.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<bigint>)"))).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items and similarity of all documents against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contaminated", "items", "similarity")
