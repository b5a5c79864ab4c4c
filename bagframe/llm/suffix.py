"""Removal of repeated byte strings: suffix arrays by induced sorting over shards that hold all places where a repeat can be.

Every window of LENGTH bytes is dealt to the smallest hash of its GRAM-byte strings, so equal windows get the same key whatever stands around them.
Runs of neighbouring windows of one key form a segment. Keys with one segment in the whole corpus cannot repeat and are dropped before any text moves;
equal segments are merged. Shards of whole keys then get a suffix array and its permuted longest common prefixes, counted byte by byte, which tell each
window's repeats; hashes only bring together what may be equal.
The segments of a key that has more than HOT different ones are cut where the distance from a window to its string passes multiples of a width (WIDTHS),
which gives finer keys: what stands inside a passage common to many texts becomes equal there and is merged, so only what straddles its ends goes on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import blocks, mix, prefix, substring_hash
from .store import written

LENGTH, GRAM = 400, 200
#: Most windows of a segment; longer runs (of periodic text) are several segments of one key.
RUN = 400
#: Bytes of a shard, about, and most segments of a key that share one.
SHARD, HOT = 1 << 20, 4_000
#: Most buckets that are filled by steps over arrays, bucket by bucket; more (of names) are filled place by place.
MOST_BUCKETS = 1 << 10
#: Numbers that are compared at once for common prefixes.
COMPARED = 1 << 20
#: Windows of the segments of finer keys; single windows are either merged or told apart.
WIDTHS = (32, 4, 1)


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    differ = np.flatnonzero(s[1:] != s[:-1])
    next_one = differ[np.minimum(np.searchsorted(differ, np.arange(len(s) - 1)), len(differ) - 1)]
    return np.append(s[next_one] < s[next_one + 1], True)


def induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int, single: int) -> np.ndarray:
    """The suffix array that follows from the order `lms` of the leftmost-smaller suffixes, bucket by bucket, each in a few steps over arrays.

    Numbers below `single` stand once in s, after greater ones only, and the last one is 0.
    """
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(len(s), -1, np.int64)
    own = s[lms]
    cuts = np.searchsorted(own, np.arange(size + 1))  # leftmost-smaller suffixes come in order, so by bucket
    to = heads.copy()

    def put(j, wanted, step):
        """Places the predecessors of wanted type of suffixes j, in this order; returns those that fall into each place."""
        p = j[j > 0] - 1
        p = p[small[p] == wanted]
        if len(p):
            c = s[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            nth = np.arange(len(c)) - np.searchsorted(c, c)
            sa[to[c] + nth if step > 0 else to[c] - 1 - nth] = p
            to[:] += step * np.bincount(c, minlength=size)

    put(lms[: cuts[single]], False, 1)
    for c in range(single, size):
        at = heads[c]
        while at < to[c]:
            at, j = to[c], sa[at : to[c]]
            put(j, False, 1)
        put(lms[cuts[c] : cuts[c + 1]], False, 1)
    low = to.copy()
    to[:] = ends
    sa[0], to[0] = len(s) - 1, 0
    for c in range(size - 1, single - 1, -1):
        at = ends[c]
        while at > to[c]:
            at, j = to[c], sa[to[c] : at][::-1]
            put(j, True, -1)
        put(sa[heads[c] : low[c]][::-1], True, -1)
    return sa


def induced_singly(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """As `induced`, place by place: for strings of names, which have many buckets of few places each."""
    ends = np.cumsum(np.bincount(s, minlength=size))
    own = s[lms]
    order = np.argsort(own, kind="stable")
    at = np.full(len(s), -1, np.int64)
    at[ends[own[order]] - np.searchsorted(own[order], own[order], "right") + np.arange(len(lms))] = lms[order]
    sa, to = at.tolist(), np.append(0, ends[:-1]).tolist()
    # The bucket that a suffix's predecessor falls into in either pass; none for the first suffix and, at the list's end, for empty places (-1).
    falls, rises = (np.where(wanted, np.roll(s, 1), -1) for wanted in (~np.roll(small, 1), np.roll(small, 1)))
    falls[0] = rises[0] = -1
    falls, rises = np.append(falls, -1).tolist(), np.append(rises, -1).tolist()
    # Both walks meet what they place: to the right of where they are, to the left on the way back.
    for j in sa:
        c = falls[j]
        if c >= 0:
            sa[to[c]] = j - 1
            to[c] += 1
    to = ends.tolist()
    for j in reversed(sa):
        c = rises[j]
        if c >= 0:
            to[c] = i = to[c] - 1
            sa[i] = j - 1
    return np.array(sa, np.int64)


def shard_array(s: np.ndarray, size: int, single: int) -> np.ndarray:
    """Suffix array of a shard: s ends in its only 0, numbers below `single` stand once and after greater ones.

    Equal leftmost-smaller substrings get one name; the order of the suffixes of the string of names, which ends in its only 0, too, comes by recursion.
    """
    if np.bincount(s).max() == 1:
        return np.argsort(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    few = size - single <= MOST_BUCKETS

    def sorted_from(order):
        return induced(s, small, order, size, single) if few else induced_singly(s, small, order, size)

    sa = sorted_from(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    stop = np.zeros(len(s), np.int64)
    stop[lms] = np.append(lms[1:] + 1, len(s))
    length = stop[order] - order
    same = np.append(False, length[1:] == length[:-1])
    pair = np.flatnonzero(same)
    n = length[pair]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    differs = s[np.repeat(order[pair], n) + inside] != s[np.repeat(order[pair - 1], n) + inside]
    same[pair] = np.bincount(np.repeat(np.arange(len(pair)), n), differs, len(pair)) == 0
    named = np.zeros(len(s), np.int64)
    named[order] = np.cumsum(~same) - 1
    return sorted_from(lms[shard_array(named[lms], len(lms) - int(same.sum()), 1)])


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, its suffix's predecessor in the array (-1: none) and how many numbers their common prefix has, compared one by one.

    Where both are preceded by the same number, the prefix is one shorter than that of the place before; all others are compared, whose lengths
    add up to O(n log n).
    """
    at = np.arange(len(s))
    before = np.full(len(s), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = (at > 0) & (before > 0) & (s[at - 1] == s[before - 1])
    reach = np.where(follows, 0, at)
    open_, block = np.flatnonzero(~follows & (before >= 0)), 8
    while len(open_):
        left = []
        for part in np.array_split(open_, len(open_) * block // COMPARED + 1):
            step = (reach[part] - part)[:, None] + np.arange(block)
            # One of the two meets the only 0 at the end first, and differs there.
            x, y = (s[np.minimum(p[:, None] + step, len(s) - 1)] for p in (part, before[part]))
            differs = x != y
            ended = differs.any(axis=1)
            reach[part] += np.where(ended, differs.argmax(axis=1), block)
            left.append(part[~ended])
        open_, block = np.concatenate(left), min(2 * block, LENGTH)
    return before, np.maximum.accumulate(reach) - at


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, where a string of `length` bytes starts that also starts elsewhere in the segments."""
    m = len(segments)
    sizes = np.array([len(x) + 1 for x in segments])
    ends = np.cumsum(sizes)
    s = np.empty(int(ends[-1]), np.int64)
    is_end = np.zeros(len(s), bool)
    is_end[ends - 1] = True
    s[is_end] = np.arange(m)[::-1]  # different ends, the last one the smallest
    s[~is_end] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + m
    values, dense = np.unique(s[~is_end], return_inverse=True)
    s[~is_end] = dense + m
    before, common = permuted_lcp(s, shard_array(s, m + len(values), m))
    hit = common >= length
    hit[before[hit]] = True
    return [np.flatnonzero(hit[a : b - 1]) for a, b in zip(ends - sizes, ends)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends (exclusive) of runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1


def window_keys(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and the smallest one of each window."""
    at = np.arange(len(data) - gram + 1)
    low = grams = substring_hash(prefix(data), at, at + gram)
    span, width = length - gram + 1, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return grams, low


def _lists(values, kind):
    offs = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def _marks(batches):
    for batch in batches:
        starts, sizes, keys, times = [], [], [], []
        for _, data, offs in blocks(batch.column(1)):
            for a, b in zip(offs[:-1], offs[1:]):
                if b - a < LENGTH:
                    first = n = often = np.zeros(0, np.int32)
                    key = np.zeros(0, np.int64)
                else:
                    grams, low = window_keys(data[a:b])
                    new = np.append(True, low[1:] != low[:-1])
                    began = np.maximum.accumulate(np.where(new, np.arange(len(low)), 0))
                    first = np.flatnonzero((np.arange(len(low)) - began) % RUN == 0)
                    n, key = np.diff(np.append(first, len(low))), low[first].view(np.int64)
                    # A segment with its key at two places may repeat a window by itself.
                    often = np.array([min(2, np.count_nonzero(grams[i : i + m + LENGTH - GRAM] == low[i])) for i, m in zip(first, n)], np.int32)
                starts.append(first)
                sizes.append(n)
                keys.append(key)
                times.append(often)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(starts, np.int32), _lists(sizes, np.int32), _lists(keys, np.int64), _lists(times, np.int32)], names=["uid", "starts", "sizes", "keys", "often"])


def _segments(batches):
    for batch in batches:
        for uid, text, places in zip(batch.column(0), batch.column(1), batch.column(2)):
            data, rows = text.as_py().encode(), places.as_py()
            parts = [data[p["start"] : p["start"] + p["n"] + LENGTH - 1] for p in rows]
            digests = [hashlib.blake2b(x, digest_size=32).digest() for x in parts]
            columns = [pa.array([uid.as_py()] * len(rows), pa.binary()), pa.array([p["start"] for p in rows], pa.int32()), pa.array([p["n"] for p in rows], pa.int32()), pa.array([p["often"] for p in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p["key"] for p in rows], pa.int64()), pa.array(digests, pa.binary()), pa.array(parts, pa.binary())], names=["uid", "start", "n", "often", "key", "seg", "bytes"])


def _ranges(segs: list[bytes], starts: list[np.ndarray]):
    rows = [(seg, *runs(x)) for seg, x in zip(segs, starts) if len(x)]
    segs, firsts, lasts = zip(*rows) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), _lists(firsts, np.int32), _lists(lasts, np.int32)], names=["seg", "firsts", "lasts"])


def _shards(batches):
    """Rows come in order of key; shards of whole keys get a suffix array each."""
    segs, parts, size, key = [], [], 0, None
    for batch in batches:
        for k, seg, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k != key and size >= SHARD:
                yield _ranges(segs, repeated_starts(parts))
                segs, parts, size = [], [], 0
            key = k
            segs.append(seg)
            parts.append(part)
            size += len(part)
    if segs:
        yield _ranges(segs, repeated_starts(parts))


def _finer(width: int):
    """Cuts segments where the distance from a window to its key's string passes multiples of width."""

    def cut(batches):
        for batch in batches:
            rows = []
            for key, gram, parent, part in zip(*(x.to_pylist() for x in batch.columns)):
                data = np.frombuffer(part, np.uint8)
                at = np.arange(len(data) - GRAM + 1)
                places = np.flatnonzero(substring_hash(prefix(data), at, at + GRAM) == np.int64(gram).view(np.uint64))
                window = np.arange(len(data) - LENGTH + 1)
                place = places[np.searchsorted(places, window)]
                group = (place - window) // width
                new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])))
                finer = mix(np.int64(key).view(np.uint64) + group[new].astype(np.uint64) * np.uint64(2 * width + 1)).view(np.int64)
                for a, b, g in zip(new.tolist(), np.append(new[1:], len(window)).tolist(), finer.tolist()):
                    inner = part[a : b + LENGTH - 1]
                    often = min(2, int(np.count_nonzero((places >= a) & (places <= b - 1 + LENGTH - GRAM))))
                    rows.append((parent, a, b - a, often, g, gram, hashlib.blake2b(inner, digest_size=32).digest(), inner))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["parent", "start", "n", "often", "key", "gram", "seg", "bytes"])

    return cut


def told(places: DataFrame, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """(seg, firsts, lasts): runs of windows of the segments of `places` (key, gram, seg, bytes, n, often) that stand elsewhere in them, too."""
    merged = places.groupBy("key", "seg").agg(F.first("bytes").alias("bytes"), F.first("gram").alias("gram"), F.first("n").alias("n"), F.max("often").alias("often"), F.count("*").alias("times"))
    merged = written(merged, "merged")
    whole = merged.filter("times > 1").select("seg", F.array(F.lit(0)).alias("firsts"), F.array("n").alias("lasts"))
    several = merged.join(merged.groupBy("key").agg(F.sum("often").alias("c")).filter("c > 1"), "key")
    if widths:
        split = several.filter(F.col("c") > hot).select("key", "gram", "seg", "bytes")
        cuts = written(split.mapInArrow(_finer(widths[0]), "parent binary, start int, n int, often int, key long, gram long, seg binary, bytes binary"), "cuts")
        if not cuts.isEmpty():
            inner = told(cuts, hot, widths[1:]).join(cuts.select("seg", "parent", "start"), "seg")
            moved = [F.expr(f"transform({x}, y -> y + start)").alias(x) for x in ("firsts", "lasts")]
            whole = whole.union(inner.select(F.col("parent").alias("seg"), *moved))
    # A single window that is unlike the others of its key by bytes is no repeat.
    arrays = several.filter((F.col("c") <= hot) & (F.col("n") > 1 if not widths else F.lit(True))).select("key", "seg", "bytes")
    arrays = arrays.repartition("key").sortWithinPartitions("key", "seg")
    return whole.union(arrays.mapInArrow(_shards, "seg binary, firsts array<int>, lasts array<int>"))


def _cut(keep: bool):
    names = ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep

    def cut(batches):
        for batch in batches:
            rows = []
            for uid, text, copies, ranges in zip(*(x.to_pylist() for x in batch.columns)):
                data = text.encode()
                depth = np.zeros(len(data) + 1, np.int32)
                if copies > 1 and len(data) >= LENGTH:
                    ranges = [{"start": 0, "firsts": [0], "lasts": [len(data) - LENGTH + 1]}]
                for r in ranges or []:
                    np.add.at(depth, [r["start"] + x for x in r["firsts"]], 1)
                    np.add.at(depth, [r["start"] + x + LENGTH - 1 for x in r["lasts"]], -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                rows.append((uid, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    return cut


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, keep: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if `keep`, kept (the remaining bytes) of each row.

    Bytes go where a string of LENGTH bytes covers them that also starts elsewhere, in the same text or another row. Equal texts of that length go
    whole. Null and empty texts are 0 bytes, and texts shorter than LENGTH stay. Null ids and repeated rows stay (as copies of each other); other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.unhex(F.sha2("text", 256)))
    texts = written(rows.groupBy("uid").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts")
    marks = written(texts.select("uid", "text").mapInArrow(_marks, "uid binary, starts array<int>, sizes array<int>, keys array<long>, often array<int>"), "marks")
    places = marks.select("uid", F.explode(F.arrays_zip("starts", "sizes", "keys", "often")).alias("p")).select("uid", F.col("p.starts").alias("start"), F.col("p.sizes").alias("n"), F.col("p.keys").alias("key"), F.col("p.often").alias("often"))
    keys = places.groupBy("key").agg(F.sum("often").alias("c")).filter("c > 1").select("key")
    shared = places.join(keys, "key").groupBy("uid").agg(F.collect_list(F.struct("start", "n", "key", "often")).alias("places"))
    found = texts.select("uid", "text").join(shared, "uid").select("uid", "text", "places")
    found = written(found.mapInArrow(_segments, "uid binary, start int, n int, often int, key long, seg binary, bytes binary"), "segments")
    ranges = told(found.select("key", F.col("key").alias("gram"), "seg", "bytes", "n", "often"), hot, WIDTHS)
    ranges = ranges.groupBy("seg").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("firsts", "lasts")))
    ranges = written(ranges, "ranges")
    per_text = found.select("uid", "start", "seg").join(ranges, "seg").groupBy("uid").agg(F.collect_list(F.struct("start", "firsts", "lasts")).alias("ranges"))
    cut = texts.join(per_text, "uid", "left").select("uid", "text", "copies", "ranges")
    schema = "uid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    cut = written(cut.mapInArrow(_cut(keep), schema), "kept")
    return rows.select(id_col, "uid").join(cut, "uid").drop("uid")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
