"""Near duplicates: bottom-k sketches of shingle sets, inverted lists of retained values, union-sketch estimates, exact Jaccard.

One hash function orders the shingles; a sketch keeps a set's k smallest hashes (all of a smaller set). For two sets of similarity t or more, the
overlap of their sketches falls below need(k, t) with a probability under MISS. By the prefix principle two such sketches share a value among each
one's k - need + 1 rarest values, so only those are posted to the inverted lists; what is frequent in the corpus (common lines, passages) hardly
is. Documents with equal sets are one class from the start.

Lists with few members whose partners are open (SHORT) are settled pair by pair. Longer ones are worked off in rounds without forming their pairs: all members of a list meet one
centre, the member whose values are the most common. Linked members join its component. Two members that the centre has not joined must share a value outside the centre:
  - X whose sketch shares fewer than `wanted` values with the centre's shares the rest of what a partner needs outside it;
  - X of size a with i shingles in the centre, not linked to it, shares (a + z) * t / (1 + t) - i or more shingles outside it with a partner of size z,
    which is one at least but where z is small; then X and its partner both lack a shingle of the centre's. For let them share nothing outside it and
    lack different ones: they share i - m, m of the centre's c missing in the partner, z >= c - m, and i - m >= (a + z) * t / (1 + t) would give
    i >= (a + c) * t / (1 + t), so X would be linked to the centre.
A pair needs one centre only: where both members have met the same best centre in a round, only that centre's new lists have to hold them (`tag` names it).
So members are posted again to lists named (centre, value outside it) or (centre, value of it that they lack), and only lists that still hold different components go to the next round. A
list grows into rows by its length, never by its square, and no link is lost; centres only fall in their order along a chain of lists, so rounds end.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import SPACE, blocks, shingle_sets
from .store import sized, small_batches, written
from .tokens import forget

K = 64
MISS = 1e-6
#: Members of a centre that one task compares, about, and rows of an Arrow batch that become Python objects at once.
MEMBERS = 500
SLICE, SLICE_BYTES = 500, 4 << 20
#: Bytes of texts whose shingles are made at once: each becomes some 30 of numbers on the way.
SHINGLED = 1 << 18
#: Lists with up to so many open members are settled at once: these meet all members, so a list makes rows by its length.
SHORT = 12
#: The same for the lists of later rounds, of which most pairs are ruled out by what their members have and ask for.
LATER = 100


def need(k: int, t: float, miss: float = MISS) -> int:
    """The largest overlap that Binomial(k, t) falls below with a probability of at most `miss`."""
    low, c = 0.0, 0
    while c <= k:
        low += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if low > miss:
            return c
        c += 1
    return k


def _digest(values: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    out = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return out.withColumn("text_hash", F.xxhash64("text"))


def with_sketches(docs: DataFrame, key: str, text: str, k: int, n: int) -> DataFrame:
    """id, text_hash, n_shingles, cls (a digest of the set; null: empty), sketch (signed, in the order of unsigned values)."""

    def sketch(batches):
        forget()
        for batch in batches:
            sizes, classes, kept = [], [], []
            for _, data, offs in blocks(batch.column(1), SHINGLED):
                for values in shingle_sets(data, offs, SPACE, n):
                    sizes.append(len(values))
                    classes.append(_digest(values) if len(values) else None)
                    kept.append(values[:k].view(np.int64).copy())  # not a view that keeps the whole set
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32), np.concatenate([*kept, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), lists], names=["id", "text_hash", "n_shingles", "cls", "sketch"])

    return _rows(docs, key, text).mapInArrow(sketch, "id long, text_hash long, n_shingles long, cls binary, sketch array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(cls, members): the sorted shingle hashes of the classes of `wanted` (cls, text_hash, held_id), as bytes."""

    def shingle(batches):
        for batch in batches:
            sets = [x.tobytes() for _, data, offs in blocks(batch.column(1), SHINGLED) for x in shingle_sets(data, offs, SPACE, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "members"])

    held = _rows(docs, key, text).join(sized(wanted), "text_hash").filter(F.col("id").eqNullSafe(F.col("held_id")))
    sets = written(held.select("cls", "text").mapInArrow(shingle, "cls binary, members binary"), "sets")
    return sets if sets.count() == wanted.count() else written(sets.dropDuplicates(["cls"]), "sets")  # rows of equal key and text


def beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (c, cls, again) with the columns of their member in table (by cls), each centre's own row before its members.

    A centre with many members is dealt to several tasks, each with a copy of its row.
    """
    counts = written(pairs.groupBy("c").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "centres")
    members = pairs.join(counts, "c").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).withColumn("own", F.lit(False))
    centres = counts.select("c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"), F.col("c").alias("cls"), F.lit(False).alias("again"))
    both = written(members.select("c", "salt", "own", "cls", "again").unionByName(centres), "beside")
    return sized(both).join(table, "cls").repartition("c", "salt").sortWithinPartitions("c", "salt", F.desc("own"))


def _sliced(batches, heavy: str | None = None):
    """Batches of up to SLICE rows, and of up to SLICE_BYTES of the binary column `heavy` or a single row."""
    for batch in batches:
        if heavy is None:
            ends = np.minimum(np.arange(SLICE, batch.num_rows + SLICE, SLICE), batch.num_rows)
        else:
            sizes = np.cumsum(pc.binary_length(batch.column(batch.schema.names.index(heavy))).to_numpy(zero_copy_only=False))
            ends, at = [], 0
            while at < batch.num_rows:
                limit = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")
                at = min(max(at + 1, int(limit)), at + SLICE, batch.num_rows)
                ends.append(at)
        at = 0
        for end in ends:
            yield batch.slice(at, int(end) - at)
            at = int(end)


def _lists(values: list) -> pa.ListArray:
    """A column of lists from arrays or lists of numbers, built from one array."""
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in values)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)), pa.array(flat))


def sketched(pairs: DataFrame, ranked: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """c, cls, again, close (the sketches allow a link, or the exact overlap has to be known), asks (values that X and a partner must share outside the
    centre's sketch, one at least), post (such values of its sketch), has (how many values from the first of post on others have, too)."""
    least = need(k, num / den)
    mask = (1 << 64) - 1

    def estimate(size: int, size_c: int, sketch: list[int], centre: set[int]) -> bool:
        if min(size, size_c) * den < max(size, size_c) * num:
            return False
        union = sorted(v & mask for v in centre.union(sketch))[:k]
        shared = sum(v in centre and v & mask <= union[-1] for v in sketch)
        return den * shared >= num * len(union) if len(union) < k else shared >= least

    def compare(batches):
        centre, size_c = set(), 0
        for batch in _sliced(batches):
            out = []
            for c, cls, own, again, size, wanted, room, sketch, values in zip(*(x.to_pylist() for x in batch.columns)):
                if own:
                    centre, size_c = set(sketch), size
                    continue
                shared = len(centre.intersection(sketch))
                close = shared >= wanted and (again or estimate(size, size_c, sketch, centre))
                post = [v for v in values if v not in centre] if again else []
                if close or post:
                    out.append((c, cls, again, close, max(1, wanted - shared), len(post), post[:room]))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, _lists(list(columns[6]))], names=["c", "cls", "again", "close", "asks", "has", "post"])

    rows = beside(pairs, ranked).select("c", "cls", "own", "again", "size", "wanted", "room", "sketch", "values")
    return rows.mapInArrow(compare, "c binary, cls binary, again boolean, close boolean, asks long, has long, post array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """c, cls, again, linked, size, inside (shingles shared with the centre), outside (the member's others), missing (the centre's others), by whole sets.

    The last two are empty where again is false.
    """

    def compare(batches):
        centre, none = np.zeros(1, np.uint64), np.zeros(0, np.int64)
        for batch in _sliced(batches, "members"):
            out = []
            for c, cls, own, again, members in zip(*(x.to_pylist() for x in batch.columns)):
                own_set = np.frombuffer(members, np.uint64)
                if own:
                    centre = own_set
                    continue
                hit = centre[np.minimum(np.searchsorted(centre, own_set), len(centre) - 1)] == own_set
                inside = int(hit.sum())
                linked = den * inside >= num * (len(own_set) + len(centre) - inside)
                if linked or again:
                    outside = own_set[~hit].view(np.int64) if again else none
                    missing = np.setdiff1d(centre, own_set, assume_unique=True).view(np.int64) if again else none
                    out.append((c, cls, again, linked, len(own_set), inside, outside, missing))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, _lists(list(columns[6])), _lists(list(columns[7]))], names=["c", "cls", "again", "linked", "size", "inside", "outside", "missing"])

    rows = beside(pairs, sets).select("c", "cls", "own", "again", "members")
    return rows.mapInArrow(compare, "c binary, cls binary, again boolean, linked boolean, size long, inside long, outside array<long>, missing array<long>")


def components(links: DataFrame, name: str) -> DataFrame:
    """(cls, comp): comp is the smallest class reachable over the links (a, b); classes without links are left out.

    Label propagation with shortcuts: each round a node takes its neighbours' smallest label and then that label's own, and the table is written.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), name + "-edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), name + "-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("further"))
        new = written(stepped.join(jump, "comp", "left").select("cls", "old", F.coalesce(F.least("comp", "further"), "comp").alias("comp")), name + "-labels")
        labels = new.select("cls", "comp")
        if new.filter(F.col("old") != F.col("comp")).isEmpty():
            return labels


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links: those of before are contracted first, so only they and new classes are walked."""
    if comp is None:
        return components(links, "components")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(comp.select(F.col("cls").alias(end), F.col("comp").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    ends = written(ends.filter("a != b").distinct(), "contracted")
    if ends.isEmpty():
        return comp
    step = components(ends, "components")
    moved = comp.join(step.select(F.col("cls").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
    return written(moved.union(step.join(comp, "cls", "left_anti").select("cls", "comp")), "components")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, k: int = K, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (id, text_hash, n_shingles, cls) of docs, and (cls, comp, first_id) of the classes of equal sets that have shingles."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, key, text, num, den, k, n)


def _grouped(docs: DataFrame, key: str, text: str, num: int, den: int, k: int, n: int) -> tuple[DataFrame, DataFrame]:
    t = num / den
    rows = written(with_sketches(docs, key, text, k, n), "sketches")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("first_id"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct("text_hash", "id")).alias("r"))
    classes = written(classes.select("cls", "first_id", "size", "sketch", "r.text_hash", F.col("r.id").alias("held_id")), "classes")
    # A partner of a set that sketches hold whole shares its part of it; otherwise what k smallest values of the union promise.
    wanted = F.when(F.col("size") <= t * k, F.ceil(F.col("size") * num / den)).otherwise(F.lit(need(k, t))).cast("int")
    n_values = F.size("sketch")
    posts = classes.select("cls", F.explode("sketch").alias("value"))
    shared = posts.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    values = posts.join(shared, "value").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum(F.log2("df")).alias("common"))
    ranked = values.join(classes, "cls").withColumn("wanted", wanted).withColumn("room", F.col("wanted") * -1 + F.size("v") + 1).filter("room > 0")
    ranked = written(ranked.select("cls", "size", "wanted", "room", "sketch", F.col("v.value").alias("values"), (F.col("common") / n_values).alias("common"), "text_hash", "held_id"), "ranked")
    info = ranked.select("cls", "size", "wanted", "room", "sketch", "values")
    # A pair of a list needs as many shared values as either asks for (`asks`), and neither can give more than it `has`: at first, sizes alone tell.
    by_size = [F.col("size").alias("has"), F.ceil(F.col("size") * num / den).alias("asks")]
    lists = ranked.select(F.explode(F.slice("values", 1, F.col("room"))).alias("key"), "cls", "common", F.lit(None).cast("long").alias("tag"), F.lit(True).alias("lone"), *by_size)
    comp, sets, turn = None, None, 0
    while True:
        turn += 1
        of = lists.withColumn("comp", F.col("cls")) if comp is None else lists.join(sized(comp), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        of = written(of.select("key", "cls", "common", "comp", "tag", "lone", "has", "asks"), "lists")
        best = F.max(F.struct("common", "cls"))
        heads = of.groupBy("key").agg(best.alias("best"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.count_if("lone").alias("open"), F.count("tag").alias("tags"), F.min("tag").alias("one"), F.max("tag").alias("two"))
        heads = heads.filter("low != high and open > 0 and (tags < n or one != two)").select("key", "best", (F.col("open") > (SHORT if turn == 1 else LATER)).alias("again"))
        open_lists = of.join(heads, "key")
        met = open_lists.filter("again and cls != best.cls").select("best", "cls", "common", "again", "tag")
        few = open_lists.filter("not again and lone").groupBy("key").agg(F.collect_list(F.struct("common", "cls", "comp", "tag", "has", "asks")).alias("m"))
        fits = "y.comp != comp and (tag is null or y.tag is null or y.tag != tag) and least(has, y.has) >= greatest(asks, y.asks) and (not lone or y.cls < cls)"
        short = open_lists.filter("not again").join(few, "key").select("cls", "common", F.explode(F.expr(f"filter(m, y -> {fits})")).alias("y"))
        short = short.select(F.struct("y.common", "y.cls").alias("best"), "cls", "common", F.lit(False).alias("again"), F.lit(None).cast("long").alias("tag"))
        pairs = met.union(short).groupBy("best", "cls").agg(F.max("common").alias("common"), F.max("again").alias("again"), F.max("tag").alias("tag"))
        pairs = written(pairs.select(F.col("best.cls").alias("c"), F.col("best.common").alias("best"), "cls", "common", "again", "tag"), "pairs")
        if pairs.isEmpty():
            break
        # The best centre that a class has met with many others, and the tag of its posts to each centre's new lists.
        tops = pairs.filter("again").groupBy("cls").agg(F.max(F.struct("best", "c")).alias("m")).select("cls", F.col("m.c").alias("top"))
        tags = written(pairs.filter("again").join(tops, "cls").select("c", "cls", "common", F.when(F.col("c") == F.col("top"), F.col("tag")).otherwise(F.xxhash64("top", F.lit(turn))).alias("tag")), "tags")
        told = written(sketched(pairs.select("c", "cls", "again"), info, num, den, k), "told")
        # Members that the sketches find close to their centre settle each other by whole sets.
        tagged = told.filter("size(post) > 0").join(sized(tags), ["c", "cls"]).withColumn("tag", F.when(F.col("close"), F.xxhash64("c", F.lit(turn), F.lit("close"))).otherwise(F.col("tag")))
        tagged = tagged.select("c", "cls", "common", "tag", (~F.col("close")).alias("lone"), "has", "asks", F.posexplode("post").alias("at", "w")).withColumn("has", F.col("has") - F.col("at")).filter("has >= asks")
        new = [tagged.select(F.expr("xxhash64(c, w)").alias("key"), "cls", "common", "tag", "lone", "has", "asks")]
        close = written(told.filter("close").select("c", "cls", "again"), "close")
        if not close.isEmpty():
            lacking = close.select("cls").union(close.select("c")).distinct()
            if sets is not None:
                lacking = lacking.join(sets, "cls", "left_anti")
            lacking = written(ranked.select("cls", "text_hash", "held_id").join(lacking, "cls"), "lacking")
            if not lacking.isEmpty():
                more = whole_sets(docs, lacking, key, text, n)
                sets = more if sets is None else sets.union(more)
            exact = written(confirmed(close, sets, num, den), "exact")
            links = exact.filter("linked").select(F.col("c").alias("a"), F.col("cls").alias("b"))
            if not links.isEmpty():
                comp = merged(comp, links)
            # Partners that need no shingle outside the centre have sizes below `beyond`.
            beyond = F.when(~F.col("linked"), F.floor(F.col("inside") * (den + num) / num - F.col("size")) + 1).otherwise(0)
            again = exact.filter("again").withColumn("beyond", beyond)
            span = again.groupBy("c").agg(F.max("beyond").alias("top"), F.min("size").alias("low"), F.min("linked").alias("all_linked")).filter("not all_linked").select("c", "top", "low")
            again = again.join(sized(written(span, "spans")), "c").join(sized(tags), ["c", "cls"])
            small = F.col("size") < F.col("top")
            waiting = ~F.col("linked") & (F.col("beyond") > F.col("low")) & (F.col("beyond") * den > F.col("size") * num)
            # Of its shingles outside the centre X shares `least` or more with a partner, so it posts that many less one fewer, the rarest.
            smallest = F.greatest(F.col("low"), F.ceil(F.col("size") * num / den))
            least = F.when(F.col("linked"), 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("size") + smallest) * num / (num + den)) - F.col("inside")))
            own = again.select("c", "cls", "common", "tag", "linked", least.alias("asks"), F.size("outside").alias("all"), F.explode("outside").alias("w"))
            often = own.groupBy("c", "w").agg(F.count("*").alias("n")).filter("n > 1")
            own = own.join(often, ["c", "w"]).groupBy("c", "cls").agg(*(F.first(x).alias(x) for x in ("common", "tag", "linked", "asks", "all")), F.array_sort(F.collect_list(F.struct("n", "w"))).alias("v"))
            own = own.select("c", "cls", "common", "tag", "linked", "asks", F.size("v").alias("n"), F.posexplode("v").alias("at", "x")).withColumn("has", F.col("n") - F.col("at")).filter("has >= asks")
            new.append(own.select(F.expr("xxhash64(c, x.w, 1)").alias("key"), "cls", "common", "tag", (~F.col("linked")).alias("lone"), F.col("has").cast("long"), F.col("asks").cast("long")))
            by_size = [(-F.col("size")).alias("has"), F.when(F.col("linked"), F.lit(-(1 << 40))).otherwise(1 - F.col("beyond")).cast("long").alias("asks")]
            new.append(again.filter(small | waiting).select(F.expr("explode(transform(missing, w -> xxhash64(c, w, 2)))").alias("key"), "cls", "common", "tag", (~F.col("linked")).alias("lone"), *by_size))
        new = written(reduce(DataFrame.union, new), "posts")
        # A centre's linked members are one component, so they need a partner among the others, and so does each of these.
        # Those that a centre has linked (or a sketch finds close) are settled among themselves, so they need a partner among the others.
        several = new.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("lone"), F.col("asks"))).alias("asked"), F.max("has").alias("most"))
        new = new.join(several.filter("n > 1 and asked is not null"), "key").filter("(lone or has >= asked) and asks <= most")
        lists = new.select("key", "cls", "common", "tag", "lone", "has", "asks")
    groups = classes.select("cls", "first_id") if comp is None else classes.select("cls", "first_id").join(comp, "cls", "left")
    return rows.select("id", "text_hash", "n_shingles", "cls"), groups.withColumn("comp", F.coalesce("comp", "cls") if comp is not None else F.col("cls"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, k: int = K, n: int = 5) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; documents are linked where den * intersection >= num * union of their word shingles.

    component_id is the smallest key reachable over links; kept marks rows whose key is that. Null and empty texts have no shingles and are their own
    component, as are texts like no other. Rows with a null key join components by their text; alone, their component is null, and kept is
    true only if it is. Repeated rows all come back. Other columns are ignored. An empty table gives no rows.
    """
    rows, classes = grouped(docs, key, text, num, den, k, n)
    ids = classes.join(classes.groupBy("comp").agg(F.min("first_id").alias("component_id")), "comp").select("cls", "component_id")
    out = rows.join(ids, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest key (rows without a key come last), equal keys by a hash of the text.

    Texts without words (null, empty) are copies of nothing and stay. Rows equal in key and text count once. Columns stay as they are, whatever
    their names but for __id and __hash, which are taken. An empty table stays empty.
    """
    rows, classes = grouped(docs, key, text, num, den)
    known = rows.filter("cls is not null").join(classes.select("cls", "comp"), "cls")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    # The rows that stay are told by what goes: fewer, and often few enough to broadcast.
    first = known.groupBy("comp").agg(F.min(order).alias("r")).select("comp", F.col("r.id").alias("best"), F.col("r.text_hash").alias("best_hash"))
    gone = known.join(first, "comp").filter(~(F.col("id").eqNullSafe(F.col("best")) & (F.col("text_hash") == F.col("best_hash"))))
    gone = written(gone.select("id", "text_hash").distinct(), "gone")
    twice = written(known.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("id", "text_hash"), "twice")
    own = docs.withColumn("__id", F.col(key).cast("long")).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def same(table: DataFrame):
        other = sized(table.select(F.col("id").alias("__other"), F.col("text_hash").alias("__hash_too")))
        return other, (F.col("__hash") == F.col("__hash_too")) & F.col("__id").eqNullSafe(F.col("__other"))

    left = own.join(*same(gone), "left_anti")
    if not twice.isEmpty():
        left = left.join(*same(twice), "left_anti").union(left.join(*same(twice), "left_semi").dropDuplicates(["__id", "__hash"]))
    return left.drop("__id", "__hash")


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The contract's link (85 of 100) over all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), num=85)
