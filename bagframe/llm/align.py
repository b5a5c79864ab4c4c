"""Token alignment of two tokenizers, byte-level BPE (A) and pieces (B), over the same bytes.

A text is tokenised whole by both. Where tokens of both end at the same byte and both go on with a token that is marked by a space, the text is cut
into windows of token ids, a pair of id tuples each. Windows recur all over a corpus, so their alignments are remembered by these tuples: groups
between shared ends, and links between tokens whose bytes overlap. A word between single spaces is a window of its own, so the number of its window is kept with it: it is
not encoded again, nor is its window looked up by ids. Links are counted by id pair in Spark, and every document's links are weighed by these
counts.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import WHITE, Encoder, groups, vocabulary

#: Most rows of the pair counts (24 bytes each) that are broadcast; beyond it the join shuffles.
BROADCAST_PAIRS = 500_000
#: Most words of either tokenizer (about 200 bytes each) and windows (300; twice as many words, 120) that a worker remembers.
WORDS, WINDOWS = 100_000, 250_000


class PlainEncoder(Encoder):
    """Ids in which the literals of added tokens are plain text, with the bytes of each token."""

    def __init__(self, path: str, size: int = WORDS):
        super().__init__(path, size)
        self.tokenizer.encode_special_tokens = True
        self.contents, self.whole = [], False
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        # Byte-level vocabularies write a byte as a visible character: itself, or the next one from 256 on.
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes = [b""] * len(self.lengths)
        for token, i in self.tokenizer.get_vocab().items():
            if all(c in byte_of for c in token):
                self.bytes[i] = bytes(byte_of[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in self.bytes])


class Pieces:
    """Ids by a sentencepiece model that puts a space before the text. Pieces have spaces at their start only, so a text with single spaces between words
    is encoded word by word, and words seen before are not encoded again."""

    def __init__(self, path: str, size: int = WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in self.bytes])
        self.apart = all(" " not in p.replace("▁", " ").lstrip(" ") for p in pieces)
        self.size = size
        #: Ids, or None where their bytes are not those of the word.
        self.known: dict[str, bytes | None] = {}

    def split(self, text: str) -> list[str]:
        return text.split(" ") if self.apart and "  " not in text and text[0] != " " and text[-1] != " " else [text]

    def learn(self, new: list[str]) -> None:
        """Encodes parts, and compares their tokens' bytes: many parts at a time, and one by one only where these differ."""
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            coded = self.model.encode(some, num_threads=1)
            ids = np.fromiter(chain.from_iterable(coded), "<u4")
            wanted = [b" " + part.encode() for part in some]
            ends = np.cumsum([len(x) for x in coded])
            reached = np.cumsum(self.sizes[ids])[ends - 1] if len(ids) and ends[0] and np.diff(ends).all() else np.zeros(len(some))
            same = b"".join(map(self.bytes.__getitem__, ids.tolist())) == b"".join(wanted) and (reached == np.cumsum([len(x) for x in wanted])).all()
            blob, first = ids.tobytes(), 0
            for part, want, end in zip(some, wanted, (4 * ends).tolist()):
                right = same or b"".join([self.bytes[i] for i in ids[first // 4 : end // 4]]) == want
                self.known[part] = blob[first:end] if right else None
                first = end

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text as bytes; None where their tokens' bytes are not a space and the text."""
        if len(self.known) > self.size:
            self.known = {}
        split = [self.split(t) for t in texts]
        new: set[str] = set()
        for x in split:
            new.update(x)
        new.difference_update(self.known)
        self.learn(list(new))
        found = [[self.known[p] for p in x] for x in split]
        return [None if None in x else b"".join(x) for x in found]


@lru_cache(maxsize=2)
def encoders(name_a: str, name_b: str) -> tuple[PlainEncoder, Pieces]:
    return PlainEncoder(vocabulary(name_a)), Pieces(vocabulary(name_b))


class Memory:
    """Alignments of windows by their id tuples: numbers of groups, the groups as text, and links as numbers of id pairs (of window w: those at
    links[at[w] : at[w + 1]])."""

    def __init__(self, a: PlainEncoder, b: Pieces):
        self.a, self.b = a, b
        self.names = [str(i) for i in range(max(len(a.bytes), len(b.bytes)))]
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.links = (np.zeros(0, np.int64) for _ in range(4))
        self.at = np.zeros(1, np.int64)
        #: The window of each word that was met between single spaces.
        self.words: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        #: Id pairs by number: A's id in the upper half, B's in the lower.
        self.pairs = np.zeros(0, np.int64)

    def learn(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Aligns new windows, one after another in both arrays of ids; n_a, n_b: tokens of each.

        Every byte where a token of either ends closes a link, of the tokens that hold it; where tokens of both end it closes a group, too.
        """
        end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        window_end = end_a[np.cumsum(n_a) - 1]
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        either = np.union1d(end_a, end_b)
        pairs, which = np.unique((ids_a[np.searchsorted(end_a, either)] << 32) | ids_b[np.searchsorted(end_b, either)], return_inverse=True)
        numbers = [self.pair_number.setdefault(p, len(self.pair_number)) for p in pairs.tolist()]
        fresh = np.array(numbers) >= len(self.pairs)
        self.pairs = np.concatenate([self.pairs, pairs[fresh]])
        self.links = np.concatenate([self.links, np.array(numbers, np.int64)[which]])
        self.at = np.concatenate([self.at, self.at[-1] + np.searchsorted(either, window_end, "right")])
        both = np.intersect1d(end_a, end_b)
        last = np.searchsorted(both, window_end, "right")
        self.n_groups = np.concatenate([self.n_groups, np.diff(last, prepend=0)])
        to_a, to_b = (np.searchsorted(end_a, both) + 1).tolist(), (np.searchsorted(end_b, both) + 1).tolist()
        name = self.names.__getitem__
        of_a, of_b = list(map(name, ids_a.tolist())), list(map(name, ids_b.tolist()))
        parts, x, y = [], 0, 0
        for p, q in zip(to_a, to_b):
            parts.append(f"{of_a[x]}|{of_b[y]}" if p == x + 1 and q == y + 1 else f"{','.join(of_a[x:p])}|{','.join(of_b[y:q])}")
            x, y = p, q
        first = 0
        for end in last.tolist():
            self.text.append(";".join(parts[first:end]))
            first = end

    def linked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of windows, one after another, and how many each has."""
        first, n = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        return self.links[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


_remembered: dict[tuple[str, str], Memory] = {}
_MARK = b"\xff\xff\xff\xff"


def windows(ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray, a, b) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B stand before each window's end. ends: byte ends of documents, where windows end too."""
    end_a, end_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    at_b = np.searchsorted(end_b, end_a)
    i = np.flatnonzero(end_b[np.minimum(at_b, len(end_b) - 1)] == end_a)
    j = at_b[i]
    last = np.isin(end_a[i], ends)
    anchor = last.copy()
    inner = np.flatnonzero(~last)
    anchor[inner] = a.spaced[ids_a[i[inner] + 1]] & b.spaced[ids_b[j[inner] + 1]]
    return i[anchor] + 1, j[anchor] + 1


def window_numbers(memory: Memory, all_a: bytes, all_b: bytes, n_bytes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the windows of texts, whose ids come one after another, and how many tokens of A stand before each window's end. New ones are aligned."""
    of_a, of_b = np.frombuffer(all_a, "<u4").astype(np.int64), np.frombuffer(all_b, "<u4").astype(np.int64)
    to_a, to_b = windows(of_a, of_b, np.cumsum(n_bytes), memory.a, memory.b)
    numbers, known, new, x0, y0 = [], memory.number, [], 0, 0
    for x, y in zip((4 * to_a).tolist(), (4 * to_b).tolist()):
        key = all_a[x0:x] + _MARK + all_b[y0:y]
        n = known.setdefault(key, len(known))
        if n == len(memory.text) + len(new):
            new.append((x0, x, y0, y))
        numbers.append(n)
        x0, y0 = x, y
    if new:
        new_a, new_b = b"".join([all_a[x0:x] for x0, x, _, _ in new]), b"".join([all_b[y0:y] for _, _, y0, y in new])
        memory.learn(np.frombuffer(new_a, "<u4").astype(np.int64), np.frombuffer(new_b, "<u4").astype(np.int64), np.array([(x - x0) // 4 for x0, x, _, _ in new]), np.array([(y - y0) // 4 for _, _, y0, y in new]))
    return np.array(numbers, np.int64), to_a


#: A space before other white space: there a text is not split into words.
_gap = re.compile(f" [{WHITE}]")


def single_words(text: str, b: Pieces) -> list[str] | None:
    """The words of a text in which single spaces stand between words without white space at their start; None of another text.

    Both tokenizers split such a text before each space, whatever stands around it, so a word's tokens are those it has in every text, and one window.
    """
    return None if not b.apart or text[0] == " " or text[-1] == " " or _gap.search(f" {text}") else text.split(" ")


#: Words that are tokenised as one text.
TOGETHER = 1000


def learn_words(memory: Memory, words: list[str]) -> None:
    """Tokenises words and keeps the number of each one's window; -1 where the tokens' bytes are not the word's.

    Many words are tokenised as one text with single spaces, which gives the same tokens; only where its bytes are not all there, one by one.
    """
    a, b, good, ids_a, ids_b = memory.a, memory.b, [], [], []
    for at in range(0, len(words), TOGETHER):
        some = words[at : at + TOGETHER]
        joined = " ".join(some)
        coded = a.tokenizer.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, b.model.encode(joined, num_threads=1)
        if all(b"".join(map(x.bytes.__getitem__, ids)) == b" " + joined.encode() for x, ids in zip((a, b), coded)):
            good += some
            ids_a.append(np.array(coded[0], "<u4").tobytes())
            ids_b.append(np.array(coded[1], "<u4").tobytes())
            continue
        alone = b.encode(some)
        memory.words.update((w, -1) for w, x in zip(some, alone) if x is None)
        right = [(w, x) for w, x in zip(some, alone) if x is not None]
        good += [w for w, _ in right]
        ids_a += a.encode([" " + w for w, _ in right])
        ids_b += [x for _, x in right]
    if good:
        numbers, _ = window_numbers(memory, b"".join(ids_a), b"".join(ids_b), [len(w.encode()) + 1 for w in good])
        if len(numbers) != len(good):
            raise ValueError("a word has several windows")
        memory.words.update(zip(good, numbers.tolist()))


def _aligned_texts(names: tuple[str, str]):
    def align(texts: list[str]):
        """For each text: numbers of A's and B's tokens, groups and links, the groups' SHA-256, id pairs and how often the text has them linked."""
        a, b = encoders(*names)
        memory = _remembered.get(names)
        if memory is None or len(memory.number) > WINDOWS or len(memory.words) > 2 * WINDOWS:
            memory = _remembered[names] = Memory(a, b)
        split = [single_words(t, b) if t else [] for t in texts]
        new: set[str] = set()
        for x in split:
            new.update(x or ())
        new.difference_update(memory.words)
        learn_words(memory, list(new))
        number = memory.words.__getitem__
        parts = [np.array(list(map(number, x)), np.int64) if x else None for x in split]
        whole = [k for k, x in enumerate(split) if x is None]
        if whole:
            ids_b = b.encode([texts[k] for k in whole])
            whole = [(k, x) for k, x in zip(whole, ids_b) if x is not None]
            ids_a = a.encode([" " + texts[k] for k, _ in whole])
            if whole:
                found, to_a = window_numbers(memory, b"".join(ids_a), b"".join([x for _, x in whole]), [len(texts[k].encode()) + 1 for k, _ in whole])
                cut = np.searchsorted(to_a, np.cumsum([len(x) // 4 for x in ids_a])) + 1
                for (k, _), own in zip(whole, np.split(found, cut[:-1])):
                    parts[k] = own
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        used = [k for k, x in enumerate(parts) if x is not None and (x >= 0).all()]
        if not used:
            return out
        numbers = np.concatenate([parts[k] for k in used])
        text = list(map(memory.text.__getitem__, numbers.tolist()))
        cut = np.cumsum([len(parts[k]) for k in used])
        first = np.concatenate([[0], cut[:-1]])
        links, n = memory.linked(numbers)
        n_a, n_b, n_groups, n_links = (np.add.reduceat(x, first) for x in (memory.n_a[numbers], memory.n_b[numbers], memory.n_groups[numbers], n))
        # Each text's id pairs: numbers below 2**40 behind the text's place.
        found, times = np.unique((np.repeat(np.arange(len(used)), n_links) << 40) | links, return_counts=True)
        pair_cut = np.searchsorted(found, np.arange(1, len(used) + 1) << 40)
        pairs = memory.pairs[found & ((1 << 40) - 1)]
        p = q = 0
        for k, to, to_pair, *counted in zip(used, cut.tolist(), pair_cut.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist()):
            digest = hashlib.sha256(";".join(text[p:to]).encode()).hexdigest()
            out[k] = (*counted, digest, pairs[q:to_pair], times[q:to_pair])
            p, q = to, to_pair
        return out

    return align


KINDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]


def _list(values, kind) -> pa.ListArray:
    offs = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind)))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("byte_bpe_50k.json", "piece_bpe_32k.model")) -> DataFrame:
    """A written table: row (a number), id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A's id * 2**32 + B's id) and times of each row of docs."""
    align = _aligned_texts(names)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                found = list(zip(*align(texts[a:b])))
                own = batch.column(0).slice(a, b - a)
                arrays = [pa.array(x, t) for x, (_, t) in zip(found, KINDS)]
                yield pa.RecordBatch.from_arrays([own, *arrays, _list(found[5], np.int64), _list(found[6], np.int64)], names=[id_col, *(n for n, _ in KINDS), "pairs", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "alignments")


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each id pair, and whether no other pair of its B id has more."""
    links = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return written(counts.withColumn("best", F.col("count") == F.max("count").over(of_b)), "pair-counts")


def with_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    Null and empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens: zeros, and '' for the groups. Repeated rows and
    null ids stay, and their links count each; other columns are ignored; an empty table gives no rows. A third of all rows may be copies of
    one text: a pair stands once in a row's list, and lists are counted before they are shuffled.
    """
    table = alignments(docs, id_col, text_col)
    counts = pair_counts(table)
    if counts.count() <= broadcast:
        counts = F.broadcast(counts)
    links = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = table.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return with_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
