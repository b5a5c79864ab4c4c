"""Lexical search, token alignment and language identification against plain Python on small tables of hard rows."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bagframe.llm import align, bloomrank, langid

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def search_rows():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=draw.choice([1, 5, 40, 200])))) for i in range(400)]
    rows += [(1000 + i, "Copy of W1 w2 w299 ÄÖ") for i in range(60)]  # one text, many rows
    rows += [(2000, None), (2001, ""), (2002, "... !!"), (None, "w5 w250 no id"), (None, "w5 w250 no id"), (2003, "w7 " * 30_000 + "w298"), (3, "w9 w9 w9"), (3, "w9 w9 w9")]
    return rows


ITEMS = [(0, "W1 w2 w299"), (1, "w250 w5 w5 w5"), (2, "äö ÄÖ copy"), (3, None), (4, "..."), (5, "nowhere at all"), (6, "w9"), (7, " ".join(f"w{i}" for i in range(0, 300, 3))), (7, "w7 w298"), (None, "w0")]


def brute_search(docs, items, most):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, len(t), Counter(t)) for i, t in texts if t]
    n_docs, total = len(texts), sum(n for _, n, _ in texts)
    df = Counter(w for _, _, c in texts for w in c)
    out = []
    for item, text in items:
        terms = TERM.findall((text or "").translate(LOWER))
        scores = []
        for i, n, tf in texts:
            m = 25 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms if w in tf)
            scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: x[:3])[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most,portion", [(10, 200_000), (3, 250)])
def test_search(spark, most, portion):
    rows = search_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, uid string, score int").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, k int")
    got = bloomrank.ranked(docs, items, most, portion_terms=portion)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, ITEMS, most)


def test_search_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bloomrank.ranked(docs.filter("false"), items).count() == 0
    assert bloomrank.ranked(docs, items.filter("false")).count() == 0
    assert bloomrank.ranked(docs.withColumn("text", bloomrank.F.lit("..")), items).count() == 0
    assert [tuple(r) for r in bloomrank.ranked(docs, items).collect()] == brute_search([(1, "a b")], [(1, "a")], 10)


def test_signatures_bound(spark):
    """No bound is below the exact score, and few documents without any term of an item get one."""
    rows = search_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = bloomrank.index(docs)
    texts = [TERM.findall((t or "").translate(LOWER)) for _, t in rows]
    full = [t for t in texts if t]
    found = bloomrank.term_hashes([t or "" for _, t in ITEMS])
    hashes = {t: h for terms, hs in found for t, h in zip(terms, hs)}
    df = Counter(hashes[w] for t in full for w in set(t) if w in hashes)
    portion = bloomrank.Portion([t for t, _ in found], hashes, dict(df), len(full), sum(map(len, full)))
    by_uid = {hashlib.sha256((t or "").encode()).digest(): TERM.findall((t or "").translate(LOWER)) for _, t in rows}
    false = seen = 0
    for r in table.collect():
        bounds = dict(portion.bounds(r["bits"], np.array(r["sizes"]), r["slices"]))
        for j, uid in enumerate(r["uids"]):
            tf = Counter(by_uid[bytes(uid)])
            for k in range(len(ITEMS)):
                exact, bound = portion.score(k, r["sizes"][j], tf), int(bounds[k][j]) if k in bounds else 0
                assert bound >= exact
                seen += exact == 0
                false += bound > 0 and exact == 0
    assert false < 0.05 * seen


ALIGN_ROWS = [
    (0, "Hello world, this is a plain text."), (1, "Hello world, this is a plain text."), (1, "Hello world, this is a plain text."), (None, "no id"), (2, None), (3, ""), (4, " "), (5, "a  b"), (6, " lead and trail "),
    (7, "<|endoftext|> and <s> </s> <0x41>"), (8, "x▁y is not a space"), (9, "naïve café ñandú 日本語 🙂🙂"), (10, "line\none\r\n\ttwo three　four"), (11, "\x00\x01 control"), (12, "word" * 4000), (13, "a b c " * 3000 + "d"), (14, "don't won't I'll"), (15, "1234567 89.01"),
]


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    docs, counts = [], Counter()
    for _, text in rows:
        docs.append(None)
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        parts = [([], []) for _ in cuts]
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            for i, end in zip(ids, ends):
                parts[bisect.bisect_left(cuts, end)][side].append(str(i))
        at, links = 0, []
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        links = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(links)
        digest = hashlib.sha256(";".join(",".join(x) + "|" + ",".join(y) for x, y in parts).encode()).hexdigest()
        docs[-1] = (len(ids_a), len(ids_b), len(cuts), links, digest)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), d in zip(rows, docs):
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, *d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [align.BROADCAST_PAIRS, 0])
def test_alignment(spark, broadcast):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ALIGN_ROWS], "doc_id long, text string, row int, pairs string").repartition(3)
    got = align.with_links(docs, broadcast=broadcast)
    want = brute_alignment(ALIGN_ROWS)
    assert sum(w[-1] == "" for w in want) >= 3 and sum(w[-1] != "" for w in want) >= 10
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert align.with_links(docs.filter("false")).count() == 0


def test_windows_are_remembered(spark):
    """A window that comes again gets its number from memory, and windows end only where both tokenizers go on with a space."""
    a, b = align.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    memory = align.Memory(a, b)
    run = align._aligned_texts(("byte_bpe_50k.json", "piece_bpe_32k.model"))
    align._remembered.clear()
    run(["one two one two"])
    memory = align._remembered["byte_bpe_50k.json", "piece_bpe_32k.model"]
    known = len(memory.number)
    run(["two one two one"])
    assert known == len(memory.number) == 2


LETTERS = {"aa": "abcde", "ab": "abcdf", "ba": "uvwxy", "bb": "uvwxz"}


def language_rows(n, seed):
    draw = random.Random(seed)
    return [(i, " ".join("".join(draw.choices(LETTERS[lang], k=draw.randint(2, 7))) for _ in range(draw.choice([3, 20, 80]))), lang) for i in range(n) for lang in [sorted(LETTERS)[i % 4]]]


def test_language(spark):
    rows = language_rows(400, 1)
    extra = [(9000, None, "aa"), (9001, "", "aa"), (9002, "123 ... 456", "ab"), (9003, "abcde abcd", None), (None, "abcde", "aa"), (9004, "abcde " * 40_000, "aa"), (9004, "abcde " * 40_000, "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = langid.fit(docs)
    assert model["langs"] == sorted(LETTERS) and model["families"] == [[0, 1], [2, 3]]
    test = spark.createDataFrame([(*r, 0.0) for r in language_rows(200, 2)], "doc_id long, text string, lang string, score double")
    got = langid.identified(test, model).collect()
    assert len(got) == 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 190
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.identified(docs.filter("doc_id is null or doc_id >= 9000"), model).collect()
    assert len(odd) == len(extra) and {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (9000, 9001, 9002)} == {9000: "und", 9001: "und", 9002: "und"}
    assert all(r["lang_pred"] == "aa" for r in odd if r["doc_id"] == 9004)
    assert langid.identified(docs.filter("false"), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [tuple(r) for r in langid.identified(docs, model).collect()] == [(1, "some text", None, "und", 0.0)]
    one = spark.createDataFrame([(1, "some text", "xx"), (2, "Привет", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identified(one, langid.fit(one)).collect()} == {"xx"}


def test_language_score_by_plain_sums(spark):
    """The family of a text by plain sums over its n-grams equals the blocks' result."""
    docs = spark.createDataFrame(language_rows(120, 3), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    import pyarrow as pa

    texts = [r["text"] for r in docs.collect()] + ["", "ab", "x"]
    names, scores = langid.predicted(pa.array(texts), model)
    for text, name in list(zip(texts, names))[:120:7]:
        found = [x for x in langid.numbered(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))]
        grams = np.concatenate(found)
        grams = grams[grams != langid.NONE]
        family = int(model["table"][grams].astype(float).mean(axis=0).argmax())
        assert model["langs"].index(name) in model["families"][family]
