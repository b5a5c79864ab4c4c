"""The ten operators on a small fixture of hard rows, against brute force or exact round trips."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagframe.llm import decontam, jpeg, licenses, neardup, packing, pfor, pii, secrets, store, suffix, tokens, toxicity

LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(900))
ITEM = " ".join(f"item{i}" for i in range(30))
SECRET = 'Password = "abcdefgh12" token=short AKIA0123456789ABCD ' + "0123456789abcdef" * 3 + " password=token: abcdefgh12"
ROWS = [
    (0, LONG), (1, LONG), (2, LONG.replace("w7919", "x")), (3, None), (4, ""), (5, "one two"), (6, "ab" * 500), (None, "no id at all"), (7, "é" * 700),
    (8, "before it " + ITEM + " after it"), (9, LONG[200:1500] + " tail"), (10, SECRET), (10, SECRET), (11, "Under the MIT License.\nSPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause\nmore"),
    (12, "mail a.b@mail.example.com, 4111 1111 1111 1111, 97.51.17.173 and 2020-02-29, 123-45-6789, +1 (017) 555-7713, 300.1.1.1, 2021-02-30"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns whose names the operators use themselves come along."""
    rows = [(i, t, "x", 1.0, None) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, uid string, score double, items string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_toxicity(spark, docs, none):
    bad = [np.array([1, 2 + i % 50], np.uint32) for i in range(200)]
    good = [np.array([60 + i % 50], np.uint32) for i in range(200)]
    found, weights, bias = toxicity.ftrl([x for p in zip(bad, good) for x in p], np.array([1, 0] * 200, float))
    assert 1 in found and weights[list(found).index(1)] > 0
    out = toxicity.scored(docs, (found, weights, bias)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(none, (found, weights, bias)).count() == 0
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels)) == 3
    empty = toxicity.fit(none, labels)
    assert {(r["score"] < 0.3, r["predicted"]) for r in toxicity.scored(docs, empty).collect()} == {(True, 0)}


def test_toxicity_learner_memory():
    """The driver holds the learner's two arrays, and else what the rows have, not several arrays of all 2**20 numbers."""
    rows = [np.array([1, 2 + i % 50], np.uint32) for i in range(200)]
    tracemalloc.start()
    toxicity.ftrl(rows, np.arange(200) % 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * 2**toxicity.BITS


def test_toxicity_stage_batches(spark, docs, tmp_path, monkeypatch):
    """The pipeline's stage learns and scores with small batches; the setting is as before afterwards."""
    import corpus_pipeline

    fit, written, before, seen = toxicity.fit, store.written, spark.conf.get(store.BATCH), []
    note = lambda f: lambda *a: seen.append(spark.conf.get(store.BATCH)) or f(*a)
    monkeypatch.setattr(toxicity, "fit", note(fit))
    monkeypatch.setattr(corpus_pipeline, "written", note(written))
    frame = docs.selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "length(text) as n_chars")
    spark.createDataFrame([(10**9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, frame, str(tmp_path)).count() == len(ROWS)
    assert seen == [str(store.BATCH_BYTES)] * 2 and spark.conf.get(store.BATCH) == before


def test_toxicity_inflected(spark):
    """A stem whose endings are new each time is learned; clean texts with other stems of the same shape stay clean."""
    draw = random.Random(5)
    word = lambda stem: stem + "".join(draw.choices("bcdfgh", k=6))
    rows = []
    for i in range(600):
        stems = ["bomente"] * 3 * (i % 3 == 0) + draw.choices(["parlo", "correr", "lentos", "verdad"], k=8)
        draw.shuffle(stems)
        rows.append((i, " ".join(map(word, stems)), int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.filter("doc_id < 400").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(frame.filter("doc_id >= 400"), model).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 400) >= 190


def test_toxicity_without_labels(spark, docs, tmp_path):
    """Nothing to learn from: no document is dropped."""
    import corpus_pipeline

    frame = docs.selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "length(text) as n_chars")
    for i, labels in enumerate(([], [(0, None), (5, None)], [(10**9, 1)])):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, frame, f"{tmp_path}/{i}").count() == len(ROWS)


def test_media(docs, none):
    out = jpeg.media_features(jpeg.media_table(docs)).collect()
    assert len(out) == len(ROWS)
    want = Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert jpeg.media_features(jpeg.media_table(none)).count() == 0
    raw = random.Random(1).randbytes(600_000)  # needs a wider image
    (head, grey), = jpeg.decode(jpeg.encode([raw]))
    assert jpeg.SWAP[grey].ravel()[: head["payload"]].tobytes().rstrip(b"\0") == raw.rstrip(b"\0")


def test_media_of_others():
    """A baseline image with AC codes, no restart intervals and other tables; and a text in several images."""
    dc, ac = ([0, 2, 2] + [0] * 13, [0, 3, 5, 6]), ([0, 1, 2, 1] + [0] * 12, [0x00, 0x03, 0x21, 0xF0])
    dc_codes, ac_codes = jpeg.codes(*dc), jpeg.codes(*ac)
    draw, bits, want, before = random.Random(3), "", [], 0
    for _ in range(12):
        diff = draw.choice([0, 5, -7, 20, -25, 40, -33])
        n = abs(diff).bit_length()
        parts = [(dc_codes[n], diff if diff > 0 else diff + (1 << n) - 1, n)]
        parts += [(ac_codes[s], 0, s & 15) for s in draw.choices([0x03, 0x21, 0xF0], k=draw.randint(0, 3))] + [(ac_codes[0], 0, 0)]
        for (code, size), extra, m in parts:
            bits += f"{code:0{size}b}" + (f"{extra:0{m}b}" if m else "")
        before += diff
        want.append(min(255, max(0, before * 16 // 8 + 128)))
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    tables = bytes([0x00, *dc[0], *dc[1]]) + bytes([0x11, *ac[0], *ac[1]])
    image = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0] + [16] * 64)) + jpeg.segment(0xC0, bytes([8, 0, 24, 0, 30, 1, 1, 0x11, 0]))
    image += jpeg.segment(0xC4, tables) + jpeg.segment(0xDA, bytes([1, 1, 0x01, 0, 63, 0])) + scan + b"\xff\xd9"
    (head, grey), = jpeg.decode([image])
    assert (head["width"], head["height"]) == (30, 24) and grey.tolist() == np.array(want).reshape(3, 4).tolist()


def test_media_in_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST", 640)
    text = LONG.encode()[:2000]
    media, = jpeg.encode([text])
    images = jpeg.images_of(media)
    assert len(images) == 4 and b"".join(jpeg.SWAP[g].ravel()[: h["n_bytes"]].tobytes() for h, g in jpeg.decode(images)) == text


def test_licenses(docs, none):
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == (["gpl", "mit"], 1.0)
    assert licenses.evaluate("MIT AND (GPL-3.0-or-later OR AGPL-3.0)") == (["mit", "gpl", "agpl"], 0.4)
    assert licenses.evaluate("") is None and licenses.evaluate("(((") is None
    rows = [r for r in licenses.licensed(docs).collect() if r["doc_id"] == 11]
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["base_labels"], rows[0]["labels"]) == (1, 0, "mit", "bsd,gpl,mit")
    assert licenses.licensed(docs).count() == len(ROWS) and licenses.licensed(none).count() == 0


def luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_pseudonyms_parse_little(spark, docs, monkeypatch):
    """The parser keeps in the driver what it learns from long expressions (30 MB of one of 11,576 characters), so it gets none."""
    parsed, expr = [""], pii.F.expr
    monkeypatch.setattr(pii.F, "expr", lambda text: parsed.append(text) or expr(text))
    assert "n_private" in pii.pseudonymised(docs).columns and max(map(len, parsed)) < 500


def test_pii(spark, docs, none):
    out = {r["doc_id"]: r for r in pii.pseudonymised(docs).collect()}
    text = out[12]["text"]
    assert out[12]["n_private"] == 8 and out[3]["text"] is None and out[0]["text"] == LONG
    assert not any(x in text for x in ("a.b@", "4111 1111", "97.51.17", "2020-02-29", "123-45", "555-7713")) and "300.1.1.1" in text and "2021-02-30" in text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text)[0].replace(" ", "")
    assert luhn(card) == 0
    assert pii.pseudonymised(none).count() == 0
    dates = spark.range(0, 73000).selectExpr("id as doc_id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    assert pii.pseudonymised(dates).select("text").distinct().count() == 73000  # a permutation


def test_pii_invalid_numbers(spark):
    """Numbers that fail Luhn stay; a valid card, or a date, next to other numbers is still replaced."""
    stay = ["4111 1111 1111 1112", "1700000000123", "12 7 33 4 5 18 22 9 16 3", "x 4111-1111-1111-1113 y", "1" * 25]
    assert all(luhn(re.sub(r"\D", "", t)) for t in stay)
    swap = ["4111 1111 1111 1111", "4111 1111 1111 1111 123", "12 4111111111111111", "12 2021-02-28 17 5559"]
    rows = list(enumerate(stay + swap))
    out = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[: len(stay)] == stay
    card, both, tail, day = out[len(stay) :]
    assert card != swap[0] and luhn(card.replace(" ", "")) == 0
    assert both == card + " 123" and re.fullmatch(r"12 \d{16}", tail) and tail[3:] == card.replace(" ", "")
    assert re.fullmatch(r"12 \d{4}-\d{2}-\d{2} 17 5559", day) and "2021-02-28" not in day


def test_token_files(docs, none):
    files = pfor.token_files(docs)
    rows = sorted(pfor.token_rows(files).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ROWS) and rows[0]["id"] is None
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert pfor.token_rows(pfor.token_files(none)).count() == 0
    ids = np.random.default_rng(1).integers(0, 50257, 1000).astype(np.uint32)
    ids[::97] = 2**32 - 1
    keys, counts, back = pfor.unpack_file(pfor.pack_file([1, None], np.array([400, 600]), ids))
    assert keys == [1, None] and counts.tolist() == [400, 600] and (back == ids).all()


def test_token_ids_of_literals(spark):
    """Ids are those of one plain encode() of the whole text, also where it holds the literal of an added token; in op5's files and op9's counts too."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary()
    plain = Tokenizer.from_file(path)
    e = "<|endoftext|>"
    texts = [f"a {e} b", e, f"{e}{e} x", f"a\u00a0\u2003{e}\n\n  b \t{e} ", f"x{e}y  {e[:-1]} > <|endo text|>", f"\0 {e}\r\n\x1f é\u3000", f"  {e}  ", "plain  text\n\n", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(path).encode(texts)] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pfor.token_rows(pfor.token_files(frame)).collect()
    assert {r["id"]: r["n_tokens"] for r in rows} == {i: len(x) + 1 for i, x in enumerate(want)}  # and the end id
    assert {r["id"]: r["ids_crc32"] for r in rows} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in enumerate(want)}
    pieces = packing.packed(frame, size=256).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces if r["start"] == 0} == {i: len(x) + 1 for i, x in enumerate(want)}


def test_token_ids_of_odd_texts():
    """Parts joined are the ids of the whole text, whatever white space, marks and literals meet."""
    from tokenizers import Tokenizer

    path, draw = tokens.vocabulary(), random.Random(2)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    marks = [" ", "\n", "\t", "\r", "  ", "\x85", "\xa0", "\u3000", "\x1c", "\0", "a", "B", "\u00e9", "1", "23", "'s", "'t", ".", "!?", "<|endoftext|>", "<|", "\u5b57", "\u200b", "\u0301", "-"]
    texts = ["".join(draw.choices(marks, k=draw.randint(0, 40))) for _ in range(3000)] + [" ".join(LONG.split() * 40)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_words_are_learned_apart_from_marks():
    """A word seen with other marks is not encoded again (F3), and ids stay those of whole texts."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary()
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    sent = []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    own.tokenizer = Spy()
    texts = ["A rivoluzzj, the \u00e9tafon. sstrange\n", "A rivoluzzj. the \u00e9tafon, sstrange,\n", "A rivoluzzj?! the\u0301, \u00e9tafon's 'quoted' can't. x1, \u5b57, don'' a'b'"]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    for at in range(3):
        sent.clear()
        assert np.frombuffer(own.encode(texts[at : at + 1])[0], "<u4").tolist() == want[at]
        assert at != 1 or not any("rivol" in x or "tafon" in x for x in sent)


def test_remembered_parts_stay_bounded():
    """Parts in use outlive others (F2): a worker holds `size` of them and those of the latest texts, and does not learn frequent ones again."""
    own, whole = tokens.Encoder(tokens.vocabulary(), 200), tokens.Encoder(tokens.vocabulary())
    learned, learn = [], own.learn
    own.learn = lambda new: (learned.extend(new), learn(new))
    texts = [" often " + " ".join(f"w{n}x" for n in range(10 * k, 10 * k + 10)) for k in range(100)]
    for t in texts:
        assert own.encode([t]) == whole.encode([t])
        assert len(own.known) + len(own.before) <= 200 + 2 * 13
    assert learned.count(" often") == 1 and len(whole.known) > 1000


def test_batches_of_texts_are_bounded(spark):
    """Arrow sends long texts a few MB at a time (F2), also in a job whose default batch would hold all of them; the setting is put back."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('ab ', 17000) as text")
    before = spark.conf.get(store.BATCH)
    with store.small_batches(spark):
        got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) < store.BATCH_BYTES + 200_000
    assert spark.conf.get(store.BATCH) == before


def test_secrets(docs, none):
    assert frozenset({"aki"}) in secrets.trigram_query("AKIA[A-Z0-9]+") and not secrets.trigram_query("[0-9a-f]+")
    rules = {k: (re.compile(x, re.A), g, n) for k, x, g, n in secrets.RULES}
    want = Counter()
    for i, t in ROWS:
        spans = [(m.start(), m.end(), k) for k, (x, g, n) in rules.items() for m in x.finditer(t or "") if len(m[g]) >= n]
        want[i, tuple(sorted(spans))] += 1
    out = secrets.secrets(docs).collect()
    assert Counter((r["doc_id"], tuple(sorted((s["start"], s["end"], s["kind"]) for s in r["found"]))) for r in out) == want
    assert secrets.secrets(none).count() == 0


@pytest.mark.parametrize("hot", [2_000, 0])
def test_repeats(docs, none, hot):
    seen, want = Counter(), Counter()
    for _, t in ROWS:
        raw = (t or "").encode()
        seen.update(raw[j : j + 400] for j in range(len(raw) - 399))
    for i, t in ROWS:
        raw, gone = (t or "").encode(), set()
        for j in range(len(raw) - 399):
            if seen[raw[j : j + 400]] > 1:
                gone.update(range(j, j + 400))
        want[i, len(raw), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest()] += 1
    out = suffix.without_repeats(docs, hot=hot).drop("kept").collect()
    assert Counter(map(tuple, out)) == want
    assert suffix.without_repeats(none).count() == 0


@pytest.mark.parametrize("most", [0, 2, 1024])
def test_suffix_array(monkeypatch, most):
    """Suffixes in order and whole common prefixes, bucket by bucket and place by place; repeats do not depend on hashes."""
    monkeypatch.setattr(suffix, "MOST_BUCKETS", most)
    monkeypatch.setattr(suffix, "COMPARED", 64)
    monkeypatch.setattr(suffix, "substring_hash", lambda pre, a, b: np.zeros(len(a), np.uint64))
    draw = random.Random(2)
    for _ in range(150):
        s = np.array([draw.randint(1, draw.randint(1, 3)) for _ in range(draw.randint(1, 60))] + [0])
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix.shard_array(s, 4, 1)
        assert sa.tolist() == want
        before, common = suffix.permuted_lcp(s, sa)
        assert before[want[0]] == -1 and common[want[0]] == 0
        for i, j in zip(want[1:], want):
            assert before[i] == j and common[i] == next(k for k in range(len(s)) if s[i + k] != s[j + k])
    for _ in range(50):
        segments = [bytes(draw.choices(b"abc", k=draw.randint(4, 30))) for _ in range(draw.randint(1, 6))]
        seen = Counter(x[i : i + 4] for x in segments for i in range(len(x) - 3))
        assert [x.tolist() for x in suffix.repeated_starts(segments, 4)] == [[i for i in range(len(x) - 3) if seen[x[i : i + 4]] > 1] for x in segments]


@pytest.mark.parametrize("hashes", [1, 2, 5])
def test_repeats_when_hashes_collide(monkeypatch, hashes):
    """Strings of 200 bytes with few different hashes share keys; what is no repeat byte by byte stays none."""
    real = suffix.substring_hash
    monkeypatch.setattr(suffix, "substring_hash", lambda pre, a, b: real(pre, a, b) % np.uint64(hashes))
    draw = random.Random(hashes)
    text = ["".join(draw.choices("ab ", k=draw.randint(300, 1500))) for _ in range(4)]
    text += [text[0][5:420] + "x" + text[1][:390], "y" + text[2], "ab" * 500]
    seen = Counter(t[i : i + 400] for t in text for i in range(len(t) - 399))
    want = {(k, i) for k, t in enumerate(text) for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1}
    (marks,) = suffix._marks([pa.RecordBatch.from_pydict({"uid": [bytes([k]) for k in range(len(text))], "text": text})])
    places = [[dict(start=a, n=n, key=k, often=o) for a, n, k, o in zip(*(r[c] for c in ("starts", "sizes", "keys", "often")))] for r in marks.to_pylist()]
    (batch,) = [pa.RecordBatch.from_pydict({"uid": [bytes([k]) for k in range(len(text))], "text": text, "places": pa.array(places)})]
    rows = [r for b in suffix._segments([batch]) for r in b.to_pylist()]
    times, merged = Counter((r["key"], r["seg"]) for r in rows), {(r["key"], r["seg"]): r["bytes"] for r in rows}
    order = sorted(merged)
    shards = pa.RecordBatch.from_pydict({"key": [k for k, _ in order], "seg": [x for _, x in order], "bytes": [merged[x] for x in order]})
    told = {r["seg"]: list(zip(r["firsts"], r["lasts"])) for b in suffix._shards([shards]) for r in b.to_pylist()}
    got = set()
    for r in rows:
        for a, b in [(0, r["n"])] if times[r["key"], r["seg"]] > 1 else told.get(r["seg"], []):
            got.update((r["uid"][0], r["start"] + i) for i in range(a, b))
    assert got == want


def test_near_duplicates(docs, none):
    sets = [set() for _ in ROWS]
    for s, (_, t) in zip(sets, ROWS):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        s.update([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
    comp = [i if i is not None else 99 for i, _ in ROWS]
    for _ in ROWS:
        for a in range(len(ROWS)):
            for b in range(len(ROWS)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = Counter((i, len(s), c if c != 99 else None) for (i, _), s, c in zip(ROWS, sets, comp))
    out = neardup.near_components(docs, num=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert neardup.near_components(none).count() == 0


def shingles(text: str) -> set:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


@pytest.mark.parametrize("num", [80, 85])
def test_near_duplicates_in_a_large_group(spark, num):
    """Hundreds of edited copies of one text, copies of these, a passage common to other texts and short lists: the components are those of all pairs."""
    draw = random.Random(num)
    vocabulary = [f"v{i}" for i in range(400)]
    base, passage = draw.choices(vocabulary, k=140), draw.choices(vocabulary, k=60)
    texts = [base]
    for _ in range(170):
        w = list(draw.choice(texts[:12]))
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            i = draw.randrange(len(w))
            w[i : i + draw.choice([0, 1, 1, 2])] = draw.choices(vocabulary[:30], k=draw.choice([0, 1, 1]))
        texts.append(w)
    texts += [passage + draw.choices(vocabulary, k=draw.randint(0, 40)) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    want = {i: top(i) for i, _ in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(frame, num=num).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)
    kept = {r["doc_id"] for r in neardup.without_near_copies(frame, num=num).collect()}
    assert kept == set(want.values())


def test_one_row_of_each_group_stays(spark):
    """Null ids, equal ids, repeated rows: exactly one row of each group with words stays, and every row without words."""
    rows = [(1, LONG), (None, LONG), (None, LONG), (2, LONG + " end"), (3, "other text of some more words"), (3, "quite another text under the same id"), (4, None), (4, None), (None, ""), (5, "once only here"), (5, "once only here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in neardup.without_near_copies(frame).collect())
    assert got == Counter([rows[0], *rows[4:10]])


def test_packing(docs, none):
    rows = packing.packed(docs, size=256).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_keys_of_fingerprints(spark, agree):
    """Any two fingerprints within the radius share a key, whichever number of parts makes one."""
    draw = random.Random(agree)
    for length, radius in decontam.LENGTHS.items():
        rows = []
        for _ in range(300):
            print_ = draw.getrandbits(64)
            near = print_ ^ sum(1 << b for b in draw.sample(range(64), radius))
            rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (print_, near)))
        keys = spark.createDataFrame(rows, "a long, b long").selectExpr(f"{decontam.parts_of('a', length, agree)} a", f"{decontam.parts_of('b', length, agree)} b")
        assert keys.filter("arrays_overlap(a, b)").count() == 300


def test_candidates_stay_linear(spark):
    """Of 20,000 random windows of items, a random window of a text meets less than one by chance, at the widest radius."""
    n, radius = 20_000, decontam.LENGTHS[64]
    keys = decontam.parts_of("print", 64, decontam.agreeing(radius, n))
    sides = [spark.range(n).selectExpr(f"xxhash64(id, {seed}) print").selectExpr(f"explode({keys}) part") for seed in (1, 2)]
    assert sides[0].join(sides[1], "part").count() < n
    for windows in (10**3, 10**5, 10**7, 10**9):
        k = decontam.agreeing(radius, windows)
        assert windows * math.comb(radius + k, k) / 2 ** (64 * k / (radius + k)) < 40


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, "never seen anywhere at all here"), (3, "two words"), (4, None), (5, "")], "item_id long, text string")
    out = decontam.decontaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["items"]) for r in out if r["contaminated"]) == [(8, [1])] and len(out) == len(ROWS)
    edited = spark.createDataFrame([(1, ITEM.replace("item29", "other")), (2, " ".join(ITEM.split()[:15]))], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.decontaminated(edited, items).orderBy("doc_id").collect()] == [True, False]
    assert decontam.decontaminated(none, items).count() == 0
    assert not decontam.decontaminated(docs, items.filter("false")).filter("contaminated").count()


def test_decontamination_of_edited_items(spark):
    """Items with words changed, put in or left out, within other text: nine of ten that hold 0.8 of their item's weight are found, and nothing else."""
    draw = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = {i: draw.choices(vocabulary, k=draw.randint(6, 90)) for i in range(120)}
    rows, want = [], {}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    often = Counter(g for w in items.values() for g in grams(w))
    weight = lambda g: np.log(1 + len(items) / often[g])
    for i, words in items.items():
        for k in range(3):
            w = list(words)
            for _ in range(draw.choice([0, 1, 2])):
                j = draw.randrange(len(w))
                w[j : j + draw.choice([0, 1, 1])] = draw.choices(vocabulary, k=draw.choice([0, 1]))
            part = sum(weight(g) for g in grams(words) & grams(w)) / sum(weight(g) for g in grams(words))
            want[3 * i + k] = i if part >= 0.8 else None
            rows.append((3 * i + k, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)) + w + draw.choices(vocabulary, k=draw.randint(0, 30)))))
    rows += [(1000 + i, " ".join(draw.choices(vocabulary, k=300))) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.decontaminated(frame, bench).collect()}
    due = [d for d, i in want.items() if i is not None]
    assert sum(want[d] in got[d] for d in due) >= 0.97 * len(due) and not any(got[1000 + i] for i in range(50))
    assert all(x == [want[d]] for d, x in got.items() if x and want.get(d) is not None)


def test_bare_words_are_merged_without_a_search():
    """A space and letters go to the merges alone, many at once (F2, F5); ids stay those of plain encode(), also where bytes of letters look like others' ends."""
    from tokenizers import Tokenizer

    path, draw = tokens.vocabulary(), random.Random(3)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    sent = []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    own.tokenizer = Spy()
    letters = "abcdeghinorstuwAEITàâÂéüßłĠɏ"
    words = ["".join(draw.choices(letters, k=draw.randint(1, 14))) for _ in range(3000)]
    texts = ["x " + " ".join(words[at : at + 300]) + draw.choice(["", ".", " ª", "\n" + words[at], "     a"]) for at in range(0, 3000, 300)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert own.merger is not None and sum(map(len, sent)) < 400


def test_counts_of_double_blocks(spark):
    """Counts of 8-word blocks are sums of those of 4 (F4)."""
    rows = spark.createDataFrame([(n, list(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n).tolist())) for n in range(41)], "n int, h array<long>")
    both = rows.withColumn("c", F.expr(decontam.block_counts("h", 4))).select(F.expr(decontam.doubled_counts("c")).alias("a"), F.expr(decontam.block_counts("h", 8)).alias("b"), "n")
    got = both.collect()
    assert all(r["a"] == r["b"] and len(r["b"]) == r["n"] // 8 for r in got) and len(got) == 41


def test_near_duplicates_get_texts_in_small_batches(spark, monkeypatch):
    """Each worker holds a few MB of texts at a time (F1), and the session's setting comes back."""
    before, seen, sketch = spark.conf.get(store.BATCH), [], neardup.with_sketches
    monkeypatch.setattr(neardup, "with_sketches", lambda docs, *rest: seen.append(int(spark.conf.get(store.BATCH))) or sketch(docs, *rest))
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(6)], "doc_id long, text string")
    assert neardup.near_components(docs).filter("kept").count() == 3
    assert seen == [store.BATCH_BYTES] and spark.conf.get(store.BATCH) == before


def test_other_tasks_forget_encoders(spark):
    """Workers outlive their stages, so tasks of other operators let go of the encoder (F1)."""
    kept = tokens.encoder(tokens.vocabulary())
    assert tokens.encoder(tokens.vocabulary()) is kept
    found = []

    class Docs:
        def __init__(self, docs):
            self.docs = docs

        def mapInArrow(self, work, schema):
            return list(work(iter(found)))

    rows, neardup._rows = neardup._rows, lambda docs, key, text: Docs(docs)
    try:
        neardup.with_sketches(None, "doc_id", "text", 64, 5)
    finally:
        neardup._rows = rows
    assert tokens.encoder(tokens.vocabulary()) is not kept
