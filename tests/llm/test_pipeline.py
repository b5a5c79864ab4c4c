"""The pipeline's stages over a small corpus of hard rows, against what each of them must keep."""

import random
import re

import pytest

import corpus_pipeline
from bagframe.llm import pii, tokens


def words(draw, n: int) -> str:
    return " ".join(draw.choices([f"v{i}" for i in range(2000)], k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, ids that stay): copies, edited copies, a benchmark passage, personal data, null and empty texts, repeated rows, a very long text."""
    draw, folder = random.Random(4), tmp_path_factory.mktemp("corpus")
    base, item = words(draw, 200), words(draw, 40)
    rows = [(1, base), (2, base), (3, base + " end"), (4, words(draw, 30) + " " + item + " " + words(draw, 20)), (5, item + " " + words(draw, 50)), (6, words(draw, 60_000))]
    rows += [(7, words(draw, 40) + " card 4111 1111 1111 1111 of a.b@mail.example.com"), (8, None), (9, ""), (10, "two words"), (10, "two words"), (None, words(draw, 30)), (None, base), (11, "two words more")]
    rows += [(20 + i, words(draw, draw.randint(5, 300))) for i in range(30)]
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = [(20 + i, i % 2, int(i % 7 == 0)) for i in range(30)]
    spark.createDataFrame(labels[:0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stay = [1, 6, 7, 8, 9, 10, None, 11] + [20 + i for i in range(30)]
    return str(folder), dict(rows), sorted(stay, key=lambda x: (x is None, x))


def test_stages(spark, corpus):
    folder, texts, stay = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    got = {}
    for r in docs.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert sorted(got, key=lambda x: (x is None, x)) == stay and all(len(x) == 1 for x in got.values())
    for i, (text,) in got.items():
        if i == 7:
            assert re.search(r"\d{4} \d{4} \d{4} \d{4}", text) and "4111" not in text and "mail.example" not in text
        elif i is not None:
            assert text == texts[i]


def test_run_packs_what_stays(spark, corpus):
    folder, texts, stay = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    first = {r["doc_id"]: r["doc_tokens"] for r in rows if r["start"] == 0}
    assert sorted(first, key=lambda x: (x is None, x)) == stay
    known = [i for i in stay if i is not None and i != 7]
    ids = tokens.Encoder(tokens.vocabulary()).encode([texts[i] for i in known])
    assert [first[i] for i in known] == [len(x) // 4 + 1 for x in ids]
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(first.values())


def test_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_key_of_the_session(spark):
    key = pii.session_key(spark)
    assert key and pii.session_key(spark) == key
