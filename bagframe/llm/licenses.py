"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Fixed base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of the method's own, and their labels.
NOTICES = {
    "released under the mit": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
}
#: The tag before a licence expression.
TAG = "spdx license identifier"
#: Identifiers without version and suffix, and how free they are, from 0 to 1. Fixed values.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "0bsd": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "zlib": 1.0, "bsl": 1.0, "ncsa": 1.0, "x11": 1.0, "postgresql": 1.0,
    "mit-0": 1.0, "python": 0.9, "psf": 0.9, "artistic": 0.8, "ofl": 0.8, "openssl": 0.8, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "eupl": 0.5, "gfdl": 0.5,
    "gpl": 0.4, "osl": 0.4, "agpl": 0.3, "sspl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
#: Identifiers that are none of these but look like one: with a version, or of one's own.
UNLISTED = re.compile(r"[a-z][a-z0-9.]*(-[a-z0-9.]+)*-\d[a-z0-9.]*(-[a-z0-9.]+)*\+?|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
RANK = {"or": 1, "and": 2, "with": 3}


def short(identifier: str) -> str:
    """mit of MIT, apache-2 of Apache-2.0, gpl of GPL-3.0-or-later: the label of an identifier."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-\d+(\.\d+)*(-clause)?$", "", name)
    return "apache-2" if name == "apache" else name


def identifier(token: str) -> str | None:
    """The label of a licence identifier; None of a word that is none."""
    label = short(token.rstrip("."))
    return label if label in FREEDOM or UNLISTED.fullmatch(token.rstrip(".")) else None


def evaluate(text: str, at: int = 0) -> tuple[list[str], float] | None:
    """(labels, freedom) of the licence expression that stands at a place of text; None if there is none.

    Two stacks: operands, and operators by rank (with, and, or). `or` takes the freer side's freedom, `and` the less free one's, and an exception after
    `with` leaves its licence's. The expression ends with its line or where the next token cannot go on; operators and parentheses that are left open
    at its end are dropped. An unlisted identifier has freedom 0.5.
    """
    values: list[tuple[list[str], float]] = []
    operators: list[str] = []

    def apply() -> None:
        op, right, left = operators.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(left)
        else:
            values.append((left[0] + right[0], (max if op == "or" else min)(left[1], right[1])))

    operand, end, opened = True, at, 0
    for m in TOKEN.finditer(text, at):
        token = m.group().lower()
        if text[end : m.start()].strip(" \t"):
            break
        if operand and token == "(":
            operators.append("(")
            opened += 1
        elif operand and operators and operators[-1] == "with" and token not in RANK and token != ")":
            values.append(([token], 0.0))  # an exception
            operand = False
        elif operand and (label := identifier(token)) is not None:
            values.append(([label], FREEDOM.get(label, 0.5)))
            operand = False
        elif not operand and token == ")" and opened:
            while operators[-1] != "(":
                apply()
            operators.pop()
            opened -= 1
        elif not operand and token in RANK:
            while operators and operators[-1] != "(" and RANK[operators[-1]] >= RANK[token]:
                apply()
            operators.append(token)
            operand = True
        else:
            break
        end = m.end()
    while operand and operators:  # what stands after the last operand: parentheses, then one operator
        operand = operators.pop() == "("
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            apply()
    return values[-1] if values else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            key = f" {phrase} "
            found.add_word(key, (*found.get(key, ()), (kind, label, len(key))))
    found.make_automaton()
    return found


def scan(text: str) -> dict:
    """Words, places and labels of one text."""
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    line = " " + " ".join(words) + " "
    places, base, labels, freedoms = [], set(), set(), []
    tags = []
    for end, hits in automaton().iter(line):
        for kind, label, size in hits:
            start = end - size + 1
            if kind == "tag":
                tags.append(end)
            else:
                labels.add(label)
                freedoms.append(FREEDOM[label])
            if kind == "base":
                base.add(label)
                places.append(start)
    starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=0))  # of the words in `line`, one place earlier
    if tags:
        ends = [m.end() for m in WORD.finditer(low)]
        for end in tags:
            at = ends[bisect_left(starts, end) - 1]
            while low[at : at + 1] == ":":
                at += 1
            result = evaluate(text, at)
            if result:
                labels.update(result[0])
                freedoms.append(result[1])
    at = [bisect_left(starts, p) for p in (min(places), max(places))] if places else [None, None]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": at[0], "last_word": at[1],
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(freedoms) if freedoms else 0.5,
    }


FIELDS = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def licensed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score is how free the text's least free licence is, 0.5 where there is none. Null and empty texts have no words and no labels. Null ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def find(batches):
        for batch in batches:
            rows = pa.Table.from_pylist([scan(t.as_py()) for t in batch.column(1)], schema=FIELDS).combine_chunks()
            arrays = [c.combine_chunks() for c in rows.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *FIELDS.names])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return licensed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
