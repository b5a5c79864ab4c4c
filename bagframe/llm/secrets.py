"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain; the index has postings of just the trigrams that queries
use. Postings are intersected per text, and the regex runs on the candidates. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import sized, written

#: (kind, regex, group whose length counts, its least length); the first three are fixed.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
]
BASE = ("assign", "access", "hex")
#: Strings that an alternative set may have before it is cut into trigrams.
MOST_EXACT = 32
#: Matches that are placed together.
CHUNK = 64


def _and(*queries):
    """Queries are frozensets of clauses, each a frozenset of trigrams of which one must occur; the empty query is always true."""
    return frozenset().union(*queries)


def _trigrams(strings: set[str]):
    """The query of texts that hold one of the strings: a clause of one trigram of each, for every choice of a place counted from the start."""
    if not strings or min(map(len, strings)) < 3:
        return frozenset()
    places = min(map(len, strings)) - 2
    return frozenset(frozenset(s[i : i + 3] for s in strings) for i in range(places))


def trigram_query(regex: str):
    """Clauses of lower-cased trigrams that every match of the regex satisfies: one of each clause occurs in the lower-cased text."""

    def walk(items) -> tuple[set[str] | None, frozenset]:
        """(all strings that the sequence can be, or None if too many; clauses)."""
        run, query, whole = {""}, frozenset(), True
        for op, value in items:
            exact, inner = None, frozenset()
            if op is sre.LITERAL:
                exact = {chr(value).lower()}
            elif op is sre.SUBPATTERN:
                exact, inner = walk(value[3])
            elif op is sre.BRANCH:
                parts = [walk(x) for x in value[1]]
                exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
                # One branch holds: its clauses only follow if the others have them too.
                inner = frozenset.intersection(*(p[1] for p in parts))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = value
                strings, clauses = walk(body)
                if low > 0:
                    inner = clauses
                if high == 1 and strings is not None:
                    exact = strings | {""} if low == 0 else strings
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in value):
                exact = {chr(v).lower() for _, v in value}
            query = _and(query, inner)
            grown = {a + b for a in run for b in exact} if exact is not None else None
            if grown is not None and len(grown) <= MOST_EXACT:
                run = grown
            else:
                query = _and(query, _trigrams(run))
                run, whole = (exact if exact is not None and len(exact) <= MOST_EXACT else {""}), False
        return (run if whole else None), _and(query, _trigrams(run))

    return walk(list(sre_parser.parse(regex)))[1]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """(digest, rules): the indexed rules whose trigram query each distinct text satisfies."""
    queries = {kind: trigram_query(regex) for kind, regex, _, _ in rules}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    if not grams:
        return texts.sparkSession.createDataFrame([], "digest string, rules array<string>")
    has = ", ".join(f"if(contains(low, {_sql(g)}), {_sql(g)}, null)" for g in grams)
    index = texts.select("digest", F.lower("text").alias("low")).select("digest", F.explode(F.expr(f"array_compact(array({has}))")).alias("trigram"))
    postings = written(index.distinct(), "postings")
    clauses = [(kind, n, g) for kind, q in queries.items() for n, clause in enumerate(sorted(q, key=sorted)) for g in clause]
    wanted = postings.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string")  # a few rows for each rule
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("digest", "kind").agg(F.countDistinct("clause").alias("met"))
    need = postings.sparkSession.createDataFrame([(k, len(q)) for k, q in queries.items() if q], "kind string, met long")
    return met.join(F.broadcast(need), ["kind", "met"]).groupBy("digest").agg(F.collect_set("kind").alias("rules"))


def spans_of(kind: str, regex: str, group: int, least: int) -> str:
    """SQL of the array of struct(start, end, rank, kind) of a rule's matches in `text`, in code points.

    Matches and the texts between them are taken CHUNK at a time, so the work grows with their number: chunks are added up first, then each one's
    matches are placed from its start on.
    """
    rank = [r[0] for r in RULES].index(kind)
    if group == 0 and (run := re.fullmatch(r"(\w*)\[[^]]+\]\+", regex)):  # runs of a class: shorter ones need not be looked at
        regex = regex[:-1] + "{" + str(max(1, least - len(run[1]))) + ",}"
    pattern = _sql(f"({regex})" if group == 0 else regex)
    whole = f"regexp_extract_all(text, {_sql('(' + regex + ')')}, 1)"
    size = "length(m)" if group == 0 else f"length(regexp_extract(m, {pattern}, {group}))"
    pairs = f"zip_with(split(text, {_sql(regex)}, -1), {whole}, (g, m) -> named_struct('gap', length(g), 'size', length(coalesce(m, '')), 'ok', coalesce({size}, 0) >= {least} and m is not null))"
    put = f"named_struct('start', s.at + x.gap, 'end', s.at + x.gap + x.size, 'rank', {rank}, 'kind', {_sql(kind)})"
    step = f"named_struct('at', s.at + x.gap + x.size, 'found', if(x.ok, concat(s.found, array({put})), s.found))"
    none = "cast(array() as array<struct<start:int,end:int,rank:int,kind:string>>)"
    chunks = f"transform(sequence(0, (size(p) - 1) div {CHUNK}), i -> slice(p, i * {CHUNK} + 1, {CHUNK}))"
    firsts = "aggregate(c, array(0), (s, part) -> concat(s, array(element_at(s, -1) + aggregate(part, 0, (t, x) -> t + x.gap + x.size))))"
    placed = f"flatten(zip_with(c, slice(f, 1, size(c)), (part, at) -> aggregate(part, named_struct('at', at, 'found', {none}), (s, x) -> {step}, s -> s.found)))"
    return f"transform(array({pairs}), p -> transform(array({chunks}), c -> transform(array({firsts}), f -> {placed})[0])[0])[0]"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """id and found (array of start, end, rank, kind by start, then rank) of each row; positions in code points, end exclusive.

    Matches of a rule are leftmost and do not overlap; those shorter than the rule's least length are dropped. Null and empty texts have none. Equal
    texts share their postings. Null ids and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    hits = candidates(rows.select("digest", "text"), rules)
    joined = rows.join(sized(written(hits, "candidates")), "digest", "left")
    none = "cast(array() as array<struct<start:int,end:int,rank:int,kind:string>>)"
    parts = []
    for kind, regex, group, least in rules:
        scan = spans_of(kind, regex, group, least)
        # A rule without trigrams has to scan; a run of that length is asked for first.
        gate = f"array_contains(rules, {_sql(kind)})" if trigram_query(regex) else f"text rlike {_sql(regex[:-1] + '{' + str(least) + '}')}" if group == 0 and regex.endswith("]+") else "true"
        parts.append(f"if({gate}, {scan}, {none})")
    return joined.select(id_col, F.expr(f"array_sort(concat({', '.join(parts)}))").alias("found"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.withColumn("found", F.expr("array_sort(found, (x, y) -> case when x.start != y.start then x.start - y.start else x.rank - y.rank end)"))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')".format
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    base = joined(f"filter(found, x -> x.rank < {len(BASE)})")
    return found.select("doc_id", *counts, F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(joined("found")).alias("spans"))
