"""Format-preserving pseudonyms of personal numbers and dates, with SQL functions only.

A value is cut into two halves and goes through a keyed Feistel network whose halves are numbers below two moduli, so it is permuted within its format:
equal values get equal pseudonyms in every document, different ones different. Domains:
  number  13 to 19 digits: all but the last are permuted; the last keeps the Luhn sum 0; digits with another sum
          are no card number and stay, but for card numbers, dates, ssn and phone numbers within them
  phone   the last ten digits          ip    four octets of up to 255
  ssn     valid areas, groups, serials date  yyyy-mm-dd within 73,000 days (250 x 292) from 1900-01-01
Mail addresses are no numbers; they become a keyed digest. Values that are not valid in their format stay.

Expressions are built from Column functions: one SQL string of them has 11,576 characters, and what Spark's parser learns from it stays in the driver.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Fixed patterns. Runs are possessive and start where they can begin, so long runs cost no more than their length, and no stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "number": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(value) -> Column:
    """A column or a number as a whole number of 64 bits."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def feistel(a: Column, b: Column, ma, mb, key: Column, tweak: str) -> Column:
    """struct(a, b): the permuted halves, a below ma and b below mb (columns or numbers). An even number of rounds."""
    ma, mb = _whole(ma), _whole(mb)

    def turn(s: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", key, F.lit(tweak), ma, mb, r, s["b"]), 256)
        draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + draw, F.when(r % 2 == 0, ma).otherwise(mb)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_whole(a).alias("a"), _whole(b).alias("b")), turn)


def permuted_digits(d: Column, key: Column, tweak: str) -> Column:
    """The permuted string of 2 to 18 digits."""
    half = _div(F.length(d), 2)
    rest = F.length(d) - half
    halves = feistel(F.left(d, half), F.substr(d, half + 1), F.pow(F.lit(10), half), F.pow(F.lit(10), rest), key, tweak)
    return _let(halves, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), rest, "0")))


def luhn(d: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""

    def worth(c: Column, i: Column) -> Column:
        twice = _let(c.cast("int"), lambda n: F.substr(F.lit("0246813579"), n + 1, F.lit(1)).cast("int"))
        return F.when(i % 2 == 1, twice).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(d), ""), worth), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))) % 10


def refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one after another, by those of a string."""

    def fill(q: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            put = F.struct(F.concat(s["out"], F.substr(q, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
            return F.when(c.between("0", "9") & (c != ""), put).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))

        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda s: s["out"])

    return _let(digits, fill)


def _digits(w: Column) -> Column:
    return F.regexp_replace(w, "[^0-9]", "")


def card(w: Column, key: Column) -> Column:
    """w with its 13 to 19 digits permuted and the Luhn sum 0."""

    def numbered(d: Column) -> Column:
        body = permuted_digits(F.left(d, F.length(d) - 1), key, "number")
        return _let(body, lambda h: F.concat(h, F.pmod(luhn(d) - luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))

    return refilled(w, _let(_digits(w), numbered))


def _matches(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(m, F.lit(pattern), group)


def _joined(m: Column, pattern: str, parts: Column) -> Column:
    """m with the matches of the pattern replaced by parts, one after another."""
    return F.array_join(F.zip_with(F.split(m, pattern, -1), parts, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def within(m: Column, key: Column) -> Column:
    """A run of digits that is no card number as a whole: card numbers of whole groups (1 to 5 of three digits or more, the last of any length) in
    it are replaced, or else dates, ssn and phone numbers in it."""
    shapes = [r"(?<!\d)(?=(\d{13,19})(?!\d))"] + [rf"(?<!\d)(?=(\d{{3,}}(?:[ -]\d{{3,}}){{{k}}}[ -]\d+)(?!\d))" for k in range(4)]
    tries = F.concat(*(_matches(m, x, 1) for x in shapes))
    valid = F.filter(tries, lambda w: F.length(_digits(w)).between(13, 19) & (luhn(_digits(w)) == 0))
    kinds = ("date", "ssn", "phone")
    any_of = "|".join(PATTERNS[k] for k in kinds)
    others = _joined(m, any_of, F.transform(_matches(m, any_of, 0), lambda w: pseudonym(w, key, kinds)))
    return _let(valid, lambda v: F.when(F.size(v) > 0, F.aggregate(v, m, lambda t, w: F.replace(t, w, card(w, key)))).otherwise(others))


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(key, F.lit(":mail:"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _ip(m: Column, key: Column) -> Column:
    def numbered(o: Column) -> Column:
        a, b = (_whole(o[i]) * 256 + _whole(o[i + 1]) for i in (0, 2))
        swapped = _let(feistel(a, b, 65536, 65536, key, "ip"), lambda p: F.concat_ws(".", *(x for h in ("a", "b") for x in (_div(p[h], 256), p[h] % 256))))
        return F.when(F.exists(o, lambda x: x.cast("int") > 255), m).otherwise(swapped)

    return _let(F.split(m, "[.]"), numbered)


def _date(m: Column, key: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def numbered(n: Column) -> Column:
        swapped = _let(feistel(_div(n, 292), n % 292, 250, 292, key, "date"), lambda p: F.date_add(first, (p["a"] * 292 + p["b"]).cast("int")).cast("string"))
        return F.when(n.isNull() | (n < 0) | (n >= 73000), m).otherwise(swapped)

    return _let(F.datediff(m.try_cast("date"), first), numbered)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = F.left(m, F.lit(3)).cast("int"), F.substring(m, 5, 2), F.right(m, F.lit(4))
    rest = (group.cast("int") - 1) * 9999 + serial.cast("int") - 1
    valid = area.between(1, 899) & (area != 666) & (group != "00") & (serial != "0000")

    def shown(p: Column) -> Column:
        a = p["a"] + 1 + F.when(p["a"] + 1 >= 666, 1).otherwise(0)
        parts = [(a, 3), (_div(p["b"], 9999) + 1, 2), (p["b"] % 9999 + 1, 4)]
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return F.when(valid, _let(feistel(area - 1 - F.when(area > 666, 1).otherwise(0), rest, 898, 989901, key, "ssn"), shown)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    def numbered(d: Column) -> Column:
        return F.concat(F.left(d, F.length(d) - 10), permuted_digits(F.right(d, F.lit(10)), key, "phone"))

    return refilled(m, _let(_digits(m), numbered))


def _number(m: Column, key: Column) -> Column:
    return F.when(luhn(_digits(m)) == 0, card(m, key)).otherwise(within(m, key))


SWAPS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "number": _number}


def pseudonym(m: Column, key: Column, kinds=tuple(PATTERNS)) -> Column:
    """The pseudonym of a string matched by one of the patterns of these kinds; other strings stay."""
    first, *others = kinds
    out = F.when(m.rlike(f"^(?:{PATTERNS[first]})$"), SWAPS[first](m, key))
    for k in others:
        out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), SWAPS[k](m, key))
    return out.otherwise(m)


#: Spark leaves values of properties named so out of its event log and environment page.
KEY = "spark.bagframe.pseudonyms.secret"


def session_key(spark: SparkSession) -> str:
    """The key set in the session under KEY; where there is none, one is drawn and kept for the session, so its pseudonyms agree with each other only."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY, key)
    return key


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with personal values of the text column replaced and `n_private`, how many were found; key: a secret of the caller's, else the session's.

    The key comes into the plan as a scalar subquery over a table of one row, so no plan prints it. Null and empty texts stay as they are (0 found). Rows
    are handled alone: repeated rows stay, an empty table stays empty, and columns other than the text, n_private, __found and __key (which are taken)
    are left alone.
    """
    spark = docs.sparkSession
    secret = spark.createDataFrame([(key or session_key(spark),)], "secret string")
    any_of = "|".join(PATTERNS.values())
    t, found = F.col(f"`{text_col}`").cast("string"), F.col("__found")
    plan = F.when(t.rlike(any_of), _matches(t, f"({any_of})", 1)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("__key", secret.scalar()).withColumn("__found", plan).withColumn("n_private", F.size(found))
    joined = _joined(t, any_of, F.transform(found, lambda m: pseudonym(m, F.col("__key"))))
    return out.withColumn(text_col, F.when(F.col("n_private") == 0, t).otherwise(joined)).drop("__found", "__key")


def op4_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, text and n_private of all documents."""
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
