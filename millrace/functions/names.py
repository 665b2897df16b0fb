"""Column builders for names: models, judges, addresses and numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def sanitized(c: Column) -> Column:
    """Model name without its owner, as an identifier."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[^/]*/", ""), r"\W+", "_"), r"^_+|_+\z", ""))


def roman(n: Column) -> Column:
    """Roman numeral of a number from 1 on; null below. Each value is used as often as what is left of the larger ones allows."""
    rest, parts = n, []
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n >= 1, F.concat(*parts))


def from_roman(c: Column) -> Column:
    """Number of a Roman numeral, null for anything else: a smaller sign before a larger one counts down."""
    worth = F.create_map(*(F.lit(x) for v, s in ROMAN if len(s) == 1 for x in (s, v)))
    signs = F.transform(F.filter(F.split(F.upper(c), ""), lambda s: s != ""), lambda s: F.try_element_at(worth, s))
    value = lambda a, x: F.struct((a["sum"] + F.when(x > a["last"], x - 2 * a["last"]).otherwise(x)).alias("sum"), x.alias("last"))
    total = F.aggregate(signs, F.struct(F.lit(0).alias("sum"), F.lit(1 << 20).alias("last")), value, lambda a: a["sum"])
    return F.when(roman(total) == F.upper(c), total)


def judge_family(c: Column) -> Column:
    """Provider of a model name."""
    return F.split_part(F.coalesce(c, F.lit("")), F.lit("/"), F.lit(1))


def repository(uri: Column) -> Column:
    """Repository of a model address: scheme, digest and host taken off."""
    own = F.regexp_replace(F.regexp_replace(uri, r"(?i)^[a-z][a-z0-9+.-]*://", ""), r"@[^/]*\z", "")
    return F.regexp_replace(own, r"^[^/]*\.[^/]*/", "")


def bucket_and_key(uri: Column) -> Column:
    """struct(bucket, key) of an object address, nulls for any other address."""
    part = lambda i: F.nullif(F.regexp_extract(uri, r"(?s)^s3://([^/]*)/?(.*)\z", i), F.lit(""))
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def digest(uri: Column) -> Column:
    """Digest behind the @ of an address, null without one."""
    return F.nullif(F.regexp_extract(uri, r"@(?:sha256:)?([0-9a-f]{64})\z", 1), F.lit(""))
