"""Text normalisation, shingles and hashes as column expressions that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def norm(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a blank; none for fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def md5_int(text: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the md5 digest as a number, 15 at most."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def kind_and_number(column: str) -> tuple[Column, Column]:
    """An id like ``order:17`` as its kind and its number, which travel at half the bytes; any other whole, with -1."""
    kind, number = F.substring_index(column, ":", 1), F.expr(f"try_cast(substring_index({column}, ':', -1) as long)")
    same = F.coalesce((number >= 0) & (F.concat(kind, F.lit(":"), number.cast("string")) == F.col(column)), F.lit(False))
    return F.when(same, kind).otherwise(F.col(column)), F.when(same, number).otherwise(-1)


def id_of(kind: Column, number: Column) -> Column:
    """The id of a kind and a number, or what stands in the kind's place."""
    return F.when(number < 0, kind).otherwise(F.concat(kind, F.lit(":"), number.cast("string")))
