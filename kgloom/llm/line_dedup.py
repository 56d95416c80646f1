"""Lines that many documents share, in DataFrame functions only.

Lines are exploded with their places, normalised and hashed; a hash in enough
distinct documents is crowded; lines with a crowded hash go, except in the
document with the largest id, and what is left of a text is put together again
by place. Only hashes, ids and places are shuffled beside the texts themselves,
which are shuffled once.

A document is an id: rows with the same id count once, and so do all rows
without one, which come before every id. Rows that are equal in id and text lose
the same lines. Null text is empty, and empty text is one empty line. A text
that loses every line is empty. Columns beyond those named are ignored; an empty
table gives an empty result. Hashes have 128 bits; the time for a text is in
proportion to its length however many lines it loses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import stored

#: What is stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(WHITE))
    # Where all is ASCII the plain function does the same, and faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def wide_hash(text: Column) -> list[Column]:
    """128 bits as two numbers."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def keyed_lines(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """``id``, ``t1``, ``t2`` (hash of the text), ``pos``, ``h1``, ``h2``: a row for each line whose key has ``least_chars`` code points."""
    lines = docs.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = wide_hash(F.col("key"))
    return lines.where(F.char_length("key") >= least_chars).select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def crowded(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """``h1``, ``h2``, ``keep``: hashes in ``least_docs`` distinct documents, and the largest id that holds each.

    Documents are made distinct by hash and id before they are counted, so that a line in
    a third of all documents is counted by many tasks.
    """
    counts = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("nameless"), F.max("id").alias("keep"))
    return counts.where(F.col("n") + F.col("nameless") >= least_docs).select("h1", "h2", "keep")


def deduplicated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``id``, ``kept`` (text), ``n_lines``, ``n_dropped``: one row for each row of ``docs``."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(col, F.lit("")).alias("text"))
    t1, t2 = wide_hash(F.col("text"))
    rows = rows.withColumns({"t1": t1, "t2": t2})
    lines = stored(keyed_lines(rows, least_chars), "lines")  # numbers only, read twice
    # Stored, so that its rows are dealt anew for the join and a line that many hold can be split.
    gone = lines.join(stored(crowded(lines, least_docs), "crowded"), ["h1", "h2"]).where(F.col("id").isNull() | (F.col("id") != F.col("keep")))
    places = gone.groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    places = places.select(F.col("id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2"), "gone")
    found = rows.join(places, F.col("id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2")), "left")
    # A flag for each line up to the last that goes: between two of these all stay. Lines beyond have none and stay.
    flags = "flatten(zip_with(gone, concat(array(-1), slice(gone, 1, size(gone) - 1)), (x, before) -> concat(array_repeat(true, x - before - 1), array(false))))"
    kept = F.expr(rf"if(gone IS NULL, text, array_join(zip_with(split(text, '\n'), {flags}, (line, stays) -> if(coalesce(stays, true), line, NULL)), '\n'))")
    return found.select("id", kept.alias("kept"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
