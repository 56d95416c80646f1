"""Exact document fingerprints: canonical text, wide hash, byte comparison inside equal hashes.

The canonical text is Unicode-normalised (NFKC), case-folded (and normalised
again, as folding can undo it) and has each run of white space as one blank,
with none at either end. Its 128-bit xxhash groups documents; within a group
of more than one row the canonical bytes themselves are compared, and a group
that holds different texts has its fingerprints extended by a second digest.

Cases: null is empty; empty texts share a fingerprint; repeated rows and ids
are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.common import stored

#: Bits of the filter that marks hashes seen more than once; its size, and so what is broadcast, is fixed: 512 kB.
FILTER_BITS = 1 << 22


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest_of(plain: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(plain)


def second_of(plain: bytes) -> str:
    return hashlib.sha256(plain).hexdigest()


def texts(column: pa.Array):
    """The texts of a column one by one, so that no batch is held as Python objects; null is empty."""
    for x in column:
        yield x.as_py() or ""


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``digest`` of each row."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(canonical(t).encode()) for t in texts(batch.column(0))], pa.string())], names=["digest"])

    return docs.select(text).mapInArrow(work, "digest string")


def repeated_filter(found: DataFrame) -> np.ndarray:
    """A fixed number of bits, of which those are set that a digest seen more than once points at."""
    place = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(FILTER_BITS))
    again = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(place.alias("at"))
    words = again.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return out


def collided(docs: DataFrame, text: str = "text") -> DataFrame:
    """The digests that stand for more than one canonical text, found by comparing bytes.

    Only texts whose digest may have been seen more than once are looked at again. Least and
    greatest canonical bytes of a digest are equal only if all are; each task keeps two texts of a
    digest, so a text that a third of all rows share crosses the shuffle once a task.
    """
    bits = docs.sparkSession.sparkContext.broadcast(repeated_filter(digests(docs, text)))

    def work(batches):
        words = bits.value
        for batch in batches:
            names, plains = [], []
            for t in texts(batch.column(0)):
                plain = canonical(t).encode()
                d = digest_of(plain)
                at = int(d[:8], 16) % FILTER_BITS
                if int(words[at >> 6]) >> (at & 63) & 1:
                    names.append(d)
                    plains.append(plain)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(plains, pa.binary())], names=["digest", "plain"])

    marked = docs.select(text).mapInArrow(work, "digest string, plain binary")
    return marked.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).where("least <> most").select("digest")


def fingerprinted(frame: DataFrame, clashes: DataFrame, digest: str, second: str, name: str) -> DataFrame:
    """``frame`` with a fingerprint: the digest, followed where it clashes by the second one. Without any clash this adds no join."""
    if clashes.isEmpty():
        return frame.withColumn(name, F.col(digest))
    found = clashes.select(F.col("digest").alias(digest), F.lit(True).alias("clash"))
    return frame.join(found, digest, "left").withColumn(name, F.when(F.col("clash"), F.concat_ws("-", digest, second)).otherwise(F.col(digest))).drop("clash")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fingerprint`` of each row."""
    clashes = stored(collided(docs, text), "clashes")
    return fingerprinted(prepared(docs, np.zeros(0, np.int64), doc_id, text), clashes, "digest", "second", "fingerprint").select("id", "fingerprint")


#: Ids that are looked at for each end of a range.
OVER = 8


def range_ends(docs: DataFrame, doc_id: str = "doc_id") -> np.ndarray:
    """Ends of ranges of ids that hold about as many rows each, two ranges to a partition of the input; every ``OVER``-th of a sample of different ids, which is all that reaches the driver."""
    frame = docs.select(doc_id)
    parts = 2 * frame.rdd.getNumPartitions()
    share = min(1.0, OVER * parts / max(1, frame.count()))
    chosen = frame.where((F.xxhash64(doc_id).cast("double") / 2.0**64 + 0.5 <= share) & F.col(doc_id).isNotNull()).distinct()
    ids = np.sort(np.array([r[0] for r in chosen.collect()], np.int64))
    return ids[OVER - 1 :: OVER]


def part_of(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The range of each id; null ids come before all."""
    return pa.array(np.where(np.asarray(ids.is_null()), -1, np.searchsorted(ends, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")), pa.int32())


def range_heads(docs: DataFrame, ends: np.ndarray, doc_id: str = "doc_id") -> DataFrame:
    """``before``, ``head``: for each range the least id of the range that follows, from the ids alone; after the last comes the first."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), part_of(batch.column(0), ends)], names=["id", "part"])

    frame = docs.select(F.col(doc_id).alias("id"))
    parts = frame.mapInArrow(work, T.StructType([frame.schema["id"], T.StructField("part", T.IntegerType())]))
    firsts = sorted((tuple(r) for r in parts.groupBy("part").agg(F.min("id").alias("id")).collect()), key=lambda r: r[0])
    return docs.sparkSession.createDataFrame([(firsts[k - 1][0], i) for k, (_, i) in enumerate(firsts)], f"before int, head {frame.schema['id'].dataType.simpleString()}")


def prepared(docs: DataFrame, ends: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``part`` (the range of the id; null ids come first), ``packed`` (the text, compressed for a shuffle), ``digest``, ``second``."""
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([frame.schema["id"], T.StructField("part", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("digest", T.StringType()), T.StructField("second", T.StringType())])

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(0)
            packed, first, second = [], [], []
            for t in texts(batch.column(1)):
                plain = canonical(t).encode()
                packed.append(squeeze(t.encode()))
                first.append(digest_of(plain))
                second.append(second_of(plain))
            yield pa.RecordBatch.from_arrays([ids, part_of(ids, ends), pa.array(packed, pa.binary()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["id", "part", "packed", "digest", "second"])

    return frame.mapInArrow(work, schema)


def with_next(frame: DataFrame, heads: DataFrame, head_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``id``, ``part`` and ``columns``, and ``columns`` of the row that follows in ascending id (after the last: the first) as ``next_*``.

    Inside a range a window looks one row ahead; its last row takes the first row of the range that
    follows, which ``heads`` names and ``head_rows`` (rows like ``frame``'s) holds. Equal ids follow in the order of ``columns``.
    """
    # A row for each range: the rows that stand first in one.
    first_rows = head_rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).groupBy("before").agg(F.min(F.struct(*columns)).alias("head_row"))
    here = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), *columns)
    ahead = frame.withColumn("ahead", F.lead(F.struct(*columns)).over(here))
    follows = [F.when(F.col("ahead").isNull(), F.col(f"head_row.{c}")).otherwise(F.col(f"ahead.{c}")).alias(f"next_{c}") for c in columns]
    return ahead.join(first_rows, F.col("part") == F.col("before")).select("id", *columns, *follows)


def edited(pairs: DataFrame, carried: list[str]) -> DataFrame:
    """``id``, ``carried``, and of each text with its last quarter replaced by the first code points of the next: ``n_chars`` before, ``sha256``, ``digest``, ``second``."""
    frame = pairs.select("id", *carried, "packed", "next_packed")
    schema = T.StructType([*[frame.schema[c] for c in ("id", *carried)], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("sha256", "digest", "second")]])

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, whole, first, second = [], [], [], []
            for a, b in zip(batch.column("packed"), batch.column("next_packed"), strict=True):
                t, u = unpack(a.as_py()).decode(), unpack(b.as_py()).decode()
                tail = len(t) // 4
                new = t[: len(t) - tail] + u[:tail]
                plain = canonical(new).encode()
                sizes.append(len(t))
                whole.append(hashlib.sha256(new.encode()).hexdigest())
                first.append(digest_of(plain))
                second.append(second_of(plain))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *carried)), pa.array(sizes, pa.int64()), *(pa.array(x, pa.string()) for x in (whole, first, second))], names=schema.names)

    return frame.mapInArrow(work, schema)
