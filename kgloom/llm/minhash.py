"""Near-duplicate classes by one-permutation MinHash.

One hash a shingle fills all bins of a signature; an empty bin takes the value
of a non-empty one that a fixed random order picks (optimal densification).
Bands of bins make buckets; each bucket gives star-shaped edges from its
members to one centre, so that pairs grow with members and not with their
square. Edges are confirmed on the full shingle sets. Buckets whose members
the confirmed edges leave in different components are looked at again: their
members are compared across components, but for those that exact bounds rule
out, so that a star whose centre is far from a member loses no link.

Equal sets are one class from the start, however many rows they have, and are
known by 128 bits of the set; ids are attached last.

Cases: null and empty texts have no shingles and are linked with nothing; a
text of fewer words than a shingle has its words as one; rows that share an id
keep their own sets and classes; a row without an id is linked like any other, and names its
component only if no member has an id (then the component is null); other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.bytesvec import mix, shingle_sets, slices
from kgloom.llm.common import stored

WIDTH, PERCENT = 5, 75
BINS, ROWS = 256, 5
#: A shingle of at most so many members is rare.
RARE = 16
BANDS = BINS // ROWS
ODD = 16

_order = np.random.default_rng(20240229).integers(0, 1 << 62, (BINS, BINS))
_factors = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_salts = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, for sorted distinct hashes; empty bins borrow."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = bins[first]
    out = np.empty(BINS, np.uint64)
    out[filled] = hashes[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = out[filled[_order[np.ix_(empty, filled)].argmin(axis=1)]] + empty.astype(np.uint64)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes)[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((rows * _factors).sum(axis=1) ^ _salts).view(np.int64)


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    """128 bits of each whole set; null for an empty one."""
    return pa.array([xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in sets], pa.binary())


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of ``64 * ODD`` classes is odd, as ``ODD`` numbers: sets differ by as many as these bits do, at least."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * ODD), minlength=64 * ODD).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``at`` (a hash of the text), ``n_shingles``, ``set_key`` (null without shingles) and ``bands`` of each row."""
    frame = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def work(batches):
        for batch in batches:
            for first, offsets, data in slices(batch.column(2)):
                sets = list(shingle_sets(offsets, data, WIDTH))
                bands = [band_keys(u) if len(u) else np.zeros(0, np.int64) for u in sets]
                flat = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(b) for b in bands])].astype(np.int32), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(sets)) for k in (0, 1)), pa.array([len(u) for u in sets], pa.int64()), set_keys(sets), flat], names=["id", "at", "n_shingles", "set_key", "bands"])

    return frame.mapInArrow(work, T.StructType([*frame.schema.fields[:2], *fields]))


def shingle_arrays(texts: DataFrame) -> DataFrame:
    """``rep`` (the set's key), ``shingles`` (the whole set) and ``odd`` (its parities) of each ``text``."""

    def work(batches):
        for batch in batches:
            for _, offsets, data in slices(batch.column(0)):
                sets = list(shingle_sets(offsets, data, WIDTH))
                flat = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(u) for u in sets])].astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
                odd = pa.array([parities(u).tolist() for u in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([set_keys(sets), flat, odd], names=["rep", "shingles", "odd"])

    return texts.select("text").mapInArrow(work, "rep binary, shingles array<long>, odd array<long>")


def bucket_members(classes: DataFrame) -> DataFrame:
    """``key``, ``rep``, ``size``: the rows of every bucket that holds more than one class."""
    rows = classes.select("rep", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(shared, "key").select("key", "rep", "size")


def star_edges(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a``, ``b``: each member with its bucket's centre, unless their sizes alone rule it out.

    The centre is the member with the least key, so that a group that meets in many buckets has few centres.
    """
    centres = members.groupBy("key").agg(F.min("rep").alias("b"), F.min_by("size", "rep").alias("size_b"))
    pairs = members.join(centres, "key").where(f"rep <> b AND 100 * least(size, size_b) >= {percent} * greatest(size, size_b)")
    return pairs.select("b", F.col("rep").alias("a")).distinct()


def mixed_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key``, ``rep``, ``size``, ``label`` of the buckets that hold more than one component."""
    rows = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    return rows.join(mixed, "key").select("key", "rep", "size", "label")


def could(shared: str, size: str, other: str, percent: int = PERCENT) -> str:
    """Alike sets have at least percent / (100 + percent) of their sizes' sum in common; ``shared`` is as much as one side can."""
    return f"{100 + percent} * {shared} >= {percent} * ({size} + {other})"


def shareable(suspects: DataFrame, sets: DataFrame, rare: int = RARE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Facts of each of ``suspects`` (``rep``, ``label``, ``size``), and the posting lists of rare shingles.

    ``rep``, ``label``, ``size``, ``shared`` (how many of its shingles occur in any other component) and ``common``
    (how many of those are in more than ``rare`` suspects); and ``shingle`` besides for each of the others that it shares.
    Suspects that share too little for any set of a like size are left out of both.
    """
    parity = [c for c in sets.columns if c == "odd"]  # sets that come without parities are compared without that bound
    placed = sets.join(suspects, "rep").select("rep", "label", "size", F.explode("shingles").alias("shingle"))
    seen = placed.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most").select("shingle", "n")
    met = placed.join(seen, "shingle").groupBy("rep", "label", "size").agg(F.count("*").alias("shared"), F.count_if(F.col("n") > rare).alias("common"), F.collect_list(F.when(F.col("n") <= rare, F.col("shingle"))).alias("rares"))
    facts = stored(met.where(could("shared", "size", f"ceil({percent} * size / 100)", percent)).join(sets.select("rep", *parity), "rep"), "facts")
    return facts.drop("rares"), facts.select(*parity, "rep", "label", "size", "shared", F.explode("rares").alias("shingle"))


def cross_edges(mixed: DataFrame, facts: DataFrame, postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a``, ``b``: pairs in different components that could be alike enough.

    Alike sets x and y have at least percent / (100 + percent) * (|x| + |y|) shingles in common.
    Either one of these is rare: then the pair meets in its short posting list. Or all are common
    ones: then both have that many common shingles, and the pair is looked for in the buckets. Both
    bounds are exact. They leave out the members of a group of copies that are too far from the
    rest, of which there can be as many as copies. So does a third: sets differ in no fewer shingles than their parities.
    """

    parity = [c for c in facts.columns if c == "odd"]

    def pairs(rows: DataFrame, on: str, count: str, more: tuple[str, ...] = (), also: str = "true") -> DataFrame:
        a = rows.select(on, F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col(count).alias("count_a"), *parity, *map(F.col, more))
        b = a.toDF(on, "b", "label_b", "size_b", "count_b", *[f"{c}_b" for c in (*parity, *more)])
        apart = " + ".join(f"bit_count(odd[{k}] ^ odd_b[{k}])" for k in range(ODD)) if parity else "0"
        alike = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) AND {could('count_a', 'size_a', 'size_b', percent)} AND {could('count_b', 'size_b', 'size_a', percent)} AND {100 + percent} * ({apart}) <= {100 - percent} * (size_a + size_b)"
        return a.join(b, on).where(f"a < b AND label_a <> label_b AND {alike} AND {also}").select("b", "a")

    within = mixed.select("key", "rep").join(facts.where(could("common", "size", f"ceil({percent} * size / 100)", percent)), "rep")
    # A pair counts in the first of the buckets that both are in, of which a member has one a band at most.
    keyed = stored(within.groupBy("rep", "label", "size", "common", *parity).agg(F.array_sort(F.collect_list("key")).alias("keys")), "bucket-rows").withColumn("key", F.explode("keys"))
    return pairs(keyed, "key", "common", ("keys",), "array_intersect(keys, keys_b)[0] = key").union(pairs(postings, "shingle", "shared")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose whole shingle sets are alike enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("in_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("in_b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("in_a", "in_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("in_a") + F.size("in_b") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``rep``, ``label``: the least key reachable over the edges, for every key that has one.

    Each round takes the least label among neighbours and then the label of that label,
    and is stored; rounds end when no label changes, about log2 of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels.rep == near.a).select("rep", F.least("label", "seen").alias("hop"), F.col("label").alias("was"))
        jump = step.select(F.col("rep").alias("hop"), F.col("hop").alias("far"))
        moved = stored(step.join(jump, "hop", "left").select("rep", F.least("hop", "far").alias("label"), "was"), "labels")
        labels = moved.select("rep", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` of every row of ``docs``."""
    sketch = stored(sketches(docs, doc_id, text), "sketches")
    holding = sketch.where("n_shingles > 0")
    classes = holding.groupBy("set_key").agg(F.min(F.struct("id", "at")).alias("first"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands")).withColumnRenamed("set_key", "rep")
    members = stored(bucket_members(classes), "members")
    # One row stands for a class: its text is looked up again by id and hash, and the set by its own key.
    firsts = holding.groupBy("set_key").agg(F.min(F.struct("id", "at")).alias("first")).join(members.select("rep").distinct(), F.col("set_key") == F.col("rep"), "left_semi").select(F.col("first.id").alias("of"), "first.at")
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).join(firsts, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("at")), "left_semi")
    sets = stored(shingle_arrays(texts).dropDuplicates(["rep"]), "sets")
    labels = components(confirmed(star_edges(members), sets))
    mixed = stored(mixed_members(members, labels), "mixed")
    named = holding.groupBy("set_key").agg(F.min("id").alias("id")).withColumnRenamed("set_key", "rep").join(labels, "rep", "left").select("rep", "id", F.coalesce("label", "rep").alias("label"))
    more = None
    if not mixed.isEmpty():
        facts, postings = shareable(mixed.select("rep", "label", "size").distinct(), sets)
        more = stored(confirmed(cross_edges(mixed, facts, postings), sets), "links")
    if more is not None and not more.isEmpty():
        # Few links are left: they join components, whose labels take the place of keys.
        ends = more.join(labels.toDF("a", "label_a"), "a", "left").join(labels.toDF("b", "label_b"), "b", "left")
        tops = components(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()).toDF("label", "top")
        named = named.join(tops, "label", "left").select("rep", "id", F.coalesce("top", "label").alias("label"))
    named = stored(named, "named")
    found = named.select("rep", "label").join(named.groupBy("label").agg(F.min("id").alias("component_id")), "label").select(F.col("rep").alias("set_key"), "component_id")
    return sketch.join(found, "set_key", "left").select("id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
