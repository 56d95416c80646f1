"""Removal of repeated byte strings by induced suffix sorting of shards.

A string of ``length`` bytes is a repeat if it also starts anywhere else. Every
such string belongs to the least hash of its ``ANCHOR``-byte substrings, so
equal strings belong to equal hashes: neighbouring strings with one anchor make
a segment, segments are dealt to shards by the anchor's hash, and all that is
left to find lies inside one shard. Equal segments are one, with a count; only
anchors of more than one segment are sorted, a shard in runs of whole anchors.

An anchor with more than ``PART_BYTES`` of different segments (a passage in many
contexts) is split first. Its strings fall into ranges of their anchor's place; all strings of a
range hold the same bytes around the anchor, and the hash of those is the new key.
Equal strings have equal places and bytes, so they stay together; what is still too
large is split into narrower ranges, down to one place, where the key is the whole string
and equal rows are all that is left.

A shard's suffixes are sorted by induction (Nong, Zhang and Chan 2009; on disk:
Bingmann, Fischer and Osipov 2013): leftmost S-suffixes are sorted through
their names, and induce all others through one queue for each first byte. Queues
hold suffixes in sorted order and spill to an unnamed scratch file of the task above
``QUEUE_BYTES``; nothing of it outlives the task. Neighbours in suffix order that
have ``length`` bytes in common are repeats; hashes pick them out and bytes confirm them.

Cases: null and empty texts have nothing to remove; texts shorter than
``length`` neither; rows are told apart by id and text, and an id may be null or repeated;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgloom.llm.bytesvec import mix, powers, prefix_sums, slices
from kgloom.llm.common import stored

LENGTH, ANCHOR = 400, 128
SHARD_BYTES, PART_BYTES, QUEUE_BYTES = 4 << 20, 1 << 20, 256 << 20


class Queue:
    """Arrays in the order in which they came, in memory or, above a limit that all queues of a sort share, in a scratch file."""

    def __init__(self, room: list[int], scratch):
        self.parts, self.room, self.scratch = [], room, scratch

    def put(self, x: np.ndarray) -> None:
        if not len(x):
            return
        if self.room[0] >= x.nbytes:
            self.room[0] -= x.nbytes
            self.parts.append(x)
        else:
            at = self.scratch.seek(0, 2)
            self.scratch.write(x.tobytes())
            self.parts.append((at, len(x), x.dtype))

    def take(self, first: int = 0) -> np.ndarray:
        """All arrays from the ``first`` on, as one."""
        out = []
        for part in self.parts[first:]:
            if isinstance(part, tuple):
                self.scratch.seek(part[0])
                part = np.frombuffer(self.scratch.read(part[1] * part[2].itemsize), part[2])
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def types_of(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last, a unique least value, included)."""
    change = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(change, np.arange(len(t) - 1))
    after = np.append(change + 1, len(t) - 1)[at]
    return np.append(t[:-1] < t[after], True)


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, room: list[int], scratch) -> np.ndarray:
    """All suffixes in order, from the leftmost S-suffixes (``seeds``) in order; ``t`` ends with a unique least value."""
    values = np.unique(t)
    place = np.zeros(int(values[-1]) + 1, np.int64)
    place[values] = np.arange(len(values))
    first = place[t[seeds]]
    order = np.argsort(first, kind="stable")
    groups = np.searchsorted(first[order], np.arange(len(values) + 1))
    seeded = [seeds[order[groups[k] : groups[k + 1]]] for k in range(len(values))]

    def sent(scanned: np.ndarray, queues: list[Queue], want_smaller: bool) -> None:
        before = scanned[scanned > 0] - 1
        before = before[smaller[before] == want_smaller]
        bucket = place[t[before]]
        order = np.argsort(bucket, kind="stable")
        before, bucket = before[order], bucket[order]
        if not len(bucket):
            return
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            queues[bucket[a]].put(before[a:b])

    larger = [Queue(room, scratch) for _ in values]
    for k in range(len(values)):
        done = 0
        while done < len(larger[k].parts):  # suffixes that begin with the same value twice or more follow in waves
            upto = len(larger[k].parts)
            wave = larger[k].take(done)
            done = upto
            sent(wave, larger, False)
        sent(seeded[k], larger, False)
    small = [Queue(room, scratch) for _ in values]
    for k in reversed(range(len(values))):
        if k == 0:
            small[0].put(np.array([len(t) - 1]))
        done = 0
        while done < len(small[k].parts):
            upto = len(small[k].parts)
            wave = small[k].take(done)
            done = upto
            sent(wave, small, True)
        sent(larger[k].take()[::-1], small, True)
    return np.concatenate([x for k in range(len(values)) for x in (larger[k].take(), small[k].take()[::-1])])


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a short string of names, by doubling the length that ranks stand for."""
    rank, width = names.astype(np.int64), 1
    while True:
        far = np.zeros(len(rank), np.int64)
        far[:-width] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (int(far.max()) + 2) + far
        values, rank = np.unique(key, return_inverse=True)
        if len(values) == len(rank) or width >= len(rank):
            return np.argsort(rank, kind="stable")
        width *= 2


def suffix_order(t: np.ndarray, memory: int = 1 << 22, queue_bytes: int = QUEUE_BYTES) -> np.ndarray:
    """The suffixes of ``t`` (which ends with a unique least value) in order.

    The string of names of the substrings between leftmost S-suffixes is sorted by recursion until it has at most ``memory`` names.
    """
    if len(t) == 1:
        return np.zeros(1, np.int64)
    smaller = types_of(t)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    with tempfile.TemporaryFile() as scratch:
        if len(seeds) > 1:
            rough = induce(t, smaller, seeds, [queue_bytes], scratch)
            is_seed = np.zeros(len(t), bool)
            is_seed[seeds] = True
            ordered = rough[is_seed[rough]]
            stop = np.zeros(len(t), np.int64)
            stop[seeds] = np.append(seeds[1:] + 1, len(t))
            # Substrings between seeds are equal if their lengths and hashes are.
            sums = np.zeros(len(t) + 1, np.uint64)
            np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers(len(t))[0], out=sums[1:])
            inside = mix((sums[stop[ordered]] - sums[ordered]) * powers(len(t) + 1)[1][ordered])
            size = stop[ordered] - ordered
            new = np.r_[True, (inside[1:] != inside[:-1]) | (size[1:] != size[:-1])]
            name = np.zeros(len(t), np.int64)
            name[ordered] = np.cumsum(new) - 1
            names = name[seeds]
            if new.all():
                seeds = ordered
            elif len(names) <= memory:
                seeds = seeds[doubled(names)]
            else:
                seeds = seeds[suffix_order(names, memory, queue_bytes)]
        scratch.seek(0)
        scratch.truncate()
        return induce(t, smaller, seeds, [queue_bytes], scratch)


def repeated_starts(segments: list[bytes], length: int, queue_bytes: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each segment the places of strings of ``length`` bytes that also start at another place of any segment."""
    sizes = np.array([len(s) for s in segments])
    # Values: 0 ends the text, 1 ends a segment, bytes follow.
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 1
    t = np.append(t, 0)
    begins = ends - sizes
    counts = np.maximum(0, sizes - length + 1)
    valid = np.zeros(len(t), bool)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    valid[np.repeat(begins, counts) + within] = True
    order = suffix_order(t, queue_bytes=queue_bytes)
    order = order[valid[order]]
    sums = prefix_sums(np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8))
    hashes = (sums[order + length] - sums[order]) * powers(len(sums))[1][order]
    alike = np.flatnonzero(hashes[1:] == hashes[:-1])
    repeated = np.zeros(len(t), bool)
    raw = np.append(t, np.zeros(length, t.dtype)).astype(np.uint16)
    for i in range(0, len(alike), 2048):
        a, b = order[alike[i : i + 2048]], order[alike[i : i + 2048] + 1]
        span = np.arange(length)
        same = (raw[a[:, None] + span] == raw[b[:, None] + span]).all(axis=1)
        repeated[a[same]] = repeated[b[same]] = True
    return [np.flatnonzero(repeated[a : a + n]) if n else np.zeros(0, np.int64) for a, n in zip(begins, counts, strict=True)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values."""
    n = len(x)
    padded = np.append(x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


def window_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """A hash of every substring of ``anchor`` bytes."""
    sums = prefix_sums(data)
    return mix((sums[anchor:] - sums[:-anchor]) * powers(len(data) + 1)[1][: len(data) - anchor + 1])


def segments_of(offsets: np.ndarray, data: np.ndarray, length: int, anchor: int):
    """Arrays (text, anchor's hash, start in the slice, how many strings start in it) of the segments of a slice of texts."""
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - length + 1)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(data, anchor)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    at = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return text[first], h[at[first]], start[first], np.diff(np.append(first, len(start)))


def segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``anchor``, ``seg`` (128 bits of its bytes), ``id``, ``start``, ``n`` of every segment of every text."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("seg", T.BinaryType()), docs.schema["id"], T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])

    def work(batches):
        for batch in batches:
            for first, offsets, data in slices(batch.column("text"), 1 << 19):
                text, anchors, start, n = segments_of(offsets, data, length, anchor)
                view = memoryview(data)
                segs = [xxhash.xxh3_128_digest(view[a : a + k + length - 1]) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                ids = batch.column("id").take(pa.array(text + first, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(segs, pa.binary()), ids, pa.array(start - offsets[text] if len(text) else start, pa.int64()), pa.array(n, pa.int64())], names=["anchor", "seg", "id", "start", "n"])

    return docs.select("id", "text").mapInArrow(work, schema)


def lead_of(segment: bytes, length: int, anchor: int) -> int:
    """How many bytes of a segment stand before its anchor."""
    h = window_hashes(np.frombuffer(segment[:length], np.uint8), anchor)
    return int(np.argmin(h >> np.uint64(32)))


def range_widths(length: int, anchor: int) -> list[int]:
    """Widths of the ranges of places of an anchor in a string, wider ones first, down to one."""
    out = [1 << max(0, (length - anchor).bit_length() - 2)]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 4))
    return out


def parts_of(segment: bytes, lead: int, key: int, width: int, length: int, anchor: int):
    """(key, offset, lead, bytes) of a segment's strings for each range of ``width`` places of the anchor."""
    strings = len(segment) - length + 1
    for low in range((lead - strings + 1) // width * width, lead + 1, width):
        high = min(low + width - 1, length - anchor)
        first, last = min(high, lead), max(low, lead - strings + 1)
        core = segment[lead - low : lead - high + length]
        own = xxhash.xxh3_64_intdigest(core, (key + low * 0x9E3779B97F4A7C15 + width) % (1 << 64)) - (1 << 63)
        yield own, lead - first, first, segment[lead - first : lead - last + length]


def split_hot(pieces: DataFrame, length: int, anchor: int, part_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``sorted later`` (``id``, ``anchor``, ``copies``, ``start``, ``bytes``, of at most ``part_bytes`` for each anchor) and spans found on the way.

    ``pieces`` are the different segments of anchors that are too large. Equal parts become one before they are counted.
    """
    id_field, longs = pieces.schema["id"], [T.StructField(c, T.LongType()) for c in ("anchor", "copies", "start", "lead")]
    schema = T.StructType([id_field, *longs, T.StructField("bytes", T.BinaryType()), T.StructField("seg", T.BinaryType())])
    hot = pieces.withColumn("lead", F.lit(-1).cast("long"))
    done = spans = None
    for width in range_widths(length, anchor):

        def split(batches, width=width):
            for batch in batches:
                rows = []
                for i, key, copies, start, raw, lead in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "copies", "start", "bytes", "lead")), strict=True):
                    lead = lead_of(raw, length, anchor) if lead < 0 else lead
                    rows += [(i, own, copies, start + off, at, part, xxhash.xxh3_128_digest(part)) for own, off, at, part in parts_of(raw, lead, key, width, length, anchor)]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                types = [batch.schema.field("id").type, *[pa.int64()] * 4, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        parts = stored(hot.select("id", "anchor", "copies", "start", "bytes", "lead").mapInArrow(split, schema), "parts")
        classes = stored(parts.groupBy("anchor", "seg").agg(F.count("*").alias("met"), F.sum("copies").alias("copies"), F.min(F.struct("id", "start", "lead", "bytes")).alias("first")), "part-classes")
        equal = classes.where("met > 1").select("anchor", "seg")
        copied = parts.join(equal, ["anchor", "seg"]).select("id", "start", (F.col("start") + F.length("bytes")).alias("stop"))
        spans = copied if spans is None else spans.union(copied)
        several = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.length("first.bytes")).alias("size")).where("classes > 1").select("anchor", "size")
        rest = classes.join(several, "anchor").select("first.id", "anchor", "copies", "first.start", "first.bytes", "first.lead", "size")
        small = (rest if width == 1 else rest.where(F.col("size") <= part_bytes)).select("id", "anchor", "copies", "start", "bytes")
        done = small if done is None else done.union(small)
        hot = rest.where(F.col("size") > part_bytes).drop("size")
        if width == 1 or hot.isEmpty():
            break
    return done, spans


def packed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["id"], T.StructField("packed", T.BinaryType())])

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([squeeze((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())], names=["id", "packed"])

    return docs.select("id", "text").mapInArrow(work, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, part_bytes: int = PART_BYTES, packs: DataFrame | None = None) -> DataFrame:
    """``id``, ``start``, ``stop``: stretches of repeated strings, in bytes; they may overlap. ``docs`` has ``id`` and ``text``.

    ``packs`` is ``packed(docs)`` where it is stored already. What a worker made is stored before the next
    reads it: a join between them may move nothing, and then each task would keep two or three workers.
    """
    packs = stored(packed(docs), "packed") if packs is None else packs
    every = stored(segments(docs, length, anchor), "segments")
    # Stored, as is what else is counted by anchor: a join of two stored tables is one whose hot keys Spark splits.
    shared = stored(every.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1").select("anchor"), "shared")
    candidates = stored(every.join(shared, "anchor"), "candidates")
    classes = candidates.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("id", "start", "n")).alias("first"))
    classes = stored(classes, "classes")
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.col("first.n") + length).alias("size")).where("classes > 1").select("anchor", (F.col("size") > part_bytes).alias("hot")), "several")
    copied = candidates.join(classes.where("copies > 1").select("anchor", "seg"), ["anchor", "seg"]).select("id", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    sought = stored(classes.join(several, "anchor").select("anchor", "copies", "hot", "first.*"), "sought")
    id_field = docs.schema["id"]

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = [(i, c["anchor"], c["copies"], c["start"], raw[c["start"] : c["start"] + c["n"] + length - 1]) for i, p, cs in zip(batch.column("id").to_pylist(), batch.column("packed"), batch.column("cuts"), strict=True) for raw in [unpack(p.as_py())] for c in cs.as_py()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), *(pa.array(columns[k], pa.int64()) for k in (1, 2, 3)), pa.array(columns[4], pa.binary())], names=["id", "anchor", "copies", "start", "bytes"])

    cut_schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in ("anchor", "copies", "start")], T.StructField("bytes", T.BinaryType())])

    def fetch(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy("id").agg(F.collect_list(F.struct("anchor", "copies", "start", "n")).alias("cuts"))
        return packs.join(wanted, "id").mapInArrow(cut, cut_schema)

    size = sought.where("NOT hot").agg(F.sum(F.col("n") + length)).head()[0] or 0
    fetched, hot = fetch(sought.where("NOT hot")), sought.where("hot")
    if not hot.isEmpty():
        parts, equal = split_hot(stored(fetch(hot), "hot"), length, anchor, part_bytes)
        parts = stored(parts, "split")
        size += parts.agg(F.sum(F.length("bytes"))).head()[0] or 0
        fetched, copied = fetched.union(parts.select(*fetched.columns)), copied.union(equal)
    shards = max(1, -(-size // SHARD_BYTES))
    fetched = fetched.repartition(int(shards), "anchor").sortWithinPartitions("anchor")

    def repeats(rows: list) -> pa.RecordBatch:
        out = []
        for (i, _, c, s, _), hits in zip(rows, repeated_starts([r[4] for r in rows], length), strict=True):
            if c > 1 or not len(hits):
                continue
            cuts = np.flatnonzero(np.r_[True, hits[1:] != hits[:-1] + 1])
            out += [(i, int(s + a), int(s + b + length)) for a, b in zip(hits[cuts], hits[np.append(cuts[1:], len(hits)) - 1], strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, pa.int64(), pa.int64()), strict=True)], names=["id", "start", "stop"])

    id_type = to_arrow_type(id_field.dataType)

    def sort(batches):
        # A shard comes in the order of its anchors; whole anchors make a run, which is all that is held.
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "copies", "start", "bytes")), strict=True):
                if held >= part_bytes and row[1] != rows[-1][1]:
                    yield repeats(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield repeats(rows)

    found = fetched.mapInArrow(sort, T.StructType([id_field, T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    return copied.union(found)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes) of each row."""
    named = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A key of id and text that is never null; the id itself comes along to the result.
    rows = named.select(F.struct(F.xxhash64("doc", "text").alias("key"), "doc").alias("id"), "text")
    packs = stored(packed(rows), "packed")
    keyed = rows.select(F.col("id.key").alias("id"), "text")
    spans = repeated_spans(keyed, length, anchor, part_bytes, packs.select(F.col("id.key").alias("id"), "packed")).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("id", "key")
    joined = packs.select(F.col("id.doc").alias("id"), "id.key", "packed").join(spans, "key", "left").drop("key")
    schema = T.StructType([T.StructField("id", named.schema["doc"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, count, kept = [], [], [], []
            for p, ss in zip(batch.column("packed"), batch.column("spans"), strict=True):
                raw = unpack(p.as_py())
                out, at, runs = [], 0, 0
                reach = -1
                for a, b in sorted((s["start"], s["stop"]) for s in ss.as_py() or ()):
                    if a > reach:
                        runs += 1
                        out.append(raw[at:a])
                    reach = at = max(reach, b)
                out.append(raw[at:])
                rest = b"".join(out)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                count.append(runs)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, count)), pa.array(kept, pa.binary())], names=schema.names)

    return joined.mapInArrow(work, schema)
