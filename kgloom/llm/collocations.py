"""Collocations: phrases of two or three words that stand together more often than their parts would.

Frequent phrases are found in two passes. In the first, every block of texts says
how often it holds each n-gram, by hash; a hash partition merges what the blocks
say into one Misra-Gries summary (Misra and Gries 1982; merging after Agarwal et
al., PODS 2012), whose capacity is more than the partition's mass divided by the
least count, so that no n-gram that is frequent enough can have been lost. What
survives is counted exactly, over the same messages and by hash; each block is
told which of its n-grams are left, reads its texts again and counts those by
their words. Counts by words are the result: hashes only decide what is counted.

A block's count of an n-gram is cut at the least count in the messages, as it is
frequent then whatever others say; so a word that makes up a third of a corpus
adds no more to a partition than any other does.

Cases: null text is empty, null language is ``und``; empty texts have no words;
repeated rows count as often as they stand there; a text is read whole and is in
one block, however long; ties end at the phrase's UTF-8 bytes; columns beyond
those named are ignored; an empty table gives an empty result. Products are of 38
decimal digits, for counts of up to 10^16.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.bytesvec import LOWER, mix, slices
from kgloom.llm.common import stored

#: Bytes of text in a block, about; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 22
#: Occurrences in a hash partition, about.
PART_MASS = 1 << 23

#: 0 within a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def in_blocks(docs: DataFrame, lang: str = "lang", col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block``, ``size``, ``payload``: the texts and languages that a task reads, in blocks of about ``block_bytes`` that are compressed as one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), pa.array([_ipc(held)], pa.binary())], ["block", "size", "payload"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                # As many texts as fill the block, the one that does included.
                stop = min(len(ends), int(np.searchsorted(ends, before + block_bytes - size)) + 1)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= block_bytes:
                    yield row()
                    block, held, size = block + 1, [], 0
        if held:
            yield row()

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col, F.lit("")).alias("text"))
    return named.mapInArrow(work, "block long, size long, payload binary")


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _block(payload: bytes) -> tuple[pa.Array, pa.Array]:
    """Languages and texts of a block."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return tuple(x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (table["lang"], table["text"]))


class Grams:
    """The n-grams of a block: distinct ones of each length with their counts, and a hash of each."""

    def __init__(self, langs: pa.Array, texts: pa.Array, longest: int):
        joins, lang_ids, spelt = [], [], []
        names = langs.dictionary_encode()
        self.langs = names.dictionary
        lang_of_row = names.indices.to_numpy(zero_copy_only=False)
        for row, offsets, data in slices(texts):
            kind = KIND[data]
            inside = kind == 0
            starts, ends = inside.copy(), inside.copy()
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            bounds = offsets[(offsets > 0) & (offsets < len(data))]
            starts[bounds] = inside[bounds]
            ends[bounds - 1] = inside[bounds - 1]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            text_of = np.searchsorted(offsets, s, "right") - 1
            piece = np.cumsum(kind == 2)[s]
            # Joined to the word that follows.
            joined = np.zeros(len(s), bool)
            joined[:-1] = (piece[1:] == piece[:-1]) & (text_of[1:] == text_of[:-1])
            at = np.concatenate([[0], np.cumsum(e - s)])
            spelt.append(pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LOWER[data[inside]].tobytes())))
            joins.append(joined)
            lang_ids.append(lang_of_row[row + text_of])
        coded = pa.chunked_array(spelt, pa.large_string()).combine_chunks().dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        joined = np.concatenate(joins) if joins else np.zeros(0, bool)
        self.lang_of = np.concatenate(lang_ids).astype(np.int64) if lang_ids else np.zeros(0, np.int64)
        self.word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_pylist()], np.uint64)
        self.lang_hash = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        v, key, place = max(1, len(self.words)), self.lang_of, np.arange(len(self.ids))
        for n in range(1, longest + 1):
            if n > 1:
                # Places whose n-gram still lies within a piece.
                held = joined[place + n - 2]
                place, key = place[held], key[held]
            if len(key) and int(key.max()) >= (1 << 62) // v:
                key = np.unique(key, return_inverse=True)[1]
            key = key * v + self.ids[place + n - 1]
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            self.found.append((place[first], counts))

    def hashes(self, n: int) -> np.ndarray:
        """64 bits for each distinct n-gram and its language."""
        at = self.found[n - 1][0]
        h = mix(self.lang_hash[self.lang_of[at]] + np.uint64(n))
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ self.word_hash[self.ids[at + k]])
        return h

    def phrases(self, n: int, chosen: np.ndarray) -> pa.Array:
        at = self.found[n - 1][0][chosen]
        spelt = [self.words.take(pa.array(self.ids[at + k])) for k in range(n)]
        return spelt[0] if n == 1 else pc.binary_join_element_wise(*spelt, pa.scalar(" ", pa.large_string()))


    def message(self, parts: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams, as ``placed`` gives them, in order, and how often each is there, up to ``cap``."""
        at = np.concatenate([placed(self.hashes(n + 1), parts) for n in range(len(self.found))])
        counts = np.concatenate([c for _, c in self.found])
        order = np.argsort(at)
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        return at[starts], np.minimum(np.add.reduceat(counts[order], starts), cap) if len(at) else counts


def runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def placed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition and 32 bits within it, as one number."""
    return ((hashes % np.uint64(parts)) << np.uint64(32)) | (hashes >> np.uint64(32))


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as steps, byte by byte, and counts of one byte."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def unpack(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(payload, 5 * n, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel(), dtype=np.uint32), raw[4 * n :]


class Summary:
    """A Misra-Gries summary: of any mass that it takes in, no count falls short by more than the mass over ``capacity + 1``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merges the counts of a block; these wait until there are as many as the summary may hold."""
        self.waiting.append((keys, counts.astype(np.int64)))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts, keys = np.add.reduceat(counts[order], starts) if len(keys) else counts, keys[starts]
        if len(keys) > self.capacity:
            # The counter after the last that there is room for is taken from all.
            counts = counts - np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among sorted ``keys``, and where."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return (keys[at] == wanted, at) if len(keys) else (np.zeros(len(wanted), bool), at)


def survivors(messages: list[tuple[bytes, int]], mass: int, least: int) -> list[np.ndarray]:
    """For the messages of one hash partition, which keys of each are counted ``least`` times or more in all of them."""
    summary = Summary(mass // least + 1)
    for payload, n in messages:
        summary.add(*unpack(payload, n))
    summary.merge()
    exact = np.zeros(len(summary.keys), np.int64)
    for payload, n in messages:
        keys, counts = unpack(payload, n)
        held, at = found_in(summary.keys, keys)
        exact[at[held]] += counts[held]
    frequent = summary.keys[exact >= least]
    return [found_in(frequent, unpack(payload, n)[0])[0] for payload, n in messages]


def pack_counts(names: list[str], codes: np.ndarray, phrases: list[str], counts: np.ndarray) -> tuple[int, bytes]:
    """Counts of phrases in order, which compress well; the size before and the bytes. No phrase holds a line feed."""
    raw = pickle.dumps((names, codes.astype(np.uint32), counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), "\n".join(phrases)))
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(size: int, payload: bytes) -> pa.Table:
    names, codes, planes, text = pickle.loads(pa.decompress(payload, size, codec="zstd", asbytes=True))
    counts = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return pa.table({"lang": pa.array(names, pa.large_string()).take(pa.array(codes)), "phrase": pa.array(text.split("\n"), pa.large_string()), "n": counts})


def frequent_grams(docs: DataFrame, least: int = 10, longest: int = 3, lang: str = "lang", col: str = "text", block_bytes: int = BLOCK_BYTES, part_mass: int = PART_MASS) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``n``: every n-gram of one to ``longest`` words with ``least`` occurrences or more in its language; with ``words`` 0 and an empty phrase, all words of a language."""
    texts = stored(in_blocks(docs, lang, col, block_bytes), "blocks")
    size = texts.agg(F.sum("size")).head()[0] or 0
    # A word and the gap behind it take about six bytes; this is for size alone and the guarantee does not rest on it.
    parts = int(max(1, -(-size * longest // (6 * part_mass))))
    cap = min(least, 255)
    high = np.uint64(32)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                at, seen = Grams(*_block(payload.as_buffer()), longest).message(parts, cap)
                part, keys = (at >> high).astype(np.int64), at.astype(np.uint32)
                spans = runs(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[x] for x, _ in spans], pa.int64()),
                        pa.array(np.full(len(spans), block, np.int64)),
                        pa.array([y - x for x, y in spans], pa.int32()),
                        pa.array([seen[x:y].sum() for x, y in spans], pa.int64()),
                        pa.array([pack(keys[x:y], seen[x:y]) for x, y in spans], pa.binary()),
                    ],
                    ["part", "block", "n", "mass", "payload"],
                )

    def decide(messages: pd.DataFrame) -> pd.DataFrame:
        left = survivors(list(zip(messages["payload"], messages["n"], strict=True)), int(messages["mass"].sum()), cap)
        return pd.DataFrame({"to": messages["block"], "part": messages["part"], "stays": [np.packbits(k).tobytes() for k in left]})

    counts_schema = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())])

    def count(block: pa.Table, replies: pa.Table) -> pa.Table:
        """The block's own counts of what survived, and of all words as those of an empty phrase, by hash partition."""
        grams = Grams(*_block(block["payload"][0].as_buffer()), longest)
        at, _ = grams.message(parts, cap)
        stays = np.zeros(len(at), bool)
        told = dict(zip(replies["part"].to_pylist(), replies["stays"].to_pylist(), strict=True))
        for x, y in runs((at >> high).astype(np.int64)):
            if bits := told.get(int(at[x] >> high)):
                stays[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x)
        totals = np.bincount(grams.lang_of, minlength=len(grams.langs))
        where, codes, spelt, counts = [(grams.lang_hash % np.uint64(parts)).astype(np.int64)], [np.arange(len(totals))], [pa.array([""] * len(totals), pa.large_string())], [totals]
        for n, (places, seen) in enumerate(grams.found, 1):
            mine = placed(grams.hashes(n), parts)
            chosen = np.flatnonzero(stays[np.searchsorted(at, mine)])
            where.append((mine[chosen] >> high).astype(np.int64))
            codes.append(grams.lang_of[places[chosen]])
            spelt.append(grams.phrases(n, chosen))
            counts.append(seen[chosen])
        made = pa.table({"part": np.concatenate(where), "code": np.concatenate(codes), "phrase": pa.chunked_array(spelt), "n": np.concatenate(counts)}).sort_by([("part", "ascending"), ("phrase", "ascending")])
        part, names = made["part"].to_numpy(), grams.langs.to_pylist()
        codes, phrases, counts = made["code"].to_numpy(), made["phrase"].to_pylist(), made["n"].to_numpy()
        spans = runs(part)
        packed = [pack_counts(names, codes[x:y], phrases[x:y], counts[x:y]) for x, y in spans]
        return pa.table([[part[x] for x, _ in spans], [p[0] for p in packed], [p[1] for p in packed]], schema=counts_schema)

    grams_schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def total(rows: pa.Table) -> pa.Table:
        """Sums over all blocks, by the words themselves."""
        held, waiting, n = None, [], 0

        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        for raw, payload in zip(rows["size"].to_pylist(), rows["payload"].to_pylist(), strict=True):
            waiting.append(unpack_counts(raw, payload))
            n += waiting[-1].num_rows
            if n > max(1 << 18, held.num_rows if held else 0):
                held, waiting, n = summed([*([held] if held else []), *waiting]), [], 0
        held = summed([*([held] if held else []), *waiting]).select(["lang", "phrase", "n"])
        return held.filter(pc.or_(pc.greater_equal(held["n"], least), pc.equal(held["phrase"], ""))).cast(grams_schema)

    messages = texts.select("block", "payload").mapInArrow(tell, "part long, block long, n int, mass long, payload binary")
    replies = messages.groupBy("part").applyInPandas(decide, "to long, part long, stays binary")
    counted = texts.select("block", "payload").groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(count, "part long, size long, payload binary")
    sums = counted.groupBy("part").applyInArrow(total, "lang string, phrase string, n long")
    return sums.select("lang", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "phrase", "n")


def scored(grams: DataFrame, share: int = 50) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``: each phrase of ``frequent_grams`` at the cut that speaks least for it, but those that a longer one holds in ``share`` hundredths of their places.

    Both parts of a phrase are as frequent as itself, so none is missing.
    """
    phrases = grams.where("words >= 2").select("lang", "phrase", F.col("words"), F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    known = grams.where("words >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    least = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    longer = phrases.where("words >= 3").select("lang", F.col("a").alias("around"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = least.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, k: int = 2000, least: int = 10, longest: int = 3, **sizes: int) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``k`` of each language by score, count and phrase.

    Every task ranks what it has and sends on ``k`` of a language at most.
    """
    grams = stored(frequent_grams(docs, least, longest, **sizes), "grams")
    totals = grams.where("words = 0").select("lang", F.col("n").alias("total"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(grams).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
