"""Alignment of two tokenizers: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) lie over the same bytes.

Both encode a blank and the text, without special tokens, so that the tokens of
either side lie end to end over the same bytes. A batch of documents is laid end
to end too. An as-of join on starts gives, for each token of one side, the token
of the other that covers its first byte; both directions together are all
overlaps, as of two tokens that overlap one covers the start of the other.
Tokens that end together are linked, and where they do a group ends.

Two linked tokens end at one byte, so the shorter is an end of the longer: pairs
of ids that can be linked at all number less than the bytes of both
vocabularies. The table of counts is therefore bounded by the vocabularies,
whatever the corpus; it goes to every worker if that bound, worked out before, is
small, and is joined otherwise.

Cases: null and empty texts have no tokens, nor have texts that either side does
not give back byte for byte (normalised or invalid ones); these have zeros and
count nothing. Repeated rows, and rows that share an id, are rows of their own.
A text is encoded whole, whatever its length. Columns beyond those named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.bytesvec import slices
from kgloom.llm.common import small_batches, stored

BYTE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A count, its pair and whether it is the best take so many bytes of a broadcast, about.
PAIR_BYTES, BROADCAST_BYTES = 48, 64 << 20
#: Fixed value: how a byte-level vocabulary of this kind cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs for which two libraries could have tables of different age.
RARE = re.compile(r"[^\x00-\u024f]")
#: Stretches that a worker remembers; then it starts anew.
STRETCHES = 1 << 17
#: Bytes of text that are aligned at a time.
SLICE = 1 << 19
#: Stretches that are encoded as one text.
TOGETHER = 256
#: A blank that is not alone between two other signs.
UNEVEN = re.compile(r"\A | \Z| \s|\s ")


def byte_of_sign() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Sides:
    """The two tokenizers as the bytes of their files, which travel to the tasks."""

    byte_file: bytes
    piece_file: bytes


class Encoders:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, sides: Sides):
        import sentencepiece
        import tiktoken

        self.file = sides.byte_file
        self.b = sentencepiece.SentencePieceProcessor(model_proto=sides.piece_file)
        signs, said = byte_of_sign(), json.loads(sides.byte_file)
        added = {x["content"]: x["id"] for x in said["added_tokens"]}
        vocab = said["model"]["vocab"] | added
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(signs[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # The same merges in their order, which another library applies faster; words are cut by the same rule, and for plain letters by the same tables.
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in added}
        self.fast = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        # What stands behind an id in the text of groups: a comma, or the sign that ends its side of the group.
        self.spelt = pa.array([f"{i}{sign}" for side, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(side))], pa.large_string())

        # Stretches between blanks that were encoded already; no piece holds a blank behind another sign, nor does a byte-level word.
        self.apart = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.forget()

    @cached_property
    def a(self):
        """The library whose file it is, made when a text needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Tokenizer.from_str(self.file.decode())
        made.encode_special_tokens = True
        return made

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = Encoded.of([])

    def encode_bytes(self, plain: list[str]) -> list[list[int]]:
        """Ids of side A, a blank in front."""
        rare = [t for t in plain if RARE.search(t)]
        slow = iter(self.a.encode_batch_fast([" " + t for t in rare], add_special_tokens=False)) if rare else iter(())
        return [next(slow).ids if RARE.search(t) else self.fast.encode_ordinary(" " + t) for t in plain]

    def encode_each(self, plain: list[str]) -> Encoded:
        """Ids of both sides of each of some texts, a blank in front; none where either does not give it back."""
        found = []
        for text, ids, b in zip(plain, self.encode_bytes(plain), self.b.encode(plain, num_threads=1), strict=True):
            whole = b" " + text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, ids)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            found.append((ids, b) if same else None)
        return Encoded.of(found)

    def encode_joined(self, stretches: list[str]) -> "list[Encoded]":
        """The same for stretches, ``TOGETHER`` of them as one text, whose tokens are dealt back by their bytes."""
        runs = [stretches[k : k + TOGETHER] for k in range(0, len(stretches), TOGETHER)]
        plain = [" ".join(x) for x in runs]
        found = []
        for run, text, a, b in zip(runs, plain, self.encode_bytes(plain), self.b.encode(plain, num_threads=1), strict=True):
            whole = b" " + text.encode()
            ends = np.cumsum([len(x.encode()) + 1 for x in run])
            sides = [(np.array(ids, np.int64), np.cumsum(n[ids])) for ids, n in ((a, self.a_len), (b, self.b_len))]
            last = [np.searchsorted(stop, ends, "right") for _, stop in sides]
            fits = all(len(stop) and np.array_equal(stop[k - 1], ends) for (_, stop), k in zip(sides, last, strict=True))
            if fits and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                found.append(Encoded((sides[0][0], sides[1][0]), (last[0], last[1]), np.ones(len(run), bool)))
            else:
                found.append(self.encode_each(run))
        return found

    def encode(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For each side the document of each token, and its id.

        Neither side joins what stands on two sides of a blank between other signs, so a text is encoded by its
        stretches and each stretch once; a text with other white space beside a blank is one stretch.
        """
        plain = [t.decode("utf-8", "replace") for t in texts]
        spoilt = [p.encode() != t for p, t in zip(plain, texts, strict=True)]
        parts = [[] if bad or not p else p.split(" ") if self.apart and not UNEVEN.search(p) else None for p, bad in zip(plain, spoilt, strict=True)]
        wanted = set().union(*(x for x in parts if x))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > STRETCHES:
            self.forget()
            new = wanted
        if new:
            # Many at a time, blanks between them; but those that begin or end in white space by themselves.
            joined = [x for x in new if not (x[0].isspace() or x[-1].isspace())]
            alone = list(new.difference(joined))
            for x in [*(joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)), *([alone] if alone else [])]:
                self.known.update(zip(x, range(len(self.known), len(self.known) + len(x)), strict=True))
            self.held = Encoded.joined([self.held, *self.encode_joined(joined), *([self.encode_each(alone)] if alone else [])])
        whole = [p for p, x in zip(plain, parts, strict=True) if x is None]
        held = Encoded.joined([self.held, self.encode_each(whole)]) if whole else self.held
        place = len(self.known)
        rows: list[int] = []
        counts = []
        for x in parts:
            if x is None:
                rows.append(place)
                place += 1
            else:
                rows.extend(map(self.known.__getitem__, x))
            counts.append(1 if x is None else len(x))
        return held.take(np.array(rows, np.int64), np.repeat(np.arange(len(parts)), counts), len(parts))


@dataclass
class Encoded:
    """Ids of many stretches, one behind another, and where each stretch's end, for both sides; ``same`` is false for those that are not given back."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    same: np.ndarray

    @staticmethod
    def of(found: list) -> Encoded:
        ids, ends = [], []
        for side in (0, 1):
            each = [x[side] if x else [] for x in found]
            ids.append(np.fromiter(chain.from_iterable(each), np.int64))
            ends.append(np.cumsum([len(x) for x in each], dtype=np.int64))
        return Encoded(tuple(ids), tuple(ends), np.array([x is not None for x in found], bool))

    @staticmethod
    def joined(parts: "list[Encoded]") -> "Encoded":
        ids, ends = [], []
        for side in (0, 1):
            before = np.cumsum([0, *(len(x.ids[side]) for x in parts[:-1])])
            ids.append(np.concatenate([x.ids[side] for x in parts]))
            ends.append(np.concatenate([x.ends[side] + n for x, n in zip(parts, before.tolist(), strict=True)]))
        return Encoded((ids[0], ids[1]), (ends[0], ends[1]), np.concatenate([x.same for x in parts]))

    def take(self, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The tokens of the stretches in ``rows``, each of a document; none of documents that are not given back."""
        spoilt = np.bincount(doc[~self.same[rows]], minlength=n) > 0
        rows, doc = rows[~spoilt[doc]], doc[~spoilt[doc]]
        docs, ids = [], []
        for mine, ends in zip(self.ids, self.ends, strict=True):
            starts = np.concatenate([[0], ends])[rows] if len(ends) else rows
            counts = ends[rows] - starts if len(ends) else rows
            before = np.cumsum(counts) - counts
            docs.append(np.repeat(doc, counts))
            ids.append(mine[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))])
        return tuple(docs), tuple(ids)


@lru_cache(maxsize=2)
def encoders(sides: Sides) -> Encoders:
    """Made once in a worker."""
    return Encoders(sides)


def load_sides(byte_path: str = BYTE_PATH, piece_path: str = PIECE_PATH) -> Sides:
    """The files of both tokenizers, which the driver reads."""
    with open(byte_path, "rb") as a, open(piece_path, "rb") as b:
        return Sides(a.read(), b.read())


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together: the one's bytes are an end of the other's."""

    def counted(side: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for x in side:
            out[x] = out.get(x, 0) + 1
        return out

    in_a, in_b = counted(a), counted(b)
    return sum(in_b.get(x[k:], 0) for x in a for k in range(len(x))) + sum(in_a.get(x[k:], 0) for x in b for k in range(1, len(x)))


@dataclass
class Aligned:
    """A batch of documents, one behind another: tokens of both sides and what overlaps.

    ``doc``, ``ids``, ``start``, ``stop`` hold an array for either side; ``over`` the places of overlapping tokens.
    """

    doc: tuple[np.ndarray, np.ndarray]
    ids: tuple[np.ndarray, np.ndarray]
    start: tuple[np.ndarray, np.ndarray]
    stop: tuple[np.ndarray, np.ndarray]
    over: tuple[np.ndarray, np.ndarray]

    @property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens that end together, in order."""
        a, b = self.over
        held = self.stop[0][a] == self.stop[1][b]
        order = np.argsort(a[held], kind="stable")
        return a[held][order], b[held][order]


def align(doc: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Tokens lie over the bytes of the documents laid end to end, so a place says which document it is in."""
    stop = tuple(np.cumsum(n[i]) for n, i in zip(lengths, ids, strict=True))
    start = tuple(e - n[i] for e, n, i in zip(stop, lengths, ids, strict=True))
    if not len(ids[0]):
        return Aligned(doc, ids, start, stop, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    a, b = (pd.DataFrame({"start": start[k], "doc": doc[k], "ab"[k]: np.arange(len(ids[k]))}) for k in (0, 1))
    covers_a = pd.merge_asof(a, b.drop(columns="doc"), on="start")
    covers_b = pd.merge_asof(b, a.drop(columns="doc"), on="start")
    a, b = covers_b["a"].to_numpy(np.int64), covers_b["b"].to_numpy()
    new = start[0][a] != start[1][b]  # tokens that start together were found from the other side
    over = (np.concatenate([covers_a["a"].to_numpy(), a[new]]), np.concatenate([covers_a["b"].to_numpy(np.int64), b[new]]))
    return Aligned(doc, ids, start, stop, over)


def _batches(batches: Iterator[pa.RecordBatch], sides: Sides):
    """The coders, the first row of a run of texts, its keys, and its texts aligned."""
    coders = encoders(sides)
    for batch in batches:
        for row, offsets, data in slices(batch["text"], SLICE):
            raw = data.tobytes()
            texts = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield coders, batch["id"][row : row + len(texts)], len(texts), align(*coders.encode(texts), (coders.a_len, coders.b_len))
    # A worker stays when its task ends.
    coders.forget()
    pa.default_memory_pool().release_unused()


def overlaps(docs: DataFrame, sides: Sides, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``id``, ``a_at``, ``b_at`` (places among the document's tokens), ``a_id``, ``b_id``, ``start``, ``stop`` (bytes that both cover, of a blank and the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(sides)  # the two files
    rows = docs.select(F.col(key).alias("id"), F.col(col).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n, found in _batches(batches, shared.value):
            a, b = found.over
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            of = found.doc[0][a]
            first_a, first_b = (np.searchsorted(found.doc[k], np.arange(n + 1)) for k in (0, 1))
            base = found.start[0][first_a[of]]  # where the document starts
            start, stop = np.maximum(found.start[0][a], found.start[1][b]), np.minimum(found.stop[0][a], found.stop[1][b])
            columns = [a - first_a[of], b - first_b[of], found.ids[0][a], found.ids[1][b], start - base, stop - base]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), *map(pa.array, columns)], ["id", "a_at", "b_at", "a_id", "b_id", "start", "stop"])

    return rows.mapInArrow(work, T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("a_at", "b_at", "a_id", "b_id", "start", "stop"))]))


def aligned(docs: DataFrame, sides: Sides, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``at`` (row), ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (hash of the groups' ids), ``links`` (pairs of ids as one number each, in order).

    A group is written as ids of A, a bar, ids of B; groups are divided by semicolons.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sides)  # the two files
    rows = docs.select(F.col(key).alias("id"), F.col(col).cast("binary").alias("text"))
    names = ["at", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for coders, keys, n, found in _batches(batches, shared.value):
            n_a, n_b = len(coders.a_len), len(coders.b_len)
            last_a, last_b = found.links
            places = [np.arange(len(ids)) for ids in found.ids]
            group = [np.searchsorted(last, at) for last, at in zip((last_a, last_b), places, strict=True)]
            ends = [np.isin(at, last) for last, at in zip((last_a, last_b), places, strict=True)]
            # Before a token of A stand those of B in earlier groups; before one of B those of A up to its own group.
            code = np.zeros(len(places[0]) + len(places[1]), np.int64)
            code[places[0] + np.concatenate([[0], last_b + 1])[group[0]]] = found.ids[0] + n_a * ends[0]
            if len(last_a):
                code[places[1] + last_a[group[1]] + 1] = 2 * n_a + found.ids[1] + n_b * ends[1]
            spelt = coders.spelt.take(pa.array(code))
            raw = memoryview(spelt.buffers()[2] or b"")
            at = np.frombuffer(spelt.buffers()[1], np.int64)[: len(code) + 1] if len(code) else np.zeros(1, np.int64)
            counts = [np.bincount(d, minlength=n) for d in found.doc]
            edges = at[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])].tolist()
            hashes = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1], edges[1:], strict=True)]
            n_links = np.bincount(found.doc[0][last_a], minlength=n)
            n_groups = np.bincount(found.doc[0][np.unique(last_a)], minlength=n)
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), pa.array(found.ids[0][last_a] * n_b + found.ids[1][last_b]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), keys, pa.array(counts[0]), pa.array(counts[1]), pa.array(n_groups), pa.array(n_links), pa.array(hashes), links], names)
            row += n

    long = [T.StructField(c, T.LongType()) for c in ("at", "n_a", "n_b", "n_groups", "n_links")]
    return rows.mapInArrow(work, T.StructType([long[0], rows.schema["id"], *long[1:], T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType()))]))


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """``pair``, ``a``, ``b``, ``n`` (links that hold it linked), ``best`` (whether no pair of its B id has more)."""
    counts = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", F.expr(f"pair div {n_b}").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, sides: Sides | None = None, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``: each document, with how its links stand in the corpus."""
    sides = sides or load_sides()
    coders = encoders(sides)
    with small_batches(docs.sparkSession):
        found = stored(aligned(docs, sides, key, col), "aligned")
    counts = stored(pair_counts(found, len(coders.b_len)), "pairs").select("pair", "n", "best")
    if most_pairs(coders.a_bytes, coders.b_bytes) * PAIR_BYTES <= BROADCAST_BYTES:
        with small_batches(docs.sparkSession):
            return stored(summed(found, counts), "sums")
    own = ["at", "id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    each = found.select(*own, F.explode_outer("links").alias("pair")).join(counts, "pair", "left")
    sums = each.groupBy(*own).agg(F.sum(F.when(F.col("best"), 1).otherwise(0)).cast("long").alias("n_best"), F.coalesce(F.sum("n"), F.lit(0)).alias("count_sum"))
    return sums.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def summed(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same where the counts fit in every worker: they are looked up where the links are, and nothing is shuffled."""
    table = counts.toPandas().sort_values("pair")  # bounded by the vocabularies
    shared = found.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            links = batch["links"].flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch["n_links"].to_numpy())])
            at = np.searchsorted(pairs, links)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[ends]) for x in (best, n)] if len(links) else [np.zeros(len(batch), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept[:5]), *map(pa.array, sums), batch["groups"]], kept)
        pa.default_memory_pool().release_unused()

    long = {c: T.StructField(c, T.LongType()) for c in kept[1:7]}
    return found.select("id", "n_a", "n_b", "n_groups", "n_links", "groups", "links").mapInArrow(work, T.StructType([found.schema["id"], *long.values(), found.schema["groups"]]))
