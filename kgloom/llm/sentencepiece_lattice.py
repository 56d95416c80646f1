"""SentencePiece encoding as a relational lattice, and decoding.

A text has its blanks as U+2581 and one more in front. It falls into parts
wherever two neighbouring characters stand side by side in no piece: no piece
spans such a place, so the best path of the text is the parts' paths in a row.
Each distinct part is encoded once: exploded to its substrings of at most the
longest piece's length, joined by equality to the table of pieces, grouped by
part again, and folded: the best score of every end, over edges in the order of
their ends, and then back from the last. Ties go to the edge that starts first,
as in the library's unigram encoder; a character that is no piece is spelt in
byte pieces. The fold keeps its last nodes apart from the older ones, so that
its time is in proportion to a part's length, however long.

Stretches between blanks that a bounded sample of documents holds often are encoded
first and broadcast. All other parts go, with the blocks of documents (about
``BLOCK_CHARS`` characters each) that hold them, to the task of the part, and their
pieces from there to the blocks, beside which the texts come to lie: the shuffle
carries compressed texts once and rare parts twice, and nothing for every token.

Cases: null and empty texts have no pieces; U+2581 in a text is a blank to the
model, and comes back as one; repeated rows and ids are kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgloom.llm.common import stored

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLOCK_CHARS = 8_000_000
#: Documents of the sample, about; documents of it that hold a stretch that is broadcast, at least; stretches that are broadcast, at most.
SAMPLE_DOCS, SAMPLE_SEEN, KNOWN = 20_000, 2, 250_000
#: Nodes that the fold keeps apart, at least; a longer part is named by its digest and not by itself.
SPAN = 64
#: The library's penalty of an unknown character below the least score.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """The normal pieces by text with id and score, the bytes of every id, and the pairs of characters that pieces hold."""

    normal: dict[str, tuple[int, float]]
    spelt: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    longest: int
    unknown: float
    pairs: frozenset[str]


def pieces_from(normal: dict[str, tuple[int, float]], spelt: list[bytes], byte_ids: list[int]) -> Pieces:
    if any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError("a piece spans two stretches")
    least = min((x for _, x in normal.values()), default=0.0)
    return Pieces(normal, tuple(spelt), tuple(byte_ids), max(map(len, normal), default=1), least - UNKNOWN_PENALTY, frozenset(p[i : i + 2] for p in normal for i in range(len(p) - 1)))


def pieces_of(model: bytes) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    normal, spelt, byte_ids = {}, [], [0] * 256
    for i, p in enumerate(proto.pieces):
        spelt.append(b"")
        if p.type == kinds.NORMAL:
            normal[p.piece] = (i, p.score)
            spelt[i] = p.piece.replace(MARK, " ").encode()
        elif p.type == kinds.BYTE:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte], spelt[i] = i, bytes([byte])
    return pieces_from(normal, spelt, byte_ids)


def load_pieces(spark: SparkSession, path: str = MODEL_PATH) -> Pieces:
    """The pieces of a model file, which the driver reads."""
    with open(path, "rb") as f:
        return pieces_of(f.read())


_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


def stretches(text: str) -> list[str]:
    """What blanks divide a text into, each without the one mark in front of it; more marks in front are kept."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [x[1:] for x in _STRETCH.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def parts_of(stretch: str, pairs: frozenset[str]) -> list[str]:
    """The parts of a stretch, its mark put back: cut between characters that no piece has side by side."""
    s = MARK + stretch
    both = [a + b for a, b in zip(s, stretch, strict=False)]
    if pairs.issuperset(both):
        return [s]
    out, begin = [], 0
    for at, pair in enumerate(both, 1):
        if pair not in pairs:
            out.append(s[begin:at])
            begin = at
    out.append(s[begin:])
    return out


def key_of(part: str) -> str:
    """A part itself, or a digest of a long one, which no part equals as it begins with a blank."""
    return part if len(part) <= SPAN else " " + hashlib.sha256(part.encode()).hexdigest()


def part_rows(parts: list[str], blocks: list[int] | None = None) -> pa.RecordBatch:
    """``block``, ``key`` and, where the key is a digest, ``long``: the part."""
    blocks = pa.nulls(len(parts), pa.int32()) if blocks is None else pa.array(blocks, pa.int32())
    return pa.RecordBatch.from_arrays([blocks, pa.array(list(map(key_of, parts)), pa.string()), pa.array([p if len(p) > SPAN else None for p in parts], pa.string())], names=["block", "key", "long"])


PART_ROWS = "block int, key string, long string"


def encode_parts(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``key``, ``blocks`` and ``ids`` of each distinct part of ``rows`` (``block``, ``key``, ``long``), which are dealt by ``key``.

    Neither the groupings nor the join move anything: the table of pieces, whose size is the
    vocabulary's, is broadcast. The blocks ride on a part's first edge. A long part is cut into
    windows first, so that no row of the explosion carries more than one of them.
    """
    spark, span = rows.sparkSession, max(SPAN, pieces.longest)
    table = F.broadcast(spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.normal.items()], "piece string, piece_id int, score double"))
    parts = rows.groupBy("key").agg(F.first("long", ignorenulls=True).alias("long"), F.collect_set("block").alias("blocks"))
    parts = parts.select("key", "blocks", F.coalesce("long", "key").alias("part"))
    windows = parts.select("key", "blocks", F.explode(F.expr(f"transform(sequence(0, char_length(part) - 1, {span}), b -> named_struct('base', b, 'text', substring(part, b + 1, {span + pieces.longest - 1})))")).alias("w"))
    starts = windows.select("key", F.when(F.col("w.base") == 0, F.col("blocks")).alias("blocks"), "w.base", "w.text", F.explode(F.expr(f"sequence(0, least({span}, char_length(w.text)) - 1)")).alias("start"))
    starts = starts.select("key", F.when(F.col("start") == 0, F.col("blocks")).alias("blocks"), "base", "text", "start")
    spans = starts.select("key", "blocks", "base", "text", "start", F.explode(F.expr(f"sequence(start + 1, least(start + {pieces.longest}, char_length(text)))")).alias("stop"))
    joined = spans.join(table, F.expr("substring(text, start + 1, stop - start)") == F.col("piece"), "left").where("piece_id IS NOT NULL OR stop = start + 1")
    # A character that is no piece says where it stands by a number below -1.
    at = F.col("base") + F.col("start")
    edge = F.struct((F.col("base") + F.col("stop")).alias("stop"), at.alias("start"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"), F.coalesce("piece_id", -2 - at).alias("id"))
    edges = joined.select("key", F.when(F.col("stop") == F.col("start") + 1, F.col("blocks")).alias("blocks"), edge.alias("edge"))
    lattice = edges.groupBy("key").agg(F.first("blocks", ignorenulls=True).alias("blocks"), F.array_sort(F.collect_list("edge")).alias("edges"))
    return lattice.select("key", "blocks", F.when(F.startswith("key", F.lit(" ")), F.expr(long_fold(span))).otherwise(F.expr(FOLD)).alias("ids"))


#: The fold over ``edges``: nodes of all ends so far, the last of which a better edge replaces; then back from the last.
FOLD = """aggregate(edges, array(named_struct('best', cast(0 as double), 'id', -1, 'origin', -1)),
  (a, e) -> if(size(a) = e.stop, concat(a, array(named_struct('best', a[e.start].best + e.score, 'id', e.id, 'origin', e.start))),
    if(a[e.start].best + e.score > a[e.stop].best, concat(slice(a, 1, e.stop), array(named_struct('best', a[e.start].best + e.score, 'id', e.id, 'origin', e.start))), a)),
  a -> aggregate(slice(a, 2, size(a)), named_struct('at', size(a) - 1, 'ids', cast(array() as array<int>)),
    (b, x) -> if(b.at <= 0, b, named_struct('at', a[b.at].origin, 'ids', concat(array(a[b.at].id), b.ids))),
    b -> b.ids))"""


def long_fold(span: int) -> str:
    """The same fold, whose steps copy at most ``2 * span`` nodes: older ones are put away in runs of ``span``, and so are the ids on the way back."""
    node = "named_struct('best', a.near[e.start - a.base].best + e.score, 'id', e.id, 'origin', e.start)"
    nodes = f"""aggregate(edges,
      named_struct('base', 0, 'old', cast(array() as array<array<struct<best:double,id:int,origin:int>>>), 'near', array(named_struct('best', cast(0 as double), 'id', -1, 'origin', -1))),
      (a, e) -> if(a.base + size(a.near) = e.stop,
        if(size(a.near) < {2 * span},
          named_struct('base', a.base, 'old', a.old, 'near', concat(a.near, array({node}))),
          named_struct('base', a.base + {span}, 'old', concat(a.old, array(slice(a.near, 1, {span}))), 'near', concat(slice(a.near, {span + 1}, {span}), array({node})))),
        if(a.near[e.start - a.base].best + e.score > a.near[e.stop - a.base].best,
          named_struct('base', a.base, 'old', a.old, 'near', concat(slice(a.near, 1, size(a.near) - 1), array({node}))), a)),
      a -> flatten(concat(a.old, array(a.near))))"""
    return f"""transform(array({nodes}), n -> aggregate(slice(n, 2, size(n)),
      named_struct('at', size(n) - 1, 'old', cast(array() as array<array<int>>), 'ids', cast(array() as array<int>)),
      (b, x) -> if(b.at <= 0, b, if(size(b.ids) < {span},
        named_struct('at', n[b.at].origin, 'old', b.old, 'ids', concat(b.ids, array(n[b.at].id))),
        named_struct('at', n[b.at].origin, 'old', concat(b.old, array(b.ids)), 'ids', array(n[b.at].id)))),
      b -> reverse(flatten(concat(b.old, array(b.ids))))))[0]"""


def settled(part: str, ids: list[int], pieces: Pieces) -> bytes:
    """Ids as bytes, numbers below zero replaced by the byte pieces of the character they point at."""
    if min(ids) < 0:
        ids = [j for i in ids for j in ([i] if i >= 0 else [pieces.byte_ids[b] for b in part[-2 - i].encode()])]
    return np.array(ids, "<i4").tobytes()


def lengths(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.char_length(F.col(text)))).head()[0] or 0


class Known:
    """Stretches and parts whose ids every task knows. It travels as two tables; a worker makes dictionaries of them once."""

    def __init__(self, pieces: Pieces, stretches: pa.Table, parts: pa.Table):
        self.pieces, self.tables, self.made = pieces, (stretches, parts), None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def dictionaries(self) -> tuple[Pieces, dict[str, bytes], dict[str, bytes]]:
        """The pieces, and ids as bytes by stretch and by part."""
        if self.made is None:
            whole, rows = self.tables
            parts = {p: settled(p, ids.as_py(), self.pieces) for p, ids in zip(rows["key"].to_pylist(), rows["ids"], strict=True)}
            self.tables = None
            self.made = self.pieces, {w: b"".join([parts[p] for p in parts_of(w, self.pieces.pairs)]) for w in whole["stretch"].to_pylist()}, parts
        return self.made


def sample_encoding(docs: DataFrame, pieces: Pieces, text: str) -> Known:
    """The stretches that most documents of a sample hold, KNOWN at most, and the encoding of their parts.

    It only saves work: a stretch that it lacks is encoded in parts. None has more than SPAN characters.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.where(F.xxhash64(text).cast("double") / 2.0**64 + 0.5 <= share).select(F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            seen = Counter()
            for t in batch.column(0):
                seen.update({w for w in stretches(t.as_py() or "") if len(w) < SPAN})
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["stretch", "n"])

    def cut(batches):
        for batch in batches:
            yield part_rows(sorted({p for w in batch.column(0).to_pylist() for p in parts_of(w, pieces.pairs)}))

    counts = chosen.mapInArrow(count, "stretch string, n long").groupBy("stretch").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_SEEN)
    often = stored(counts.orderBy(F.desc("n"), "stretch").limit(KNOWN).select("stretch"), "stretches")
    parts = encode_parts(often.repartition(12).mapInArrow(cut, PART_ROWS).repartition(12, "key"), pieces)
    return Known(pieces, often.toArrow(), parts.select("key", "ids").toArrow())


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``ids`` (piece ids) and ``decoded`` (what they decode to) of each row."""
    spark = docs.sparkSession
    frame = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast(sample_encoding(frame, pieces, "text"))
    blocks = max(1, -(-lengths(frame, "text") // BLOCK_CHARS))
    id_field = frame.schema["id"]
    blocked = frame.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "text")

    def pack(batches):
        # Texts of a batch that go to one block are compressed as one.
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else np.zeros(0, int)
            edges = pa.array(np.append(cuts, len(at)), pa.int32())
            texts = [[t.as_py().encode() for t in batch.column(2).take(pa.array(order[x:y]))] for x, y in zip(cuts, [*cuts[1:], len(at)], strict=True)]
            sizes = pa.array([len(t) for ts in texts for t in ts], pa.int32())
            ids = batch.column(0).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, ids), pa.array(at[order][cuts], pa.int32()), pa.ListArray.from_arrays(edges, sizes), pa.array([squeeze(b"".join(ts)) for ts in texts], pa.binary())], names=["ids", "block", "sizes", "packed"])

    packed_schema = T.StructType([T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("block", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType())])
    dealt = blocked.mapInArrow(pack, packed_schema).repartition(blocks, "block")

    def rare(batches):
        pieces, whole, parts = known.value.dictionaries()
        for batch in batches:
            missing, at = [], []
            for block, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = {p for w in set(stretches(t.as_py())).difference(whole) for p in parts_of(w, pieces.pairs)}.difference(parts)
                missing += here
                at += [block] * len(here)
            # Alike parts side by side are compressed better.
            order = sorted(range(len(missing)), key=missing.__getitem__)
            yield part_rows([missing[k] for k in order], [at[k] for k in order])

    # Each task of this encodes whole parts; a block's rare parts come from all of them.
    found = encode_parts(blocked.select("block", "text").mapInArrow(rare, PART_ROWS).repartition(blocks, "key"), pieces)
    found = found.select(F.explode("blocks").alias("block"), "key", "ids")
    schema = T.StructType([id_field, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    empty = pa.schema([("id", to_arrow_type(id_field.dataType)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]).empty_table()

    def assemble(texts: pa.Table, mine: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        pieces, whole, parts = known.value.dictionaries()
        own: dict[str, list[int] | bytes] = {}
        for chunk in mine.to_batches():
            ids = chunk.column("ids")
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].tolist()
            odd = np.minimum.reduceat(flat, at[:-1]) < 0 if len(flat) else []
            raw = flat.tobytes()
            for k, key in enumerate(chunk.column("key").to_pylist()):
                own[key] = flat[at[k] : at[k + 1]].tolist() if odd[k] else raw[4 * at[k] : 4 * at[k + 1]]

        def ids_of(part: str) -> bytes:
            found = parts.get(part)
            if found is None:
                found = own[key_of(part)]
                if isinstance(found, list):
                    found = settled(part, found, pieces)
            return found

        spelling, done = Spelling(pieces), []
        for chunk in texts.to_batches():
            for k, (sizes, p) in enumerate(zip(chunk.column("sizes"), chunk.column("packed"), strict=True)):
                # One document at a time: what is held of a block is its result, as Arrow arrays.
                raw, at, found_ids, decoded = unpack(p.as_py()), 0, [], []
                for n in sizes.as_py():
                    ws = stretches(raw[at : at + n].decode())
                    at += n
                    found = list(map(whole.get, ws))
                    for j, f in enumerate(found):
                        if f is None:
                            found[j] = b"".join(map(ids_of, parts_of(ws[j], pieces.pairs)))
                    found_ids.append(b"".join(found))
                    decoded.append(spelling.text(np.frombuffer(found_ids[-1], "<i4")))
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found_ids])].astype(np.int32)
                flat = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found_ids), "<i4")))
                done.append(pa.table([chunk.column("ids").slice(k, 1).flatten(), flat, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"]))
        return pa.concat_tables(done) if done else empty

    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assemble, schema)


class Spelling:
    """The bytes of all pieces in a row, for decoding all ids of a text at once."""

    def __init__(self, pieces: Pieces):
        self.sizes = np.array([len(x) for x in pieces.spelt])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces.spelt), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        """What ids decode to, without the blank that encoding puts in front."""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        raw = self.bytes[np.repeat(self.starts[ids] - (stops - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        return raw.decode(errors="replace")[1:]


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of piece ids, without the blank that encoding puts in front; bytes that are no text come out as replacement marks."""
    return b"".join(map(pieces.spelt.__getitem__, ids)).decode(errors="replace")[1:]


def decode_column(pieces: Pieces):
    """A column function from arrays of piece ids to texts."""
    @F.pandas_udf(T.StringType())
    def decoded(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(list(x), pieces) for x in ids], dtype=object)

    return decoded
