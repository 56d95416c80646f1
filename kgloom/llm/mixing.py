"""Mixing of sources to target weights by proportionate-fair (Pfair) scheduling.

A source's documents stand one after another in the order of a hash, and every ``block_chars``
characters of that row are a block; a document belongs to the block in which it
starts and fills as many blocks as it reaches into (``n_blocks``). The running sum of characters
is taken inside ranges of hashes, whose sums are added up beforehand. Time is counted in slots of one block. With weight w, block i
of a source is released at floor(i / w) and due at ceil((i + 1) / w), and the
block that is due earliest goes first. At every slot each source is then
less than one block of characters away from its share (Baruah et al. 1996), for as long as it has
blocks, where a document's characters count in the slots of the blocks that they fill.

Weights are exact fractions, and so are releases and deadlines: nothing is rounded that could add up.
Blocks grow with the data beyond ``BLOCKS`` of them, so that the schedule, which the driver plays
and broadcasts, has about that many rows at any size. Every
document is kept, once: a source that runs out leaves its later slots empty.

Cases: a null source counts as the source ''; a null id hashes as ''; null and empty
texts count as one character; sources without a given weight, or with none above
zero, get ``LEAST`` of the others' total; repeated rows start in one block and fill
blocks together; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CHARS, BLOCKS, EXPONENT, LEAST = 65536, 1 << 17, 0.7, Fraction(1, 4096)
#: Ranges of hashes, besides one for each source, at most: their sums reach the driver.
RANGES = 4096


def shares(weights: dict[str, float]) -> dict[str, Fraction]:
    """The exact share of each source; all together are one."""
    given = {s: Fraction(w) if w > 0 else Fraction(0) for s, w in weights.items()}
    total = sum(given.values())
    least = total * LEAST if total else Fraction(1)
    given = {s: w or least for s, w in given.items()}
    total = sum(given.values())
    return {s: w / total for s, w in given.items()}


def window(share: Fraction, block: int) -> tuple[int, int]:
    """Release and deadline of a block: floor(i / w) and ceil((i + 1) / w)."""
    return block * share.denominator // share.numerator, -(-(block + 1) * share.denominator // share.numerator)


def schedule(share: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks: at each slot, of the released ones the one due earliest, ties by source."""
    coming = [(0, s, 0) for s, n in blocks.items() if n]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    out, t = [], 0
    while coming or ready:
        if not ready:
            t = max(t, coming[0][0])
        while coming and coming[0][0] <= t:
            release, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (window(share[s], i)[1], s, i, release))
        due, s, i, release = heapq.heappop(ready)
        out.append((s, i, t, release, due))
        if i + 1 < blocks[s]:
            heapq.heappush(coming, (window(share[s], i + 1)[0], s, i + 1))
        t += 1
    return out


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def document_key(doc_id: str, source: str, text: str) -> Column:
    """A hash of source, id and text: rows that share all three share a slot."""
    return F.xxhash64(_source(source), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row`` (the whole row of ``docs``), ``block``, ``n_blocks``, ``slot``, ``release``, ``deadline``.

    Without ``weights`` a source's target is its characters to the power ``EXPONENT``, which lifts small sources.
    The sources, as many as a mixture names, and sums of RANGES ranges are all that reaches the driver.
    """
    spark = docs.sparkSession
    chars = F.greatest(F.coalesce(F.char_length(F.col(text)), F.lit(0)), F.lit(1)).cast("long")
    sizes = {r["s"]: r["n"] for r in docs.groupBy(_source(source).alias("s")).agg(F.sum(chars).alias("n")).collect()}
    total = sum(sizes.values())
    block_chars = max(block_chars, -(-total // BLOCKS))
    width = max(block_chars, -(-total // RANGES))
    share = shares({s: (weights or {}).get(s, 0.0) if weights is not None else float(n) ** EXPONENT for s, n in sizes.items()})
    # What is broadcast is bounded: a row for each source, for each range, and for each block.
    facts = spark.createDataFrame([(s, -(-n // width)) for s, n in sizes.items()], "s string, ranges long")
    rows = docs.select(F.struct("*").alias("row"), _source(source).alias("s"), document_key(doc_id, source, text).alias("h"), chars.alias("chars"))
    ranged = rows.join(F.broadcast(facts), "s").withColumn("range", F.pmod("h", "ranges"))
    before, so_far = [], dict.fromkeys(sizes, 0)
    for s, r, n in sorted(tuple(r) for r in ranged.groupBy("s", "range").agg(F.sum("chars").alias("n")).collect()):
        before.append((s, r, so_far[s]))
        so_far[s] += n
    offsets = spark.createDataFrame(before, "s string, range long, before long")
    played = schedule(share, {s: -(-n // block_chars) for s, n in sizes.items()})
    columns = list(zip(*played, strict=True)) or [[]] * 5
    names = ["s", "block", "slot", "release", "deadline"]
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], names=names))
    # The frame holds whole groups of equal hashes, so that equal rows share a place and their order does not matter.
    upto = F.sum("chars").over(Window.partitionBy("s", "range").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("chars").over(Window.partitionBy("s", "range", "h"))
    placed = ranged.withColumn("upto", upto).withColumn("own", own).join(F.broadcast(offsets), ["s", "range"])
    stop = F.col("before") + F.col("upto")
    placed = placed.withColumn("block", F.floor((stop - F.col("own")) / F.lit(block_chars)).cast("long")).withColumn("n_blocks", F.floor((stop - 1) / F.lit(block_chars)).cast("long") - F.col("block") + 1)
    return placed.join(F.broadcast(plan), ["s", "block"]).select("row", "block", "n_blocks", "slot", "release", "deadline")


def mixed_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule: ranges of slots, sorted within."""
    dealt = mixed.select("row", "slot", F.md5(F.to_json("row")).alias("tie"))
    return dealt.repartitionByRange(partitions, "slot", "tie").sortWithinPartitions("slot", "tie").select("row.*")
