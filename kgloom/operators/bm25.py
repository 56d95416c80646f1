"""Keyword retrieval by BM25, exact over all terms, on an index of impact-ordered postings.

The weight that a document gives a term does not depend on the question, so it is
stored. Postings of a term are dealt to levels by weight and to blocks by shard of
documents; a level knows its greatest weight (cf. Anh and Moffat, SIGIR 2006; Ding
and Suel, SIGIR 2011). A question reads the levels that promise most, works out a
few documents in full and so has a threshold that its k-th best cannot be under.
Levels whose greatest weights together stay under the threshold are not read,
those first that hold most postings for it: a document that stands in none of the
others cannot be among the best. What others
say of a document bounds it from above; only those that can still be among the
best are worked out in full. No term is left out, however common: its small
weight puts its levels among those that need no reading.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions.text import tokens
from kgloom.session import cut, shared_dir

#: Levels of weight; documents in a shard, which bounds a block; postings in a folder, about.
LEVELS, SHARD_DOCS, FOLDER_POSTINGS = 32, 1 << 18, 1 << 24
#: Terms of a vocabulary that may be broadcast.
BROADCAST_TERMS = 1 << 18
#: Scores are rounded to six digits; what may be lost by that.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """``documents`` (doc_id, len, w), ``blocks`` (bucket, shard, tok, level, postings), ``levels`` (tok, level, top, n) and the corpus' size."""

    documents: DataFrame
    blocks: DataFrame
    levels: DataFrame
    n_docs: int
    mean: float
    buckets: int
    k1: float
    b: float

    def weight(self, tf: Column, length: Column) -> Column:
        """What a document's count of a term is worth, beside the term's own rarity; below k1 + 1."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def rarity(self, df: Column) -> Column:
        return F.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))


def write_index(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, vocabulary: DataFrame | None = None) -> Index:
    """Builds the index of ``docs`` (``doc_id``, a key, and ``text``) at a path: of all terms, or of those in ``vocabulary`` (``tok``)."""
    spark = docs.sparkSession
    words = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", F.size("w").alias("len"), "w")
    words.write.parquet(f"{path}/documents")
    words = spark.read.schema(words.schema).parquet(f"{path}/documents")
    size = words.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"), F.sum("len").alias("n")).head()
    buckets = max(1, -(-(size["n"] or 0) // FOLDER_POSTINGS))
    spark.createDataFrame([(size["n_docs"], size["mean"] or 1.0, buckets, k1, b)], "n_docs long, mean double, buckets long, k1 double, b double").coalesce(1).write.parquet(f"{path}/corpus")
    index = Index(words, words, words, size["n_docs"], size["mean"] or 1.0, buckets, k1, b)
    each = words.select("doc_id", "len", F.explode("w").alias("tok"))
    if vocabulary is not None:
        known = cut(vocabulary.select("tok").distinct())
        each = each.join(F.broadcast(known) if known.count() <= BROADCAST_TERMS else known, "tok", "left_semi")
    terms = each.groupBy("doc_id", "len", "tok").agg(F.count("*").alias("tf")).select("tok", "doc_id", index.weight(F.col("tf"), F.col("len")).alias("weight"))
    shards = max(1, -(-size["n_docs"] // SHARD_DOCS))
    placed = terms.select("tok", F.floor(F.col("weight") * (LEVELS / (k1 + 1))).cast("int").alias("level"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.struct("doc_id", "weight").alias("posting"))
    blocks = placed.groupBy("tok", "level", "shard").agg(F.max("posting.weight").alias("top"), F.count("*").alias("n"), F.collect_list("posting").alias("postings"))
    dealt = blocks.withColumn("bucket", F.pmod(F.xxhash64("tok"), F.lit(buckets)))
    (dealt.repartition("bucket", "shard", F.pmod(F.xxhash64("tok", "level"), F.lit(8))) if buckets > 1 else dealt).write.partitionBy("bucket").parquet(f"{path}/blocks")
    _blocks(words, path).groupBy("tok", "level").agg(F.max("top").alias("top"), F.sum("n").alias("n")).write.parquet(f"{path}/levels")
    return read_index(spark, path)


def _blocks(documents: DataFrame, path: str) -> DataFrame:
    """The stored blocks; without terms there is no folder to learn the columns from."""
    shape = f"tok string, level int, shard long, top double, n long, postings array<struct<doc_id:{documents.schema['doc_id'].dataType.simpleString()},weight:double>>, bucket long"
    return documents.sparkSession.read.schema(shape).parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> Index:
    size = spark.read.parquet(f"{path}/corpus").head()
    documents, levels = (spark.read.parquet(f"{path}/{name}") for name in ("documents", "levels"))
    return Index(documents, _blocks(documents, path), levels, size["n_docs"], size["mean"], size["buckets"], size["k1"], size["b"])


def _in_full(index: Index, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``qid``, ``doc_id``, ``score`` of pairs, from all words of the documents."""
    held = pairs.join(index.documents, "doc_id").select("qid", "doc_id", "len", F.explode("w").alias("tok")).join(wanted, ["qid", "tok"])
    counts = held.groupBy("qid", "doc_id", "len", "tok", "rarity").agg(F.count("*").alias("tf"))
    return counts.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("rarity") * index.weight(F.col("tf"), F.col("len"))), 6).alias("score"))


def _postings(index: Index, levels: DataFrame) -> DataFrame:
    """The postings of chosen levels (``qid``, ``tok``, ``level`` and more), a row each; folders that hold none of them are not read."""
    blocks = index.blocks
    if index.buckets > 1:
        found = levels.select(F.pmod(F.xxhash64("tok"), F.lit(index.buckets)).alias("bucket")).distinct().collect()  # as many as there are folders, at most
        blocks = blocks.where(F.col("bucket").isin([r["bucket"] for r in found]))
    return levels.join(blocks.select("tok", "level", "postings"), ["tok", "level"]).withColumn("posting", F.explode("postings")).drop("postings")


def search(questions: DataFrame, index: Index, k: int, first: int = 50, tries: int = 4, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best documents of each question, and what was read for it.

    The one is ``qid``, ``doc_id``, ``score``, ``rank``; the other ``qid``, ``postings`` (of all its terms), ``read`` (of the levels that it read at all).
    Levels are given up as long as they add up to less than ``share`` of the threshold; a smaller share reads more postings and works out fewer documents in full.
    A threshold comes from the levels that promise most, of ``first`` times ``k`` postings or a level more, and from ``tries`` times ``k`` documents of these.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    spread = index.levels.groupBy("tok").agg(F.sum("n").alias("df"))
    wanted = cut(asked.join(spread, "tok").select("qid", "tok", index.rarity(F.col("df")).alias("rarity")))
    levels = wanted.join(index.levels, "tok").withColumn("bound", F.col("rarity") * F.col("top"))
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "tok", "level").rowsBetween(Window.unboundedPreceding, -1)
    levels = cut(levels.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))))
    said = F.sum(F.col("rarity") * F.col("posting.weight"))
    early = _postings(index, levels.where(F.col("before") < first * k)).groupBy("qid", F.col("posting.doc_id").alias("doc_id")).agg(said.alias("part"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "doc_id"))
    tried = early.withColumn("nth", nth).where(F.col("nth") <= tries * k).select("qid", "doc_id")
    kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    thresholds = _in_full(index, wanted, tried).withColumn("nth", kth).where(F.col("nth") == k).select("qid", (F.col("score") - SLACK).alias("least"))
    # Levels of a term are given up from the lowest on, those first that save most postings for what a document could gain from them.
    upwards = Window.partitionBy("qid", "tok").orderBy("bound", "level")
    rise = F.col("bound") - F.coalesce(F.lag("bound").over(upwards), F.lit(0.0))
    ratio = F.sum("n").over(upwards.rowsBetween(Window.unboundedPreceding, 0)) / F.col("bound")
    saved = F.max("ratio").over(upwards.rowsBetween(0, Window.unboundedFollowing))
    risen = levels.withColumns({"rise": rise, "ratio": ratio}).withColumn("saved", saved)
    so_far = Window.partitionBy("qid").orderBy(F.desc("saved"), "tok", "level").rowsBetween(Window.unboundedPreceding, 0)
    unread = risen.withColumn("unread", F.sum("rise").over(so_far)).join(thresholds, "qid", "left")
    planned = cut(unread.withColumn("skip", F.coalesce(F.col("unread") < F.col("least") * share, F.lit(False))))
    rest = planned.where("skip").groupBy("qid", "tok").agg(F.max("bound").alias("rest"))
    chosen = planned.where("NOT skip").select("qid", "tok", "level", "rarity", "least").join(rest, ["qid", "tok"], "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    # A term that a document has in a level that was read no longer counts with what it could have been.
    gain = F.sum(F.col("rarity") * F.col("posting.weight") - F.col("rest"))
    met = _postings(index, chosen).groupBy("qid", F.col("posting.doc_id").alias("doc_id")).agg(gain.alias("gain"), F.any_value("least").alias("least"))
    unseen = rest.groupBy("qid").agg(F.sum("rest").alias("unseen"))
    able = met.join(unseen, "qid", "left").where(F.col("least").isNull() | (F.col("gain") + F.coalesce("unseen", F.lit(0.0)) >= F.col("least")))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    found = _in_full(index, wanted, cut(able.select("qid", "doc_id"))).withColumn("rank", best).where(F.col("rank") <= k)
    read = planned.groupBy("qid").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("skip") & (F.col("before") >= first * k), 0).otherwise(F.col("n"))).alias("read"))
    return found, read


def retrieve(questions: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``qid``, ``doc_id``, ``score``, ``rank``: the k best of ``docs`` by an index for these questions alone."""
    path = f"{shared_dir(docs.sparkSession)}/bm25-{uuid.uuid4().hex}"
    terms = questions.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    return search(questions, write_index(docs, path, k1, b, terms), k)[0]
