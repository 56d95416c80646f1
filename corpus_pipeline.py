"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import minhash, mixing, pii, toxicity
from kgloom.llm import sentencepiece_lattice as lattice
from kgloom.llm.common import shared_dir, small_batches, stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less likely than the threshold to be toxic; the model learns from all labelled ones."""
    # The size of batches is read when a job starts, so that what is kept is stored in here.
    with small_batches(spark):
        model = toxicity.train(docs, table(spark, sf_dir, "labels"))
        return stored(toxicity.score(docs.select(F.struct("*").alias("row")), model, "row", "row.text").where("predicted = 0").select("id.*"), "clean")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, and of texts with that id the one with the smallest hash.

    Rows that are equal in id and text are one document, and one row of them stays. Texts without words are in no class, and all their rows stay.
    """
    key = F.struct(F.col("doc_id").alias("of"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    found = minhash.near_duplicates(docs.select(key.alias("key"), "text"), "key")
    kept = stored(found.where("id = component_id").groupBy("id").agg(F.count_if(F.col("n_shingles") > 0).alias("n")).select("id.*", "n"), "kept")
    own = f"key-{uuid.uuid4().hex}"  # clashes with no column
    keyed = docs.withColumn(own, key)

    def rows(which: str) -> DataFrame:
        some = kept.where(which)
        return keyed.join(some, keyed[own]["of"].eqNullSafe(some["of"]) & (keyed[own]["h1"] == some["h1"]) & (keyed[own]["h2"] == some["h2"]), "left_semi")

    return rows("n <= 1").union(rows("n > 1").dropDuplicates([own])).drop(own)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and what discloses it, generalised; ``n_chars`` follows."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = pii.find(rows, "row", clean=True)
    new = {"text": F.when(F.col("id.text").isNotNull(), F.col("text")), "n_chars": F.when(F.col("id.text").isNotNull(), F.char_length("text")).otherwise(F.col("id.n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col("id").getField(c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which every prefix holds the sources in their target weights."""
    return mixing.mixed_order(mixing.mix(docs), max(1, docs.rdd.getNumPartitions()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its place in the mixture and its pieces: ``doc_id``, ``slot``, ``n_pieces``, ``ids``.

    Files do not keep the order of rows, so the schedule of the mixing stage travels as ``slot``. It is worked
    out from the documents alone and so is the same here as there; only keys and slots are joined, no texts.
    """
    key = mixing.document_key("doc_id", "source", "text")
    slots = mixing.mix(docs).select(F.col("row.doc_id").alias("slot_id"), mixing.document_key("row.doc_id", "row.source", "row.text").alias("slot_key"), "slot").distinct()
    rows = docs.select(F.struct("doc_id", key.alias("key")).alias("doc"), "text")
    pieces = lattice.encode(rows, lattice.load_pieces(spark), "doc").select(F.col("id.doc_id").alias("doc_id"), F.col("id.key").alias("key"), F.size("ids").cast("long").alias("n_pieces"), "ids")
    placed = pieces.join(slots, (F.col("key") == F.col("slot_key")) & F.col("doc_id").eqNullSafe(F.col("slot_id")))
    return placed.select("doc_id", "slot", "n_pieces", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_copies_out),
    ("personal_data", personal_data_out),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The model, the schedule and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
