"""Context of questions: earlier turns, entities in focus, passages, ranks by context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import tokens


def with_history(conversations: DataFrame, n: int) -> DataFrame:
    """``conv_id``, ``turn``, ``text``, ``history``: for each turn of a user the n turns before it, in order, as one text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    said = F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(before), "\n")
    return conversations.withColumn("history", said).where("role = 'user'").select("conv_id", "turn", "text", "history")


def carry_focus(mentions: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid``, ``focus``: a question's own entity, else the latest of its conversation."""
    own = mentions.where("rank = 1").groupBy("qid").agg(F.min(F.struct("start", "id")).alias("m")).select("qid", "m.id")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return questions.join(own, "qid", "left").select("qid", F.last("id", ignorenulls=True).over(so_far).alias("focus"))


def with_focus(mentions: DataFrame, focus: DataFrame) -> DataFrame:
    """Mentions, and for questions without any the entity in focus as one without words."""
    silent = focus.where("focus IS NOT NULL").join(mentions.select("qid").distinct(), "qid", "left_anti")
    return mentions.unionByName(silent.select("qid", F.lit(0).alias("start"), F.lit(0).alias("n_tok"), F.lit("").alias("alias_norm"), F.col("focus").alias("id"), F.lit(1).alias("rank")))


def split_passages(documents: DataFrame, n: int, stride: int) -> DataFrame:
    """``passage_id``, ``doc_id``, ``pos``, ``text``: windows of n words, a stride apart; the last holds the end."""
    words = documents.select("doc_id", tokens(F.col("text")).alias("w")).where("size(w) > 0")
    count = F.greatest(F.lit(0), F.ceil((F.size("w") - n) / F.lit(stride))).cast("int")
    at = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), count)).alias("pos"))
    return at.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("passage_id"), "doc_id", "pos", F.array_join(F.slice("w", F.col("pos") * stride + 1, n), " ").alias("text"))


def rerank(candidates: DataFrame, focus: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid``, ``answer_id``, ``near``, ``rank``: by how many of the question's focus entities (``qid``, ``id``) a candidate is next to, then by the old rank."""
    both = edges.select("s", "o").union(edges.select("o", "s")).toDF("answer_id", "id").distinct()
    near = candidates.select("qid", "answer_id").distinct().join(focus.select("qid", "id").distinct(), "qid").join(both, ["answer_id", "id"]).groupBy("qid", "answer_id").agg(F.count("*").alias("near"))
    joined = candidates.join(near, ["qid", "answer_id"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    best = Window.partitionBy("qid").orderBy(F.desc("near"), "rank", "answer_id")
    return joined.select("qid", "answer_id", "near", F.row_number().over(best).alias("rank"))
