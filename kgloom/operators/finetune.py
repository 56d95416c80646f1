"""Data for fine-tuning: examples, negatives, deduplication, decontamination, splits, export."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import grams, md5_int, norm, tokens
from kgloom.session import cut


def make_examples(questions: DataFrame, responses: DataFrame, cap: int) -> DataFrame:
    """``example_id``, ``question``, ``answer``, ``p``: at most ``cap`` a predicate, by the md5 of the question's id. ``questions`` has ``qid``, ``text``, ``p``."""
    first = Window.partitionBy("p").orderBy(F.md5("qid"), "qid")
    made = questions.join(responses, "qid").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= cap)
    return made.select(F.md5("qid").alias("example_id"), F.col("text").alias("question"), F.col("answer_text").alias("answer"), "p")


def numbered(nodes: DataFrame, buckets: int = 64, rows: int = 65536) -> DataFrame:
    """``type``, ``idx`` (from 0, without gaps, by hash bucket and id), ``id``, ``size`` of the type.

    A type is numbered in buckets of about ``rows``, ``buckets`` at least, and a bucket starts where those before it end: no task holds a whole type.
    """
    counts = nodes.groupBy("type").agg(F.greatest(F.lit(buckets), F.ceil(F.count("*") / rows)).alias("buckets"))
    # Types are a vocabulary, which is small: by type, all nodes of one would meet in a task.
    dealt = nodes.join(F.broadcast(counts), "type").select("type", "id", (md5_int(F.col("id")) % F.col("buckets")).alias("bucket"))
    sizes = dealt.groupBy("type", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("type", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(Window.partitionBy("type")).alias("size"))
    inside = F.row_number().over(Window.partitionBy("type", "bucket").orderBy("id")) - 1
    return dealt.withColumn("nth", inside).join(starts, ["type", "bucket"]).select("type", (F.col("at") + F.col("nth")).alias("idx"), "id", "size")


def negatives(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``s``, ``p``, ``o``: up to n false edges for each edge, its object replaced by one of the same type that a hash picks; never a true edge.

    Edges are shuffled to their object's type, to the object that is picked, and once more beside the true ones; that last
    time one grouping makes them distinct and settles which are true. The size of a type goes to the rows.
    """
    listed = numbered(nodes)
    # Nodes are far fewer than edges: a task keeps its share of them, and edges need not be sorted, twice, to be looked up.
    typed = edges.select("s", "p", "o").join(nodes.select(F.col("id").alias("o"), "type").hint("shuffle_hash"), "o")
    sizes = nodes.groupBy("type").agg(F.count("*").alias("size"))
    tries = typed.join(F.broadcast(sizes), "type").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    picked = md5_int(F.concat_ws("|", "s", "p", "o", F.col("k").cast("string")))
    dealt = tries.select("s", "p", "type", (picked % F.col("size")).alias("idx"))
    made = dealt.join(listed.select("type", "idx", F.col("id").alias("o")).hint("shuffle_hash"), ["idx", "type"]).select("s", "p", "o", F.lit(False).alias("held"))
    every = made.union(edges.select("s", "p", "o", F.lit(True)))
    return every.groupBy("s", "p", "o").agg(F.max("held").alias("held")).where("NOT held").select("s", "p", "o")


def dedup_exact(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """``key`` and ``n``: of each normalised text the least key, and how many have it."""
    return df.groupBy(F.md5(norm(F.col(col))).alias("h")).agg(F.min(key).alias(key), F.count("*").alias("n")).select(key, "n")


def shingle_sets(df: DataFrame, key: str = "doc_id", col: str = "text", width: int = 5) -> DataFrame:
    """``key``, ``shingles``: the sorted distinct runs of ``width`` normalised words, 60 bits of their digest each; no row for fewer words.

    A row's set is made in its place. Rows with one key are one set: sets are shuffled, as arrays of numbers, if a key has several rows.
    """
    words = df.select(key, tokens(F.col(col)).alias("w")).where(F.size("w") >= width)
    runs = words.select(key, F.array_distinct(grams(F.col("w"), width)).alias("runs"))
    held = runs.select(key, F.array_sort(F.array_distinct(F.transform("runs", lambda g: md5_int(g, 15)))).alias("shingles"))
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return held
    return held.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shingles")))).alias("shingles"))


def named_sets(df: DataFrame, key: str, col: str, width: int) -> DataFrame:
    """``shingle_sets`` with ``of``, a digest of the set."""
    return shingle_sets(df, key, col, width).withColumn("of", F.md5(F.array_join(F.transform("shingles", lambda g: g.cast("string")), ",")))


def members_of(sets: DataFrame, key: str) -> DataFrame:
    """``key`` and ``representative``: the least key that has the same set."""
    return sets.join(sets.groupBy("of").agg(F.min(key).alias("representative")), "of").select(key, "representative")


def set_members(df: DataFrame, key: str = "doc_id", col: str = "text", width: int = 5) -> DataFrame:
    """``key`` and ``representative`` of all sets, without looking for alike ones: names of sets are stored, and no shingles."""
    return members_of(cut(named_sets(df, key, col, width).select(key, "of")), key)


def similar_sets(df: DataFrame, threshold: float, key: str = "doc_id", col: str = "text", width: int = 5) -> tuple[DataFrame, DataFrame]:
    """All pairs of different shingle sets that are alike enough, and who has which set; exact.

    The one is ``a``, ``b``, ``jaccard`` of classes, each named by the least key that has its set, the other ``key`` and
    ``representative``: copies are members of a class and make no pairs. Sets are joined by prefixes of their rarest
    shingles with bounds on sizes and places (PPJoin, Xiao et al., TODS 2011): alike sets share one of these, and what
    follows it must still suffice.
    """
    share = Fraction(threshold).limit_denominator(10_000)
    num, den = share.numerator, share.denominator
    sets = named_sets(df, key, col, width)
    members = members_of(sets.select(key, "of"), key)
    # Equal sets meet once and leave one of them; sorted once, as what meets is in its place.
    classes = sets.repartition("of").groupBy("of").agg(F.min(key).alias("id"), F.any_value("shingles").alias("shingles"))
    # Only shingles that several sets hold are dealt back to their sets: the others can join nothing and are in no two sets, and it is enough to know how many they are, as they are the rarest.
    each = classes.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("g"))
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("g"))).where("n > 1")
    ordered = cut(shared.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("rarest")).withColumn("rarest", F.col("rarest.g")))
    prefix = F.expr(f"slice(rarest, 1, greatest(0, cast(size - ceil({num} * size / {den}) + 1 - (size - size(rarest)) as int)))")
    heads = ordered.select("id", "size", (F.col("size") - F.size("rarest")).alias("alone"), F.posexplode(prefix).alias("place", "g"))
    heads = cut(heads.select("id", "size", (F.col("place") + F.col("alone")).alias("place"), "g"))
    a, b = heads.toDF("a", "size_a", "place_a", "g"), heads.toDF("b", "size_b", "place_b", "g")
    could = f"{num + den} * (1 + least(size_a - 1 - place_a, size_b - 1 - place_b)) >= {num} * (size_a + size_b)"
    met = a.join(b, "g").where(f"a < b AND {den} * least(size_a, size_b) >= {num} * greatest(size_a, size_b) AND {could}").select("a", "b").distinct()
    left, right = (ordered.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("rarest").alias(f"in_{x}")) for x in ("a", "b"))
    both = met.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", F.size(F.array_intersect("in_a", "in_b")).alias("common"))
    alike = both.where(f"{num + den} * common >= {num} * (size_a + size_b)")
    return alike.select("a", "b", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("jaccard")), members


def near_duplicates(df: DataFrame, threshold: float, key: str = "doc_id", col: str = "text", width: int = 5) -> DataFrame:
    """``a``, ``b``, ``jaccard``: all pairs of different shingle sets that are alike enough."""
    return similar_sets(df, threshold, key, col, width)[0]


def decontaminate(df: DataFrame, heldout: DataFrame, n: int = 8, key: str = "doc_id", col: str = "text") -> DataFrame:
    """The rows that share no run of n words with the held-out texts; shorter texts stay."""
    # Words become a column of their own first: inside the n-grams they would be found anew for every one.
    held = heldout.select(tokens(F.col("text")).alias("w")).where(F.size("w") >= n).select(F.explode(grams(F.col("w"), n)).alias("g")).distinct()
    words = df.select(key, tokens(F.col(col)).alias("w")).where(F.size("w") >= n)
    mine = words.select(key, F.explode(F.array_distinct(grams(F.col("w"), n))).alias("g"))
    hit = mine.join(held, "g", "left_semi").select(key).distinct()
    return df.join(hit, key, "left_anti")


def select_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the labels call good and clean."""
    return docs.join(labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")


def split(examples: DataFrame, anchor: str, fractions: tuple[int, int, int] = (800, 100, 100)) -> DataFrame:
    """Rows with ``split`` by the hash of the anchor entity, in thousandths: no entity is in two."""
    at = md5_int(F.col(anchor)) % sum(fractions)
    name: Column = F.when(at < fractions[0], "train").when(at < fractions[0] + fractions[1], "dev").otherwise("test")
    return examples.withColumn("split", name)


def balance(examples: DataFrame, by: str, per_class: int, key: str) -> DataFrame:
    """At most ``per_class`` rows of each class, by the md5 of their key."""
    first = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return examples.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_class).drop("nth")


def to_chat(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``line``: a conversation in turn order as one JSON line."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    return turns.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("line"))


def write_chat(lines: DataFrame, path: str) -> None:
    """The lines as text files, one conversation a line."""
    lines.select("line").write.text(path)
