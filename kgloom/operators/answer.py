"""Answers: batches of logical forms grouped by the shape of their path, evidence, sentences, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.session import cut


def _steps(path: str) -> list[tuple[str, bool]]:
    return [(x[1:], x[0] == "+") for x in path.split("/") if x]


def shapes(parsed: DataFrame) -> list[str]:
    """The distinct paths: as many as the lexicon has, whatever the number of questions."""
    return sorted(r["path"] for r in parsed.where("path IS NOT NULL").select("path").distinct().collect())


def walkable(edges: DataFrame, paths: list[str]) -> DataFrame:
    """The edges whose predicate some path has, stored: the steps of all paths read them, and a plan that maps them anew for each is too large for the driver."""
    return cut(edges.where(F.col("p").isin(sorted({p for path in paths for p, _ in _steps(path)}))).select("s", "p", "o"))


def walked(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """``anchor_id``, ``path``, ``id``: the distinct ends of every path from every anchor, walked once however many questions have both.

    All paths are walked together, a step of each at a time: one join a depth, whatever the number of paths, over the predicates that some path has at that depth.
    """
    shaped = shapes(parsed)
    paths, edges = [_steps(p) for p in shaped], walkable(edges, shaped)
    way = F.filter(F.split("path", "/"), lambda x: x != "")
    at = parsed.where("path IS NOT NULL AND anchor_id IS NOT NULL").select("anchor_id", "path", F.col("anchor_id").alias("id")).distinct()
    found = [at.where(F.size(way) == 0)]
    for depth in range(max(map(len, paths), default=0)):
        steps = {p[depth] for p in paths if len(p) > depth}
        walks = []
        for forward, a, b in ((True, "s", "o"), (False, "o", "s")):
            if names := sorted(p for p, f in steps if f == forward):
                walks.append(edges.where(F.col("p").isin(names)).select(F.concat(F.lit("+" if forward else "-"), "p").alias("step"), F.col(a).alias("id"), F.col(b).alias("next")))
        # Null and not an error beyond the end: the optimiser may look for the step before it has dropped the shorter paths.
        moving = at.where(F.size(way) > depth).withColumn("step", F.get(way, F.lit(depth)))
        at = moving.join(reduce(DataFrame.union, walks), ["step", "id"]).select("anchor_id", "path", F.col("next").alias("id")).distinct()
        if any(len(p) > depth + 1 for p in paths):
            at = cut(at)  # those that end here, and those that go on
        found.append(at.where(F.size(way) == depth + 1))
    return reduce(DataFrame.union, found)


def ends(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid``, ``id``: the distinct ends of every question's path."""
    return walked(parsed, edges).join(parsed.select("qid", "anchor_id", "path").distinct(), ["anchor_id", "path"]).select("qid", "id").distinct()


def filtered(walks: DataFrame, asked: DataFrame, filters: DataFrame, attrs: DataFrame) -> DataFrame:
    """The ends (``anchor_id``, ``path``, ``id``) for the rows of ``asked`` (``qid``, ``anchor_id``, ``path``) that meet all ``filters`` (``qid``, ``filter_p``, ``value``) of the question; questions without any keep theirs.

    Ends meet values before they meet questions: a question is joined to the ends that have its values, and never to all from its anchor.
    """
    walks, filters = cut(walks), cut(filters.distinct())
    # Names of attributes: as many as the vocabulary has, whatever the number of questions.
    names = sorted(r["filter_p"] for r in filters.select("filter_p").distinct().collect())
    having = attrs.where(F.col("p").isin(names) & F.col("v_str").isNotNull()).select(F.col("s").alias("id"), F.col("p").alias("filter_p"), norm(F.col("v_str")).alias("value")).distinct()
    wanted = asked.join(filters, "qid").join(filters.groupBy("qid").agg(F.count("*").alias("conditions")), "qid")
    met = cut(walks.join(having, "id").join(wanted, ["anchor_id", "path", "filter_p", "value"]).select(*asked.columns, "id", "conditions"))
    several = met.where("conditions > 1").groupBy(*asked.columns, "id", "conditions").agg(F.count("*").alias("n")).where("n = conditions")
    free = walks.join(asked.join(filters.select("qid").distinct(), "qid", "left_anti"), ["anchor_id", "path"])
    columns = [*asked.columns, "id"]
    return free.select(columns).union(met.where("conditions = 1").select(columns)).union(several.select(columns))


def answer(parsed: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """``qid``, ``answer_id``, ``answer_label``: entities for lists and superlatives, a number for counts, yes or no, or a value; of ends that meet ``filters``."""
    asked = parsed.select("qid", "qtype", "agg", "attr_p", "target_id", "anchor_id", "path").where("qid IS NOT NULL AND qtype IS NOT NULL")
    # Every class of question starts from these ends: they are walked once and stored.
    found = walked(parsed, edges)
    at = cut(found.join(asked, ["anchor_id", "path"]) if filters is None else filtered(found, asked, filters, attrs))
    labelled = nodes.select("id", "label")
    lists = at.where("qtype = 'list'").select("qid", "id").distinct()
    counted = at.where("qtype = 'count'").groupBy("qid").agg(F.countDistinct("id").cast("string").alias("answer_id"))
    none = parsed.where("qtype = 'count' AND path IS NOT NULL").select("qid").join(counted, "qid", "left").select("qid", F.coalesce("answer_id", F.lit("0")).alias("answer_id"))
    yes = at.where("qtype = 'boolean'").groupBy("qid").agg(F.max((F.col("id") == F.col("target_id")).cast("int")).alias("hit"))
    said = parsed.where("qtype = 'boolean' AND path IS NOT NULL").select("qid").join(yes, "qid", "left").select("qid", F.when(F.col("hit") == 1, "yes").otherwise("no").alias("answer_id"))
    values = attrs.select(F.col("s").alias("id"), F.col("p").alias("attr_p"), "v_num", F.coalesce("v_str", F.col("v_num").cast("string"), F.col("v_ts").cast("string")).alias("v"))
    valued = at.where("qtype IN ('superlative', 'attribute')").join(values, ["id", "attr_p"])
    value = valued.where("qtype = 'attribute'").select("qid", F.col("v").alias("answer_id")).distinct()
    top = valued.where("qtype = 'superlative' AND v_num IS NOT NULL")
    limits = top.groupBy("qid").agg(F.when(F.first("agg") == "min", F.min("v_num")).otherwise(F.max("v_num")).alias("v_num"))
    best = top.join(limits, ["qid", "v_num"]).select("qid", "id").distinct()
    entities = lists.union(best).join(labelled, "id", "left").select("qid", F.col("id").alias("answer_id"), F.coalesce("label", "id").alias("answer_label"))
    plain = none.union(said).union(value).select("qid", "answer_id", F.col("answer_id").alias("answer_label"))
    return entities.union(plain)


def evidence(parsed: DataFrame, answers: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid``, ``evidence``: the sorted edges, as text, on the paths from the anchor to an answer; for counts and yes or no, to any end."""
    kept, paths = [], shapes(parsed)
    edges = walkable(edges, paths)
    wanted = cut(answers.select("qid", F.col("answer_id").alias("id")).distinct())  # read for every path
    for path in paths:
        walked = parsed.where(F.col("path") == path).select("qid", "qtype", F.col("anchor_id").alias("id"), F.array().cast("array<string>").alias("trail"))
        for p, forward in _steps(path):
            a, b = ("s", "o") if forward else ("o", "s")
            step = edges.where(F.col("p") == p).select(F.col(a).alias("id"), F.col(b).alias("next"), F.concat_ws(" ", "s", "p", "o").alias("edge"))
            walked = walked.join(step, "id").select("qid", "qtype", F.col("next").alias("id"), F.array_append("trail", F.col("edge")).alias("trail"))
        exact = walked.where("qtype IN ('list', 'superlative')").join(wanted, ["qid", "id"], "left_semi")
        kept.append(exact.unionByName(walked.where("qtype NOT IN ('list', 'superlative')")).select("qid", F.explode("trail").alias("edge")))
    if not kept:
        return parsed.where("false").select("qid", F.lit("").alias("evidence"))
    return reduce(DataFrame.union, kept).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("edge")), "; ").alias("evidence"))


def verbalize(questions: DataFrame, answers: DataFrame, templates: DataFrame, m: int = 3, fallback: str = "I do not know.") -> DataFrame:
    """``qid``, ``answer_text``, ``n_answers``: the class's sentence around the first m names in order, "and n more"; without an answer the fallback.

    ``questions`` has ``qid`` and ``qtype``; ``templates`` has ``qtype`` and ``sentence`` with one ``%s``.
    """
    # The first names and the count of all are found apart, so that no row gathers a question's every answer.
    given = cut(answers.where("answer_label IS NOT NULL").select("qid", "answer_label"))  # read twice
    first = Window.partitionBy("qid").orderBy("answer_label")
    heads = given.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= m).groupBy("qid").agg(F.array_sort(F.collect_list("answer_label")).alias("names"))
    named = heads.join(given.groupBy("qid").agg(F.count("*").alias("n")), "qid")
    joined = questions.select("qid", "qtype").join(templates, "qtype", "left").join(named, "qid", "left")
    more = F.col("n") - m
    listed = F.concat(F.array_join("names", ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    text = F.when(F.col("names").isNull() | F.col("sentence").isNull(), F.lit(fallback)).otherwise(F.replace("sentence", F.lit("%s"), listed))
    return joined.select("qid", text.alias("answer_text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_answers"))


def score(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid``, ``precision``, ``recall``, ``f1`` of every question in either table."""
    a = answers.select("qid", "answer_id").distinct().withColumn("given", F.lit(1))
    g = gold.select("qid", "answer_id").distinct().withColumn("right", F.lit(1))
    sums = a.join(g, ["qid", "answer_id"], "full_outer").groupBy("qid").agg(F.count("given").alias("n_given"), F.count("right").alias("n_right"), F.count(F.when(F.col("given").isNotNull() & F.col("right").isNotNull(), 1)).alias("hit"))
    p = F.when(F.col("n_given") > 0, F.col("hit") / F.col("n_given")).otherwise(0.0)
    r = F.when(F.col("n_right") > 0, F.col("hit") / F.col("n_right")).otherwise(0.0)
    return sums.select("qid", p.alias("precision"), r.alias("recall"), F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("n_given") + F.col("n_right"))).otherwise(0.0).alias("f1"))


def score_by_class(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """Means over the questions of each class."""
    return scores.join(classes, "qid").groupBy("qtype").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def score_ranking(candidates: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """``n``, ``hits_at_k``, ``mrr`` over the questions of ``gold``."""
    first = candidates.join(gold, ["qid", "answer_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    every = gold.select("qid").distinct().join(first, "qid", "left")
    return every.agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("rank", F.lit(10**9)) <= k).cast("double")), 6).alias("hits_at_k"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
