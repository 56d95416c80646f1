"""Questions as tables: templates, tokens, classes, mentions, relations, logical forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm, tokens
from kgloom.session import cut

#: Rows of one n-gram from which on it is looked up apart.
HOT = 50_000


def make_questions(nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """``qid`` (template id and anchor id), ``anchor_id``, ``tid``, ``text``: a question for each node of a template's type.

    ``templates`` has ``tid``, ``type`` and ``pattern`` with one ``%s`` for the label.
    """
    made = nodes.join(templates, "type")
    return made.select(F.concat_ws("|", "tid", "id").alias("qid"), F.col("id").alias("anchor_id"), "tid", F.expr("replace(pattern, '%s', label)").alias("text"))


def tokenize(df: DataFrame, col: str = "text") -> DataFrame:
    """``qid``, ``pos`` (from 0), ``tok``."""
    return df.select("qid", F.posexplode(tokens(F.col(col))).alias("pos", "tok"))


def classify(questions: DataFrame, cues: DataFrame, default: str = "list") -> DataFrame:
    """``qid``, ``qtype``: of the cues (``cue_norm``, ``qtype``, ``priority``) that a question's words hold, the one of highest priority."""
    # Cues are a word or a few: each question meets them by its n-grams, not one by one.
    longest = cues.agg(F.max(F.size(F.split("cue_norm", " ")))).head()[0] or 1
    # Cues are a vocabulary that people write, so they go to the n-grams: by n-gram, every question's "how many" would meet in one task.
    met = ngrams(questions, longest).join(F.broadcast(cues), F.col("gram") == F.col("cue_norm"))
    hit = met.groupBy("qid").agg(F.min(F.struct((-F.col("priority")).alias("late"), "qtype")).alias("best")).select("qid", "best.qtype")
    return questions.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("qtype", F.lit(default)).alias("qtype"))


def ngrams(questions: DataFrame, longest: int) -> DataFrame:
    """``qid``, ``start``, ``n_tok``, ``gram`` of all runs of up to ``longest`` words."""
    words = questions.select("qid", tokens(F.col("text")).alias("w")).where("size(w) > 0")
    starts = words.select("qid", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start"))
    spans = starts.select("qid", "w", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("start")))).alias("n_tok"))
    return spans.select("qid", "start", "n_tok", F.array_join(F.slice("w", F.col("start") + 1, F.col("n_tok")), " ").alias("gram"))


def find_mentions(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``qid``, ``start``, ``n_tok``, ``alias_norm``: runs of words that are an alias, unless a longer one, or one as long further left, overlaps."""
    longest = aliases.agg(F.max("n_tok")).head()[0] or 1
    names = aliases.select("alias_norm").distinct()
    grams = ngrams(questions, longest)
    # N-grams that very many questions hold, one for HOT rows at most, are looked up once each and go to the rows: joined by themselves, all rows of one would meet in a task.
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram")
    hot = cut(often.join(names.select(F.col("alias_norm").alias("gram"), F.lit(True).alias("known")), "gram", "left"))
    seldom = grams.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(names, F.col("gram") == F.col("alias_norm")).select("qid", "start", "n_tok", "alias_norm")
    common = grams.join(F.broadcast(hot.where("known").select("gram")), "gram").select("qid", "start", "n_tok", F.col("gram").alias("alias_norm"))
    raw = seldom.union(common)
    other = raw.select("qid", F.col("start").alias("start_2"), F.col("n_tok").alias("n_tok_2"))
    meets = "start < start_2 + n_tok_2 AND start_2 < start + n_tok"
    beats = "n_tok_2 > n_tok OR (n_tok_2 = n_tok AND start_2 < start)"
    beaten = raw.join(other, "qid").where(f"{meets} AND ({beats})").select("qid", "start", "n_tok").distinct()
    return raw.join(beaten, ["qid", "start", "n_tok"], "left_anti")


def deletions(word: str, most: int) -> Column:
    """A word and what is left of it without up to ``most`` of its letters: words at a distance of at most ``most`` have one of these in common."""
    level = every = F.array(word)
    for _ in range(most):
        fewer = F.transform(F.filter(level, lambda x: F.length(x) > 0), lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        level = F.array_distinct(F.flatten(fewer))
        every = F.concat(every, level)
    return F.array_distinct(every)


def correct_tokens(tokens_: DataFrame, vocab: DataFrame, max_dist: int = 1) -> DataFrame:
    """``qid``, ``pos``, ``tok``, ``fixed``: unknown words of four letters or more become the nearest known one with the same first letter."""
    known = vocab.select("tok").distinct()
    unknown = tokens_.select("tok").distinct().where("tok rlike '^[a-z]{4,}$'").join(known, "tok", "left_anti")
    first = F.substring("tok", 1, 1).alias("first")
    mine = unknown.select("tok", first, F.explode(deletions("tok", max_dist)).alias("left"))
    theirs = known.select(F.col("tok").alias("fixed"), first, F.explode(deletions("tok", max_dist)).alias("left"))
    near = mine.join(theirs, ["first", "left"]).select("tok", "fixed").distinct().withColumn("d", F.levenshtein("tok", "fixed", max_dist)).where("d >= 0")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("tok").orderBy("d", "fixed"))).where("nth = 1").select("tok", "fixed")
    return tokens_.join(best, "tok", "left").select("qid", "pos", "tok", F.coalesce("fixed", "tok").alias("fixed"))


def link_relations(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``qid``, ``phrase_norm``, ``path``, ``agg``, ``attr_p``: the longest phrase of the lexicon in each question, ties by phrase."""
    longest = lexicon.agg(F.max(F.size(F.split("phrase_norm", " ")))).head()[0] or 1
    # The lexicon is what people write and goes to the n-grams, see classify.
    hits = ngrams(questions, longest).join(F.broadcast(lexicon), F.col("gram") == F.col("phrase_norm"))
    best = hits.groupBy("qid").agg(F.min(F.struct((-F.col("n_tok")).alias("short"), "phrase_norm", "path", "agg", "attr_p")).alias("best"))
    return best.select("qid", "best.phrase_norm", "best.path", "best.agg", "best.attr_p")


def link_filters(questions: DataFrame, filters: DataFrame, attrs: DataFrame) -> DataFrame:
    """``qid``, ``filter_p``, ``value``: conditions on the answers, a phrase of ``filters`` (``phrase_norm``, ``attr_p``) followed by a value that the attribute has."""
    # Names of attributes: as many as the vocabulary has. Others are not made distinct for their values.
    names = sorted(r["attr_p"] for r in filters.where("attr_p IS NOT NULL").select("attr_p").distinct().collect())
    # As many rows as attributes of this kind have different values: they meet the questions' n-grams by equality.
    values = attrs.where(F.col("p").isin(names) & F.col("v_str").isNotNull()).select(F.col("p").alias("attr_p"), norm(F.col("v_str")).alias("value")).where("value <> ''").distinct()
    wanted = filters.join(values, "attr_p").select("attr_p", "value", F.concat_ws(" ", "phrase_norm", "value").alias("gram"))
    longest = wanted.agg(F.max(F.size(F.split("gram", " ")))).head()[0] or 1
    return ngrams(questions, longest).join(wanted, "gram").select("qid", F.col("attr_p").alias("filter_p"), "value").distinct()


def disambiguate(mentions: DataFrame, aliases: DataFrame, relations: DataFrame, predicates: DataFrame, nodes: DataFrame, degrees: DataFrame, k: int = 1) -> DataFrame:
    """Mentions with ``id`` and ``rank``: ids of the alias by fit of type with the relation's first step, then degree, then id; the first k."""
    # Ids of an alias are ranked once for each type, before questions fan out: the first k of a question are among these.
    found = cut(aliases.select("alias_norm", "id").join(mentions.select("alias_norm").distinct(), "alias_norm", "left_semi").join(nodes.select("id", "type"), "id"))
    # Degrees are of use only where a name is that of several.
    several = cut(found.join(found.groupBy("alias_norm").agg(F.count("*").alias("n")).where("n > 1").select("alias_norm"), "alias_norm", "left_semi").select("id").distinct())
    if several.isEmpty():
        named = found.withColumn("degree", F.lit(None).cast("long"))
    else:
        named = found.join(degrees.join(several, "id", "left_semi").select("id", (F.col("n_in") + F.col("n_out")).alias("degree")), "id", "left")
    of_type = Window.partitionBy("alias_norm", "type").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id")
    ids = mentions.join(named.withColumn("nth", F.row_number().over(of_type)).where(F.col("nth") <= k).drop("nth"), "alias_norm")
    first = relations.select("qid", F.regexp_extract("path", r"^([+-])", 1).alias("dir"), F.regexp_extract("path", r"^[+-]([^/]+)", 1).alias("p"))
    ends = predicates.groupBy("p").agg(F.collect_set("from_type").alias("from_types"), F.collect_set("to_type").alias("to_types"))
    wanted = first.join(ends, "p", "left").select("qid", F.when(F.col("dir") == "+", F.col("from_types")).otherwise(F.col("to_types")).alias("types"))
    scored = ids.join(wanted, "qid", "left").withColumn("fit", F.coalesce(F.array_contains("types", F.col("type")), F.lit(True)).cast("int"))
    best = Window.partitionBy("qid", "start").orderBy(F.desc("fit"), F.coalesce("degree", F.lit(0)).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "start", "n_tok", "alias_norm", "id", "rank")


def steps(path) -> F.Column:
    """A path as text, ``+a/-b``, as an array of predicate and direction."""
    return F.transform(F.split(path, "/"), lambda x: F.struct(F.substring(x, 2, 1000).alias("p"), F.substring(x, 1, 1).alias("dir")))


def assemble(questions: DataFrame, mentions: DataFrame, relations: DataFrame, classes: DataFrame, predicates: DataFrame, nodes: DataFrame) -> DataFrame:
    """One ``parsed`` row a question: ``qid``, ``qtype``, ``anchor_id``, ``path``, ``agg``, ``attr_p``, ``target_id``.

    The first mention that fits the path's first step is the anchor; in a boolean question the other one is the
    target. A path with an unknown predicate, or a first step that does not fit the anchor's type, gives a null path.
    """
    first = relations.select("qid", "path", "agg", "attr_p", F.regexp_extract("path", r"^([+-])", 1).alias("dir"), F.regexp_extract("path", r"^[+-]([^/]+)", 1).alias("p"))
    ends = predicates.select("p", "from_type", "to_type").distinct()
    placed = mentions.where("rank = 1").join(nodes.select("id", "type"), "id").join(first, "qid")
    fitting = placed.join(ends, "p", "left").withColumn("fits", F.expr("p = '' OR coalesce(if(dir = '+', from_type, to_type) = type, false)"))
    per_id = fitting.groupBy("qid", "start", "id").agg(F.max("fits").alias("fits"))
    ranked = per_id.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((~F.col("fits")).alias("misfit"), "start", "id"))).alias("m"))
    heads = ranked.select("qid", F.expr("if(m[0].misfit, null, m[0].id)").alias("anchor_id"), F.expr("get(filter(m, x -> x.id <> m[0].id), 0).id").alias("other"))
    known = {r["p"] for r in predicates.select("p").distinct().collect()}  # the vocabulary of predicates, which is small
    valid = F.forall(steps(F.col("path")), lambda x: x.p.isin(*known))
    out = questions.select("qid").join(classes, "qid", "left").join(heads, "qid", "left").join(relations.drop("phrase_norm"), "qid", "left")
    return out.select(
        "qid",
        "qtype",
        "anchor_id",
        F.when(F.col("anchor_id").isNotNull() & (valid | (F.col("path") == "")), F.col("path")).alias("path"),
        "agg",
        "attr_p",
        F.when(F.col("qtype") == "boolean", F.col("other")).alias("target_id"),
    )


def union_questions(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
