"""Keeping a graph: deltas, differences, integrity, duplicate entities, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import id_of, kind_and_number
from kgloom.session import cut

KEY = ["s", "p", "o", "domain"]


def latest_ops(delta: DataFrame) -> DataFrame:
    """The latest ``op`` of each edge of a delta (``op``, ``ts``), a delete on equal times."""
    (s, s_number), (o, o_number) = kind_and_number("s"), kind_and_number("o")
    packed = delta.select(s_number.alias("s_number"), o_number.alias("o_number"), "ts", s.alias("s"), o.alias("o"), "p", "domain", "op")
    latest = Window.partitionBy("s_number", "o_number", "s", "o", "p", "domain").orderBy(F.col("ts").desc_nulls_last(), F.col("op"))
    first = packed.withColumn("nth", F.row_number().over(latest)).where("nth = 1")
    return first.select(id_of(F.col("s"), F.col("s_number")).alias("s"), "p", id_of(F.col("o"), F.col("o_number")).alias("o"), "domain", "op")


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges after upserts and deletes (``op``, ``ts``): the latest op of an edge wins, a delete on equal times.

    Edges are a set; they are looked up in the delta, which alone is ordered. ``store.change`` does the same to a stored graph and reads the touched folders only.
    """
    ops = latest_ops(delta)
    return edges.select(*KEY).join(ops.select(*KEY), KEY, "left_anti").unionByName(ops.where("op = 'upsert'").select(*KEY))


def signed_sums(signed: DataFrame) -> DataFrame:
    """Edges with ``change`` (``added``, ``removed``) of those with ``sign`` +1 and -1, as often as one side has more of them."""
    sums = signed.groupBy(*KEY).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return sums.select(*KEY, F.explode(F.expr("array_repeat(if(sign > 0, 'added', 'removed'), cast(abs(sign) as int))")).alias("change"))


def diff_kg(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``change``: ``added`` or ``removed``. Each side is read once, and one sum settles what both have. ``store.diff`` compares stored graphs by digests first."""
    return signed_sums(old.select(*KEY).withColumn("sign", F.lit(-1)).unionByName(new.select(*KEY).withColumn("sign", F.lit(1))))


def dangling_edges(edges: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Edges with ``missing``: the end (``s`` or ``o``) that is no node; an edge may stand twice.

    Ends are looked up, each once, and edges only where their predicate has a missing end. ``ends`` (``p``, ``end``,
    ``id``; see ``build.map_ends``) are those of ``edges`` where they can be had without making these distinct.
    """
    if ends is None:
        ends = edges.select("p", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in ("s", "o")])).alias("e")).select("p", "e.*").distinct()
    lost = cut(ends.join(nodes.select("id"), "id", "left_anti"))
    # Names of predicates: as many as the vocabulary has, whatever the number of edges.
    names = [(r["p"], r["end"]) for r in lost.select("p", "end").distinct().collect()]
    found = []
    for end in ("s", "o"):
        some = edges.where(F.col("p").isin(sorted(p for p, e in names if e == end)))
        ids = lost.where(F.col("end") == end).select("p", F.col("id").alias(end))
        found.append(some.join(ids, ["p", end], "left_semi").select(*edges.columns, F.lit(end).alias("missing")))
    return found[0].unionByName(found[1])


def violations(edges: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """``s``, ``p``, ``domain``, ``rule``, ``n``: several objects of a functional predicate; subjects or objects of a wrong type."""
    predicates = F.broadcast(predicates)  # the vocabulary of predicates, which is small: by predicate, all edges of one would meet in a task
    ruled = edges.join(predicates.where("functional").select("p", "domain"), ["p", "domain"])
    several = ruled.groupBy("s", "p", "domain").agg(F.countDistinct("o").alias("n")).where("n > 1").withColumn("rule", F.lit("several objects"))
    kinds = nodes.select("id", "type")
    typed = edges.join(predicates.select("p", "domain", "from_type", "to_type"), ["p", "domain"])

    def wrong(end: str, want: str, rule: str) -> DataFrame:
        met = typed.join(kinds, typed[end] == kinds.id).where(F.col("type") != F.col(want))
        return met.groupBy("s", "p", "domain").agg(F.countDistinct("o").alias("n")).withColumn("rule", F.lit(rule))

    columns = ["s", "p", "domain", "rule", "n"]
    return several.select(columns).unionByName(wrong("s", "from_type", "subject type").select(columns)).unionByName(wrong("o", "to_type", "object type").select(columns))


def _segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """Where the i-th of ``parts`` even segments of so many letters starts, and its length: the first ones are the shorter ones."""
    short = f"({length} div {parts})"
    longer = f"greatest(0, {i} - ({parts} - {length} % {parts}))"
    return f"({i} * {short} + {longer})", f"({short} + if({i} >= {parts} - {length} % {parts}, 1, 0))"


def near_labels(labels: DataFrame, by: list[str], max_dist: int) -> DataFrame:
    """``by``, ``a``, ``b``: labels (``low``) of one block within an edit distance, the shorter or as long one first, each with itself too.

    A label is cut into one segment more than it may have edits, so that one of them stands unchanged in any label that
    is near, moved by as many places at most (Pass-Join, Li et al., VLDB 2011). Only labels that share a segment are
    compared, however many a block has.
    """
    parts = max_dist + 1
    own, seen = [], []
    for i in range(parts):
        start, size = _segment("n", i, parts)
        own.append(f"named_struct('l', n, 'i', {i}, 'x', substring(low, {start} + 1, {size}))")
        for fewer in range(parts):
            start, size = _segment(f"(n - {fewer})", i, parts)
            seen += [f"if(n - {fewer} > {max_dist} AND {start} + {shift} >= 0 AND {start} + {shift} + {size} <= n, named_struct('l', n - {fewer}, 'i', {i}, 'x', substring(low, {start} + {shift} + 1, {size})), NULL)" for shift in range(-max_dist, parts)]
    # Labels with fewer letters than segments meet by their shortness.
    brief = "named_struct('l', -1, 'i', 0, 'x', '')"
    sized = labels.where("low IS NOT NULL").select(*by, "low", F.length("low").alias("n"))
    mine = sized.select(*by, F.col("low").alias("a"), F.expr(f"explode(if(n > {max_dist}, array({', '.join(own)}), array({brief})))").alias("sign"))
    theirs = sized.select(*by, F.col("low").alias("b"), F.expr(f"explode(array_distinct(filter(array({', '.join(seen)}, if(n <= {2 * max_dist}, {brief}, NULL)), x -> x IS NOT NULL)))").alias("sign"))
    # A label has many segments, which the optimiser does not count: it would broadcast them all through the driver.
    met = mine.select(*by, "a", "sign.*").hint("merge").join(theirs.select(*by, "b", "sign.*"), [*by, "l", "i", "x"])
    return met.where("length(a) <= length(b)").where(F.levenshtein("a", "b", max_dist) >= 0).select(*by, "a", "b").distinct()


def _near_nodes(nodes: DataFrame, attrs: DataFrame, block: list[str], max_dist: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes by block and label (``id``, ``low``), which labels of a block are near (``a``, ``b``), and the columns of a block."""
    wide = attrs.where(F.col("p").isin(*block)).select("s", "p", F.coalesce("v_str", F.col("v_num").cast("string")).alias("v"))
    keys = [f"block_{k}" for k in range(len(block))]
    values = wide.groupBy("s").pivot("p", block).agg(F.first("v")).toDF("id", *keys).dropna(subset=keys)
    keyed = cut(nodes.select("id", F.col("type").alias("kind"), F.lower("label").alias("low")).join(values, "id"))
    by = ["kind", *keys]
    return keyed, near_labels(keyed.select(*by, "low").distinct(), by, max_dist), by


def match_entities(nodes: DataFrame, attrs: DataFrame, block: list[str], max_dist: int) -> DataFrame:
    """``id``, ``dup_id``: pairs of a type that agree in the given attributes and whose labels are within an edit distance."""
    keyed, near, by = _near_nodes(nodes, attrs, block, max_dist)
    left, right = keyed.select(*by, F.col("low").alias("a"), F.col("id").alias("x")), keyed.select(*by, F.col("low").alias("b"), F.col("id").alias("y"))
    pairs = near.join(left, [*by, "a"]).join(right, [*by, "b"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("dup_id")).distinct()


def match_links(nodes: DataFrame, attrs: DataFrame, block: list[str], max_dist: int) -> DataFrame:
    """``id``, ``dup_id``: some of the pairs of ``match_entities`` that have the same components.

    Nodes of one block and label all match each other: each is linked with the least of them only, and the least ones of
    near labels with each other. So links grow with the nodes, and pairs with the square of how many have one label.
    """
    keyed, near, by = _near_nodes(nodes, attrs, block, max_dist)
    least = cut(keyed.where("low IS NOT NULL").groupBy(*by, "low").agg(F.min("id").alias("head")))
    own = keyed.join(least, [*by, "low"]).select(F.col("head").alias("x"), F.col("id").alias("y"))
    heads = near.where("a <> b").join(least.withColumnsRenamed({"low": "a", "head": "x"}), [*by, "a"]).join(least.withColumnsRenamed({"low": "b", "head": "y"}), [*by, "b"]).select("x", "y")
    return own.union(heads).where("x <> y").select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("dup_id")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``id``, ``canonical``: the least id reachable over the pairs. A round takes the least among neighbours and then that one's own."""
    both = cut(pairs.select(F.col("id").alias("a"), F.col("dup_id").alias("b")).union(pairs.select("dup_id", "id")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("canonical")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("canonical").alias("seen"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("canonical", "seen").alias("hop"), F.col("canonical").alias("was"))
        far = step.select(F.col("id").alias("hop"), F.col("hop").alias("far"))
        moved = cut(step.join(far, "hop", "left").select("id", F.least("hop", "far").alias("canonical"), "was"))
        labels = moved.select("id", "canonical")
        if moved.where("canonical <> was").isEmpty():
            return labels


def canonicalize(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the canonical id of their component, distinct."""
    names = components(pairs)
    s = names.select(F.col("id").alias("s"), F.col("canonical").alias("new_s"))
    o = names.select(F.col("id").alias("o"), F.col("canonical").alias("new_o"))
    return edges.join(s, "s", "left").join(o, "o", "left").select(F.coalesce("new_s", "s").alias("s"), "p", F.coalesce("new_o", "o").alias("o"), "domain").dropDuplicates()


def kg_stats(edges: DataFrame, approximate: bool = False) -> DataFrame:
    """``p``, ``n_edges``, ``n_s``, ``n_o``, ``max_in``: of each predicate, the last over objects."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    by_object = edges.groupBy("p", "o").agg(F.count("*").alias("n")).groupBy("p").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_o"), F.max("n").alias("max_in"))
    return by_object.join(edges.groupBy("p").agg(count("s").alias("n_s")), "p").select("p", "n_edges", "n_s", "n_o", "max_in")


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``n_in``, ``n_out``."""
    ends = edges.select(F.col("s").alias("id"), F.lit("out").alias("dir")).unionByName(edges.select(F.col("o").alias("id"), F.lit("in").alias("dir")))
    return ends.groupBy("id").pivot("dir", ["in", "out"]).count().select("id", F.coalesce("in", F.lit(0)).alias("n_in"), F.coalesce("out", F.lit(0)).alias("n_out"))
