"""Queries of a graph: patterns, paths, sets, aggregates. Patterns name variables by a leading question mark."""

from __future__ import annotations

import itertools
import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import kind_and_number
from kgloom.session import cut


def match(edges: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Distinct ``s``, ``p``, ``o`` of the edges with the bound ends."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges.select("s", "p", "o").distinct()


def filter_attr(ids: DataFrame, attrs: DataFrame, p: str, cond: Column | str) -> DataFrame:
    """The ids whose attribute ``p`` meets a condition on ``v_num``, ``v_str`` or ``v_ts``."""
    hits = attrs.where(F.col("p") == p).where(cond).select(F.col("s").alias("id"))
    return ids.join(hits, "id", "left_semi")


def entity_record(attrs: DataFrame, ids: DataFrame, preds: list[str] | None = None) -> DataFrame:
    """``id`` with a column for each of ``preds``, or with a map of all attributes."""
    value = F.coalesce("v_str", F.col("v_num").cast("string"), F.col("v_ts").cast("string"))
    mine = attrs.join(ids.select(F.col("id").alias("s")).distinct(), "s", "left_semi")
    if preds:
        return mine.where(F.col("p").isin(*preds)).groupBy(F.col("s").alias("id")).pivot("p", preds).agg(F.first(value))
    return mine.groupBy(F.col("s").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", value.alias("v"))))).alias("record"))


def _bindings(edges: DataFrame, pattern: tuple[str, str, str], distinct: bool = False) -> DataFrame:
    """The variables of one pattern as columns; edges that are ``distinct`` already, by ``s``, ``p`` and ``o``, are not compared once more."""
    s, p, o = pattern
    rows = edges.where(F.col("p") == p) if not p.startswith("?") else edges
    out: dict[str, Column] = {}
    for name, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            rows = rows.where(F.col(name) == term)
        elif term[1:] in out:
            rows = rows.where(F.col(name) == out[term[1:]])
        else:
            out[term[1:]] = F.col(name)
    made = rows.select(*[c.alias(v) for v, c in out.items()])
    return made if distinct else made.distinct()


def _sizes(bindings: list[DataFrame]) -> list[dict]:
    """For each pattern its rows, as ``*``, about how many values each of its variables has, and as ``kind *`` the one kind whose numbered ids these all are; one job for all."""
    counts = []
    for k, b in enumerate(bindings):
        facts = [F.count("*").alias("*")]
        for c in b.columns:
            kind, number = kind_and_number(c)
            facts += [F.approx_count_distinct(c).alias(c), F.when((F.min(number) >= 0) & (F.min(kind) == F.max(kind)), F.min(kind)).alias(f"kind {c}")]
        counts.append(b.agg(*facts).select(F.lit(k).alias("nth"), F.to_json(F.struct("*")).alias("sizes")))
    return [json.loads(r["sizes"]) for r in reduce(DataFrame.union, counts).orderBy("nth").collect()]


def match_all(edges: DataFrame, patterns: list[tuple[str, str, str]], distinct: bool = False) -> DataFrame:
    """Bindings of a conjunction of patterns, each of which must share a variable with others.

    Variables are bound one after another, beginning with the pattern from which counts promise least. Where several
    patterns hold a new variable beside bound ones, as in a cycle, each row is extended by that of them in which it has
    fewest partners (counted exactly), and the others only confirm: a row with few orders looks at its orders though
    another pattern has many for it. Patterns whose variables are all bound filter. A variable whose values all are
    numbered ids of one kind is joined by the numbers. Bindings are distinct, so that joins of them are; ``distinct``
    says that edges are, by ``s``, ``p`` and ``o``.
    """
    bindings, kinds = [_bindings(edges, p, distinct) for p in patterns], {}
    if len(bindings) > 2:
        bindings = [cut(b) for b in bindings]  # read for sizes, degrees and joins
        sizes = _sizes(bindings)

        def growth(k: int) -> float:
            """Rows of a pattern times the least mean number of partners in a pattern that shares a variable."""
            means = [sizes[j]["*"] / max(1, *(sizes[j][c] for c in b.columns if c in bindings[k].columns)) for j, b in enumerate(bindings) if j != k and set(b.columns) & set(bindings[k].columns)]
            return sizes[k]["*"] * min(means, default=1.0)

        start = min(range(len(bindings)), key=growth)
        seen = {c: {x.get(f"kind {c}") for x, b in zip(sizes, bindings, strict=True) if c in b.columns} for b in bindings for c in b.columns}
        kinds = {c: k for c, (k, *more) in seen.items() if k is not None and not more}
        bindings = [b.select(*[kind_and_number(c)[1].alias(c) if c in kinds else c for c in b.columns]) for b in bindings]
    else:
        start = 0
    found, left = bindings[start], [b for k, b in enumerate(bindings) if k != start]
    while left:
        bound = set(found.columns)
        if whole := [b for b in left if set(b.columns) <= bound]:
            found = found.join(whole[0], whole[0].columns, "left_semi")
            left.remove(whole[0])
            continue
        near = [b for b in left if set(b.columns) & bound]
        if not near:
            raise ValueError(f"no shared variable: {left[0].columns}")
        new = {frozenset(b.columns) - bound for b in near}
        # The new variable that most patterns hold; a pattern with several new ones stands alone.
        fresh = max(new, key=lambda v: (len(v) == 1, sum(frozenset(b.columns) - bound == v for b in near), sorted(v)))
        several = [b for b in near if frozenset(b.columns) - bound == fresh] if len(fresh) == 1 else [b for b in near if frozenset(b.columns) - bound == fresh][:1]
        left = [b for b in left if b not in several]
        shared = [[c for c in b.columns if c in bound] for b in several]
        if len(several) == 1:
            found = found.join(several[0], shared[0])
            continue
        columns = found.columns
        for k, (b, on) in enumerate(zip(several, shared, strict=True)):
            found = found.join(b.groupBy(*on).agg(F.count("*").alias(f"partners {k}")), on)
        least = F.least(*[F.col(f"partners {k}") for k in range(len(several))])
        fewest = reduce(lambda rest, k: F.when(F.col(f"partners {k}") == least, k).otherwise(rest), range(len(several) - 1), F.lit(len(several) - 1))
        found = cut(found.select(*columns, fewest.alias("by")))
        # Patterns that no row is extended by need not be read for it.
        used = {r["by"] for r in found.select("by").distinct().collect()} or {0}
        parts = []
        for k, (b, on) in enumerate(zip(several, shared, strict=True)):
            if k not in used:
                continue
            part = found.where(F.col("by") == k).drop("by").join(b, on)
            for j, other in enumerate(several):
                if j != k:
                    part = part.join(other, other.columns, "left_semi")
            parts.append(part.select(*columns, *fresh))
        found = reduce(DataFrame.union, parts)
    return found.select(*[F.concat(F.lit(f"{kinds[c]}:"), F.col(c).cast("string")).alias(c) if c in kinds else c for c in found.columns])


def match_optional(left: DataFrame, edges: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    more = _bindings(edges, pattern)
    return left.join(more, [c for c in more.columns if c in left.columns], "left")


def match_exists(left: DataFrame, edges: DataFrame, pattern: tuple[str, str, str], negate: bool = False) -> DataFrame:
    more = _bindings(edges, pattern)
    shared = [c for c in more.columns if c in left.columns]
    return left.join(more.select(shared), shared, "left_anti" if negate else "left_semi")


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Alternative (``any``), common (``both``) or excluded (``minus``) answers."""
    b = b.select(a.columns)
    return {"any": a.union(b).distinct(), "both": a.intersect(b), "minus": a.subtract(b)}[how]


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``p``, ``dir``, ``other``, in both directions; a loop shows once in each."""
    keys = ids.select("id").distinct()
    out = edges.select(F.col("s").alias("id"), "p", F.lit("out").alias("dir"), F.col("o").alias("other"))
    into = edges.select(F.col("o").alias("id"), "p", F.lit("in").alias("dir"), F.col("s").alias("other"))
    return out.join(keys, "id", "left_semi").unionByName(into.join(keys, "id", "left_semi")).distinct()


def hop(edges: DataFrame, at: DataFrame, p: str, forward: bool, anchor: list[str]) -> DataFrame:
    """One step of a path from ``id``, with the ``anchor`` columns carried; distinct, so that paths do not multiply."""
    a, b = ("s", "o") if forward else ("o", "s")
    step = edges.where(F.col("p") == p).select(F.col(a).alias("id"), F.col(b).alias("next"))
    return at.join(step, "id").select(*anchor, F.col("next").alias("id")).distinct()


def follow(edges: DataFrame, anchors: DataFrame, path: list[tuple[str, str]]) -> DataFrame:
    """``anchor``, ``id``: distinct ends of a path of (predicate, ``+`` or ``-``) from each anchor id."""
    at = anchors.select(F.col("id").alias("anchor"), "id").distinct()
    for p, direction in path:
        at = hop(edges, at, p, direction == "+", ["anchor"])
    return at


def reach(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``id``, ``hops``: the nodes within k steps in any direction, with the least number. Only the frontier is joined."""
    pairs = cut(edges.select(F.col("s").alias("id"), F.col("o").alias("next")).union(edges.select("o", "s")).distinct())
    seen = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for n in range(1, k + 1):
        front = cut(front.join(pairs, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(n)))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def closure(edges: DataFrame, preds: list[str]) -> DataFrame:
    """``s``, ``o``, ``depth``: all ancestors over the given predicates with the least depth, however deep; cycles end, as a frontier holds new pairs only."""
    base = cut(edges.where(F.col("p").isin(*preds)).select("s", "o").distinct())
    step = base.select(F.col("s").alias("o"), F.col("o").alias("next"))
    seen = cut(base.withColumn("depth", F.lit(1)))
    front = seen
    for n in itertools.count(2):
        front = cut(front.join(step, "o").select("s", F.col("next").alias("o")).distinct().join(seen, ["s", "o"], "left_anti").withColumn("depth", F.lit(n)))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``s``, ``o``, ``hops``, ``path``: for each pair the fewest forward steps, k at most, and the least such path as text.

    Frontiers grow from both ends, each time the smaller one, and meet. Each keeps one path, the least, for every end and
    node: a least path is the least way to where the frontiers meet, and the least way on from there. Ends of pairs that
    are settled grow no further.
    """
    step = cut(edges.select(F.col("s").alias("at"), F.col("o").alias("next")).distinct())
    left = cut(pairs.select("s", "o").distinct())
    found = left.where("s = o").select("s", "o", F.lit(0).alias("hops"), F.col("s").alias("path"))
    left = left.where("s <> o")
    front = {end: cut(left.select(end, F.col(end).alias("at"), F.array(end).alias("way")).distinct()) for end in ("s", "o")}
    seen = {end: front[end].select(end, "at") for end in front}
    for n in range(1, k + 1):
        end = min(front, key=lambda x: front[x].count())
        if end == "s":
            grown = front[end].join(step, "at").select(end, F.col("next").alias("at"), F.array_append("way", F.col("next")).alias("way"))
        else:
            grown = front[end].join(step.toDF("before", "at"), "at").select(end, F.col("before").alias("at"), F.array_prepend("way", F.col("before")).alias("way"))
        front[end] = cut(grown.join(seen[end], [end, "at"], "left_anti").groupBy(end, "at").agg(F.min("way").alias("way")))
        seen[end] = cut(seen[end].union(front[end].select(end, "at")))
        # Where they meet a path of n steps is whole; the shorter ones are settled.
        met = left.join(front["s"], "s").join(front["o"].withColumnRenamed("way", "on"), ["o", "at"])
        hits = cut(met.groupBy("s", "o").agg(F.min(F.concat("way", F.slice("on", F.lit(2), F.greatest(F.size("on") - 1, F.lit(0))))).alias("way")))
        found = cut(found.union(hits.select("s", "o", F.lit(n).alias("hops"), F.array_join("way", ">").alias("path"))))
        left = cut(left.join(hits, ["s", "o"], "left_anti"))
        front = {end: cut(front[end].join(left.select(end).distinct(), end, "left_semi")) for end in front}
        if any(x.isEmpty() for x in front.values()):
            break
    return found


def common_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``p``, ``n``: objects that both of a pair have by the same predicate."""
    left = edges.select(F.col("s").alias("a"), "p", "o").distinct()
    right = edges.select(F.col("s").alias("b"), "p", "o").distinct()
    return pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "p", "o"]).groupBy("a", "b", "p").agg(F.count("*").alias("n"))


def in_order(ids: DataFrame) -> DataFrame:
    """``s`` and ``at``: whole numbers from 0 in the order of the ids, which are distinct; of four bytes where these suffice."""
    placed = cut(ids.select("s").orderBy("s").withColumn("at", F.monotonically_increasing_id()))
    # A row for each task that wrote; the number of a row begins with that of its task.
    sizes = sorted((r["task"], r["n"]) for r in placed.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip([t for t, _ in sizes], itertools.accumulate([0, *(n for _, n in sizes)]), strict=False))
    first = ids.sparkSession.createDataFrame(list(starts.items()), "task long, first long")
    kind = "int" if sum(n for _, n in sizes) < 2**31 else "long"
    at = (F.col("first") + F.col("at").bitwiseAND(2**33 - 1)).cast(kind)
    return placed.join(F.broadcast(first), F.shiftright("at", 33) == F.col("task")).select("s", at.alias("at"))


#: Others that a subject gathers before they are counted.
WAITING = 1 << 20


def shared(lists: DataFrame, k: int | None = None) -> DataFrame:
    """``id``, ``other``, ``n``: in how many of the ``lists`` (``others``, distinct numbers) two are; with ``k`` for each the k that are with it most often, ties to the smaller.

    Lists go to their members, who count them in arrays: pairs are neither rows nor shuffled, and a member's
    lists are counted as they come.
    """
    kind = lists.schema["others"].dataType.elementType.simpleString()

    def counted(parts):
        seen, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return seen, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(at, parts):
        others, n = counted(parts)
        others, n = others[others != at], n[others != at]
        if k is not None and len(n) > k:
            least = -np.partition(-n, k - 1)[k - 1]
            others, n = others[n >= least], n[n >= least]
            best = np.argsort(-n, kind="stable")[:k]
            others, n = others[best], n[best]
        return np.full(len(n), at, others.dtype), others, n

    def work(batches):
        at, parts, size = None, [], 0
        for batch in batches:
            ids, lists_ = batch.column(0).to_numpy(), batch.column(1)
            ends, values = lists_.offsets.to_numpy(), lists_.values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if len(ids) else np.array([], int)
            out = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and ids[i] != at:
                    out.append(rows(at, parts))
                    parts, size = [], 0
                at, some = ids[i], values[ends[i] : ends[j]]
                parts.append((some, np.ones(len(some))))
                size += len(some)
                if size > WAITING:
                    parts, size = [counted(parts)], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "other", "n"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(at, parts)], names=["id", "other", "n"])

    dealt = lists.select(F.explode("others").alias("id"), "others").repartition("id").sortWithinPartitions("id")
    return dealt.mapInArrow(work, f"id {kind}, other {kind}, n long")


def related(edges: DataFrame, p: str, k: int, hub: int = 256) -> DataFrame:
    """``id``, ``other``, ``n``, ``rank``: of the subjects of ``p`` the k that share most objects, ties to the smaller id.

    Subjects are numbered in their order. Those of an object that at most ``hub`` have meet by its list. Those of a hub
    do not: subjects with the same set of hubs are a class, classes that share hubs meet, and the ``k + 1`` smallest ids
    of the classes that share most are all that a subject can need of those that it meets in hubs alone. Any other of
    these is behind k that share as many. Pairs so grow with a hub's classes and not with its subjects.
    """
    named = cut(edges.where((F.col("p") == p) & F.col("s").isNotNull() & F.col("o").isNotNull()).select("s", "o").distinct())
    ids = cut(in_order(named.select("s").distinct()))
    mine = cut(named.join(ids, "s").select(F.col("at").alias("s"), "o"))
    degrees = mine.groupBy("o").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "other"))
    hubs = cut(degrees.where(F.col("n") > hub).select("o"))
    plain = hubs.isEmpty()
    few = mine if plain else mine.join(hubs, "o", "left_anti")
    met = shared(few.groupBy("o").agg(F.collect_list("s").alias("others")).where(F.size("others") > 1), k if plain else None)

    def best(pairs: DataFrame) -> DataFrame:
        top = pairs.withColumn("rank", first).where(F.col("rank") <= k).withColumnsRenamed({"id": "at", "other": "at_other"})
        own, others = ids.select("at", F.col("s").alias("id")), ids.select(F.col("at").alias("at_other"), F.col("s").alias("other"))
        return top.join(own, "at").join(others, "at_other").select("id", "other", "n", "rank")

    if plain:
        return best(met)
    held = mine.join(hubs, "o").groupBy("s").agg(F.array_sort(F.collect_list("o")).alias("held"))
    held = cut(held.select("s", "held", F.md5(F.array_join("held", "\n")).alias("of")))
    smallest = F.row_number().over(Window.partitionBy("of").orderBy("s"))
    heads = held.select("of", "s").withColumn("nth", smallest).where(F.col("nth") <= k + 1).select(F.col("of").alias("to"), F.col("s").alias("other"))
    classes = cut(held.groupBy("of").agg(F.any_value("held").alias("held")).select("of", F.explode("held").alias("o")))
    near = classes.join(classes.select(F.col("of").alias("to"), "o"), "o").groupBy("of", "to").agg(F.count("*").alias("n"))
    most = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "other"))
    tops = near.join(heads, "to").withColumn("nth", most).where(F.col("nth") <= k + 1).select("of", "other", "n")
    in_hubs = held.select(F.col("s").alias("id"), "of").join(tops, "of").where("id <> other").select("id", "other", "n")
    # Pairs that share other objects count with their common hubs too.
    a, b = held.select(F.col("s").alias("id"), F.col("held").alias("mine")), held.select(F.col("s").alias("other"), F.col("held").alias("its"))
    common = F.coalesce(F.size(F.array_intersect("mine", "its")), F.lit(0))
    in_all = met.join(a, "id", "left").join(b, "other", "left").select("id", "other", (F.col("n") + common).alias("n"))
    return best(in_all.union(in_hubs).groupBy("id", "other").agg(F.max("n").alias("n")))


def aggregate(matches: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Grouped by variables: name = (``count`` | ``count_distinct`` | ``sum`` | ``avg`` | ``min`` | ``max``, column)."""
    functions = {"count": F.count, "count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return matches.groupBy(*by).agg(*[functions[f](c).alias(name) for name, (f, c) in aggs.items()])


def superlative(matches: DataFrame, attrs: DataFrame, p: str, k: int | None = None, desc: bool = True, anchor: list[str] | None = None) -> DataFrame:
    """The ids of each anchor with the greatest (or least) attribute: all that tie for first, or with ``k`` the first k, ties by id."""
    anchor = anchor or ["anchor"]
    valued = matches.join(attrs.where(F.col("p") == p).select(F.col("s").alias("id"), F.col("v_num").alias("value")), "id").where("value IS NOT NULL")
    order = F.desc("value") if desc else F.asc("value")
    if k is None:
        return valued.withColumn("rank", F.rank().over(Window.partitionBy(*anchor).orderBy(order))).where("rank = 1").select(*anchor, "id", "value")
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy(*anchor).orderBy(order, "id"))).where(F.col("rank") <= k).select(*anchor, "id", "value", "rank")


def any_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
