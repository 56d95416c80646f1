"""Nearest vectors, related entities and similar sets against brute force, also where one key holds most rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgloom.operators import knn, query

rng = random.Random(8)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def nearest(queries, vectors, k):
    unit = {i: np.array(v, float) / max(np.linalg.norm(v), 1e-300) for i, v in [*queries, *vectors]}
    out = []
    for q, _ in queries:
        best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i, _ in vectors if i != q)[:k]
        out += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 37])
def test_nearest_vectors_are_exact_and_few_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    made = np.random.default_rng(3)
    centres = made.normal(size=(25, 12))
    vectors = [(i, (centres[i % 25] + 0.05 * made.normal(size=12)).tolist()) for i in range(1500)]
    vectors += [(2000, [0.0] * 12), (2001, vectors[7][1]), (2002, vectors[7][1])]
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame([*vectors, (3000, None), (3001, [None] * 12)], schema).repartition(5)
    asked = [v for v in vectors if v[0] % 50 == 0 or v[0] in (7, 2000)]
    found, read = knn.search(spark.createDataFrame(asked, schema), frame, 6)
    assert rows_of(found.select("query_id", "vec_id", "rank")) == nearest(asked, vectors, 6)
    compared = {r["query_id"]: r["compared"] for r in read.collect()}
    assert sum(n for q, n in compared.items() if q != 2000) < 0.15 * len(compared) * len(vectors)
    assert knn.search(frame.limit(0), frame, 3)[0].count() == 0 and knn.search(frame, frame.limit(0), 3)[0].count() == 0


def most_related(pairs, k):
    of, having = defaultdict(set), defaultdict(set)
    for s, o in pairs:
        of[s].add(o)
        having[o].add(s)
    out = []
    for s, objects in of.items():
        n = Counter(x for o in objects for x in having[o] if x != s)
        out += [(s, x, c, r) for r, (x, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def graph(spark, pairs):
    return spark.createDataFrame([(s, "p", o, "k") for s, o in pairs], "s string, p string, o string, domain string")


@pytest.mark.parametrize("hub", [1, 3, 10, 10**6])
def test_related_against_brute_force(spark, hub):
    pairs = {(f"s{rng.randrange(60)}", f"o{min(rng.randrange(40), rng.randrange(40))}") for _ in range(300)} | {(f"s{i}", "hub") for i in range(0, 60, 2)} | {("alone", "x"), ("t1", "hub"), ("t2", "hub")}
    assert rows_of(query.related(graph(spark, pairs), "p", 3, hub)) == most_related(pairs, 3)


def test_a_hub_of_many_is_not_squared(spark):
    n = 20_000
    edges = spark.range(n).selectExpr("concat('s', lpad(id, 6, '0')) AS s", "'p' AS p", "explode(array('hub', if(id % 3 = 0, 'second', 'hub'), concat('o', id div 2))) AS o", "'k' AS domain")
    got = query.related(edges, "p", 2)
    assert got.count() == 2 * n
    row = {r["rank"]: (r["other"], r["n"]) for r in got.where("id = 's000010'").collect()}
    assert row == {1: ("s000011", 2), 2: ("s000000", 1)}
    row = {r["rank"]: (r["other"], r["n"]) for r in got.where("id = 's000009'").collect()}
    assert row == {1: ("s000000", 2), 2: ("s000003", 2)}


def test_similar_sets_against_all_pairs(spark):
    from kgloom.operators import finetune

    words = [f"w{i}" for i in range(30)]
    base = [rng.choices(words, k=rng.randrange(5, 60)) for _ in range(25)]
    texts = []
    for w in base:
        for _ in range(rng.randrange(1, 5)):
            x = list(w)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(x))
    texts += [texts[0].upper()] * 30 + ["", None, "too few words", " ".join(base[0]) + "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().replace(".", "").split()
        if len(w) >= 5:
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    first = {}
    for i, x in sorted(sets.items()):
        first.setdefault(x, i)
    for threshold in (0.75, 0.4):
        pairs, members = finetune.similar_sets(docs, threshold)
        want = sorted((i, j, round(len(x & y) / len(x | y), 6)) for x, i in first.items() for y, j in first.items() if i < j and len(x & y) / len(x | y) >= threshold)
        assert rows_of(pairs) == want and len(want) > 5
        assert rows_of(members) == sorted((i, first[x]) for i, x in sets.items())
    assert finetune.near_duplicates(docs.limit(0), 0.75).count() == 0


def test_shortest_paths_from_both_ends(spark):
    nodes = [f"n{i}" for i in range(14)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)} | {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "x")}
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("a", "d"), ("a", "a"), ("d", "a"), ("x", "x"), ("no", "b")]
    want = {}
    for s, o in set(pairs):
        ways = [(s,)]
        for hops in range(5):
            if hits := [w for w in ways if w[-1] == o]:
                want[s, o] = (hops, ">".join(min(hits)))
                break
            ways = [(*w, b) for w in ways for a, b in edges if a == w[-1] and b not in w]
    got = {(r["s"], r["o"]): (r["hops"], r["path"]) for r in query.shortest_paths(graph(spark, edges), spark.createDataFrame(pairs, "s string, o string"), 4).collect()}
    assert got == want and len(want) > 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_labels_against_all_pairs(spark, most):
    from kgloom.operators import manage

    labels = {"".join(rng.choices("abc", k=rng.randrange(0, 9))) for _ in range(150)} | {"", "a", "ab", "straße eins", "strasse eins", "straße ein"}
    frame = spark.createDataFrame([(str(len(x) % 2), x) for x in labels] + [("0", x) for x in labels] + [("0", None)], "block string, low string").distinct()
    blocks = {"0": labels, "1": {x for x in labels if len(x) % 2}}
    want = {(k, *sorted((a, b), key=lambda x: (len(x), x))) for k, held in blocks.items() for a in held for b in held if distance(a, b) <= most}
    got = {(r["block"], *sorted((r["a"], r["b"]), key=lambda x: (len(x), x))) for r in manage.near_labels(frame, ["block"], most).collect()}
    assert got == want


def test_a_block_of_many_is_not_squared(spark):
    from kgloom.operators import manage

    n = 20_000
    nodes = spark.range(n).selectExpr("concat('e:', id) AS id", "'part' AS type", "if(id = 7, 'x0000000000y', concat('x', lpad(conv(id * 7919, 10, 16), 10, '0'), 'y')) AS label", "'k' AS domain")
    attrs = spark.range(n).selectExpr("concat('e:', id) AS s", "'brand' AS p", "'str' AS dtype", "'one' AS v_str", "cast(NULL AS double) AS v_num", "cast(NULL AS timestamp_ntz) AS v_ts", "'k' AS domain")
    got = {tuple(r) for r in manage.match_entities(nodes, attrs, ["brand"], 0).collect()}
    assert got == {("e:0", "e:7")}


PATTERNS = [
    [("?a", "p", "?b"), ("?b", "p", "?c"), ("?a", "p", "?c")],
    [("?a", "p", "?b"), ("?b", "p", "?c"), ("?c", "q", "?d"), ("?a", "q", "?d")],
    [("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "?r", "n1")],
    [("?a", "p", "?b")],
    [("?a", "p", "?a"), ("?a", "q", "?b")],
    [("?a", "p", "?b"), ("?c", "p", "?b"), ("?d", "p", "?b"), ("?c", "q", "?a")],
]


@pytest.mark.parametrize("patterns", PATTERNS)
def test_patterns_against_all_bindings(spark, patterns):
    nodes = [f"n{i}" for i in range(9)]
    edges = {(rng.choice(nodes), rng.choice("pq"), rng.choice(nodes)) for _ in range(45)}
    found = [{}]
    for pattern in patterns:
        grown = []
        for row in found:
            for edge in edges:
                new = dict(row)
                if all(new.setdefault(t[1:], v) == v if t[0] == "?" else t == v for t, v in zip(pattern, edge, strict=True)):
                    grown.append(new)
        found = grown
    names = sorted({t[1:] for x in patterns for t in x if t[0] == "?"})
    frame = spark.createDataFrame([(*e, "k") for e in sorted(edges)], "s string, p string, o string, domain string")
    assert rows_of(query.match_all(frame, patterns).select(*names)) == sorted({tuple(r[n] for n in names) for r in found})


def test_patterns_join_numbers_of_ids_and_are_not_made_distinct_again(spark):
    made = random.Random(4)
    of = {"a": [f"a:{i}" for i in range(12)], "b": ["b:1", "b:01", "b", "b:-1", "c:1", "b:2"], "c": [f"x:y:{i}" for i in range(8)]}
    held = {p: sorted({(made.choice(of[x]), made.choice(of[y])) for _ in range(50)}) for p, x, y in (("p", "a", "b"), ("q", "b", "c"), ("r", "a", "c"))}
    rows = [(s, p, o) for p, pairs in held.items() for s, o in pairs]
    want = sorted((a, b, c) for a, b in held["p"] for x, c in held["q"] if x == b and (a, c) in held["r"])
    patterns = [("?a", "p", "?b"), ("?b", "q", "?c"), ("?a", "r", "?c")]
    found = query.match_all(spark.createDataFrame(rows, "s string, p string, o string"), patterns, distinct=True).select("a", "b", "c")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "concat(a:" in plan and "concat(b:" not in plan and "concat(x:" not in plan
    assert rows_of(found) == want and len(want) > 20
    twice = spark.createDataFrame([(s, p, o, d) for s, p, o in rows for d in "kl"], "s string, p string, o string, domain string")
    assert rows_of(query.match_all(twice, patterns).select("a", "b", "c")) == want
    lacking = spark.createDataFrame([r for r in rows if r[1] != "q"], "s string, p string, o string")
    assert query.match_all(lacking, patterns, distinct=True).count() == 0


def test_a_cycle_looks_at_the_smaller_side_of_each_row(spark):
    """A hub on either side: joined in any fixed order, half a million rows would be looked at."""
    n = 700
    rows = [("h", "p", f"x{i}") for i in range(n)] + [(f"x{i}", "q", "h2") for i in range(n)] + [("h", "r", f"y{i}") for i in range(n)] + [(f"y{i}", "q", f"z{i}") for i in range(n)]
    rows += [(f"a{i}", "p", "hub") for i in range(n)] + [("hub", "q", f"b{i}") for i in range(n)] + [("a1", "r", "b1"), ("h", "r", "h2")]
    frame = spark.createDataFrame([(*e, "k") for e in rows], "s string, p string, o string, domain string")
    got = rows_of(query.match_all(frame, [("?a", "p", "?b"), ("?b", "q", "?c"), ("?a", "r", "?c")]).select("a", "b", "c"))
    assert got == sorted([("a1", "hub", "b1")] + [("h", f"x{i}", "h2") for i in range(n)])


def test_links_of_equal_nodes_have_the_components_of_all_pairs(spark):
    """They grow with the nodes and not with the square of those of one label, and no segments of labels are broadcast."""
    from pyspark.sql import functions as F

    from kgloom.operators import manage

    labels = ["alpha one"] * 40 + ["alpha ons"] * 3 + ["alphb ont", "other", "other", "ALPHA ONE", None, None, "ab", "ac"]
    nodes = spark.createDataFrame([(f"e:{i}", "e", x) for i, x in enumerate(labels)], "id string, type string, label string")
    attrs = spark.createDataFrame([(f"e:{i}", "brand", "x" if i % 2 else "y", None) for i in range(len(labels))], "s string, p string, v_str string, v_num double")
    pairs, links = manage.match_entities(nodes, attrs, ["brand"], 2), manage.match_links(nodes, attrs, ["brand"], 2)
    assert links.count() < len(labels) < pairs.count() and links.exceptAll(pairs).isEmpty()
    assert sorted(manage.components(links).collect()) == sorted(manage.components(pairs).collect())
    near = manage.near_labels(nodes.select(F.col("type").alias("kind"), F.lower("label").alias("low")).distinct(), ["kind"], 2)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().toString()

def test_members_need_no_pairs_and_shingles_are_made_in_place(spark, monkeypatch):
    from kgloom.operators import finetune

    words = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(words[:20])), (3, " ".join(words[20:])), (4, "too few words"), (5, None), (6, " ".join(words[:20] * 2))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tables, put = [], finetune.cut
    monkeypatch.setattr(finetune, "cut", lambda df: tables.append(df.columns) or put(df))
    members = sorted(map(tuple, finetune.set_members(docs).collect()))
    assert tables == [["doc_id", "of"]]
    assert members == sorted(map(tuple, finetune.similar_sets(docs, 0.75)[1].collect())) == [(1, 1), (2, 1), (3, 3), (6, 6)]
    held = {r["doc_id"]: r["shingles"] for r in finetune.shingle_sets(docs).collect()}
    assert {k: len(v) for k, v in held.items()} == {1: 36, 2: 36, 3: 32, 6: 20} and all(v == sorted(set(v)) for v in held.values())


def test_only_shingles_that_several_sets_hold_are_kept(spark):
    """Texts of 40 words of their own and ten that two share: whole sets are neither stored nor, where keys are unique, shuffled by key."""
    from pathlib import Path

    from kgloom.operators import finetune

    texts = [" ".join([f"s{i // 2}x{j}" for j in range(10)] + [f"t{i}x{j}" for j in range(40 if i < 20 else 2)]) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:5])], "doc_id long, text string")
    assert "Exchange" not in finetune.shingle_sets(docs)._jdf.queryExecution().executedPlan().toString()
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    pairs, members = finetune.similar_sets(docs, 0.5)
    assert rows_of(pairs) == [(i, i + 1, 0.6) for i in range(20, 40, 2)] and sorted(map(tuple, members.where("doc_id <> representative").collect())) == [(100 + i, i) for i in range(5)]
    kept = [spark.read.parquet(str(x)) for x in set(shared.iterdir()) - before]
    arrays = [(x, c) for x in kept for c, kind in x.dtypes if kind.startswith("array")]
    assert sum(x.selectExpr(f"sum(size({c}))").first()[0] for x, c in arrays) == 40 * 6
    # Rows with one key are one set.
    twice = spark.createDataFrame([(1, texts[20]), (1, texts[21]), (2, texts[20]), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["shingles"]) for r in finetune.shingle_sets(twice).collect()} == {1: 10, 2: 8}
    assert rows_of(finetune.near_duplicates(twice, 0.75)) == [(1, 2, 0.8)]


@pytest.mark.parametrize("waiting", [1 << 20, 3])
def test_members_of_lists_are_counted_without_a_row_for_each_pair(spark, monkeypatch, waiting):
    monkeypatch.setattr(query, "WAITING", waiting)
    pairs = [(f"s{rng.randrange(60)}", f"o{rng.randrange(25)}") for _ in range(500)]
    for k in (1, 3, 100):
        got = query.related(graph(spark, pairs), "p", k)
        assert rows_of(got) == most_related(pairs, k)
        # Before, pairs were joined by object and grouped as rows.
        assert "MapInArrow" in got._jdf.queryExecution().toString()
    names = spark.createDataFrame([(x,) for x in ("b", "a10", "a9", "B", "é", "")], "s string")
    assert [r["at"] for r in query.in_order(names).orderBy("s").collect()] == list(range(6))
