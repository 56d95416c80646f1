"""What grows with the tables: what is broadcast, what is shuffled and by which keys."""

from pyspark.sql import functions as F

from kgloom.operators import build, manage, questions
from kgloom.plans.queries import QUERIES
from kgloom.plans.trade import Trade
from kgloom.session import cut
from kgloom.sources import store


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    rows = spark.range(400_000).coalesce(1).select(F.concat(F.lit("customer:"), "id").alias("id"), F.lit("a phrase that stands in every row").alias("phrase"))
    a, b = cut(rows), cut(rows.withColumnRenamed("phrase", "other"))
    assert "Broadcast" not in planned(a.join(b, "id"))


def test_edges_are_made_distinct_as_numbers(spark):
    specs = [("order", "o", "has", "part", "q"), ("order", "o", "by", "supplier", "q")]
    rows = [(1, 2), (1, 2), (1, None), (None, 3), (4, 5)]
    numbers = build.map_edges(spark.createDataFrame(rows, "o long, q int"), specs, "d")
    texts = build.map_edges(spark.createDataFrame(rows, "o string, q string"), specs, "d")
    assert sorted(numbers.collect()) == sorted(texts.collect()) and numbers.count() == 4
    assert "keys=[a#" in planned(numbers)
    nodes = [("order", "o", None), ("part", "q", "label")]
    named = [(1, 2, "b"), (1, 2, "a"), (None, 2, None), (3, None, "c")]
    made = [build.build_nodes(spark.createDataFrame(named, f"o {kind}, q {kind}, label string"), nodes, "d") for kind in ("long", "string")]
    assert sorted(made[0].collect()) == sorted(made[1].collect())
    assert "keys=[key#" in planned(made[0])


def test_vocabularies_go_to_the_rows(spark):
    asked = spark.createDataFrame([("1", "How many orders?"), ("2", "Who?"), ("3", "How many most expensive orders?")], "qid string, text string")
    cues = spark.createDataFrame([("how many", "count", 50), ("most expensive", "superlative", 60)], "cue_norm string, qtype string, priority int")
    classes = questions.classify(asked, cues)
    assert sorted(map(tuple, classes.collect())) == [("1", "count"), ("2", "list"), ("3", "superlative")]
    lexicon = spark.createDataFrame([("orders", "-x", "", ""), ("expensive orders", "-y", "max", "z")], "phrase_norm string, path string, agg string, attr_p string")
    linked = questions.link_relations(asked, lexicon)
    assert sorted((r["qid"], r["path"]) for r in linked.collect()) == [("1", "-x"), ("3", "-y")]
    rules = spark.createDataFrame([("p", "d", "a", "b", True)], "p string, domain string, from_type string, to_type string, functional boolean")
    edges = spark.createDataFrame([("x", "p", "y", "d"), ("x", "p", "z", "d")], "s string, p string, o string, domain string")
    broken = manage.violations(edges, spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "a")], "id string, type string"), rules)
    assert sorted((r["rule"], r["n"]) for r in broken.collect()) == [("object type", 1), ("several objects", 2)]
    for made in (classes, linked, broken):
        assert "BroadcastHashJoin" in planned(made)


def test_ngrams_of_many_questions_are_looked_up_apart(spark, monkeypatch):
    asked = spark.createDataFrame([(str(i), f"who is in new york {i}") for i in range(9)], "qid string, text string")
    aliases = spark.createDataFrame([("a", "new york", 2), ("b", "york", 1), ("c", "york 3", 2), ("d", "7", 1)], "id string, alias_norm string, n_tok int")
    whole = sorted(questions.find_mentions(asked, aliases).collect())
    monkeypatch.setattr(questions, "HOT", 2)
    assert sorted(questions.find_mentions(asked, aliases).collect()) == whole and len(whole) == 10


def test_every_order_and_supplier_has_its_way_to_a_region(spark):
    found = {r["s"]: (r["o"], r["hops"]) for r in QUERIES["k12_shortest_paths"](spark, "/root/testdata/sf0.001").collect()}
    t = Trade(spark, "/root/testdata/sf0.001")
    assert len(found) == t.table("orders").count() + t.table("supplier").count()
    assert {k.split(":")[0]: hops for k, (_, hops) in found.items()} == {"order": 3, "supplier": 2}


def test_distinct_edges_are_stored_as_they_are(spark, tmp_path):
    edges = spark.createDataFrame([(f"a{i}", f"p{i % 2}", f"b{i % 3}", "d") for i in range(20)], "s string, p string, o string, domain string")
    plain, told = store.write_graph(edges, f"{tmp_path}/plain", 5), store.write_graph(edges, f"{tmp_path}/told", 5, distinct=True)
    assert sorted(plain.edges().collect()) == sorted(told.edges().collect()) == sorted(edges.collect())
    assert sorted(plain.stats().collect()) == sorted(told.stats().collect())
    assert store.differing(plain, told).isEmpty()


def test_dangling_edges_come_from_ends(spark):
    specs = [("order", "o", "has", "part", "q"), ("order", "o", "by", "supplier", "q")]
    rows = spark.createDataFrame([(1, 2), (1, 2), (1, None), (None, 3), (4, 5)], "o long, q int")
    edges, ends = build.map_edges(rows, specs, "d"), build.map_ends(rows, specs)
    want = {(p, end, row[end]) for row in edges.collect() for p in [row["p"]] for end in "so"}
    assert sorted(map(tuple, ends.collect())) == sorted(want)
    nodes = spark.createDataFrame([(x,) for x in ("order:1", "order:4", "part:2", "part:5", "supplier:2")], "id string")
    for given in (ends, None):
        lost = manage.dangling_edges(edges, nodes, given)
        assert [tuple(r) for r in lost.collect()] == [("order:4", "by", "supplier:5", "d", "o")]
        # Edges of predicates that miss nothing are not read.
        assert "has" not in lost._jdf.queryExecution().optimizedPlan().toString()


def test_questions_of_one_anchor_share_its_walk_and_meet_only_ends_that_have_their_values(spark, monkeypatch):
    from kgloom.operators import answer

    parts = [(f"p{i}", "red" if i % 3 else "blue", "big" if i % 2 else "small") for i in range(12)]
    edges = spark.createDataFrame([("s1", "has", p, "d") for p, _, _ in parts] + [("s2", "has", "p0", "d")], "s string, p string, o string, domain string")
    attrs = spark.createDataFrame([(p, k, v, None, None) for p, *vs in parts for k, v in zip(("colour", "size"), vs, strict=True)], "s string, p string, v_str string, v_num double, v_ts timestamp_ntz")
    nodes = spark.createDataFrame([(p, p.upper()) for p, _, _ in parts], "id string, label string")
    asked = [("red", ["s1", {"colour": "red"}]), ("both", ["s1", {"colour": "blue", "size": "big"}]), ("all", ["s1", {}]), ("none", ["s2", {"colour": "red"}]), ("one", ["s2", {"colour": "blue", "size": "small"}])]
    asked += [(f"again {i}", ["s1", {"size": "small"}]) for i in range(30)]
    parsed = spark.createDataFrame([(q, "list", a, "+has", "", "", None) for q, (a, _) in asked], "qid string, qtype string, anchor_id string, path string, agg string, attr_p string, target_id string")
    filters = spark.createDataFrame([(q, k, v) for q, (_, f) in asked for k, v in f.items()], "qid string, filter_p string, value string")
    tables, put = [], answer.cut
    monkeypatch.setattr(answer, "cut", lambda df: tables.append(put(df)) or tables[-1])
    got = sorted((r["qid"], r["answer_id"]) for r in answer.answer(parsed, nodes, edges, attrs, filters).collect())
    owned = {"s1": parts, "s2": parts[:1]}
    assert got == sorted((q, p) for q, (a, f) in asked for p, c, s in owned[a] if f.get("colour", c) == c and f.get("size", s) == s)
    walks = [t for t in tables if t.columns == ["anchor_id", "path", "id"]]
    assert [t.count() for t in walks] == [13]  # and not 12 for each of the 33 questions on s1


def test_false_edges_need_no_shuffle_by_type_and_no_second_look_at_true_ones(spark):
    from kgloom.operators import finetune

    nodes = spark.createDataFrame([(f"{t}{i}", t) for t, n in (("a", 3), ("b", 150), ("c", 1)) for i in range(n)], "id string, type string")
    rows = [(f"a{i % 3}", "r", f"b{i}", d) for i in range(60) for d in ("x", "y")] + [("b1", "q", f"a{i}", "x") for i in range(3)] + [("b1", "q", "c0", "x"), ("b1", "q", "nowhere", "x"), (None, "q", "b7", "x")]
    edges = spark.createDataFrame(rows, "s string, p string, o string, domain string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        false = finetune.negatives(edges, nodes, 3)
        plan, made = planned(false), [tuple(r) for r in false.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # The sizes and buckets of types go to the rows, nodes are hashed, and the true edges need no join of their own.
    assert plan.count("BroadcastHashJoin") == 3 and "LeftAnti" not in plan
    assert len(set(made)) == len(made) > 100 and not {r[:3] for r in rows} & set(made)
    assert {(s, p, o[0]) for s, p, o in made} == {(f"a{i}", "r", "b") for i in range(3)} | {(None, "q", "b")}
