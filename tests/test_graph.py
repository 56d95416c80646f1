"""Micro-graphs with known answers, and properties that hold between operators."""

import json

import pytest

from kgloom.functions.text import norm
from kgloom.operators import answer, build, context, finetune, manage, query, questions
from kgloom.sources.tables import load_source, read_kg, write_kg


def edges(spark, rows, domain="d"):
    return spark.createDataFrame([(*r, domain) for r in rows], "s string, p string, o string, domain string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CYCLE = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a")]
DIAMOND = [("a", "r", "b"), ("a", "r", "c"), ("b", "r", "d"), ("c", "r", "d")]


def test_nulls_make_no_edges_and_equal_rows_make_one(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (3, None)], "a int, b int")
    made = build.map_edges(df, [("x", "a", "p", "y", "b")], "d")
    assert got(made, "s", "p", "o") == [("x:1", "p", "y:2")]


def test_merge_is_commutative_and_keeps_domains(spark):
    a, b = edges(spark, [("a", "r", "b")], "one"), edges(spark, [("a", "r", "b"), ("b", "r", "c")], "two")
    left, right = build.merge_domains(a, b), build.merge_domains(b, a)
    assert got(left, "s", "o", "domains") == got(right, "s", "o", "domains") == [("a", "b", ["one", "two"]), ("b", "c", ["two"])]


def test_delta_undoes_a_difference(spark):
    old, new = edges(spark, CYCLE), edges(spark, [*CYCLE[:2], ("c", "r", "d")])
    diff = manage.diff_kg(old, new)
    assert got(diff, "s", "o", "change") == [("c", "a", "removed"), ("c", "d", "added")]
    delta = diff.selectExpr("s", "p", "o", "domain", "if(change = 'added', 'upsert', 'delete') AS op", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    assert got(manage.apply_delta(old, delta), "s", "p", "o") == sorted(tuple(r[:3]) for r in new.collect())


def test_dangling_and_rules(spark):
    nodes = spark.createDataFrame([("a", "t", "A", "d"), ("b", "u", "B", "d"), ("c", "u", "C", "d")], "id string, type string, label string, domain string")
    e = edges(spark, [("a", "r", "b"), ("a", "r", "c"), ("a", "r", "missing"), ("b", "r", "a")])
    assert got(manage.dangling_edges(e, nodes), "s", "o", "missing") == [("a", "missing", "o")]
    rules = spark.createDataFrame([("r", "d", "t", "u", True)], "p string, domain string, from_type string, to_type string, functional boolean")
    assert got(manage.violations(e, nodes, rules), "s", "rule", "n") == [("a", "several objects", 3), ("b", "object type", 1), ("b", "subject type", 1)]


def test_components_and_canonical_edges(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "id string, dup_id string")
    assert got(manage.components(pairs), "id", "canonical") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert got(manage.canonicalize(edges(spark, [("c", "r", "y"), ("b", "r", "x")]), pairs), "s", "o") == [("a", "x")]


def test_paths_end_on_cycles_and_keep_the_least(spark):
    cycle = edges(spark, CYCLE)
    assert got(query.closure(cycle, ["r"]), "s", "o", "depth") == sorted((s, o, d) for s in "abc" for o in "abc" for d in [(ord(o) - ord(s) - 1) % 3 + 1])
    assert got(query.reach(cycle, ids(spark, "a"), 5), "id", "hops") == [("a", 0), ("b", 1), ("c", 1)]
    diamond = edges(spark, DIAMOND)
    assert got(query.follow(diamond, ids(spark, "a"), [("r", "+"), ("r", "+")]), "anchor", "id") == [("a", "d")]
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a")], "s string, o string")
    assert got(query.shortest_paths(diamond, pairs, 4), "s", "o", "hops", "path") == [("a", "a", 0, "a"), ("a", "d", 2, "a>b>d")]


def test_patterns(spark):
    e = edges(spark, [*DIAMOND, ("d", "q", "d")])
    assert got(query.match_all(e, [("?x", "r", "?y"), ("?y", "r", "?z")]), "x", "y", "z") == [("a", "b", "d"), ("a", "c", "d")]
    assert got(query.match_all(e, [("?x", "q", "?x")]), "x") == [("d",)]
    with pytest.raises(ValueError):
        query.match_all(e, [("?x", "r", "?y"), ("?u", "r", "?v")])
    left = spark.createDataFrame([("b",), ("d",)], "y string")
    assert got(query.match_exists(left, e, ("?y", "r", "?z")), "y") == [("b",)]
    assert got(query.match_exists(left, e, ("?y", "r", "?z"), negate=True), "y") == [("d",)]
    assert len(query.neighbors(edges(spark, [("a", "r", "a")]), ids(spark, "a")).collect()) == 2


def test_superlative_keeps_ties(spark):
    m = spark.createDataFrame([("c", "o1"), ("c", "o2"), ("c", "o3")], "anchor string, id string")
    attrs = spark.createDataFrame([("o1", "v", 5.0), ("o2", "v", 5.0), ("o3", "v", 1.0)], "s string, p string, v_num double")
    assert got(query.superlative(m, attrs, "v"), "id") == [("o1",), ("o2",)]
    assert got(query.superlative(m, attrs, "v", k=1), "id") == [("o1",)]


def test_mentions_match_words_not_letters(spark):
    nodes = spark.createDataFrame([("n:1", "NATION_1"), ("n:10", "NATION_10"), ("x", "a b"), ("y", "b c d")], "id string, label string")
    asked = spark.createDataFrame([("q1", "in NATION_10?"), ("q2", "a b c d"), ("q3", ""), ("q4", None)], "qid string, text string")
    found = questions.find_mentions(asked, build.build_aliases(nodes))
    assert got(found, "qid", "alias_norm") == [("q1", "nation 10"), ("q2", "b c d")]


def test_correction(spark):
    words = spark.createDataFrame([("q", 0, "nacion"), ("q", 1, "xyzzy"), ("q", 2, "of")], "qid string, pos int, tok string")
    vocab = spark.createDataFrame([("nation",), ("national",)], "tok string")
    assert got(questions.correct_tokens(words, vocab, 1), "tok", "fixed") == [("nacion", "nation"), ("of", "of"), ("xyzzy", "xyzzy")]


def test_unanswerable_questions_get_the_fallback(spark):
    asked = spark.createDataFrame([("q1", "list"), ("q2", "list")], "qid string, qtype string")
    answers = spark.createDataFrame([("q1", x) for x in "dcba"], "qid string, answer_label string")
    sentences = spark.createDataFrame([("list", "Found %s.")], "qtype string, sentence string")
    assert got(answer.verbalize(asked, answers, sentences, m=3), "qid", "answer_text", "n_answers") == [("q1", "Found a, b, c and 1 more.", 4), ("q2", "I do not know.", 0)]


def test_scores(spark):
    a = spark.createDataFrame([("q1", "x"), ("q1", "y")], "qid string, answer_id string")
    g = spark.createDataFrame([("q1", "x"), ("q2", "z")], "qid string, answer_id string")
    assert got(answer.score(a, g), "qid", "precision", "recall") == [("q1", 0.5, 1.0), ("q2", 0.0, 0.0)]


def test_passages_cover_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(25))), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"].split()[0] for r in context.split_passages(docs, 10, 8).orderBy("pos").collect()] == ["w0", "w8", "w16"]


def test_negatives_are_false_and_splits_are_clean(spark):
    nodes = spark.createDataFrame([(f"n{i}", "t") for i in range(20)], "id string, type string")
    e = edges(spark, [(f"n{i}", "r", f"n{(i + 1) % 20}") for i in range(20)])
    false = finetune.negatives(e, nodes, 2)
    assert false.join(e, ["s", "p", "o"]).isEmpty() and not false.isEmpty()
    listed = got(finetune.numbered(nodes), "idx", "size")
    assert [i for i, _ in listed] == list(range(20)) and {n for _, n in listed} == {20}
    parts = finetune.split(nodes.union(nodes), "id")
    assert parts.select("id", "split").distinct().count() == 20


def test_layout_round_trip(spark, tmp_path):
    write_kg(edges(spark, DIAMOND), str(tmp_path / "kg"))
    assert got(read_kg(spark, str(tmp_path / "kg")).where("p = 'r'"), "s", "o") == sorted((s, o) for s, _, o in DIAMOND)


def test_files_of_a_layout_have_tasks_of_their_own(spark, tmp_path):
    many = edges(spark, [(f"s{i}", p, f"o{i}") for p, n in (("r", 400), ("q", 90), ("one", 1)) for i in range(n)])
    write_kg(many, str(tmp_path / "kg"), 25)
    files = list((tmp_path / "kg").glob("p=*/*.parquet"))
    # 16, 4 and 1 files; a file's name begins with the number of the task that wrote it.
    assert len({f.name.split("-")[1] for f in files}) == len(files) == 21
    stored = read_kg(spark, str(tmp_path / "kg"))
    assert sorted(stored.select("s", "p", "o").collect()) == sorted(many.select("s", "p", "o").collect())
    write_kg(many.limit(0), str(tmp_path / "none"))


def test_norm(spark):
    df = spark.createDataFrame([("Ünder_Score  #12!",)], "t string")
    assert df.select(norm(df.t)).head()[0] == "ünder score 12"


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k long, name string, x double")
    for fmt, options in (("parquet", {}), ("csv", {"header": "true"}), ("json", {}), ("orc", {})):
        path = str(tmp_path / fmt)
        rows.write.format(fmt).options(**options).save(path)
        assert sorted(map(tuple, load_source(spark, fmt, path, "k long, name string, x double", **options).collect())) == [(1, "a", 2.5), (2, None, None)]
    talk = spark.createDataFrame([(7, 1, "assistant", "hi \"you\""), (7, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    finetune.write_chat(finetune.to_chat(talk), str(tmp_path / "chat"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "chat")).collect()]
    assert lines == [{"messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi \"you\""}]}]


def test_records_as_maps(spark):
    attrs = spark.createDataFrame([("a", "size", "num", None, 3.0, None), ("a", "name", "str", "x", None, None), ("b", "name", "str", "y", None, None)], "s string, p string, dtype string, v_str string, v_num double, v_ts timestamp")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert [(r["id"], r["record"]) for r in query.entity_record(attrs, ids).collect()] == [("a", {"name": "x", "size": "3.0"})]


def test_related_splits_hub_objects(spark):
    edges = spark.createDataFrame([(f"s{i}", "r", "hub") for i in range(9)] + [("s1", "r", "x"), ("s2", "r", "x")], "s string, p string, o string")
    for block in (2, 100):
        got = {(r["id"], r["other"]): r["n"] for r in query.related(edges, "r", 100, block).collect()}
        assert len(got) == 72 and got["s1", "s2"] == got["s2", "s1"] == 2 and got["s1", "s3"] == 1


def test_spelling_meets_all_near_words(spark):
    words = ["nation", "nacion", "natoin", "regon", "region", "nations", "motion", "nat"]
    toks = spark.createDataFrame([("q", i, w) for i, w in enumerate(words)], "qid string, pos int, tok string")
    vocab = spark.createDataFrame([("nation",), ("region",), ("mot",)], "tok string")
    assert [r["fixed"] for r in questions.correct_tokens(toks, vocab, 2).orderBy("pos").collect()] == ["nation", "nation", "nation", "region", "region", "nation", "motion", "nat"]


def test_closure_has_no_bound(spark):
    edges = spark.createDataFrame([(str(i), "r", str(i + 1)) for i in range(12)] + [("12", "r", "0")], "s string, p string, o string")
    assert query.closure(edges, ["r"]).agg({"depth": "max"}).head()[0] == 13


def test_paths_without_steps_are_no_error_where_every_predicate_is_a_literal(spark, tmp_path):
    """The optimiser then tests each question's step for each mapping, before it has dropped the paths that have none."""
    spark.createDataFrame([("1", "a:1", "+r"), ("2", "a:1", ""), ("3", "a:1", "+r/+q"), ("4", "b:1", "-r")], "qid string, anchor_id string, path string").write.parquet(f"{tmp_path}/parsed")
    spark.createDataFrame([(1, 1)], "x long, y long").write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    edges = build.union([build.map_edges(table, [spec], "t") for spec in (("a", "x", "r", "b", "y"), ("b", "x", "q", "c", "y"), ("d", "x", "r", "b", "y"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = answer.ends(spark.read.parquet(f"{tmp_path}/parsed"), edges).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found)) == [("1", "b:1"), ("2", "a:1"), ("3", "c:1"), ("4", "a:1"), ("4", "d:1")]
