"""Stored graphs that change, and the BM25 index, against plain computations."""

import math
import os
import random
import re
from collections import Counter

from kgloom.operators import bm25, manage
from kgloom.sources import store

rng = random.Random(5)
EDGES = "s string, p string, o string, domain string"


def some_edges(spark, n):
    rows = {(f"a:{rng.randrange(60)}", rng.choice(["likes", "is in", "x=1/y"]), f"b:{rng.randrange(40)}", rng.choice(["k", "l"])) for _ in range(n)}
    return sorted(rows), spark.createDataFrame(sorted(rows), EDGES)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_rewrites_only_what_it_touches(spark, tmp_path):
    rows, edges = some_edges(spark, 900)
    path = str(tmp_path / "g")
    first = store.write_graph(edges, path, rows=50)
    assert rows_of(first.edges()) == rows and first.manifest.where("side = 's'").count() > 10
    before = files(f"{path}/edges")
    gone, back = rows[3], rows[7]
    delta = spark.createDataFrame(
        [(*gone, "delete", 2), (*gone, "upsert", 1), (*back, "delete", 1), (*back, "upsert", 2), ("a:new", "likes", "b:1", "k", "upsert", None), ("n:1", "new one", "n:2", "k", "upsert", 1), (*rows[9], "upsert", 5), (*rows[11], "delete", 3), (*rows[11], "upsert", 3), ("no", "such", "edge", "k", "delete", 1)],
        f"{EDGES}, op string, ts int",
    )
    second = store.change(first, delta, rows=50)
    want = manage.apply_delta(edges, delta)
    assert rows_of(second.edges()) == rows_of(want) == sorted({*rows, ("a:new", "likes", "b:1", "k"), ("n:1", "new one", "n:2", "k")} - {gone, rows[11]})
    after = files(f"{path}/edges")
    assert {f: t for f, t in after.items() if f in before} == before  # no file changed or went
    kept = second.manifest.join(first.manifest, ["side", "p", "bucket", "version"]).count()
    assert kept >= first.manifest.count() - 8 and rows_of(first.edges()) == rows
    assert rows_of(second.stats()) == rows_of(manage.kg_stats(want)) and rows_of(first.stats()) == rows_of(manage.kg_stats(edges))
    assert rows_of(store.diff(first, second)) == rows_of(manage.diff_kg(edges, want))
    assert len(store.diff(first, second).inputFiles()) < len(before) / 2
    third = store.change(second, delta, rows=50)
    assert store.diff(second, third).inputFiles() == [] and store.diff(second, third).count() == 0
    emptied = store.change(third, spark.createDataFrame([("n:1", "new one", "n:2", "k", "delete", 9)], f"{EDGES}, op string, ts int"))
    assert emptied.manifest.where("p = 'new one'").count() == 0 and emptied.edges(p="new one").count() == 0


def test_edges_are_made_once_and_odd_ids_come_back(spark, tmp_path):
    """Where counts are given, edges are not made twice; ids that look like kinds with numbers, but are not, are kept as they are."""
    ends = ["a:1", "a:-1", "a:01", "a:+1", "a: 1", "a:", "a", ":7", "", "a:b:3", "a:1\n", "x:9223372036854775807", "x:9223372036854775808", "é:0", "a:1e3"]
    rows = sorted((s, "p", o, "k") for s in ends for o in ends)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(rows, EDGES).mapInArrow(counted, EDGES)
    graph = store.write_graph(edges, str(tmp_path / "g"), rows=50, distinct=True, counts=spark.createDataFrame([("p", 200), ("p", 25)], "p string, n long"))
    assert made.value == len(rows)
    assert rows_of(graph.edges()) == rows and graph.manifest.where("side = 's' AND buckets = 5").count() > 1
    assert rows_of(graph.stats()) == [("p", len(rows), len(ends), len(ends), len(ends))] and rows_of(graph.edges(s="a:01")) == [r for r in rows if r[0] == "a:01"]
    delta = spark.createDataFrame([(*r, op, 1) for r in rows for op in (["delete"] if r[0] == "a:01" else ["upsert"] if r[2] == "a" else [])] + [("a", "p", "a", "l", "upsert", 1)], f"{EDGES}, op string, ts int")
    assert rows_of(store.change(graph, delta, rows=50).edges()) == sorted([r for r in rows if r[0] != "a:01"] + [("a", "p", "a", "l")])


def test_differences_of_domains(spark, tmp_path):
    """Only domains that both sides have and that differ are summed; also where a predicate is dealt otherwise."""
    rows, edges = some_edges(spark, 900)
    first = store.write_graph(edges, str(tmp_path / "g"), rows=10**6)
    fresh = [(f"a:{i}", "likes", f"b:{i % 9}", "m") for i in range(50)]
    lost = [r for r in rows if r[1] == "is in" and r[3] == "k"]
    some = [r for r in rows if r[1] == "x=1/y" and r[3] == "l"][:3]
    delta = spark.createDataFrame([(*r, "upsert", 1) for r in fresh] + [(*r, "delete", 1) for r in lost + some], f"{EDGES}, op string, ts int")
    second = store.change(first, delta)
    want = sorted([(*r, "added") for r in fresh] + [(*r, "removed") for r in lost + some])
    assert rows_of(store.diff(first, second)) == want
    (work,) = (tmp_path / "g" / "work").glob("diff-*")
    assert sorted((r["p"], r["domain"], r["both"]) for r in spark.read.parquet(str(work)).collect()) == [("is in", "k", False), ("likes", "m", False), ("x=1/y", "l", True)]
    other = store.write_graph(second.edges(), str(tmp_path / "h"), rows=50)
    assert rows_of(store.diff(first, other)) == want and rows_of(store.diff(second, other)) == []


def test_bound_ends_read_one_folder(spark, tmp_path):
    rows, edges = some_edges(spark, 900)
    graph = store.write_graph(edges, str(tmp_path / "g"), rows=50)
    for bound in ({"p": "likes", "s": "a:3"}, {"p": "x=1/y", "o": "b:5"}, {"p": "is in", "s": "a:1", "o": "b:1"}):
        found = graph.edges(**bound)
        assert rows_of(found) == [r for r in rows if all(r["spo".index(k)] == v for k, v in {**{"s": bound.get("s"), "p": bound["p"], "o": bound.get("o")}}.items() if v is not None)]
        assert len(found.inputFiles()) <= 1
    assert rows_of(graph.edges(o="b:5")) == [r for r in rows if r[2] == "b:5"] and len(graph.edges(o="b:5").inputFiles()) <= 3
    # Sorted by the end: groups of rows have ranges that do not overlap.
    one = spark.createDataFrame([(f"a:{i:05d}", "p", f"b:{i % 7}", "k") for i in range(4000)], EDGES)
    spark.conf.set("parquet.block.size", "2048")
    try:
        graph = store.write_graph(one, str(tmp_path / "h"), rows=10**6)
    finally:
        spark.conf.unset("parquet.block.size")
    found = graph.edges(p="p", s="a:01234")
    assert found.count() == 1
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(graph.edges(p="p", s="a:01234").inputFiles()[0].removeprefix("file://")).metadata
    spans = [(meta.row_group(k).column(0).statistics.min, meta.row_group(k).column(0).statistics.max) for k in range(meta.num_row_groups)]
    assert spans == sorted(spans) and sum(a <= "a:01234" <= b for a, b in spans) == 1


def test_empty_graphs(spark, tmp_path):
    empty = spark.createDataFrame([], EDGES)
    graph = store.write_graph(empty, str(tmp_path / "g"))
    assert graph.edges().count() == 0 and graph.stats().count() == 0
    more = store.change(graph, spark.createDataFrame([("a", "p", "b", "k", "upsert", 1)], f"{EDGES}, op string, ts int"))
    assert rows_of(more.edges()) == [("a", "p", "b", "k")] and rows_of(store.diff(graph, more)) == [("a", "p", "b", "k", "added")]


def test_differences_of_bags(spark):
    a = spark.createDataFrame([("a", "p", "b", "k")] * 3 + [("c", "p", "d", "k")], EDGES)
    b = spark.createDataFrame([("a", "p", "b", "k"), ("e", "p", "f", "k")], EDGES)
    assert rows_of(manage.diff_kg(a, b)) == [("a", "p", "b", "k", "removed")] * 2 + [("c", "p", "d", "k", "removed"), ("e", "p", "f", "k", "added")]


def best_by_bm25(questions, docs, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    out = []
    for q, text in questions:
        scores = {}
        for i, w in words.items():
            tf = Counter(w)
            s = [math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(re.findall(r"[^\W_]+", text.lower())) if tf[t]]
            if s:
                scores[i] = round(sum(s), 6)
        out += [(q, i, s, n) for n, (s, i) in enumerate(sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def test_bm25_is_exact_and_reads_little_of_common_terms(spark, tmp_path):
    common = [f"c{i}" for i in range(8)]
    docs = [(i, " ".join(rng.choices(common, k=30) + [f"r{rng.randrange(150)}" for _ in range(10)])) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "c1 " * 400), (1003, docs[5][1]), (1004, docs[5][1])]
    questions = [("q1", "c1 c2 c3 r1 r2 r3"), ("q2", docs[5][1]), ("q3", "nothing of it"), ("q4", "c1"), ("q5", "r7 r8 r9 c0 c4 c5"), ("q6", "")]
    asked = spark.createDataFrame(questions, "qid string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = bm25.write_index(frame, str(tmp_path / "i"))
    for share in (0.0, 0.6, 1.0):
        found, read = bm25.search(asked, index, 5, share=share, first=2)
        got = rows_of(found.select("qid", "doc_id", "score", "rank"))
        want = best_by_bm25(questions, docs, 5)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    reads = {r["qid"]: (r["read"], r["postings"]) for r in read.collect()}
    assert all(reads[q][0] < 0.35 * reads[q][1] for q in ("q1", "q2", "q5")), reads
    assert rows_of(bm25.retrieve(asked, frame, 5)) == rows_of(found) and bm25.retrieve(asked, frame.limit(0), 5).count() == 0
    assert rows_of(bm25.search(asked, bm25.read_index(spark, str(tmp_path / "i")), 5)[0]) == rows_of(found)
