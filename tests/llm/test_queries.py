"""Every registered query of the training-data operators on odd tables, and held-out accuracy of the learnt ones."""

import os
import random
import zlib

import pytest

from kgloom.llm import queries

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
made = random.Random(4)
WORDS = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("n", "r", "st")]


def prose(n):
    return " ".join(made.choice(WORDS) for _ in range(n))


LONG = prose(20_000) + " " + "x" * 5000
TEXTS = [prose(90), None, "", " ", "one", "\u0000\U0001f600 é\n\t", LONG, "password = " + "a" * 20 + " mail x@y.zz", *(prose(60) for _ in range(20))]
TEXTS += [TEXTS[0], TEXTS[0], TEXTS[0] + " end", TEXTS[0].upper()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, repeated and null ids, ties, repeated rows, a very long text, columns with clashing names."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i if i % 9 else None, t, "aa" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if i % 7 == 0 else len(t or ""), "c", 1, "c", 2, 3) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8], (2, "another text for an id that is there already " + TEXTS[8], "bb", "s1", 3, "c", 1, "c", 2, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, part int, row string, slot int, block int"
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float(i % 5), 1.0, float(i)], i, "c") for i in range(120)] + [(None, [1.0, 2.0, 3.0], 1, "c"), (200, None, None, None), (300, [None, 1.0, 2.0], 1, "c"), (400, [0.0, 0.0, 0.0], 1, "c"), (0, [0.0, 1.0, 0.5], 1, "c")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, key string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def bare(spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("bare")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_repeated_strings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_sentencepiece": ["doc_id", "n_pieces", "ids", "decoded_sha256"],
    "op4_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_languages": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_mixing": ["doc_id", "source", "block", "n_blocks", "slot", "release", "deadline"],
    "op7_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op8_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_repeated_lines": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_on_odd_and_empty_tables(spark, odd, bare, name):
    found = queries.QUERIES[name](spark, odd)
    assert found.columns == COLUMNS[name]
    rows = found.collect()
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    if name == "op7_neighbours":
        near = {}
        for r in rows:
            near.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
        assert set(near) == {0, 100} and all([x[2] for x in sorted(near[100])] == list(range(1, 11)) for _ in near)
    elif name == "op11_collocations":
        # Only the long text, which has no language, repeats pairs of words so often.
        assert {r["lang"] for r in rows} == {"und"} and all(r["a"] >= 10 and r["score"] <= 1000000 for r in rows)
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    if "held_out" in COLUMNS[name]:
        folds, fold = (4, 2) if name == "op1_toxicity" else (3, 1)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert queries.QUERIES[name](spark, bare).count() == 0


def truth(spark, path, name, column):
    return {r[0]: r[1] for r in spark.read.parquet(f"{path}/{name}.parquet").select("doc_id", column).where(f"{column} IS NOT NULL").collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_languages(spark):
    want = truth(spark, DATA, "documents", "lang")
    rows = [r for r in queries.op5_languages(spark, DATA).collect() if r["held_out"] and r["doc_id"] in want and r["lang_pred"] != "und"]
    assert len(rows) > 200 and sum(r["lang_pred"] == want[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_toxicity(spark):
    want = truth(spark, LARGER, "labels", "toxic")
    rows = [r for r in queries.op1_toxicity(spark, LARGER).collect() if r["held_out"] and r["doc_id"] in want]
    toxic, clean = ([r["predicted"] for r in rows if want[r["doc_id"]] == k] for k in (1, 0))
    assert len(toxic) > 5 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)
