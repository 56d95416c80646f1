"""The pipeline's stages on a small table."""

from fractions import Fraction
from math import ceil, floor

import corpus_pipeline
from kgloom.llm import mixing


def test_stages_keep_the_columns(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 100, 10)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate([*texts, texts[0], None, "", "mail a@b.example.com now please"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(path)
        at = spark.read.parquet(path)
        seen.append(at.count())
        if name != "sentencepiece":
            assert at.columns == docs.columns
        if name == "personal_data":
            cleaned = at.where("doc_id = 13").head()
            assert cleaned["text"] == "mail <EMAIL> now please" and cleaned["n_chars"] == len(cleaned["text"])
    assert seen == [14, 13, 13, 13, 13]


def test_one_of_each_group_of_copies_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "k"), (1, a, "k"), (3, b, "k"), (5, b + " x", "k"), (5, c, "k"), (None, c + " y", "k"), (None, None, "k"), (None, None, "k"), (8, " ", "k"), (9, "alone here", "k"), (9, "alone here", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = corpus_pipeline.near_copies_out(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (None, c + " y"), (None, None), (None, None), (8, " "), (9, "alone here")], key=str)
    assert corpus_pipeline.near_copies_out(spark, docs.limit(0), "").count() == 0


def test_the_schedule_reaches_the_last_stage(spark):
    """A bad order of rows on reading changes nothing: slots are those of a schedule played slot by slot."""
    texts = {i: "w" * (i * 977 % 4001) + " end" for i in range(300)}
    rows = [(i, t, "en", "ab"[i % 5 == 0], len(t)) for i, t in texts.items()] + [(None, "no id", "en", None, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    block = {(r["row"]["source"], r["row"]["doc_id"]): r["block"] for r in mixing.mix(docs).collect()}
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + len(t)
    # Played slot by slot, by definition: of the blocks whose window has begun the one whose window ends first.
    power = {s: Fraction(float(n) ** mixing.EXPONENT) for s, n in sizes.items()}
    share = {s: x / sum(power.values()) for s, x in power.items()}
    left, slot_of, done, t = {s: -(-n // mixing.BLOCK_CHARS) for s, n in sizes.items()}, {}, dict.fromkeys(share, 0), 0
    while any(done[s] < n for s, n in left.items()):
        ready = [(ceil((done[s] + 1) / w), s) for s, w in share.items() if done[s] < left[s] and floor(done[s] / w) <= t]
        if ready:
            s = min(ready)[1]
            slot_of[s, done[s]] = t
            done[s] += 1
        t += 1
    want = {i: slot_of[s or "", block[s, i]] for i, _, _, s, _ in rows}
    assert len(set(want.values())) > 5
    moved = spark.createDataFrame(rows[::-1], schema)
    got = corpus_pipeline.STAGES[-1][1](spark, moved, "").collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["slot"] for r in got} == want and all(r["n_pieces"] == len(r["ids"]) for r in got)


def test_texts_travel_once_and_in_small_batches(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from kgloom.llm import toxicity

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    docs = spark.createDataFrame([(1, "a vile text"), (2, None), (3, "")], "doc_id long, text string")
    model = toxicity.Model(weights={"vile": 5.0}, curve=(0.0, 1.0, 1.0))
    inside = toxicity.score(docs.select(F.struct("*").alias("row")), model, "row", "row.text")
    assert [f.split("#")[0] for f in inside._jdf.queryExecution().analyzed().children().head().output().mkString(",").split(",")] == ["id"]
    plain = toxicity.score(docs, model)
    assert sorted((r["id"]["doc_id"], r["score"], r["passages"]) for r in inside.collect()) == sorted((r["id"], r["score"], r["passages"]) for r in plain.collect())
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    put = corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, of: seen.append(spark.conf.get(name)) or put(df, of))
    assert sorted(corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).collect(), key=lambda r: r["doc_id"]) == docs.orderBy("doc_id").collect()
    assert seen == ["1000"] and spark.conf.get(name) == before
