"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import alignment, ann, collocations, fingerprint, langid, line_dedup, minhash, mixing, pii, secrets, suffix_dedup, toxicity
from kgloom.llm import sentencepiece_lattice as lattice
from kgloom.llm.common import fold, shared_dir, stored, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.encode(table(spark, sf_dir, "documents"), lattice.load_pieces(spark))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    network = langid.train(docs.where(~held_out).select("lang", "text"))
    found = langid.predict(docs, network)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "row.source", "block", "n_blocks", "slot", "release", "deadline")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    # A ledger of this run alone, so that the result is that of the tables given.
    return secrets.secret_digest(secrets.scan(versions, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clashes = stored(fingerprint.collided(docs), "clashes")
    ends = fingerprint.range_ends(docs)
    heads = fingerprint.range_heads(docs, ends)

    def own(rows: DataFrame) -> DataFrame:
        named = fingerprint.fingerprinted(fingerprint.prepared(rows, ends), clashes, "digest", "second", "fingerprint")
        return named.select("id", "part", "packed", "fingerprint")

    # Heads are a row for each range: their documents are picked before anything is worked out of them.
    first = docs.join(F.broadcast(heads.select("head").distinct()), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    new = fingerprint.edited(fingerprint.with_next(own(docs), heads, own(first), ["packed", "fingerprint"]), ["fingerprint", "next_fingerprint"])
    return fingerprint.fingerprinted(new, clashes, "digest", "second", "edited_fingerprint").select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.col("sha256").alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def _op9_sql() -> str:
    parts = []
    for order, rule in enumerate(secrets.BASE_RULES + secrets.EXTRA_RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {order} AS o, '{rule.name}' AS kind, st, st + length(m) AS en FROM (
          SELECT doc_id, m, g, list_sum([length(x) for x in pieces[1:k]])::BIGINT + coalesce(list_sum([length(x) for x in ms[1:k-1]]), 0)::BIGINT AS st FROM (
            SELECT doc_id, ms, pieces, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(ms) + 1)) AS k FROM (
              SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS gs, string_split_regex(t, '{p}') AS pieces
              FROM docs)))
        WHERE length(g) >= {rule.least}""")
    spans = " UNION ALL ".join(parts)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      spans AS ({spans}),
      per_doc AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, o) FILTER (o < {len(secrets.BASE_RULES)}) AS base,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, o) AS every FROM spans GROUP BY doc_id)
      SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
      FROM docs d LEFT JOIN per_doc USING (doc_id)"""


_OP11_SQL = r"""WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS lengths(k)) GROUP BY lang, k, phrase HAVING count(*) >= 10),
  phrases AS (SELECT lang, phrase, f AS a, k AS words, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2),
  cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, words)) AS c FROM phrases)),
  scored AS (SELECT cuts.lang, cuts.phrase, a, c, g.f AS l, h.f AS r, ((1000000::HUGEINT * a * a) // (g.f::HUGEINT * h.f))::BIGINT AS score
    FROM cuts JOIN grams g ON g.lang = cuts.lang AND g.phrase = x JOIN grams h ON h.lang = cuts.lang AND h.phrase = y),
  least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM scored) WHERE nth = 1),
  around AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM phrases WHERE words = 3) GROUP BY lang, phrase),
  ranked AS (SELECT least.*, row_number() OVER (PARTITION BY least.lang ORDER BY score DESC, a DESC, least.phrase) AS rank
    FROM least LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


_OP12_SQL = """WITH lines AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
  keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
  crowded AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> keep, false) AS gone FROM keyed LEFT JOIN crowded USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_languages": op5_languages,
    "op6_mixing": op6_mixing,
    "op7_neighbours": op7_neighbours,
    "op8_personal_data": op8_personal_data,
    "op9_secrets": op9_secrets,
    "op10_fingerprints": op10_fingerprints,
    "op11_collocations": op11_collocations,
    "op12_repeated_lines": op12_repeated_lines,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {
    "op9_secrets": _op9_sql(),
    "op11_collocations": _OP11_SQL,
    "op12_repeated_lines": _OP12_SQL,
}
