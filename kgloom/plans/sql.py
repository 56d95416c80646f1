"""The same graph in SQL over the given tables, for the queries' oracles."""

from __future__ import annotations

from kgloom.plans import trade


def values(rows, names: str) -> str:
    said = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS v({names})"


def norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


def md5_int(x: str, digits: int = 8) -> str:
    return f"('0x' || substr(md5({x}), 1, {digits}))::BIGINT"


_EDGES = " UNION ".join(
    f"SELECT '{st}:' || {sc} AS s, '{p}' AS p, '{ot}:' || {oc} AS o, 'trade' AS domain FROM {t} WHERE {sc} IS NOT NULL AND {oc} IS NOT NULL"
    for t, specs in trade.EDGE_SPECS.items()
    for st, sc, p, ot, oc in specs
)
_KINDS = {"str": "VARCHAR", "num": "DOUBLE", "ts": "TIMESTAMP"}
_ATTRS = " UNION ALL ".join(
    f"SELECT '{k}:' || {key} AS s, '{p}' AS p, '{d}' AS dtype, "
    + ", ".join(f"{f'CAST({c} AS {cast})' if d == kind else f'CAST(NULL AS {cast})'} AS v_{kind}" for kind, cast in _KINDS.items())
    + f", 'trade' AS domain FROM {t} WHERE {c} IS NOT NULL"
    for t, specs in trade.ATTR_SPECS.items()
    for k, key, p, d, c in specs
)
_NODES = " UNION ALL ".join(
    f"SELECT '{k}:' || {key} AS id, '{k}' AS type, min({label or f"'{k} ' || {key}"}) AS label, 'trade' AS domain FROM {t} GROUP BY {key}" for t, specs in trade.NODE_SPECS.items() for k, key, label in specs
)

CTES = {
    "edges": _EDGES,
    "attrs": _ATTRS,
    "nodes": _NODES,
    "aliases": f"SELECT DISTINCT id, {norm('label')} AS alias_norm, len(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}]+')) AS n_tok FROM nodes WHERE type <> 'order' AND {norm('label')} <> ''",
    "templates": values(trade.TEMPLATES, "tid, type, pattern"),
    "lexicon": values(trade.LEXICON, "phrase_norm, path, agg, attr_p"),
    "cues": values(trade.CUES, "cue_norm, qtype, priority"),
    "sentences": values(trade.SENTENCES, "qtype, sentence"),
    "predicates": values(trade.PREDICATES, "p, domain, from_type, to_type, functional"),
    "asked7": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE (s_nationkey + 1) % 25 END AS nk, s_nationkey FROM supplier",
    "questions": """SELECT tid || '|' || id AS qid, id AS anchor_id, tid, replace(pattern, '%s', label) AS text FROM nodes JOIN templates USING (type)
      UNION ALL SELECT 'T7|supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'T7', 'Is ' || s_name || ' in ' || n_name || '?' FROM asked7 JOIN nation ON nk = n_nationkey""",
    "ambiguous": "SELECT DISTINCT 'T10|' || p_name AS qid, 'How many orders contain ' || p_name || '?' AS text FROM part WHERE p_name IS NOT NULL",
    "classes": "SELECT * FROM (VALUES ('T1', 'list'), ('T2', 'list'), ('T3', 'list'), ('T4', 'count'), ('T5', 'superlative'), ('T6', 'attribute'), ('T7', 'boolean')) AS v(tid, qtype)",
    "degrees": "SELECT id, count(*) FILTER (d = 'in') AS n_in, count(*) FILTER (d = 'out') AS n_out FROM (SELECT s AS id, 'out' AS d FROM edges UNION ALL SELECT o, 'in' FROM edges) GROUP BY id",
    # Answers from the tables themselves, template by template.
    "gold": """SELECT 'T1|customer:' || c_custkey AS qid, 'nation:' || c_nationkey AS answer_id FROM customer
      UNION SELECT 'T2|nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
      UNION SELECT 'T2|nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
      UNION SELECT 'T3|customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION SELECT 'T4|customer:' || c_custkey, CAST(count(DISTINCT o_orderkey) AS VARCHAR) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
      UNION SELECT 'T5|customer:' || o_custkey, 'order:' || o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r = 1
      UNION SELECT 'T6|customer:' || c_custkey, c_mktsegment FROM customer
      UNION SELECT 'T7|supplier:' || s_suppkey, CASE WHEN nk = s_nationkey THEN 'yes' ELSE 'no' END FROM asked7""",
    "labelled": "SELECT qid, answer_id, coalesce(label, answer_id) AS answer_label FROM gold LEFT JOIN nodes ON answer_id = id",
    "responses": """SELECT q.qid, CASE WHEN names IS NULL THEN 'I do not know.' ELSE replace(sentence, '%s', array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || ' more' ELSE '' END) END AS answer_text,
        coalesce(len(names), 0)::BIGINT AS n_answers
      FROM questions q JOIN classes USING (tid) JOIN sentences USING (qtype) LEFT JOIN (SELECT qid, list(answer_label ORDER BY answer_label) AS names FROM labelled GROUP BY qid) a ON a.qid = q.qid""",
    "ranked": """SELECT qid, id, rank FROM (SELECT a.qid, n.id, row_number() OVER (PARTITION BY a.qid ORDER BY coalesce(n_in + n_out, 0) DESC, n.id) AS rank
      FROM ambiguous a JOIN nodes n ON a.qid = 'T10|' || n.label AND n.type = 'part' LEFT JOIN degrees d ON d.id = n.id)""",
}
NEEDS = {
    "aliases": ["nodes"],
    "questions": ["nodes", "templates", "asked7"],
    "degrees": ["edges"],
    "gold": ["asked7"],
    "labelled": ["gold", "nodes"],
    "responses": ["questions", "classes", "sentences", "labelled"],
    "ranked": ["ambiguous", "nodes", "degrees"],
}


def query(body: str, *names: str) -> str:
    """``body`` below the named tables and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " if order else "") + body


def ngrams(source: str, longest: int) -> str:
    """``qid``, ``start``, ``n_tok``, ``gram`` of a table with ``qid`` and ``text``."""
    return f"""SELECT qid, s AS start, n AS n_tok, array_to_string(w[s + 1:s + n], ' ') AS gram FROM (
      SELECT qid, w, s, unnest(range(1, least({longest}, len(w) - s) + 1)) AS n FROM (
      SELECT qid, w, unnest(range(0, len(w))) AS s FROM (
      SELECT qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source})))"""
