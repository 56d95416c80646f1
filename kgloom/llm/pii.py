"""Personal data: base patterns, and information-theoretic sanitisation of what gives it away.

The base patterns find e-mail and IP addresses, card and phone numbers. An
address or number that stands in several documents is a protected entity, and
the corpus tells how strongly a term of these documents reveals it: a term t discloses an
entity e if PMI(t, e) reaches ``DISCLOSURE`` of e's information -log p(e), that
is, if seeing t all but names e (Sanchez and Batet 2013). Probabilities are
shares of all documents; equal texts count once. The whole text is an entity's context, and
every occurrence of a disclosing term in a document with the entity is a span. Such terms are
generalised up a hierarchy of forms: numbers, codes of letters and digits, and capitalised names to
their class, which is common and so hides them; plain words, whose form tells no class, are removed.

Co-occurrence in fewer than ``SUPPORT`` texts is no estimate of a probability (every term of a text
would disclose an entity that is seen once), so such pairs disclose nothing.

Counts of documents per term are taken over the whole corpus, for those terms
only that stand with an entity at least ``SUPPORT`` times; a filter of fixed
size, which is all that is broadcast, picks them out, and an exact join follows.

Cases: null and empty texts have no spans; ties go to the span that starts
first, then to the kind listed first; repeated rows are kept; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Least texts that an entity and a term share; share of the entity's information.
SUPPORT, DISCLOSURE = 3, 0.8
FILTER_BITS = 1 << 22

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of IP starts where a run of digits does; saying so keeps long runs linear.
_IP = re.compile("(?<![0-9])" + IP.pattern)
_DOTTED = re.compile(r"[0-9]\.[0-9]")
# A match of CARD is a whole run, and only runs of sixteen digits or more can pass.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_TERM = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str):
    """Matches of EMAIL, found from their at signs: time does not grow with the square of a long word."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, stop) of the base matches, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity_key(kind: int, value: str) -> int:
    """A protected entity by kind and value, whatever its spacing and case."""
    plain = value.lower() if kind < 2 else "".join(c for c in value if c.isdigit())
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - (1 << 63)


def term_key(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(lower-cased term, start, stop) of every term of a text that no base span touches."""
    out, end = [], 0
    for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        if a > end:
            out += [(m[0].lower(), *m.span()) for m in _TERM.finditer(text, end, a) if not (m.start() == end > 0 and _TERM.match(text[end - 1])) and not (m.end() == a < len(text) and _TERM.match(text[a]))]
        end = max(end, b)
    return out


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))


def _listed(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in ss] for ss in spans], _SPANS)


def split_holders(frame: DataFrame, holding: bool) -> DataFrame:
    """``id``, ``at``, ``text``, ``spans`` of the rows with base spans, and the keys of their ``entities``; or of those without."""
    fields = [*frame.select("id", "at", "text").schema.fields, T.StructField("spans", T.ArrayType(SPAN)), T.StructField("entities", T.ArrayType(T.LongType()))]

    def work(batches):
        for batch in batches:
            spans = [base_spans(t.as_py()) for t in batch.column(2)]
            at = [k for k, ss in enumerate(spans) if bool(ss) == holding]
            chosen = batch.take(pa.array(at, pa.int64()))
            entities = [sorted({entity_key(kind, t.as_py()[a:b]) for kind, a, b in spans[k]}) if holding else [] for k, t in zip(at, chosen.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*chosen.columns, _listed([spans[k] for k in at]), pa.array(entities, pa.list_(pa.int64()))], names=["id", "at", "text", "spans", "entities"])

    return frame.select("id", "at", "text").mapInArrow(work, T.StructType(fields))


def near_terms(held: DataFrame) -> DataFrame:
    """``doc`` (hash of the text), ``entity``, ``terms`` (keys of the distinct terms of the text) of every entity of every text."""

    def work(batches):
        for batch in batches:
            terms = [sorted({term_key(x) for x in {x for x, _, _ in terms_of(t.as_py(), [(s["kind"], s["start"], s["stop"]) for s in ss.as_py()])}}) for t, ss in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(terms, pa.list_(pa.int64()))], names=["doc", "entities", "terms"])

    once = held.select("at", "text", "spans", "entities").dropDuplicates(["at"])
    return once.mapInArrow(work, "doc long, entities array<long>, terms array<long>").select("doc", F.explode("entities").alias("entity"), "terms")


def bits_of(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS, of which those are set that a value of the column ``key`` points at; its size, and so what is broadcast, is fixed."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    words = keys.select(place.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words:
        bits[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return bits


def is_set(bits: np.ndarray, key: int) -> bool:
    p = key % FILTER_BITS
    return bool(int(bits[p >> 6]) >> (p & 63) & 1)


def term_documents(docs: DataFrame, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """``term``, ``n_t``: in how many distinct texts each of the given terms occurs, over all texts (``at``, ``text``).

    Texts that are there once are counted inside each task. Only for those that may have copies (``copied`` names these by
    ``at``) do pairs of text and term go through the shuffle, where equal ones become one. A filter picks the terms: a few others may be among the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits_of(terms.select(F.col("term").alias("key"))), bits_of(copied.select(F.col("at").alias("key")))))

    def work(batches):
        flags, again = shared.value
        known = {}
        for batch in batches:
            single, pairs = Counter(), set()
            for at, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = []
                for w in set(_TERM.findall(t.as_py().lower())):
                    k = known.get(w)
                    if k is None:
                        if len(known) > 500_000:
                            known.clear()
                        k = term_key(w)
                        known[w] = k = k if is_set(flags, k) else 0
                    if k:
                        mine.append(k)
                if is_set(again, at):
                    pairs.update((at, k) for k in mine)
                else:
                    single.update(mine)
            pairs = sorted(pairs)
            doc = pa.array([*[None] * len(single), *(d for d, _ in pairs)], pa.int64())
            yield pa.RecordBatch.from_arrays([doc, pa.array([*single, *(k for _, k in pairs)], pa.int64()), pa.array([*single.values(), *[1] * len(pairs)], pa.int64())], names=["doc", "term", "n"])

    # Equal pairs, and what tasks have counted of a term, meet here; then both kinds of count are added up.
    once = docs.select("at", "text").mapInArrow(work, "doc long, term long, n long").groupBy("term", "doc").agg(F.when(F.col("doc").isNull(), F.sum("n")).otherwise(F.lit(1)).alias("n"))
    return once.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, held: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``entity``, ``term``: the terms that disclose an entity, by co-occurrence over all distinct texts of ``docs``; ``held`` has those with entities.

    Only entities of ``support`` texts can have any.
    """
    near = stored(near_terms(held), "near-terms")
    texts = stored(docs.groupBy("at").agg(F.count("*").alias("n")), "texts")
    whole = texts.count()
    entities = near.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < whole))
    known = stored(near.join(entities, "entity"), "known-entities")
    if known.isEmpty():
        return known.select("entity", F.lit(0).cast("long").alias("term"))
    # A pair discloses if its term is in at most n_et * (all / n_e) ^ (1 - disclosure) texts; one that stands
    # in more texts with entities of any kind than that is out before its texts are counted.
    spread = known.dropDuplicates(["doc"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    met = known.select("entity", "n_e", F.explode("terms").alias("term")).groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    most = F.col("n_et") * F.pow(F.lit(float(whole)) / F.col("n_e"), F.lit(1 - disclosure))
    pairs = stored(met.join(spread, "term").withColumn("most", most).where("n_near <= most * 1.000001").select("entity", "term", "most"), "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term")
    terms = stored(pairs.select("term").distinct(), "terms")
    return pairs.join(term_documents(docs, terms, texts.where("n > 1")), "term").where("n_t <= most * 1.000001").select("entity", "term")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: bool = True, clean: bool = False) -> DataFrame:
    """``id``, ``text`` (with ``clean``, generalised), ``spans`` (``kind``, ``start``, ``stop``) of each row: base kinds, then, with ``terms``, disclosing terms.

    Rows with base spans are stored, and everything about entities starts from them; the others have no more to find.
    """
    frame = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = stored(split_holders(frame, True), "holders")
    found = held
    if terms:
        pairs = disclosing_terms(frame.select("at", "text"), held)
        named = held.select("at", F.explode("entities").alias("entity")).distinct()
        found = held.join(named.join(pairs, "entity").groupBy("at").agg(F.collect_set("term").alias("revealing")), "at", "left")
    else:
        found = held.withColumn("revealing", F.lit(None).cast("array<long>"))
    schema = T.StructType([held.schema["id"], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])

    def finish(batches):
        for batch in batches:
            texts, spans = [], []
            for t, ss, rs in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                t, known = t.as_py(), set(rs.as_py() or ())
                mine = [(s["kind"], s["start"], s["stop"]) for s in ss.as_py()]
                if known:
                    mine += [(len(KINDS), a, b) for x, a, b in terms_of(t, mine) if term_key(x) in known]
                texts.append(cleaned(t, mine) if clean else t)
                spans.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), _listed(spans)], names=["id", "text", "spans"])

    marked = found.select("id", "text", "spans", "revealing").mapInArrow(finish, schema)
    return split_holders(frame, False).select("id", "text", "spans").union(marked)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text: of the base kinds hashed, of all kinds in full."""
    names = F.array(*map(F.lit, (*KINDS, "term")))

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.kind], x.start.cast("string"), x.stop.cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("id", *counts, F.sha2(said(F.expr(f"filter(spans, x -> x.kind < {len(KINDS)})")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def general(term: str) -> str:
    """What stands for a disclosing term: its class by form, nothing for a plain word."""
    if term.isdigit():
        return "<NUMBER>"
    if any(map(str.isdigit, term)):
        return "<CODE>"
    return "<NAME>" if term[:1].isupper() else ""


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span generalised: base kinds to their names, disclosing terms as ``general`` says.

    Of overlapping spans the one that starts first, then the longest, names the whole stretch.
    """
    out, at, reach = [], 0, -1
    for a, b, k in sorted((a, -b, k) for k, a, b in spans if b > a):
        b = -b
        if a < reach:
            if b > reach:
                reach = at = b
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>" if k < len(KINDS) else general(text[a:b])]
        at = reach = b
    return "".join((*out, text[at:]))
