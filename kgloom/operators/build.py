"""From tables and pages to nodes, edges, attributes and aliases; merging and aligning domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import norm

HREF = r'href="([^"]+)"'


def node_id(kind: str, key):
    return F.when(key.isNotNull(), F.concat(F.lit(f"{kind}:"), key.cast("string")))


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def whole(df: DataFrame, *columns: str) -> bool:
    """Whether keys are whole numbers, of which equal ids are equal keys: they can be made distinct as numbers, before they become text that is shuffled at several times their size."""
    return all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in columns)


def map_edges(df: DataFrame, specs: list[tuple[str, str, str, str, str]], domain: str) -> DataFrame:
    """``s``, ``p``, ``o``, ``domain`` by specs (subject type, subject column, predicate, object type, object column); null keys give none; distinct."""
    if whole(df, *(c for _, sc, _, _, oc in specs for c in (sc, oc))) and len({(st, p, ot) for st, _, p, ot, _ in specs}) == len(specs):
        keys = [(spec, df.select(F.col(spec[1]).alias("a"), F.col(spec[4]).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()) for spec in specs]
        parts = [k.select(node_id(st, F.col("a")).alias("s"), F.lit(p).alias("p"), node_id(ot, F.col("b")).alias("o")) for (st, _, p, ot, _), k in keys]
        return union(parts).withColumn("domain", F.lit(domain))
    parts = [df.select(node_id(st, F.col(sc)).alias("s"), F.lit(p).alias("p"), node_id(ot, F.col(oc)).alias("o")) for st, sc, p, ot, oc in specs]
    return union(parts).where("s IS NOT NULL AND o IS NOT NULL").dropDuplicates().withColumn("domain", F.lit(domain))


def map_ends(df: DataFrame, specs: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """``p``, ``end`` (``s`` or ``o``), ``id``: the ends of the edges that the specs make. A row needs both of its keys; distinct by column and predicate."""
    parts = []
    for st, sc, p, ot, oc in specs:
        both = df.where(F.col(sc).isNotNull() & F.col(oc).isNotNull())
        parts += [both.select(F.col(column).alias("key")).distinct().select(F.lit(p).alias("p"), F.lit(end).alias("end"), node_id(kind, F.col("key")).alias("id")) for end, kind, column in (("s", st, sc), ("o", ot, oc))]
    return union(parts)


def map_counts(df: DataFrame, specs: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """``p``, ``n``: how many rows make an edge of each spec, which are at least as many as its distinct edges."""
    return union([df.where(F.col(sc).isNotNull() & F.col(oc).isNotNull()).groupBy(F.lit(p).alias("p")).agg(F.count("*").alias("n")) for _, sc, p, _, oc in specs])


def map_attrs(df: DataFrame, specs: list[tuple[str, str, str, str, str]], domain: str) -> DataFrame:
    """``s``, ``p``, ``dtype``, ``v_str``, ``v_num``, ``v_ts``, ``domain`` by specs (type, key column, attribute, ``str`` | ``num`` | ``ts``, value column)."""
    types = {"str": "string", "num": "double", "ts": "timestamp_ntz"}
    rows = []
    for kind, key, p, dtype, column in specs:
        values = {t: F.col(column).cast(cast) if t == dtype else F.lit(None).cast(cast) for t, cast in types.items()}
        rows.append(F.struct(node_id(kind, F.col(key)).alias("s"), F.lit(p).alias("p"), F.lit(dtype).alias("dtype"), *[v.alias(f"v_{t}") for t, v in values.items()]))
    made = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return made.where("s IS NOT NULL AND (v_str IS NOT NULL OR v_num IS NOT NULL OR v_ts IS NOT NULL)").dropDuplicates(["s", "p"]).withColumn("domain", F.lit(domain))


def build_nodes(df: DataFrame, specs: list[tuple[str, str, str | None]], domain: str) -> DataFrame:
    """``id``, ``type``, ``label``, ``domain`` by specs (type, key column, label column or None for "type key"); one row an id, the least label."""
    if whole(df, *(key for _, key, _ in specs)) and len({kind for kind, _, _ in specs}) == len(specs):
        keyed = [(kind, label, df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(label).cast("string") if label else F.lit(None)).alias("label"))) for kind, key, label in specs]
        least = [(kind, label, d.groupBy("key").agg(F.min("label").alias("label")) if label else d.select("key").distinct()) for kind, label, d in keyed]
        made = [d.select(node_id(kind, F.col("key")).alias("id"), F.lit(kind).alias("type"), F.col("label") if label else F.concat(F.lit(f"{kind} "), F.col("key").cast("string")).alias("label")) for kind, label, d in least]
        return union(made).withColumn("domain", F.lit(domain))
    parts = []
    for kind, key, label in specs:
        text = F.col(label).cast("string") if label else F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
        parts.append(df.select(node_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("type"), text.alias("label")))
    return union(parts).where("id IS NOT NULL").groupBy("id", "type").agg(F.min("label").alias("label")).withColumn("domain", F.lit(domain))


def build_aliases(nodes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``id``, ``alias_norm``, ``n_tok`` of labels and of further names (``id``, ``alias``)."""
    named = nodes.select("id", F.col("label").alias("alias"))
    if extra is not None:
        named = named.unionByName(extra.select("id", "alias"))
    made = named.select("id", norm(F.col("alias")).alias("alias_norm")).where("alias_norm <> ''").distinct()
    return made.withColumn("n_tok", F.size(F.split("alias_norm", " ")))


def map_page_edges(pages: DataFrame, domain: str = "web") -> DataFrame:
    """Page to host, to language and to every link's target."""
    page = node_id("page", F.col("page_id"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    lang = F.regexp_extract("html", r'<html[^>]*\slang="([^"]+)"', 1)
    pair = [F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), v.alias("v")) for p, kind, v in (("on_host", "host:", host), ("in_lang", "lang:", lang))]
    one = pages.select(page.alias("s"), F.explode(F.array(*pair)).alias("e"))
    many = pages.select(page.alias("s"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("v"))
    singles = one.where("e.v <> ''").select("s", "e.p", F.concat("e.kind", "e.v").alias("o"))
    links = many.where("v <> ''").select("s", F.lit("links_to").alias("p"), F.concat(F.lit("link:"), "v").alias("o"))
    return singles.unionByName(links).where("s IS NOT NULL").dropDuplicates().withColumn("domain", F.lit(domain))


def merge_domains(*edges: DataFrame) -> DataFrame:
    """``s``, ``p``, ``o``, ``domains``: equal edges become one, with the sorted list of their domains."""
    return union(edges).groupBy("s", "p", "o").agg(F.sort_array(F.collect_set("domain")).alias("domains"))


def align_predicates(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with predicates renamed by ``mapping`` (``domain``, ``p``, ``p_shared``); others are kept. The mapping is left to the optimiser to broadcast."""
    return edges.join(mapping, ["domain", "p"], "left").select("s", F.coalesce("p_shared", "p").alias("p"), "o", "domain").dropDuplicates()
