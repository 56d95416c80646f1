"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is addressed by the digest of its
content. A ledger records which (blob, rule, rule version) has been scanned and
what was found; only pairs that it lacks are scanned, each blob once however many
paths hold it, and old and new findings together are joined back to all paths.

Cases: null content is empty content; empty content has no findings; repeated
rows give repeated results; columns beyond those named are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the fewest characters that ``group`` of a match may have; shorter ones are dropped."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The kinds that every scan reports, in the order of ties.
BASE_RULES = (
    Rule(
        "assign",
        1,
        "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", least=18),
    # A run is matched whole or not at all, so its least length can stand in the pattern.
    Rule("hex", 1, "[0-9a-f]{16,}", least=16),
)
#: Kinds beyond the base ones: formats whose prefix alone marks them.
EXTRA_RULES = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("host_token", 1, "gh[opusr]_[A-Za-z0-9]{30,}"),
)

FOUND = "array<struct<start:int,ord:int,kind:string,stop:int>>"
LEDGER = f"blob binary, rule string, rule_version int, found {FOUND}"


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(rule: Rule, order: int, content: str = "content"):
    """All matches of a rule, leftmost and not overlapping, with code-point positions.

    What stands between matches and the matches themselves add up to the places; spans are
    gathered in runs, so that the time is in proportion to the text and its matches.
    """
    whole = f"regexp_extract_all({content}, {_quoted(rule.pattern)}, 0)"
    pairs = f"zip_with({whole}, regexp_extract_all({content}, {_quoted(rule.pattern)}, {rule.group}), (m, g) -> named_struct('m', m, 'g', g))" if rule.group else f"transform({whole}, m -> named_struct('m', m, 'g', m))"
    # One gap more than matches: what follows the last of them.
    matches = f"zip_with({pairs}, split({content}, {_quoted(rule.pattern)}, -1), (y, gap) -> named_struct('m', y.m, 'g', y.g, 'gap', gap))"
    span = f"named_struct('start', a.at + char_length(x.gap), 'ord', {order}, 'kind', '{rule.name}', 'stop', a.at + char_length(x.gap) + char_length(x.m))"
    return F.expr(f"""if({content} rlike {_quoted(rule.pattern)}, aggregate({matches}, named_struct('at', 0, 'old', cast(array() as array<{FOUND}>), 'near', cast(array() as {FOUND})),
      (a, x) -> if(x.m IS NULL, a, named_struct(
        'at', a.at + char_length(x.gap) + char_length(x.m),
        'old', if(size(a.near) < 256, a.old, concat(a.old, array(a.near))),
        'near', concat(if(size(a.near) < 256, a.near, cast(array() as {FOUND})), if(char_length(x.g) < {rule.least}, cast(array() as {FOUND}), array({span}))))),
      a -> flatten(concat(a.old, array(a.near)))), cast(array() as {FOUND}))""")


def addressed(versions: DataFrame) -> DataFrame:
    """Each version with the address of its blob, and without its content."""
    return versions.select("path", "version", F.unhex(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("blob"))


def scan_blobs(versions: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of each blob that has something unseen: ``blob``, ``scanned`` (rule and version pairs), ``found``.

    The contents of equal blobs are folded to one in each task before the shuffle, so a blob
    that a third of all paths hold crosses it once a task.
    """
    content = F.coalesce("content", F.lit(""))
    blobs = versions.select(content.alias("content"), F.unhex(F.sha2(content, 256)).alias("blob")).groupBy("blob").agg(F.any_value("content").alias("content"))
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("scanned", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("scanned", F.array_except(every, F.coalesce("seen", F.array().cast("array<struct<rule:string,rule_version:int>>")))).where(F.size("scanned") > 0)
    per_rule = []
    for order, rule in enumerate(rules):
        spans = _spans(rule, order)
        if ledger is not None:
            mine = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"))
            spans = F.when(F.array_contains("scanned", mine), spans).otherwise(F.array().cast(FOUND))
        per_rule.append(spans)
    return todo.select("blob", "scanned", F.array_sort(F.concat(*per_rule)).alias("found"))


def ledger_entries(scanned: DataFrame) -> DataFrame:
    """What a scan adds to the ledger: ``blob``, ``rule``, ``rule_version``, ``found`` (of that rule alone)."""
    pairs = scanned.select("blob", "found", F.explode("scanned").alias("x"))
    return pairs.select("blob", "x.rule", "x.rule_version", F.filter("found", lambda f: f.kind == F.col("x.rule")).alias("found"))


def united(ledger: DataFrame, scanned: DataFrame | None, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """``blob``, ``found``: one row a blob with all that is known of it for the current versions of ``rules``, old and new."""
    spark = ledger.sparkSession
    current = spark.createDataFrame([(r.name, r.version, k) for k, r in enumerate(rules)], "rule string, rule_version int, place int")
    entries = ledger.select("blob", "rule", "rule_version", "found")
    entries = (entries if scanned is None else entries.union(ledger_entries(scanned))).join(F.broadcast(current), ["rule", "rule_version"])
    # A pair that was entered twice counts once; the place of a rule may have changed since it was entered.
    once = entries.groupBy("blob", "place").agg(F.any_value("found").alias("found"))
    placed = once.withColumn("found", F.expr(f"cast(transform(found, f -> named_struct('start', f.start, 'ord', place, 'kind', f.kind, 'stop', f.stop)) as {FOUND})"))
    return placed.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def findings(versions: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings joined back to every version of every path; a version without any has an empty list.

    ``scanned`` is a scan without a ledger, or ``united`` of a ledger and the scan that used it.
    """
    return addressed(versions).join(scanned.select("blob", "found"), "blob", "left").select("path", "version", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; an empty one where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """Findings of every version, with what the ledger at ``path`` lacks scanned and appended to it first.

    A run that dies leaves no half entry; one that is repeated scans what is still unseen.
    """
    spark = versions.sparkSession
    ledger_entries(scan_blobs(versions, rules, read_ledger(spark, path))).write.mode("append").parquet(path)
    mine = addressed(versions).select("blob").distinct()
    return findings(versions, stored(united(read_ledger(spark, path).join(mine, "blob", "left_semi"), None, rules), "found"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text: of the base kinds hashed, of all kinds in full."""
    base = F.filter("found", lambda x: x.ord < len(BASE_RULES))

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(found, x -> x.ord = {k})) as long)").alias(f"n_{r.name}") for k, r in enumerate(BASE_RULES)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
