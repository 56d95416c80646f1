"""Mapping specs of the domains over the given tables, question templates, lexicon and cues."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import build, manage, questions
from kgloom.session import cut, sized
from kgloom.sources.tables import load_source

EDGE_SPECS = {
    "nation": [("nation", "n_nationkey", "in_region", "region", "n_regionkey")],
    "customer": [("customer", "c_custkey", "in_nation", "nation", "c_nationkey")],
    "supplier": [("supplier", "s_suppkey", "in_nation", "nation", "s_nationkey")],
    "orders": [("order", "o_orderkey", "placed_by", "customer", "o_custkey")],
    "lineitem": [
        ("order", "l_orderkey", "contains_part", "part", "l_partkey"),
        ("order", "l_orderkey", "shipped_by", "supplier", "l_suppkey"),
        ("supplier", "l_suppkey", "supplies", "part", "l_partkey"),
    ],
}
ATTR_SPECS = {
    "customer": [("customer", "c_custkey", "acctbal", "num", "c_acctbal"), ("customer", "c_custkey", "market_segment", "str", "c_mktsegment")],
    "supplier": [("supplier", "s_suppkey", "acctbal", "num", "s_acctbal")],
    "part": [
        ("part", "p_partkey", "brand", "str", "p_brand"),
        ("part", "p_partkey", "type", "str", "p_type"),
        ("part", "p_partkey", "size", "num", "p_size"),
        ("part", "p_partkey", "retail_price", "num", "p_retailprice"),
    ],
    "orders": [
        ("order", "o_orderkey", "status", "str", "o_orderstatus"),
        ("order", "o_orderkey", "total_price", "num", "o_totalprice"),
        ("order", "o_orderkey", "order_date", "ts", "o_orderdate"),
        ("order", "o_orderkey", "priority", "str", "o_orderpriority"),
    ],
}
NODE_SPECS = {
    "region": [("region", "r_regionkey", "r_name")],
    "nation": [("nation", "n_nationkey", "n_name")],
    "customer": [("customer", "c_custkey", "c_name")],
    "supplier": [("supplier", "s_suppkey", "s_name")],
    "part": [("part", "p_partkey", "p_name")],
    "orders": [("order", "o_orderkey", None)],
}
#: p, domain, from_type, to_type, functional
PREDICATES = [
    ("in_region", "trade", "nation", "region", True),
    ("in_nation", "trade", "customer", "nation", True),
    ("in_nation", "trade", "supplier", "nation", True),
    ("placed_by", "trade", "order", "customer", True),
    ("contains_part", "trade", "order", "part", False),
    ("shipped_by", "trade", "order", "supplier", False),
    ("supplies", "trade", "supplier", "part", False),
]
#: tid, type of the anchor, pattern
TEMPLATES = [
    ("T1", "customer", "Which nation is %s in?"),
    ("T2", "nation", "Who is in %s?"),
    ("T3", "customer", "Which region is %s in?"),
    ("T4", "customer", "How many orders did %s place?"),
    ("T5", "customer", "What is the most expensive order of %s?"),
    ("T6", "customer", "What is the market segment of %s?"),
]
#: phrase_norm, path, agg, attr_p
LEXICON = [
    ("which nation", "+in_nation", "", ""),
    ("who is in", "-in_nation", "", ""),
    ("which region", "+in_nation/+in_region", "", ""),
    ("orders did", "-placed_by", "count", ""),
    ("most expensive order", "-placed_by", "max", "total_price"),
    ("market segment", "", "", "market_segment"),
    ("orders contain", "-contains_part", "count", ""),
    ("is supplier", "+in_nation", "", ""),
    ("parts does", "+supplies", "", ""),
]
#: phrase_norm, attr_p
FILTERS = [("of type", "type"), ("of brand", "brand")]
#: cue_norm, qtype, priority
CUES = [("how many", "count", 50), ("most expensive", "superlative", 40), ("market segment", "attribute", 30), ("is supplier", "boolean", 20)]
#: qtype, sentence
SENTENCES = [
    ("list", "The answer is %s."),
    ("count", "There are %s."),
    ("superlative", "It is %s."),
    ("attribute", "The value is %s."),
    ("boolean", "The answer is %s."),
]
STOP_WORDS = ["which", "who", "what", "how", "many", "the", "of", "in", "is", "did", "place", "orders", "nation", "region", "most", "expensive", "order", "market", "segment", "supplier", "customer"]


@dataclass
class Trade:
    """The trade graph of one directory of tables; every table is a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        sized(self.spark)

    def table(self, name: str) -> DataFrame:
        return load_source(self.spark, "parquet", f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def edges(self) -> DataFrame:
        return build.union([build.map_edges(self.table(t), specs, "trade") for t, specs in EDGE_SPECS.items()])

    @cached_property
    def ends(self) -> DataFrame:
        """The ends of ``edges``, from the tables: edges need not be made distinct for them."""
        return build.union([build.map_ends(self.table(t), specs) for t, specs in EDGE_SPECS.items()])

    @cached_property
    def counts(self) -> DataFrame:
        """About how many ``edges`` each predicate has, from the tables, likewise."""
        return build.union([build.map_counts(self.table(t), specs) for t, specs in EDGE_SPECS.items()])

    @cached_property
    def attrs(self) -> DataFrame:
        return build.union([build.map_attrs(self.table(t), specs, "trade") for t, specs in ATTR_SPECS.items()])

    @cached_property
    def nodes(self) -> DataFrame:
        return build.union([build.build_nodes(self.table(t), specs, "trade") for t, specs in NODE_SPECS.items()])

    @cached_property
    def named(self) -> DataFrame:
        """Nodes that questions name: all but orders."""
        return self.nodes.where("type <> 'order'")

    @cached_property
    def aliases(self) -> DataFrame:
        return build.build_aliases(self.named)

    @cached_property
    def stored_aliases(self) -> DataFrame:
        return cut(self.aliases)

    @cached_property
    def predicates(self) -> DataFrame:
        return self.spark.createDataFrame(PREDICATES, "p string, domain string, from_type string, to_type string, functional boolean")

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(LEXICON, "phrase_norm string, path string, agg string, attr_p string")

    @cached_property
    def cues(self) -> DataFrame:
        return self.spark.createDataFrame(CUES, "cue_norm string, qtype string, priority int")

    @cached_property
    def sentences(self) -> DataFrame:
        return self.spark.createDataFrame(SENTENCES, "qtype string, sentence string")

    @cached_property
    def degrees(self) -> DataFrame:
        return manage.degrees(self.edges)

    @cached_property
    def questions(self) -> DataFrame:
        """``qid``, ``anchor_id``, ``tid``, ``text`` of all templates; T7 asks of every supplier whether it is in a nation, right or wrong."""
        templates = self.spark.createDataFrame(TEMPLATES, "tid string, type string, pattern string")
        first = questions.make_questions(self.nodes, templates)
        asked = self.table("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).otherwise((F.col("s_nationkey") + 1) % 25).alias("n_nationkey"))
        seventh = asked.join(self.table("nation"), "n_nationkey").select(
            F.concat(F.lit("T7|supplier:"), F.col("s_suppkey").cast("string")).alias("qid"),
            F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("anchor_id"),
            F.lit("T7").alias("tid"),
            F.concat(F.lit("Is "), "s_name", F.lit(" in "), "n_name", F.lit("?")).alias("text"),
        )
        return first.unionByName(seventh)

    @cached_property
    def ambiguous(self) -> DataFrame:
        """One question for each part name, of which many parts have the same."""
        return self.table("part").where("p_name IS NOT NULL").select(F.concat(F.lit("T10|"), "p_name").alias("qid"), F.concat(F.lit("How many orders contain "), "p_name", F.lit("?")).alias("text")).distinct()

    def understood(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Mentions with ids, relations and classes of questions."""
        # Both are read several times below.
        relations = cut(questions.link_relations(asked, self.lexicon))
        found = cut(questions.find_mentions(asked, self.stored_aliases))
        mentions = questions.disambiguate(found, self.stored_aliases, relations, self.predicates, self.nodes, self.degrees)
        return mentions, relations, questions.classify(asked, self.cues)

    @cached_property
    def parsed(self) -> DataFrame:
        """Logical forms of all questions, worked out once: every path shape starts from them."""
        asked = cut(self.questions)  # read by every step
        mentions, relations, classes = self.understood(asked)
        return cut(questions.assemble(asked, mentions, relations, classes, self.predicates, self.nodes))
