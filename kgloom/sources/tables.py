"""Sources and sinks: tables of a domain in, a graph laid out by predicate out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Edges of a file, about.
FILE_EDGES = 1_000_000


def load_source(spark: SparkSession, fmt: str, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table in any format that Spark reads (parquet, csv, json, orc, jdbc)."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write_kg(edges: DataFrame, path: str, rows: int = FILE_EDGES) -> None:
    """One folder a predicate, in as many files, dealt by subject, as it has ``rows`` edges, so that a large predicate is not one task.

    Every file has a task of its own: with a fixed number of tasks, a task's share would grow with the edges.
    """
    # A row for each predicate: as many as the vocabulary has, whatever the number of edges.
    counts = [(r["p"], -(-r["n"] // rows)) for r in edges.where("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()]
    first = [sum(n for _, n in counts[:k]) for k in range(len(counts) + 1)]
    buckets = edges.sparkSession.createDataFrame([(p, n, at) for (p, n), at in zip(counts, first, strict=False)], "p string, buckets long, at long")
    dealt = edges.join(F.broadcast(buckets), "p").select(*edges.columns, (F.col("at") + F.pmod(F.xxhash64("s"), F.col("buckets"))).cast("int").alias("task"))
    dealt.repartitionById(max(1, first[-1]), F.col("task")).drop("task").write.mode("overwrite").partitionBy("p").parquet(path)


def read_kg(spark: SparkSession, path: str) -> DataFrame:
    """The stored edges; a filter on ``p`` reads that predicate's folder only."""
    return spark.read.parquet(path).select("s", F.col("p").cast("string").alias("p"), "o", "domain")
