"""A session with the settings that the jobs assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "kgloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a fresh one on this machine, but only if executors run here too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Bytes in memory of a byte in a compressed columnar file, about: names and ids that count upwards take a byte or two there and a row of fifty bytes here.
FILE_GROWTH = 40


def sized(spark: SparkSession) -> None:
    """Files are judged by what they hold in memory: the default takes their compressed size for it, and broadcasts tables of millions of rows through the driver."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_GROWTH))


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round of a fixpoint: a table written once to the shared folder."""
    sized(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
