"""What the driver and all executors share: folders, and this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, on one machine, a local folder is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several results are made of, written and read again; computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *by: str, each: int = 20_000) -> DataFrame:
    """Rows dealt by columns to partitions of about ``each`` rows, which Spark doesn't merge again: so
    what a task holds is the same over any input. Spark itself goes by the bytes of an exchange,
    which for pushes are a tenth or less of what their sorts take. Counts the rows, of a table by its footers."""
    return rows.repartition(max(1, -(-rows.count() // each)), *by)


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it. On a cluster where it
    lies elsewhere it is shipped as usual (``--py-files``), and this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
