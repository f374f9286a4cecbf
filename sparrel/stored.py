"""Tables in the shared folder, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, one in a local folder of this session, if it runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        if not hasattr(sc, "_sparrel_dir"):
            sc._sparrel_dir = "file://" + tempfile.mkdtemp(prefix="sparrel")
        base = sc._sparrel_dir
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write a table and read it again: a lost executor costs no more than a read."""
    return settle_counted(df, tag)[0]


def settle_counted(df: DataFrame, tag: str = "table") -> tuple[DataFrame, int]:
    """As settle(), with the number of rows, which is counted as they are written."""
    spark = df.sparkSession
    path, seen = folder(spark, tag), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]
