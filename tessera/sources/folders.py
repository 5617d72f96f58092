"""Folders for what a job puts down for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared folder (spark.checkpoint.dir).

    Only on one machine, as in tests, a session without that setting gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to tasks that write or read a file a key: a fixed number, as Spark merges partitions by bytes and files cost more.

    By the key's hash: rows that are grouped by the key itself already would be left where they are, in partitions that Spark merges.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(key))


def store(uri: str):
    """File system of pyarrow and path of a folder; the schemes of Hadoop's S3 connectors are read as s3."""
    from pyarrow import fs

    head, sep, rest = uri.partition(":")
    if not sep:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(("s3" if head in ("s3a", "s3n") else head) + sep + rest)
