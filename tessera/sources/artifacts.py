"""Run folders: artifacts in, artifacts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sha256
from tessera.sources import saved_files

#: Policies by artifact kind; others have the default.
POLICIES = {
    "state": ("authoritative", "session", "private", "none"), "manifest": ("authoritative", "session", "private", "none"),
    "evidence": ("authoritative", "session", "private", "hashes"), "raw_transcript": ("authoritative", "archive", "restricted", "required"),
    "user_messages": ("derived", "session", "private", "required"), "rendered": ("derived", "session", "private", "none"), "events": ("diagnostic", "short", "private", "required"),
}
DEFAULT_POLICY = ("derived", "session", "private", "none")


def read_artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """(run_id, kind, content): whole files of run folders; the folder is the run, the file name the kind."""
    path = F.col("path")
    files = saved_files.read_files(spark, pattern)
    return files.select(F.element_at(F.split(path, "/"), -2).alias("run_id"), F.regexp_extract(path, r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("kind"), F.col("content").cast("string").alias("content"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved extraction output, fixtures, results: one document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def required_literals(fixture: DataFrame) -> DataFrame:
    return fixture.select(F.explode("required_literals").alias("literal")).distinct()


def carried_states(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records (session_id, line, state_path) with the state they point to; null where it can't be read."""
    return records.join(states.select(F.col("path").alias("state_path"), "state"), "state_path", "left")


def manifest(artifacts: DataFrame) -> DataFrame:
    """(run_id, kind, sha256, bytes, authority, retention, exposure, redaction) of artifacts (run_id, kind, content)."""
    spark = artifacts.sparkSession
    names = ["authority", "retention", "exposure", "redaction"]
    known = spark.createDataFrame([(k, *v) for k, v in POLICIES.items()], ["kind", *names])  # seven rows
    out = artifacts.select("run_id", "kind", sha256(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    out = out.join(F.broadcast(known), "kind", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(d)) for n, d in zip(names, DEFAULT_POLICY, strict=True)})


def hash_sidecar(entries: DataFrame) -> DataFrame:
    """line, hash and preview for a tab-separated file."""
    return entries.select("session_id", "line", "hash", F.regexp_replace("preview", "[\t\r\n]", " ").alias("preview"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.partitionBy("session_id").csv(path, sep="\t", quote="", escape="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON line for each row, by session."""
    df.write.partitionBy("session_id").json(path)


def rejects(df: DataFrame, stage: str, error: Column) -> DataFrame:
    """(session_id, stage, error) for rows with an error."""
    return df.select("session_id", F.lit(stage).alias("stage"), error.alias("error")).where("error IS NOT NULL")
