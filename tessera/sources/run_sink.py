"""Run folders as a data source: a run's artifacts, and a manifest that appears when all of them are there.

A run's rows are written by one task: each artifact to a file of this attempt's own name, then the manifest, in one
step, under a name that all attempts share. Whoever reads goes by manifests, so files of a task that died, was repeated or ran
twice at once are never seen, and no half run is. Nothing but a count of runs passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources import artifacts, folders, saved_files

#: The ten artifacts of a run.
KINDS = ["summary", "timeline", "user_messages", "spans", "rehydrated", "state", "manifest", "handoff", "after_transcript", "result"]
MANIFEST = "run-manifest.json"
ENTRY = "kind string, file string, sha256 string, bytes long, authority string, retention string, exposure string, redaction string"


class Written(WriterCommitMessage):
    def __init__(self, runs: int, incomplete: int):
        self.runs, self.incomplete = runs, incomplete


class RunWriter(DataSourceWriter):
    """Writes rows (run_id, kind, content) that stand together by run."""

    def __init__(self, folder: str, kinds: list[str]):
        self.folder, self.kinds = folder, kinds

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = folders.store(self.folder)
        attempt, now, held, counts = uuid.uuid4().hex, None, [], [0, 0]

        def finish() -> None:
            if now is None:
                return
            whole = set(self.kinds) <= {e["kind"] for e in held}
            counts[0 if whole else 1] += 1
            if whole:
                saved_files.put(store, f"{root}/{now}", MANIFEST, json.dumps({"run_id": now, "artifacts": held}).encode(), attempt)

        for row in iterator:
            if row.run_id != now:
                finish()
                now, held = row.run_id, []
                saved_files.named(now)
                store.create_dir(f"{root}/{now}", recursive=True)
            data, name = (row.content or "").encode(), f"{saved_files.named(row.kind)}-{attempt}"
            with store.open_output_stream(f"{root}/{now}/{name}") as out:
                out.write(data)
            policy = dict(zip(("authority", "retention", "exposure", "redaction"), artifacts.POLICIES.get(row.kind, artifacts.DEFAULT_POLICY), strict=True))
            held.append({"kind": row.kind, "file": name, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)} | policy)
        finish()
        return Written(*counts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = folders.store(self.folder)
        done = [m for m in messages if m is not None]
        total = {"runs": sum(m.runs for m in done), "incomplete": sum(m.incomplete for m in done)}
        store.create_dir(root, recursive=True)
        saved_files.put(store, root, f"commit-{uuid.uuid4().hex}.json", json.dumps(total).encode(), "commit")

    def abort(self, messages: list[Written | None]) -> None:
        """Whole runs stay; files that no manifest names are left for ``unnamed``."""


class RunArtifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_artifacts"

    def schema(self) -> str:
        return "run_id string, kind string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        return RunWriter(self.options["path"], json.loads(self.options["kinds"]))


def write_runs(df: DataFrame, folder: str, kinds: list[str] = KINDS) -> None:
    """Writes artifacts (run_id, kind, content) of whole runs; a run that lacks one of ``kinds`` gets no manifest.

    A run that is written again has its manifest replaced.
    """
    df.sparkSession.dataSource.register(RunArtifacts)
    rows = df.select(F.col("run_id").cast("string").alias("run_id"), "kind", "content").where("run_id IS NOT NULL AND kind IS NOT NULL")
    dealt = folders.dealt(rows, "run_id").sortWithinPartitions("run_id", "kind")
    dealt.write.format("run_artifacts").option("kinds", json.dumps(kinds)).mode("append").save(folder)


def _names(folder: str):
    """Folders of runs, listed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, root = folders.store(folder)
            found = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith((".", "_"))]
            yield pa.RecordBatch.from_pydict({"run_id": pa.array(found, pa.string())})

    return run


def _entries(folder: str, whole: bool, schema: pa.Schema):
    """What the manifests of runs list, with the files' bytes if whole; some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folders.store(folder)
        rows, size = [], 0
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            try:
                told = json.loads(saved_files.content(store, f"{root}/{name}/{MANIFEST}") or b"{}")
            except ValueError:
                continue
            for entry in told.get("artifacts") or []:
                row = {"run_id": told.get("run_id")} | entry
                if whole:
                    row["content"] = None if "/" in row["file"] else saved_files.content(store, f"{root}/{row['run_id']}/{row['file']}")
                    size += len(row["content"] or b"")
                rows.append(row)
            if size > saved_files.BATCH_BYTES or len(rows) > saved_files.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _listed(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    """Tasks open manifests and files by name, so that no list of files passes through the driver."""
    schema = f"run_id string, {ENTRY}" + (", content binary" if whole else "")
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(n, types[kind]) for n, kind in (x.split() for x in schema.split(", "))])
    names = spark.range(0, 1, 1, 1).mapInArrow(_names(folder), "run_id string")
    return folders.dealt(names, "run_id").mapInArrow(_entries(folder, whole, fields), schema)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, kind, file, sha256, bytes, policies) of all whole runs."""
    return _listed(spark, folder, whole=False)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*-*").load(f"{folder}/*")
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("file"), "content").where(F.col("file").rlike("-[0-9a-f]{32}$"))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, kind, content, sound) of all whole runs; sound: the file's bytes are those that the manifest tells of."""
    found = _listed(spark, folder, whole=True)
    return found.select("run_id", "kind", F.col("content").cast("string").alias("content"), F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("sound"))


def unnamed(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, file): what no manifest names, left by attempts that came to nothing."""
    return _files(spark, folder).drop("content").join(read_manifests(spark, folder), ["run_id", "file"], "left_anti")
