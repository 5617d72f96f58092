"""Whole files in folders of runs, written and read by tasks that open them by name: no list of files passes through the driver."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources import folders

#: Bytes and rows of a batch that a task reads before it passes them on, more by one file or run at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
_PARTS = re.compile(r"\\.|\[[^]]+\]|[*?{},]|[^\\*?{},\[]+|.", re.S)


def named(x: str) -> str:
    """x, if it can be a file's name."""
    if not x or "/" in x or x.startswith((".", "_")):
        raise ValueError(f"{x!r} is no name of a run or an artifact")
    return x


def put(store, folder: str, name: str, data: bytes, attempt: str) -> None:
    """Writes a file that is there whole or not at all; until then its name is a hidden one."""
    with store.open_output_stream(f"{folder}/.{name}.{attempt}") as out:
        out.write(data)
    store.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")


def content(store, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path) as file:
            return file.read()
    except FileNotFoundError:
        return None


class FileWriter(DataSourceWriter):
    """Writes rows (run_id, kind, content), a file each; a task that is repeated puts the same files in place again."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = folders.store(self.folder)
        attempt, now = uuid.uuid4().hex, None
        for row in iterator:
            if row.run_id != now:
                now = named(row.run_id)
                store.create_dir(f"{root}/{now}", recursive=True)
            put(store, f"{root}/{now}", named(row.kind), (row.content or "").encode(), attempt)
        return WriterCommitMessage()


class SavedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_files"

    def schema(self) -> str:
        return "run_id string, kind string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(df: DataFrame, folder: str) -> None:
    """Writes (run_id, kind, content) as files <folder>/<run_id>/<kind>, dealt to all tasks."""
    df.sparkSession.dataSource.register(SavedFiles)
    rows = df.select(F.col("run_id").cast("string").alias("run_id"), "kind", "content").where("run_id IS NOT NULL AND kind IS NOT NULL")
    folders.dealt(rows, "run_id").sortWithinPartitions("run_id").write.format("saved_files").mode("append").save(folder)


def _level(glob: str) -> re.Pattern:
    """A pattern of Hadoop's for one name: *, ?, [a-z], [^a-z], {one,other}, and a backslash before what stands for itself."""
    depth, out = 0, []
    for x in _PARTS.findall(glob):
        if x[0] == "[" and len(x) > 2:
            out.append("[" + ("^" if x[1] in "^!" else "") + re.sub(r"([\\\[&~|])", r"\\\1", x[1:-1].lstrip("^!")) + "]")
            continue
        depth += (x == "{") - (x == "}" and depth > 0)
        made = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(x)
        out.append(made or re.escape(x[1:] if x[0] == "\\" else x))
    return re.compile("".join(out), re.S)


def _split(pattern: str) -> tuple[str, list[str]]:
    """The folder before the first name that is a pattern, and the names from there."""
    steps = pattern.rstrip("/").split("/")
    first = next((i for i, x in enumerate(steps) if re.search(r"[*?\[{]", x)), None)
    if first is not None:
        return "/".join(steps[:first]) or ("/" if pattern.startswith("/") else "."), steps[first:]
    store, path = folders.store(pattern.rstrip("/"))
    if store.get_file_info(path).type == fs.FileType.Directory:
        return pattern.rstrip("/"), []
    return "/".join(steps[:-1]) or ".", [re.sub(r"([\\,}])", r"\\\1", steps[-1])]


def _hidden(name: str) -> bool:
    """As Spark has it: such files aren't read, what ``put`` has begun among them, nor such folders but where a pattern matches them."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _matched(store, folder: str, levels: list[str]) -> Iterator[fs.FileInfo]:
    """Files and folders below a folder whose names match one level after another."""
    name = _level(levels[0])
    for info in store.get_file_info(fs.FileSelector(folder)):
        if name.fullmatch(info.base_name):
            if info.type == fs.FileType.Directory and len(levels) > 1:
                yield from _matched(store, info.path, levels[1:])
            elif len(levels) == 1 and (info.type == fs.FileType.Directory or not _hidden(info.base_name)):
                yield info


def _below(store, folder: str) -> Iterator[str]:
    """Files in a folder at any depth, without hidden names."""
    for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
        if info.type == fs.FileType.File and not any(map(_hidden, info.path[len(folder) :].split("/"))):
            yield info.path


def _first(folder: str, level: str | None):
    """Names of the first level, listed by one task; all that aren't hidden, where it is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, root = folders.store(folder)
            infos = _matched(store, root, [level]) if level else (i for i in store.get_file_info(fs.FileSelector(root)) if not _hidden(i.base_name))
            found = [(i.path, i.type == fs.FileType.Directory) for i in infos]
            if level and not found:
                raise FileNotFoundError(f"nothing in {folder} is named {level}")
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in found], pa.string()), "folder": pa.array([f for _, f in found], pa.bool_())})

    return run


def _opened(folder: str, levels: list[str]):
    """Files with their bytes, of names of the first level; some megabytes at a time."""

    def files(store, path: str, is_folder: bool) -> Iterator[str]:
        if not is_folder:
            yield from [] if levels else [path]
            return
        for at, inside in [(i.path, i.type == fs.FileType.Directory) for i in _matched(store, path, levels)] if levels else [(path, True)]:
            yield from _below(store, at) if inside else [at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = folders.store(folder)
        paths, texts, size = [], [], 0
        made = lambda: pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(texts, pa.binary())})
        for row in (x for batch in batches for x in batch.to_pylist()):
            for path in files(store, row["path"], row["folder"]):
                data = content(store, path)
                if data:
                    paths.append(path)
                    texts.append(data)
                    size += len(data)
                if size > BATCH_BYTES or len(paths) > BATCH_ROWS:
                    yield made()
                    paths, texts, size = [], [], 0
        if paths:
            yield made()

    return run


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of whole files, as bytes; a file without a byte gives no row.

    The pattern names files, or folders with files at any depth; its braces hold no slash. One task lists its first level that isn't a plain name, and the
    others list what is below and open the files.
    """
    root, levels = _split(pattern)
    found = spark.range(0, 1, 1, 1).mapInArrow(_first(root, levels[0] if levels else None), "path string, folder boolean")
    return folders.dealt(found, "path").mapInArrow(_opened(root, levels[1:]), "path string, content binary")
