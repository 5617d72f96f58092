"""Texts in files of the shared folder that Python tasks read again, block by block, always in the same order.

An operator that needs a text several times writes (doc_id, text) once and moves only what it found
about it: rows are named by their file and their place in it, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import frames, kernel

#: Bytes of text of a block: what a task works on at a time.
BLOCK = 8 << 20
#: Rows of a file at most.
ROWS = 1 << 15


def store(uri: str):
    """File system and path of a folder; the schemes of Hadoop's S3 connectors are read as s3."""
    from pyarrow import fs

    head, sep, rest = uri.partition(":")
    return fs.FileSystem.from_uri(("s3" if head in ("s3a", "s3n") else head) + sep + rest if sep else uri)


def write(docs: DataFrame, folder: str, first: int = 0) -> DataFrame:
    """Writes (doc_id, text) and gives (file, name): a number from ``first`` on and a name for each file."""
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.option("maxRecordsPerFile", ROWS).option("compression", "zstd").parquet(folder)
    names = docs.sparkSession.read.schema("doc_id long, text string").parquet(folder).select(F.col("_metadata.file_name").alias("name")).distinct()
    return frames.written(names.select((F.row_number().over(Window.orderBy("name")) - 1 + first).cast("int").alias("file"), "name"), "files")  # a row for each file


def blocks(folder: str, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, kernel.Texts]]:
    """Number, first row, doc_ids, mask of null doc_ids, and texts of each block of a file."""
    import pyarrow.parquet as pq

    files, root = store(folder)
    held: list[pa.RecordBatch] = []
    size = number = first = 0
    with files.open_input_file(f"{root}/{name}") as f:
        for batch in pq.ParquetFile(f).iter_batches(256, columns=["doc_id", "text"], use_threads=False):
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield number, first, *_joined(held)
                number, first, size = number + 1, first + sum(b.num_rows for b in held), 0
                held.clear()
    if held:
        yield number, first, *_joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, kernel.Texts]:
    table = pa.Table.from_batches(held)
    ids = table["doc_id"].combine_chunks()
    data, offsets = kernel.texts_of(table["text"])
    return np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), kernel.Texts(data, offsets, 0)


def with_files(files: DataFrame, side: DataFrame) -> DataFrame:
    """A partition for each file with its rows of ``side`` (which has a column file), the row that names it last."""
    count = max(1, files.count())
    mine = files.select("file", "name", *(F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema if f.name != "file"))
    theirs = side.select("file", F.lit(None).cast("string").alias("name"), *(f.name for f in side.schema if f.name != "file"))
    return mine.union(theirs).repartitionById(count, F.col("file")).sortWithinPartitions("file", F.col("name").asc_nulls_first())


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """From the rows of ``with_files``: number, name and side rows of each file."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = kernel.column(batch, "name")
        at = 0
        for i in np.flatnonzero(np.asarray(names.is_valid())).tolist():
            held.append(batch.slice(at, i - at))
            at = i + 1
            yield kernel.column(batch, "file")[i].as_py(), names[i].as_py(), pa.Table.from_batches(held, batch.schema)
            held.clear()
        held.append(batch.slice(at))
