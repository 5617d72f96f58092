"""A log-structured index of window fingerprints, in blocks of a bucket each.

A fingerprint (anchor) is a chosen gram of k items; every window of ``span`` items holds the window's
least gram, so equal windows choose equal anchors at equal places. A run is an immutable table with,
for each bucket of anchor hashes, blocks of sorted hashes with the places they come from: file, row
and first item. A new batch becomes a run of its own and is merge-joined, bucket by bucket, with the
runs there are; anchors that occur more than once give hits on both sides. Runs are sorted, so the
stable sort that brings them together only merges them. When there are ``fanout`` runs, they are
compacted to one. A manifest, written last, lists batches, runs and hits; whoever opens the folder
goes on from the latest one, and what a job left without a manifest is never read.

An anchor that a block of one task holds several times goes to its bucket once, with a flag; its
other places are known to be repeated already and pass through buckets of their own files. So an
anchor of many documents costs its bucket one entry a block, not one a document.

Anchors are named by 40 bits within their bucket; what two have in common by chance is one more place
to verify. All work of a bucket is on numpy arrays; the number of buckets is set when an index begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import frames, kernel, text_files

U = np.uint64
KINDS = (("hashes", 5), ("files", np.int32), ("rows", np.uint32), ("places", np.uint32), ("flags", bool), ("known_files", np.int32), ("known_rows", np.uint32), ("known_places", np.uint32))
NAMES = [c for c, _ in KINDS]
RUN = "bucket int, " + ", ".join(f"{c} binary" for c in NAMES)
HITS = "file int, rows binary, places binary"
MANIFEST = "version int, kind string, number int, path string, buckets int"
LOW = U((1 << 40) - 1)


def chosen(h: np.ndarray, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w grams inside one text (numbered by its first gram): the position of its least gram.

    h: gram hashes; at: first gram of each text. Gives window numbers and positions, both ascending.
    """
    least = kernel.sliding_least(h, w)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    window = np.flatnonzero(own[: len(least)] == own[w - 1 :]) if len(least) else np.zeros(0, np.int64)
    return window, least[window]


def packed(number: np.ndarray, name: str, schema: list[str], **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each number that occurs, with the bytes of its rows' columns; columns of the schema not given are empty."""
    order = np.argsort(number, kind="stable")
    number = number[order]
    names = np.unique(number)
    edges = np.append(np.searchsorted(number, names), len(number)).tolist()
    out = [pa.array(names.astype(np.int32))]
    for c in schema:
        if c in columns:
            x = columns[c][order]
            out.append(kernel.binary([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]))
        else:
            out.append(kernel.binary([b""] * len(names)))
    return pa.RecordBatch.from_arrays(out, names=[name, *schema])


class Buffer:
    """Collects arrays and gives them back joined once there are many rows."""

    def __init__(self, rows: int = 1 << 20):
        self.limit, self.parts, self.rows = rows, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])
        return self.rows >= self.limit

    def take(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.rows = [], 0
        return out


def five(x: np.ndarray) -> np.ndarray:
    """The low 40 bits, five bytes a row."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def loaded(rows: pa.Table, *kinds: tuple) -> list[np.ndarray]:
    """Columns of packed bytes as arrays; kind 5: of 40-bit numbers."""
    out = []
    for c, kind in kinds:
        raw = np.frombuffer(b"".join(x.as_buffer() for chunk in rows.column(c).chunks for x in chunk), np.uint8 if kind == 5 else kind)
        if kind == 5:
            wide = np.zeros((len(raw) // 5, 8), np.uint8)
            wide[:, :5] = raw.reshape(-1, 5)
            raw = wide.reshape(-1).view(U)
        out.append(raw)
    return out


def blocks_of(h: np.ndarray, file: int, row: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a run from one block of a file: each hash once, sorted by bucket, the other places apart."""
    order = np.argsort(h, kind="stable")
    h, row, place = h[order], row[order].astype(np.uint32), place[order].astype(np.uint32)
    first = np.concatenate(([True], h[1:] != h[:-1]))
    flag = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
    n, m = int(first.sum()), int((~first).sum())
    yield packed(bucket_of(h[first], buckets), "bucket", NAMES, hashes=five(h[first]), files=np.full(n, file, np.int32), rows=row[first], places=place[first], flags=flag)
    if m:
        yield packed(np.full(m, file % buckets), "bucket", NAMES, known_files=np.full(m, file, np.int32), known_rows=row[~first], known_places=place[~first])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(16)) % U(buckets)).astype(np.int64)


@kernel.released
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of one bucket; ``new`` tells the batch's blocks from those of earlier runs."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    batches.clear()
    is_new = np.asarray(rows["new"])
    h, *place, flag, known_file, known_row, known_place = loaded(rows.filter(pa.array(is_new)), *KINDS)
    old, *old_place = loaded(rows.filter(pa.array(~is_new)), *KINDS[:4])
    del rows
    order = np.argsort(h, kind="stable")
    h, place, twin = h[order], [x[order] for x in place], flag[order].copy()
    if len(h):
        same = h[1:] == h[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    out = []
    if len(old) and len(h):
        order = np.argsort(old, kind="stable")
        old, old_place = old[order], [x[order] for x in old_place]
        twin |= old[np.minimum(np.searchsorted(old, h), len(old) - 1)] == h
        seen = h[np.minimum(np.searchsorted(h, old), len(h) - 1)] == old
        out.append([x[seen] for x in old_place])
    file, row, place = (np.concatenate(x) for x in zip(*out, [x[twin] for x in place], [known_file, known_row, known_place], strict=True))
    if len(file):
        yield packed(file, "file", ["rows", "places"], rows=row, places=place)


@kernel.released
def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each hash of a bucket, flagged if it had several."""
    if not (got := [b for b in batches if b.num_rows]):
        return
    rows = pa.Table.from_batches(got)
    h, file, row, place, flag, *_ = loaded(rows, *KINDS)
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, file, row, place, flag = h[order], file[order], row[order], place[order], flag[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    many = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
    yield packed(np.full(first.sum(), rows["bucket"][0].as_py()), "bucket", NAMES, hashes=five(h[first]), files=file[first], rows=row[first], places=place[first], flags=many | flag[first])


class Index:
    """Batches of texts, runs and hits in a shared folder; each is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        self.version, self.entries, self.buckets = 0, [], buckets
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            manifest = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            self.version = manifest.agg(F.max("version")).first()[0]
            rows = manifest.where(F.col("version") == self.version).collect()  # a row for each batch and run
            self.entries = sorted((r.kind, r.number, r.path) for r in rows)
            self.buckets = rows[0].buckets

    def paths(self, kind: str) -> list[str]:
        return [f"{self.folder}/{p}" for k, _, p in self.entries if k == kind]

    def _next(self) -> int:
        return max((n for _, n, _ in self.entries), default=-1) + 1

    def _save(self, entries: list[tuple[str, int, str]]) -> None:
        self.entries, self.version = sorted(entries), self.version + 1
        rows = self.spark.createDataFrame([(self.version, *e, self.buckets) for e in self.entries], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def files(self) -> DataFrame:
        """(file, name) of all batches, names from the index's folder on."""
        return self.spark.read.schema("file int, name string").parquet(*self.paths("files"))

    def hits(self) -> DataFrame:
        return self.spark.read.schema(HITS).parquet(*self.paths("hits"))

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])
        return self.rows >= self.limit

    def take(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.rows = [], 0
        return out


def five(x: np.ndarray) -> np.ndarray:
    """The low 40 bits, five bytes a row."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def loaded(rows: pa.Table, *kinds: tuple) -> list[np.ndarray]:
    """Columns of packed bytes as arrays; kind 5: of 40-bit numbers."""
    out = []
    for c, kind in kinds:
        raw = np.frombuffer(b"".join(x.as_buffer() for chunk in rows.column(c).chunks for x in chunk), np.uint8 if kind == 5 else kind)
        if kind == 5:
            wide = np.zeros((len(raw) // 5, 8), np.uint8)
            wide[:, :5] = raw.reshape(-1, 5)
            raw = wide.reshape(-1).view(U)
        out.append(raw)
    return out


def blocks_of(h: np.ndarray, file: int, row: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a run from one block of a file: each hash once, sorted by bucket, the other places apart."""
    order = np.argsort(h, kind="stable")
    h, row, place = h[order], row[order].astype(np.uint32), place[order].astype(np.uint32)
    first = np.concatenate(([True], h[1:] != h[:-1]))
    flag = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
    n, m = int(first.sum()), int((~first).sum())
    yield packed(bucket_of(h[first], buckets), "bucket", NAMES, hashes=five(h[first]), files=np.full(n, file, np.int32), rows=row[first], places=place[first], flags=flag)
    if m:
        yield packed(np.full(m, file % buckets), "bucket", NAMES, known_files=np.full(m, file, np.int32), known_rows=row[~first], known_places=place[~first])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(16)) % U(buckets)).astype(np.int64)


@kernel.released
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of one bucket; ``new`` tells the batch's blocks from those of earlier runs."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    batches.clear()
    is_new = np.asarray(rows["new"])
    h, *place, flag, known_file, known_row, known_place = loaded(rows.filter(pa.array(is_new)), *KINDS)
    old, *old_place = loaded(rows.filter(pa.array(~is_new)), *KINDS[:4])
    del rows
    order = np.argsort(h, kind="stable")
    h, place, twin = h[order], [x[order] for x in place], flag[order].copy()
    if len(h):
        same = h[1:] == h[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    out = []
    if len(old) and len(h):
        order = np.argsort(old, kind="stable")
        old, old_place = old[order], [x[order] for x in old_place]
        twin |= old[np.minimum(np.searchsorted(old, h), len(old) - 1)] == h
        seen = h[np.minimum(np.searchsorted(h, old), len(h) - 1)] == old
        out.append([x[seen] for x in old_place])
    file, row, place = (np.concatenate(x) for x in zip(*out, [x[twin] for x in place], [known_file, known_row, known_place], strict=True))
    if len(file):
        yield packed(file, "file", ["rows", "places"], rows=row, places=place)


@kernel.released
def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each hash of a bucket, flagged if it had several."""
    if not (got := [b for b in batches if b.num_rows]):
        return
    rows = pa.Table.from_batches(got)
    h, file, row, place, flag, *_ = loaded(rows, *KINDS)
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, file, row, place, flag = h[order], file[order], row[order], place[order], flag[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    many = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
    yield packed(np.full(first.sum(), rows["bucket"][0].as_py()), "bucket", NAMES, hashes=five(h[first]), files=file[first], rows=row[first], places=place[first], flags=many | flag[first])


class Index:
    """Batches of texts, runs and hits in a shared folder; each is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        self.version, self.entries, self.buckets = 0, [], buckets
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            manifest = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            self.version = manifest.agg(F.max("version")).first()[0]
            rows = manifest.where(F.col("version") == self.version).collect()  # a row for each batch and run
            self.entries = sorted((r.kind, r.number, r.path) for r in rows)
            self.buckets = rows[0].buckets

    def paths(self, kind: str) -> list[str]:
        return [f"{self.folder}/{p}" for k, _, p in self.entries if k == kind]

    def _next(self) -> int:
        return max((n for _, n, _ in self.entries), default=-1) + 1

    def _save(self, entries: list[tuple[str, int, str]]) -> None:
        self.entries, self.version = sorted(entries), self.version + 1
        rows = self.spark.createDataFrame([(self.version, *e, self.buckets) for e in self.entries], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def files(self) -> DataFrame:
        """(file, name) of all batches, names from the index's folder on."""
        return self.spark.read.schema("file int, name string").parquet(*self.paths("files"))

    def hits(self) -> DataFrame:
        return self.spark.read.schema(HITS).parquet(*self.paths("hits"))

    def _by_bucket(self, blocks: DataFrame) -> DataFrame:
        return blocks.repartitionById(self.buckets, F.col("bucket"))

    def add(self, docs: DataFrame, anchors) -> None:
        """Takes in a batch of (doc_id, text); anchors(folder, buckets) gives the function that turns files into blocks."""
        n, first = self._next(), self.files().count() if self.entries else 0
        name = f"batch-{n:05d}-{uuid.uuid4().hex[:8]}"
        listed = text_files.write(docs, f"{self.folder}/{name}", first)
        listed.select("file", F.concat(F.lit(f"{name}/"), "name").alias("name")).write.parquet(f"{self.folder}/files-{name}")
        frames.drop(listed)
        mine = self.spark.read.schema("file int, name string").parquet(f"{self.folder}/files-{name}")
        made = text_files.with_files(mine, self.spark.createDataFrame([], "file int")).mapInArrow(anchors(self.folder, self.buckets), RUN)
        made.write.parquet(f"{self.folder}/run-{name}")
        read = lambda *paths: self.spark.read.schema(RUN).parquet(*paths)
        new = read(f"{self.folder}/run-{name}").withColumn("new", F.lit(True))
        if old := self.paths("run"):
            new = new.union(read(*old).withColumn("new", F.lit(False)))
        frames.by_bucket(new, self.buckets, _merge, HITS, "hits").write.parquet(f"{self.folder}/hits-{name}")
        self._save([*self.entries, ("files", n, f"files-{name}"), ("run", n, f"run-{name}"), ("hits", n, f"hits-{name}")])
        if len(self.paths("run")) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """One run with an entry for each anchor in place of all; then the old folders are deleted.

        Places of repeated anchors have given their hits; one of them stays for batches to come.
        """
        old, name = self.paths("run"), f"run-compacted-{uuid.uuid4().hex[:8]}"
        runs = self.spark.read.schema(RUN).parquet(*old)
        frames.by_bucket(runs, self.buckets, _compacted, RUN, "run").write.parquet(f"{self.folder}/{name}")
        self._save([*(e for e in self.entries if e[0] != "run"), ("run", self._next() - 1, name)])
        for path in old:
            frames.delete(self.spark, path)
