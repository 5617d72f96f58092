"""Incremental removal of repeated word windows over a log-structured fingerprint index.

Texts come in batches. Each batch's anchors (see runs) become a sorted run that is merge-joined with
the runs before; the hits name the places, old and new, whose windows may be repeated. Those windows
are then verified: hashes of whole windows meet by anchor, and windows that occur twice or more are
removed. Windows are one if their 64-bit hash and 40 bits of their anchor's, in one bucket of anchors,
agree. A window of ``span`` words holds span - k + 1 grams of k words, so equal windows always choose
equal anchors.

An index may be opened again later, given more batches, and asked for what is kept of all of them.

Defined cases: null texts have no words; texts of fewer than ``span`` words lose none; rows that
repeat a text, with or without its doc_id, are repetitions of each other; an empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import frames, kernel, runs, text_files

U = np.uint64
SPAN, GRAM = 35, 17
#: Bytes of text whose words are sought at a time.
PART = 1 << 18
WINDOWS = (("hashes", U), ("flags", bool), ("anchors", 5), ("files", np.int32), ("rows", np.uint32), ("starts", np.uint32), ("sizes", np.uint32))
CUTS = (("rows", np.uint32), ("starts", np.uint32), ("ends", np.uint32))


def grams(texts: kernel.Texts, span: int, k: int) -> Iterator[tuple[kernel.Texts, kernel.Words, np.ndarray, tuple]]:
    """For each part of the texts: the part, its words, their hashes, and hashes, firsts, windows and anchors of its grams."""
    for part in texts.parts(PART):
        words = kernel.Words(part, kernel.NONSPACE, lower=False)
        hashes = words.hashes()
        h, _, at = kernel.grams(hashes, words.first, k)
        window, least = runs.chosen(h, at, span - k + 1)
        yield part, words, hashes, (h, at, window, least)


def anchors(span: int, k: int):
    """For runs.Index.add: blocks of a run from files."""

    def of(folder: str, buckets: int):
        @kernel.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, name, _ in text_files.each_file(batches):
                for _, first, _, _, texts in text_files.blocks(folder, name):
                    found = [(np.zeros(0, U), *(np.zeros(0, np.int64),) * 2)]
                    for part, _, _, (h, at, _, least) in grams(texts, span, k):
                        least = np.unique(least)
                        own = np.searchsorted(at, least, "right") - 1
                        found.append((h[least], first + part.first + own, least - at[own]))
                    h, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
                    if len(h):
                        yield from runs.blocks_of(h, file, row, place, buckets)

        return run

    return of


def _windows(folder: str, span: int, k: int, buckets: int):
    names, cut_names = [c for c, _ in WINDOWS], [f"cut_{c}" for c, _ in CUTS]

    def whole(rows: pa.RecordBatch, file: int) -> pa.RecordBatch:
        have, none = {c: kernel.column(rows, c) for c in rows.schema.names}, kernel.binary([b""] * rows.num_rows)
        return pa.RecordBatch.from_arrays([have["bucket"], pa.array(np.full(rows.num_rows, file, np.int32)), *(have.get(c, none) for c in (*names, *cut_names))], names=["bucket", "file", *names, *cut_names])

    def block(file: int, h: np.ndarray, anchor: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each window once, by bucket and place, as runs of windows that follow each other; the others' spans are cut already."""
        order = np.lexsort((anchor, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])))
        first = np.zeros(len(h), bool)
        first[order[new]] = True
        flag = np.zeros(len(h), bool)
        flag[order[new]] = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        bucket = runs.bucket_of(anchor[first], buckets)
        a, b, c, d = row[first], start[first], h[first], anchor[first]
        order = np.lexsort((b, a, bucket))
        bucket, a, b, c, d, f = bucket[order], a[order], b[order], c[order], d[order], flag[first][order]
        head = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1] + 1) | (d[1:] != d[:-1])))
        size = np.diff(np.append(np.flatnonzero(head), len(head)))
        one = runs.packed(bucket, "bucket", names[:2], hashes=c, flags=f)
        more = runs.packed(bucket[head], "bucket", names[2:], anchors=runs.five(d[head]), files=np.full(head.sum(), file, np.int32), rows=a[head].astype(np.uint32), starts=b[head].astype(np.uint32), sizes=size.astype(np.uint32))
        yield whole(pa.RecordBatch.from_arrays([*one.columns, *more.columns[1:]], names=["bucket", *names]), file)
        if not first.all():
            a, b, c = spans(row[~first], start[~first], span)
            yield whole(runs.packed(np.full(len(a), file % buckets), "bucket", cut_names, cut_rows=a.astype(np.uint32), cut_starts=b.astype(np.uint32), cut_ends=c.astype(np.uint32)), file)

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, name, side in text_files.each_file(batches):
            hit_row, hit_place = runs.loaded(side, ("rows", np.uint32), ("places", np.uint32))
            order = np.argsort(hit_row, kind="stable")
            hit_row, hit_place = hit_row[order], hit_place[order]
            for _, row, _, _, texts in text_files.blocks(folder, name):
                found = []
                for part, words, hashes, (h, at, window, least) in grams(texts, span, k):
                    mine = slice(*np.searchsorted(hit_row, [row + part.first, row + part.first + part.n]))
                    if mine.start == mine.stop:
                        continue
                    wanted = np.zeros(len(h), bool)
                    wanted[at[hit_row[mine].astype(np.int64) - row - part.first] + hit_place[mine]] = True
                    take = wanted[least]
                    window, least = window[take], least[take]
                    own = np.searchsorted(at, window, "right") - 1
                    start = window - at[own]
                    found.append((kernel.gram_hash(hashes, span)[words.first[own] + start], h[least], row + part.first + own, start))
                if found:
                    yield from block(file, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def spans(row: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row as one span of their text."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    head = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1))) if len(row) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(head)[1:], len(row)) - 1 if len(row) else np.zeros(0, np.int64)
    return row[head], start[head], start[last] + span


def _repeated(span: int):
    """Spans of the windows of one bucket that occur more than once."""

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        batches.clear()
        names = [c for c, _ in CUTS]
        is_cut = np.array([len(x.as_buffer()) > 0 for chunk in rows["cut_rows"].chunks for x in chunk], bool)
        if is_cut.any():
            yield from rows.filter(pa.array(is_cut)).select(["file", *(f"cut_{c}" for c in names)]).rename_columns(["file", *names]).to_batches()
        h, flag, anchor, file, row, start, size = runs.loaded(rows, *WINDOWS)
        del rows
        if not len(h):
            return
        start, size = start.astype(np.int64), size.astype(np.int64)
        of_run = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((anchor[of_run], h))
        same = (h[order][1:] == h[order][:-1]) & (anchor[of_run[order]][1:] == anchor[of_run[order]][:-1])
        twin = flag.copy()
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(h))
        key = file[of_run].astype(np.int64) << 32 | row[of_run]
        a, b, c = spans(key[twin], at[twin], span)
        if len(a):
            yield runs.packed(a >> 32, "file", names, rows=(a & 0xFFFFFFFF).astype(np.uint32), starts=b.astype(np.uint32), ends=c.astype(np.uint32))

    return run


def _kept(folder: str, with_text: bool):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, side in text_files.each_file(batches):
            row, a, b = runs.loaded(side, *CUTS)
            order = np.argsort(row, kind="stable")
            row, a, b = row[order].astype(np.int64), a[order].astype(np.int64), b[order].astype(np.int64)
            for _, first, ids, null, texts in text_files.blocks(folder, name):
                for part in texts.parts(1 << 20):
                    words = kernel.Words(part, kernel.NONSPACE, lower=False)
                    base = first + part.first
                    mine = slice(*np.searchsorted(row, [base, base + part.n]))
                    step = np.zeros(len(words.starts) + 1, np.int32)
                    np.add.at(step, words.first[row[mine] - base] + a[mine], 1)
                    np.add.at(step, words.first[row[mine] - base] + b[mine], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    total = np.concatenate(([0], np.cumsum(gone)))
                    kept = joined_words(words, ~gone)
                    own = slice(part.first, part.first + part.n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own], mask=null[own]), pa.array(words.counts), pa.array(total[words.first[1:]] - total[words.first[:-1]]), pa.array([x.decode("utf-8", "replace") if with_text else hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept"],
                    )

    return run


def joined_words(words: kernel.Words, keep: np.ndarray) -> Iterator[bytes]:
    """For each text its kept words, joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    size = ends - starts + 1
    to = np.cumsum(size)
    out = np.full(to[-1] if len(to) else 0, 0x20, np.uint8)
    inner = np.arange(len(out)) - np.repeat(to - size, size)
    out = np.where(inner < np.repeat(size - 1, size), words.texts.data[np.minimum(inner + np.repeat(starts, size), len(words.texts.data) - 1)], out) if len(out) else out
    edge = np.concatenate(([0], to))[np.searchsorted(starts, words.texts.offsets)]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield out[a : max(a, b - 1)].tobytes()


def kept(index: runs.Index, span: int = SPAN, k: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every text of the index, judged on all of them."""
    names = ", ".join(f"{c} binary" for c in (*(c for c, _ in WINDOWS), *(f"cut_{c}" for c, _ in CUTS)))
    files = index.files()
    windows = text_files.with_files(files, index.hits()).mapInArrow(_windows(index.folder, span, k, index.buckets), f"bucket int, file int, {names}")
    cuts = frames.by_bucket(windows, index.buckets, _repeated(span), "file int, " + ", ".join(f"{c} binary" for c, _ in CUTS), "cuts")
    cuts = frames.written(cuts, "cuts")
    return text_files.with_files(files, cuts).mapInArrow(_kept(index.folder, with_text), "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(batches: list[DataFrame], span: int = SPAN, k: int = GRAM, with_text: bool = False, bucket_bytes: int = 8 << 20, folder: str | None = None, fanout: int = 4) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of (doc_id, text) of all batches, and of those the folder's index has already.

    Batches are taken in one after the other; kept is the kept words joined by one space, or without
    with_text the SHA-256 of that. Windows are judged on all of the input.
    """
    spark = batches[0].sparkSession
    buckets = max(64, sum(frames.buckets_for(b, bucket_bytes, 1) for b in batches))
    index = runs.Index(spark, folder or frames.scratch(spark, "index"), buckets, fanout)
    for b in batches:
        index.add(b, anchors(span, k))
    return kept(index, span, k, with_text)
