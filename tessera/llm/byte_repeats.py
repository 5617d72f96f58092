"""Removal of byte strings that start in an earlier document, decided by suffix arrays.

A string of ``span`` bytes holds its least gram of k bytes, its anchor, at the same place wherever it
stands. Four steps:

1. Texts are written once (text_files). Each block's distinct anchors go, sorted, to buckets by hash,
   and a bit for each comes back: does it stand anywhere else?
2. For those that do, the bytes of all strings they are the anchor of, a context, go to the anchor's
   bucket. Contexts with the same bytes in one block go once, from their least doc_id; those of greater
   doc_ids are cut by it already.
3. In a bucket, contexts are shortened to the strings that more than one document may hold (by hash,
   which loses none), equal ones become one (by their bytes), and those of one anchor are joined to one
   string. Its suffix array, built by linear grouping (suffix_groups), brings equal strings side by
   side; the least doc_id among them decides for each string of each document. So every cut between
   blocks is decided by a suffix array. An anchor with so many contexts that its string would be
   longer than LONGEST is worked off by classes of its strings' hashes, in which equal strings meet.
4. Cuts go back to their files.

No bucket needs more than its own contexts, and no string is compared with all others.

Defined cases: null texts are empty; texts of fewer than ``span`` bytes lose none; rows with equal
doc_id remove nothing from each other; a null doc_id is neither smaller nor larger than any; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import frames, kernel, runs, text_files
from tessera.llm.suffix_groups import suffix_arrays

U = np.uint64
SPAN, GRAM = 50, 24
#: Symbols of one batch of strings, and of one string at most.
BATCH, LONGEST = 1 << 17, 1 << 9
#: Bytes of text whose anchors are sought at a time.
PART = 1 << 16
CONTEXTS = (("anchors", 5), ("files", np.int32), ("rows", np.uint32), ("docs", np.int64), ("places", np.uint32), ("sizes", np.uint16), ("bytes", np.uint8))
CUTS = (("rows", np.uint32), ("starts", np.uint32), ("ends", np.uint32))


def anchors(texts: kernel.Texts, usable: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of the usable texts, in order: hash, text, first byte of its first string in the text, number of its strings."""
    found = [(np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)]
    for part in texts.parts(PART):
        many = np.where(usable[part.first : part.first + part.n], np.maximum(np.diff(part.offsets) - k + 1, 0), 0)
        at = np.concatenate(([0], np.cumsum(many)))
        h = kernel.byte_grams(part.data, k)
        if at[-1] != len(h):
            h = h[flat(part.offsets[:-1], many)]
        window, least = runs.chosen(h, at, span - k + 1)
        if len(least):
            head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            own = np.searchsorted(at, window[head], "right") - 1
            found.append((h[least[head]], own + part.first, window[head] - at[own], np.diff(np.append(head, len(least)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted(h: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by bucket: bucket and hash of each, which of them each hash is, whether documents of several ids have it."""
    order = np.argsort(h)
    order = order[np.argsort(runs.bucket_of(h[order], buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    x = h[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    first = np.flatnonzero(new)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    several = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
    return runs.bucket_of(x[first], buckets), x[first], which, several


def _edges(sorted_numbers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    names, first = np.unique(sorted_numbers, return_index=True)
    return names, np.append(first, len(sorted_numbers)).tolist()


def _asked(folder: str, span: int, k: int, buckets: int):
    """Rows of a bucket each: distinct anchors of one block, and which of them several of its documents have."""

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, name, _ in text_files.each_file(batches):
            for number, _, ids, null, texts in text_files.blocks(folder, name):
                h, own, *_ = anchors(texts, ~null, span, k)
                if not len(h):
                    continue
                bucket, low, _, several = _sorted(h, ids[own], buckets)
                names, edge = _edges(bucket)
                low = runs.five(low)
                ends = list(zip(edge[:-1], edge[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), file, np.int32)), pa.array(np.full(len(names), number, np.int32)), kernel.binary([low[a:b].tobytes() for a, b in ends]), kernel.binary([np.packbits(several[a:b]).tobytes() for a, b in ends])],
                    names=["bucket", "file", "block", "hashes", "several"],
                )

    return run


ASKED = "bucket int, file int, block int, hashes binary, several binary"
TOLD = "file int, block int, bucket int, shared binary"


@kernel.released
def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a bucket a bit for each anchor: it stands elsewhere too."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    batches.clear()
    (h,) = runs.loaded(rows, ("hashes", 5))
    size = np.array([len(x.as_buffer()) // 5 for chunk in rows["hashes"].chunks for x in chunk])
    shared = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip((x for chunk in rows["several"].chunks for x in chunk), size.tolist(), strict=True)]).astype(bool)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    to = np.cumsum(size)
    some = np.flatnonzero(np.logical_or.reduceat(shared, to - size))
    yield pa.RecordBatch.from_arrays(
        [*(rows[c].combine_chunks().take(pa.array(some)) for c in ("file", "block", "bucket")), kernel.binary([np.packbits(shared[to[i] - size[i] : to[i]]).tobytes() for i in some.tolist()])],
        names=["file", "block", "bucket", "shared"],
    )


def flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... up to size[0] numbers, then those of begin[1], and so on."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which string each of data[begin:begin + size] is among those of its group, and an example of each; strings are one if all bytes agree."""
    key = kernel.fold(kernel.bytes_hash(data, begin, begin + size), group.astype(U))
    _, one, number = np.unique(key, return_index=True, return_inverse=True)
    like = one[number]
    other = np.flatnonzero(like != np.arange(len(key)))
    equal = (size[other] == size[like[other]]) & (group[other] == group[like[other]])
    for a in range(0, len(other), 1 << 14):
        at = slice(a, a + (1 << 14))
        mine, n = other[at], np.where(equal[at], size[other[at]], 0)
        differ = data[flat(begin[mine], n)] != data[flat(begin[like[mine]], n)]
        bad = np.repeat(np.arange(len(mine)), n)[differ]
        equal[a + bad] = False
    strange = other[~equal]  # an equal hash of other bytes: a string of its own
    number[strange] = len(one) + np.arange(len(strange))
    return number, np.concatenate((one, strange))


def cuts_of(number: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that start in a row in one text as one cut: text, first byte, end. Texts and starts ascend."""
    if not len(number):
        return (np.zeros(0, np.int64),) * 3
    head = np.concatenate(([True], (number[1:] != number[:-1]) | (start[1:] > start[:-1] + 1)))
    last = np.append(np.flatnonzero(head)[1:], len(number)) - 1
    return number[head], start[head], start[last] + span


def _contexts(folder: str, span: int, k: int, buckets: int):
    names = [c for c, _ in CONTEXTS]
    cut_names = [f"cut_{c}" for c, _ in CUTS]

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, name, side in text_files.each_file(batches):
            told = {}
            for block, bucket, bits in zip(*(side[c].to_numpy() for c in ("block", "bucket")), side["shared"].to_pylist(), strict=True):
                told.setdefault(int(block), {})[int(bucket)] = bits
            for number, row, ids, null, texts in text_files.blocks(folder, name):
                if number not in told:
                    continue
                h, own, start, many = anchors(texts, ~null, span, k)
                bucket, _, which, _ = _sorted(h, ids[own], buckets)
                shared = np.zeros(len(bucket), bool)
                of_bucket, edge = _edges(bucket)
                for b, i, j in zip(of_bucket.tolist(), edge[:-1], edge[1:], strict=True):
                    if bits := told[number].get(b):
                        shared[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
                take = shared[which]
                h, own, start, many = h[take], own[take], start[take], many[take]
                begin, size, doc = texts.offsets[own] + start, many + span - 1, ids[own]
                string, one = distinct(texts.data, begin, size, h.view(np.int64))
                least = least_of(doc, string, len(one))
                later = doc > least[string]
                n, a, b = cuts_of(np.repeat(own[later], many[later]), flat(start[later], many[later]), span)
                if len(n):
                    rows = runs.packed(np.full(len(n), file % buckets), "bucket", cut_names, cut_rows=(row + n).astype(np.uint32), cut_starts=a.astype(np.uint32), cut_ends=b.astype(np.uint32))
                    yield _row(rows, file)
                stay = np.flatnonzero(~later)
                bucket = runs.bucket_of(h[stay], buckets)
                order = np.argsort(bucket, kind="stable")
                stay, bucket = stay[order], bucket[order]
                rows = runs.packed(bucket, "bucket", names[:-1], anchors=runs.five(h[stay]), files=np.full(len(stay), file, np.int32), rows=(row + own[stay]).astype(np.uint32), docs=doc[stay], places=start[stay].astype(np.uint32), sizes=size[stay].astype(np.uint16))
                data = texts.data[flat(begin[stay], size[stay])]
                edge = np.concatenate(([0], np.cumsum(size[stay])))[_edges(bucket)[1]].tolist()
                yield _row(pa.RecordBatch.from_arrays([*rows.columns, kernel.binary([data[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])], names=[*rows.schema.names, "bytes"]), file)

    def _row(rows: pa.RecordBatch, file: int) -> pa.RecordBatch:
        have = {c: kernel.column(rows, c) for c in rows.schema.names}
        none = kernel.binary([b""] * rows.num_rows)
        return pa.RecordBatch.from_arrays([have["bucket"], pa.array(np.full(rows.num_rows, file, np.int32)), *(have.get(c, none) for c in (*names, *cut_names))], names=["bucket", "file", *names, *cut_names])

    return run


def least_of(value: np.ndarray, number: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(out, number, value)
    return out


def greatest_of(value: np.ndarray, number: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.iinfo(np.int64).min)
    np.maximum.at(out, number, value)
    return out


def least_docs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, string: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each window of span bytes of the pieces data[begin:begin + size], piece by piece: the least doc of equal windows of the same string.

    string: a number for each piece that doesn't fall; pieces of one number are joined to one string.
    """
    many = size + 1
    total = np.cumsum(many)
    at = total - many
    symbols = np.ones(total[-1], np.int16)  # what ends a piece
    symbols[flat(at, size)] = data[flat(begin, size)].astype(np.int16) + 2
    last = np.flatnonzero(np.append(string[1:] != string[:-1], True))
    symbols[total[last] - 1] = 0  # what ends a string
    order = suffix_arrays(symbols, np.concatenate(([0], total[last])))
    piece = np.repeat(np.arange(len(size)), many)[order]
    start = order - at[piece]
    window = start <= size[piece] - span
    piece, start = piece[window], start[window]
    place = begin[piece] + start
    # Neighbours of the suffix array, eight bytes at a time.
    same = string[piece][1:] == string[piece][:-1]
    eights = kernel.eights(data)
    for c in (*range(0, span - 8, 8), span - 8):
        part = eights[place + c]
        same &= part[1:] == part[:-1]
    one = np.concatenate(([0], np.cumsum(~same))) if len(place) else np.zeros(0, np.int64)
    windows = size - span + 1
    out = np.empty(windows.sum(), np.int64)
    if len(one):
        out[(np.cumsum(windows) - windows)[piece] + start] = least_of(doc[piece], one, one[-1] + 1)[one]
    return out


def decided(anchor: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, span: int) -> np.ndarray:
    """For each window of each context, context by context: a document with a smaller doc_id has it too."""
    begin = np.cumsum(size) - size
    _, group = np.unique(anchor, return_inverse=True)
    number, one = distinct(data, begin, size, group)
    lo, hi = least_of(doc, number, len(one)), greatest_of(doc, number, len(one))
    # Windows whose hash two documents have.
    windows = size[one] - span + 1
    edge = np.cumsum(windows) - windows
    own = np.repeat(np.arange(len(one)), windows)
    h = kernel.byte_grams(data, span)[flat(begin[one], windows)]
    order = np.argsort(h)
    head = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    several = np.minimum.reduceat(lo[own[order]], head) < np.maximum.reduceat(hi[own[order]], head)
    class_of = np.empty(len(h), np.int64)
    class_of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    active = several[class_of]
    out = np.full(len(h), np.iinfo(np.int64).max)  # the least doc of each window of each distinct context
    live = np.flatnonzero(np.logical_or.reduceat(active, edge))
    if len(live):
        at = np.flatnonzero(active)
        first = at[np.searchsorted(at, edge[live])] - edge[live]
        after = at[np.searchsorted(at, edge[live] + windows[live]) - 1] - edge[live] + 1
        trimmed = after - first + span - 1
        long = np.bincount(group[one[live]], trimmed + 1)[group[one[live]]] > LONGEST
        # Pieces of short strings: trimmed contexts, by anchor. Of long ones: single windows, by class.
        short, split = np.flatnonzero(~long), flat(edge[live[long]] + first[long], (after - first)[long])
        split = split[active[split]]
        p_begin = np.concatenate(((begin[one[live]] + first)[short], begin[one[own[split]]] + split - edge[own[split]]))
        p_size = np.concatenate((trimmed[short], np.full(len(split), span)))
        p_to = np.concatenate((edge[live[short]] + first[short], split))  # where its windows stand in ``out``
        p_group = np.concatenate((group[one[live[short]]], len(group) + class_of[split]))
        p_doc = np.concatenate((lo[live[short]], lo[own[split]]))
        piece, example = distinct(data, p_begin, p_size, p_group)
        p_least = least_of(p_doc, piece, len(example))
        total = np.bincount(p_group[example], p_size[example] + 1, p_group.max() + 1)[p_group[example]]
        by = np.lexsort((p_group[example], total))  # strings of about equal length side by side
        begin_, size_, group_, doc_ = p_begin[example][by], p_size[example][by], p_group[example][by], p_least[by]
        ends = np.cumsum(size_ + 1)
        found, a = [], 0
        while a < len(by):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH, "right")))
            while b < len(by) and group_[b] == group_[b - 1]:
                b += 1
            found.append(least_docs(data, begin_[a:b], size_[a:b], group_[a:b], doc_[a:b], span))
            a = b
        found = np.concatenate(found)
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(size_ - span + 1) - (size_ - span + 1)  # where an example's windows stand in ``found``
        p_windows = p_size - span + 1
        out[flat(p_to, p_windows)] = found[flat(of[piece], p_windows)]
    mine = flat(edge[number], windows[number])
    return out[mine] < np.repeat(doc, windows[number])


def _decide(span: int):
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
            known = rows.filter(pa.array(is_cut)).select(["file", *(f"cut_{c}" for c in names)]).rename_columns(["file", *names])
            yield from known.to_batches()
        anchor, file, row, doc, place, size, data = runs.loaded(rows, *CONTEXTS)
        del rows
        if not len(anchor):
            return
        size = size.astype(np.int64)
        gone = decided(anchor, doc, size, data, span)
        many = size - span + 1
        context = np.repeat(np.arange(len(size)), many)[gone]
        n, a, b = cuts_of(context, (flat(place.astype(np.int64), many))[gone], span)
        if len(n):
            yield runs.packed(file[n], "file", names, rows=row[n], starts=a.astype(np.uint32), ends=b.astype(np.uint32))

    return run


def _kept(folder: str):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, side in text_files.each_file(batches):
            row, a, b = runs.loaded(side, *CUTS)
            order = np.argsort(row, kind="stable")
            row, a, b = row[order], a[order].astype(np.int64), b[order].astype(np.int64)
            for _, first, ids, null, texts in text_files.blocks(folder, name):
                mine = slice(*np.searchsorted(row, [first, first + texts.n]))
                at = texts.offsets[row[mine] - first]
                step = np.zeros(len(texts.data) + 1, np.int32)
                np.add.at(step, at + a[mine], 1)
                np.add.at(step, at + b[mine], -1)
                gone = np.cumsum(step[:-1]) > 0
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                edge = texts.offsets[:-1][texts.offsets[:-1] < len(gone)]
                start[edge] = gone[edge]
                total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, start))
                o = texts.offsets
                kept = [texts.data[x:y][~gone[x:y]].tobytes() for x, y in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=null), pa.array(np.diff(o)), pa.array(total[o[1:]] - total[o[:-1]]), pa.array(spans[o[1:]] - spans[o[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), kernel.binary(kept)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = GRAM, part_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of (doc_id, text)."""
    if not 8 <= k <= span or 2 * span >= 1 << 16:
        raise ValueError("grams have 8 bytes at least, spans as many as a gram and fewer than 32768")
    spark = docs.sparkSession
    folder = frames.scratch(spark, "texts")
    parts = frames.buckets_for(docs, part_bytes)
    files = text_files.write(docs, folder)
    asked = text_files.with_files(files, spark.createDataFrame([], "file int")).mapInArrow(_asked(folder, span, k, parts), ASKED)
    told = frames.written(frames.by_bucket(asked, parts, _told, TOLD, "shared"), "shared")
    schema = "bucket int, file int, " + ", ".join(f"{c} binary" for c in (*(c for c, _ in CONTEXTS), *(f"cut_{c}" for c, _ in CUTS)))
    contexts = text_files.with_files(files, told).mapInArrow(_contexts(folder, span, k, parts), schema)
    cuts = frames.written(frames.by_bucket(contexts, parts, _decide(span), "file int, " + ", ".join(f"{c} binary" for c, _ in CUTS), "cuts"), "cuts")
    frames.drop(told)
    return text_files.with_files(files, cuts).mapInArrow(_kept(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
