"""Token-ID files: one independent zstandard frame a document, a seek table, per-frame checksums.

A file holds, in this order: the frames, each an ordinary zstandard frame with its own checksum; a
skippable frame with the document index (zstandard-compressed little-endian int64 doc_ids with a
null mask, and token counts); a skippable frame with the seek table in the public zstandard seekable
format (sizes and XXH64 checksums of every frame). Standard zstandard tools can decompress a file; a
reader that wants some documents reads the tail of the file and then only the frames it needs.

Ids are little-endian uint16 where the vocabulary fits, else uint32; the index says which.

Defined cases: null and empty texts have the end id alone; rows with equal doc_ids are kept, ordered
by their ids; null doc_ids come first; an empty table gives no file. Special-token strings in a text
are read as the tokenizer's file says. Columns other than the two named are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import frames, kernel, text_files

#: Fixed values of the zstandard formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

LETTER, PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

ENCODED = "doc_id long, n_tokens long, width int, frame binary, check long, shard int"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class Table:
    """Numbers by 64-bit hash: open addressing in numpy arrays, looked up many at a time."""

    def __init__(self, log: int):
        self.low, self.shift = (1 << log) - 1, np.uint64(64 - log)
        self.hash, self.number = np.zeros(1 << log, np.uint64), np.full(1 << log, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out, live, at = np.full(len(h), -1, np.int32), None, (h >> self.shift).astype(np.int64)
        while True:
            number = self.number[at]
            hit = self.hash[at] == h
            out[live if live is not None else slice(None)] = np.where(hit, number, -1)
            go = np.flatnonzero((number >= 0) & ~hit)
            if not len(go):
                return out
            live = go if live is None else live[go]
            h, at = h[go], at[go] + 1 & self.low

    def add(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct hashes that it doesn't hold yet."""
        at = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.number[at] < 0
            self.number[at[free]] = number[free]
            go = self.number[at] != number  # taken before, or by another of these
            won = ~go
            self.hash[at[won]] = h[won]
            h, number, at = h[go], number[go], at[go] + 1 & self.low


class Encoder:
    """Tokenizer over slices of texts with a bounded memory of pieces it has seen.

    A text is cut where a character that isn't white space is followed by ASCII white space, and
    where a Latin letter is followed by ASCII punctuation. The byte-level pattern never matches
    across such places, so a text's ids are its pieces' ids in a row, and each distinct piece is
    given to the tokenizer once. Pieces are looked up by hash and then compared byte by byte; those
    whose hash another piece has are given to the tokenizer anew. Forgetting pieces changes no id.
    """

    def __init__(self, path: str, remember: int = 800_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember, self.longest = remember, longest
        self.forget()

    def forget(self, room: int = 0) -> None:
        self.known = Table(max(8, (2 * max(self.remember, room) - 1).bit_length()))
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.text = np.zeros(1 << 16, np.uint8)  # bytes of the pieces, and eight more
        self.text_at, self.text_size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.many = self.used = self.written = 0

    def pieces(self, texts: kernel.Texts) -> np.ndarray:
        """Where pieces start."""
        d = texts.data
        n = len(d)
        space = ~kernel.NONSPACE[d]
        cut = np.zeros(n + 1, bool)
        if n > 1:
            letter = LETTER[d]
            latin = np.flatnonzero(d == 0xC3)
            latin = latin[latin + 1 < n] + 1
            letter[latin] = (d[latin] != 0x97) & (d[latin] != 0xB7)
            cut[1:n] = space[1:] & ~space[:-1] | PUNCTUATION[d[1:]] & letter[:-1]
        if n > 2:  # not after other white space of Unicode
            at = np.flatnonzero(cut[:n] & space & (np.concatenate(([0], d[:-1])) >= 0x80))
            if len(at):
                a, b, c = (d[np.maximum(at - k, 0)].astype(np.int64) for k in (1, 2, 3))
                two, three = b << 8 | a, c << 16 | b << 8 | a
                odd = np.isin(two, [0xC285, 0xC2A0]) | np.isin(three, [0xE19A80, 0xE1A08E, 0xE2819F, 0xE38080, 0xEFBBBF])
                odd |= (three >> 8 == 0xE280) & ((a <= 0x8F) | (a >= 0xA8) & (a <= 0xAF))
                cut[at[odd]] = False
        raw = d.tobytes()
        for word in self.added:  # strings that stand for one id stay whole
            i = raw.find(word)
            while i >= 0:
                cut[i + 1 : i + len(word)] = False
                i = raw.find(word, i + 1)
        cut[texts.offsets] = True
        return np.flatnonzero(cut[:n])

    def grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Gives pieces to the tokenizer; their numbers."""
        m, n = self.many, self.many + len(starts)
        self.at, self.size, self.text_at, self.text_size = (self.grown(x, n) for x in (self.at, self.size, self.text_at, self.text_size))
        raw = data.tobytes()
        strings = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for a in range(0, len(strings), 2048):  # a piece counts as a word of one long sequence
            got = self.tokenizer.encode(strings[a : a + 2048], is_pretokenized=True, add_special_tokens=False)
            ids, size = np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(strings[a : a + 2048]))
            self.ids = self.grown(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            to = slice(m + a, m + a + len(size))
            self.size[to] = size
            self.at[to] = self.used + np.cumsum(size) - size
            self.used += len(ids)
        size = np.where(ends - starts <= self.longest, ends - starts, 0)  # longer ones are rare and not worth keeping
        at = np.cumsum(size) - size
        self.text = self.grown(self.text, self.written + int(size.sum()) + 8)
        self.text[self.written : self.written + size.sum()] = data[np.arange(size.sum()) + np.repeat(starts - at, size)]
        self.text_at[m:n], self.text_size[m:n] = self.written + at, ends - starts
        self.written += int(size.sum())
        self.many = n
        return np.arange(m, n)

    def same(self, eights: np.ndarray, starts: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Is each piece, byte by byte, the known one of that number?"""
        mine = np.ndarray(len(self.text) - 7, np.dtype("<u8"), self.text, 0, (1,))
        out = (size == self.text_size[number]) & (size <= self.longest)
        live = np.flatnonzero(out)
        for k in range(0, self.longest, 8):
            live = live[size[live] > k]
            if not len(live):
                break
            differ = (eights[starts[live] + k] ^ mine[self.text_at[number[live]] + k]) & kernel._MASKS[np.minimum(size[live] - k, 8)] != 0
            out[live[differ]] = False
            live = live[~differ]
        return out

    def encode(self, texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids before each text and at the end."""
        starts = self.pieces(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        ends = np.append(starts[1:], len(texts.data))
        size = ends - starts
        if self.many + len(starts) > self.remember:
            self.forget(len(starts))
        h = kernel.bytes_hash(texts.data, starts, ends)
        piece = self.known.find(h).astype(np.int64)
        new = np.flatnonzero(piece < 0)
        keep = new[size[new] <= self.longest]
        if len(keep):
            hashes, one, where = np.unique(h[keep], return_index=True, return_inverse=True)
            numbers = self.learn(texts.data, starts[keep[one]], ends[keep[one]])
            self.known.add(hashes, numbers)
            piece[keep] = numbers[where]
        eights = kernel.eights(texts.data)
        short = np.flatnonzero(size <= self.longest)
        other = np.concatenate((short[~self.same(eights, starts[short], size[short], piece[short])], np.flatnonzero(size > self.longest)))
        if len(other):
            piece[other] = self.learn(texts.data, starts[other], ends[other])
        size = self.size[piece]
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.at[piece] - total[:-1], size)]
        return ids, total[np.searchsorted(starts, texts.offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder: what it remembers serves all tasks that it runs."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shards_of(doc: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Number of cut points that are at most each doc_id; null ids get 0."""
    return np.where(doc.is_null(), 0, np.searchsorted(cuts, np.asarray(doc.fill_null(0)), "right")).astype(np.int32)


def _encode(tokenizer: str, end_id: int, level: int, cuts: np.ndarray):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encoder = encoder_of(tokenizer)
        wide = max(encoder.vocabulary, end_id + 1) > 1 << 16
        kind = np.dtype("<u4") if wide else np.dtype("<u2")
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text")):
                ids, first = encoder.encode(texts)
                ids = ids.astype(kind)
                packed, checks = [], []
                for i in range(texts.n):
                    raw = np.append(ids[first[i] : first[i + 1]], kind.type(end_id)).tobytes()
                    packed.append(packer.compress(raw))
                    checks.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                own = doc.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.diff(first) + 1), pa.array(np.full(texts.n, kind.itemsize, np.int32)), kernel.binary(packed), pa.array(np.array(checks, np.int64)), pa.array(shards_of(own, cuts))],
                    names=["doc_id", "n_tokens", "width", "frame", "check", "shard"],
                )

    return run


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def _write(folder: str):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = text_files.store(folder)
        out, docs, counts, seek, width, shard, path = None, [], [], [], 2, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                shard = kernel.column(batch, "shard")[0].as_py()
                path = f"shard-{shard:06d}-{uuid.uuid4().hex}.ztok"  # another name for each attempt of a task
                out = store.open_output_stream(f"{root}/{path}")
            docs.append(kernel.column(batch, "doc_id"))
            n, w, check = (kernel.column(batch, c).to_numpy() for c in ("n_tokens", "width", "check"))
            width = int(w[0])
            counts.append(n)
            for k, (frame, c) in enumerate(zip(kernel.column(batch, "frame"), check, strict=True)):
                frame = frame.as_py()
                out.write(frame)
                seek.append((len(frame), int(n[k]) * width, int(c)))
        if out is None:
            return
        ids = pa.concat_arrays(docs)
        n = np.concatenate(counts).astype("<i8")
        nulls = np.packbits(np.asarray(ids.is_null()))
        index = struct.pack("<QB", len(n), width) + nulls.tobytes() + np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + n.tobytes()
        out.write(_skippable(SKIPPABLE_INDEX, zstandard.ZstdCompressor().compress(index)))
        out.write(_skippable(SKIPPABLE_SEEK, np.array(seek, "<u4").tobytes() + struct.pack("<IBI", len(seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(n)]), pa.array([int(n.sum())])], names=["shard", "path", "n_docs", "n_tokens"])

    return run


class TokenFile:
    """A reader of one file: the tail at once, frames when asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        end = file.size()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        file.seek(end - 9 - 12 * n)
        table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.raw_size, self.check = table[:, 1], table[:, 2]
        file.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        index = self.unpack.decompress(file.read(size))
        m, self.width = struct.unpack_from("<QB", index)
        gap = 9 + -(-m // 8)
        self.null = np.unpackbits(np.frombuffer(index, np.uint8, gap - 9, 9), count=m).astype(bool)
        self.doc_id = np.frombuffer(index, "<i8", m, gap)
        self.n_tokens = np.frombuffer(index, "<i8", m, gap + 8 * m)
        self.start = np.concatenate(([0], np.cumsum(self.n_tokens)))

    def ids(self, i: int) -> np.ndarray:
        """Token ids of the file's i-th document, checked."""
        import xxhash

        self.file.seek(int(self.at[i]))
        raw = self.unpack.decompress(self.file.read(int(self.at[i + 1] - self.at[i])))
        if len(raw) != self.raw_size[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Encodes (doc_id, text) and writes files below ``folder`` in ascending doc_id order; gives the manifest.

    Texts are encoded where they are read; only compressed frames are dealt to shards by ranges of
    doc_id. The manifest names the files of the attempts that ended well, so a lost executor leaves
    at most a file that no manifest names.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, frames.parts_for(docs, shard_bytes, 1))
    cuts = frames.even_ranges(docs, "doc_id", n)
    encoded = docs.mapInArrow(_encode(tokenizer, end_id, level, np.array(cuts, np.int64)), ENCODED)
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("doc_id", "n_tokens", "frame")
    manifest = dealt.mapInArrow(_write(folder), MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _read(folder: str, wanted: list | None, digest: bool):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = text_files.store(folder)
        for batch in batches:
            for path, before in zip(kernel.column(batch, "path").to_pylist(), kernel.column(batch, "before").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path}") as f:
                    file = TokenFile(f)
                    take = np.arange(len(file.n_tokens))
                    if wanted is not None:
                        take = take[np.isin(file.doc_id, wanted) & ~file.null]
                    for part in np.array_split(take, -(-len(take) // 4096)) if len(take) else []:
                        last = [zlib.crc32(file.ids(i).astype("<u4").tobytes()) if digest else file.ids(i).astype(np.int32) for i in part]
                        last = pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_id[part], mask=file.null[part]), pa.array(before + file.start[part]), pa.array(file.n_tokens[part]), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str, wanted: list | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents or of the wanted ids, from the files.

    start counts the ids of all documents before it. digest: ids_crc32, the unsigned CRC-32 of the
    ids as little-endian uint32, instead of the ids themselves.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = manifest.count()
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before).select("shard", "path", "before")  # a row for each file
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return shards.repartition(max(1, files), "shard").mapInArrow(_read(folder, wanted, digest), schema)
