"""Cost-balanced packing of documents into training sequences of a fixed number of tokens.

A piece of a document costs its tokens once (all that works token by token) and the square of their number
once (attention, which stays inside a document). Documents in descending cost go to the sequence of least
cost that still has room for them; one that no sequence has room for is cut, and its rest goes on. Documents
longer than a sequence are cut into whole sequences and a rest first.

A task packs a block of documents into as many sequences as they fill, and carries what is left (less than a
sequence) into its next block; what is left of tasks is packed together, in rounds, until less than
one sequence is left of all. That is cut into sequences whose lengths are powers of two, so no token of padding
is needed anywhere. Nothing but these rests is shuffled, and each round's pieces are files in the shared folder.

Defined cases: null and empty texts have the end id alone; rows with equal or null doc_ids are documents of
their own; an empty table gives no piece; columns other than the two named are ignored; documents of equal
cost keep the order in which they are read. Special-token strings are read as the tokenizer's file says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames, kernel, token_files

#: Tokens of a block: what a task packs at a time.
BLOCK = 1 << 20
#: Rests that one task of a round packs.
GROUP = 256
#: A piece of this many tokens costs as much for attention as for all else.
EVEN = 6144

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: A task's rest is one row more, with the number of the task in place of a sequence.
WRITTEN = f"{PIECE}, rest binary"


def cost(length, even: int = EVEN):
    """Linear plus quadratic cost of a piece, in tokens."""
    return length + length * length / even


def assign(lengths: np.ndarray, room: np.ndarray, even: int = EVEN) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Deals items to sequences with so much room each: rows (item, start, length, sequence, offset), and what found no room.

    Items longer than the largest sequence must not be given.
    """
    left, load = room.astype(np.int64), np.zeros(len(room))
    out, rest = [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        start, size = 0, int(lengths[i])
        while size:
            fits = left >= size
            if fits.any():
                to, take = int(np.where(fits, load, np.inf).argmin()), size
            else:
                to = int(left.argmax()) if len(left) else 0
                take = int(left[to]) if len(left) else 0
                if not take:
                    rest.append((i, start, size))
                    break
            out.append((i, start, take, to, int(room[to] - left[to])))
            left[to] -= take
            load[to] += cost(take, even)
            start, size = start + take, size - take
    return np.array(out, np.int64).reshape(-1, 5), rest


class Packer:
    """Documents, or pieces of them, that wait to be packed; ids of all stand in one row."""

    def __init__(self, capacity: int, even: int, first: int):
        self.capacity, self.even, self.sequence = capacity, even, first
        self.clear()

    def clear(self) -> None:
        self.doc: list[pa.Array] = []
        self.start: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: pa.Array, start: np.ndarray, size: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> None:
        for held, more in ((self.doc, doc), (self.start, start), (self.size, size), (self.tokens, tokens), (self.ids, ids)):
            held.append(more)
        self.held += len(ids)

    def pack(self, last: bool = False) -> pa.RecordBatch | None:
        """Pieces of as many sequences as can be filled; the rest waits on. last: nothing waits."""
        if not self.held:
            return None
        doc, (start, size, tokens, ids) = pa.concat_arrays(self.doc), (np.concatenate(x) for x in (self.start, self.size, self.tokens, self.ids))
        at = np.cumsum(size) - size
        whole = size // self.capacity  # sequences that a document fills alone
        item = np.repeat(np.arange(len(size)), whole)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)
        alone = np.stack((item, nth * self.capacity, np.full(len(item), self.capacity), np.arange(len(item)), np.zeros(len(item), np.int64)), 1)
        over = size - whole * self.capacity
        some = np.flatnonzero(over)
        many, left = divmod(int(over.sum()), self.capacity)
        room = [self.capacity] * many
        if last:
            room += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        dealt, rest = assign(over[some], np.array(room, np.int64), self.even)
        dealt[:, 0] = some[dealt[:, 0]]
        dealt[:, 1] += (whole * self.capacity)[dealt[:, 0]]
        dealt[:, 3] += len(alone)
        out = np.concatenate((alone, dealt))
        out = out[np.lexsort((out[:, 4], out[:, 3]))]
        made = self._rows(doc, start, tokens, ids, at, out) if len(out) else None
        self.sequence += len(alone) + len(room)
        self.clear()
        if rest:
            keep = np.array([(some[i], whole[some[i]] * self.capacity + a, n) for i, a, n in rest], np.int64)
            parts = [ids[at[i] + a : at[i] + a + n] for i, a, n in keep.tolist()]
            self.add(doc.take(pa.array(keep[:, 0])), start[keep[:, 0]] + keep[:, 1], keep[:, 2], tokens[keep[:, 0]], np.concatenate(parts))
        return made

    def _rows(self, doc, start, tokens, ids, at, out) -> pa.RecordBatch:
        item, inner, size, sequence, offset = out.T
        begin = at[item] + inner
        raw = ids.astype("<u4", copy=False).view(np.uint8)
        pieces = kernel.binary([raw[4 * a : 4 * (a + n)].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
        columns = [doc.take(pa.array(item)), *map(pa.array, (start[item] + inner, size)), pieces, *map(pa.array, (tokens[item], self.sequence + sequence, offset))]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.binary())], names=NAMES)

    def rest(self, task: int) -> pa.RecordBatch:
        """What waits, as the row of this task."""
        table = pa.table({"doc_id": pa.concat_arrays(self.doc), "start": np.concatenate(self.start), "size": np.concatenate(self.size), "tokens": np.concatenate(self.tokens)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        ids = np.concatenate(self.ids).astype("<u4", copy=False).tobytes()
        none = pa.nulls(1, pa.int64())
        columns = [none, none, none, kernel.binary([ids]), none, none, pa.array([task]), kernel.binary([sink.getvalue().to_pybytes()])]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def add_rest(self, ids: bytes, rest: bytes) -> None:
        table = pa.ipc.open_stream(rest).read_all()
        start, size, tokens = (table[c].to_numpy() for c in ("start", "size", "tokens"))
        self.add(table["doc_id"].combine_chunks(), start, size, tokens, np.frombuffer(ids, "<u4"))


NAMES = [c.split()[0] for c in WRITTEN.split(", ")]


def first_sequence(round_: int, task: int) -> int:
    """Numbers of a task's sequences start here: 2**30 for each task, 2**28 tasks a round."""
    return round_ << 58 | task << 30


def _first(tokenizer: str, end_id: int, capacity: int, even: int, block: int):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = token_files.encoder_of(tokenizer), TaskContext.get().partitionId()
        packer = Packer(capacity, even, first_sequence(0, task))
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text")):
                ids, first = encoder.encode(texts)
                size = np.diff(first) + 1
                packer.add(doc.slice(texts.first, texts.n), np.zeros(texts.n, np.int64), size, size, np.insert(ids, first[1:], end_id))
                if packer.held >= block and (made := packer.pack()):
                    yield made
        if made := packer.pack():
            yield made
        if packer.held:
            yield packer.rest(task)

    return run


def _next(round_: int, capacity: int, even: int, block: int, last: bool):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(capacity, even, first_sequence(round_, task))
        for batch in batches:
            for ids, rest in zip(kernel.column(batch, "ids"), kernel.column(batch, "rest"), strict=True):
                packer.add_rest(ids.as_py(), rest.as_py())
                if packer.held >= block and (made := packer.pack()):
                    yield made
        if made := packer.pack(last):
            yield made
        if packer.held:
            yield packer.rest(task)

    return run


def pack(docs: DataFrame, folder: str, tokenizer: str, end_id: int, capacity: int = 4096, even: int = EVEN, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Packs (doc_id, text) into sequences below ``folder``; gives their pieces.

    A piece: doc_id, start (ids of its document before it), length, ids (little-endian uint32), doc_tokens (ids
    of its document, the end id too), sequence_id, offset (ids of its sequence before it).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made, paths = docs.mapInArrow(_first(tokenizer, end_id, capacity, even, block), WRITTEN), []
    while made is not None:
        paths.append(f"{folder}/round-{len(paths)}")
        made.write.option("compression", "zstd").parquet(paths[-1])
        rests = spark.read.schema(WRITTEN).parquet(paths[-1]).where("rest IS NOT NULL").select("ids", "offset", "rest")
        most, made = rests.agg(F.max("offset")).first()[0], None
        if most is not None:
            tasks = most // group + 1
            dealt = rests.repartitionById(tasks, F.floor(F.col("offset") / group).cast("int")).sortWithinPartitions("offset")
            made = dealt.mapInArrow(_next(len(paths), capacity, even, block, tasks == 1), WRITTEN)
    return spark.read.schema(WRITTEN).parquet(*paths).where("rest IS NULL").drop("rest")


def sequences(pieces: DataFrame) -> DataFrame:
    """A row for each sequence: its length, its ids, and the lengths of its pieces in order (for attention inside documents)."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # at most a sequence's tokens
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("length"), joined.alias("ids"), F.col("p.length").alias("piece_lengths"))
