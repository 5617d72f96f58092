"""Exact n-gram Jaccard self-join by pigeonhole over a partition of the shingle universe.

A set's shingle hashes fall into m segments of the hash universe. Two sets with similarity of at
least t differ in at most H elements, H depending on their sizes, so with enough segments at least
one segment is equal on both sides, or differs by one element where its one-deletion neighbourhood is
indexed too. Sets are put into bands of sizes; a pair meets at the band of its smaller set. For each
band an allocation with n0 plain segments and n1 with neighbourhoods, n0 + 2 * n1 > H, is chosen by
estimated cost: signatures written and false candidates expected from the band's number of sets.

Sets that are equal (128 bits of two sums of hashes) are one node, named by their least doc_id. Sets
that share a signature form a list. Work on lists is in three steps, none of which loses a link between
components:

1. Each list's members are compared with one of them, the one that is in most lists, which tends to be
   the text that others were copied from. So a list of k members costs k candidates.
2. What the links so far don't join is left of each list; lists that were compared with one member are
   one list then. All of its pairs are held against a bound in numpy, from sketches that hold parities of
   the cells of a partition of the universe: a pair whose cells differ more often than its sizes allow
   can't link. Lists of more than BLOCK members are dealt to pairs of blocks.
3. What is left is compared too, and all links together give the components.

Candidates are verified on the texts: 64-bit shingle hashes first, and where those suffice the words.

Defined cases: null or empty texts, and texts without words, have an empty set and link with
nothing; texts of fewer words than n have one shingle; rows of equal texts are linked; rows with
equal doc_id are one node; rows with null doc_id have no component_id; an empty table gives no rows;
columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames, graph, kernel, runs

U = np.uint64
_CHECK = U(0xA24BAED4963EE407)
#: Share of a set's shingles that unrelated sets are taken to have in common, for the cost model.
COMMON = 0.05
FLUSH = 1 << 20
#: Members of a list that one task compares with each other, or with as many others.
BLOCK = 2048
#: Up to so many nodes are broadcast to pick their texts; more are joined by a shuffle.
FEW = 500_000
INDEX = (("keys", U), ("sizes", np.uint32), ("sigs", 5), ("flags", bool), ("known_keys", U), ("known_sigs", U))
LOW = U((1 << 40) - 1)


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    differ: int  # H
    plain: int  # n0
    near: int  # n1
    slack: int  # plain segments beyond those needed, so that empty ones can be left out

    @property
    def segments(self) -> int:
        return self.plain + self.near


def _allocate(low: int, high: int, differ: int, sets: float) -> Band:
    best, least = None, math.inf
    for near in {0, *(round((differ + 1) / 2 * x / 8) for x in range(1, 9))}:
        plain = max(0, differ + 1 - 2 * near)
        slack = 0
        if plain > 1:
            empty = (plain + near) * math.exp(-low / (plain + near))
            slack = math.ceil(empty + 4 * math.sqrt(empty))
        m = plain + near + slack
        size = (low + high) / 2 / m
        signatures = plain + slack + near * (1 + size)
        false = sets * ((plain + slack) * COMMON**size + near * (1 + size) * COMMON ** (size - 1))
        if signatures + false < least:
            best, least = Band(low, high, differ, plain + slack, near, slack), signatures + false
    return best


def bands(largest: int, percent: int, counts: dict[int, int]) -> list[Band]:
    """Bands of sizes 1..largest; counts: sets by band number of the geometric scale (see band_of)."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        after = (high + 1) * 100 // percent
        total = high + min(after, high * 100 // percent)
        out.append(_allocate(low, high, total * (100 - percent) // (100 + percent), counts.get(len(out), 1)))
        low = high + 1
    return out


def shingle_sets(texts: kernel.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and where each begins."""
    words = kernel.Words(texts, kernel.NONSPACE, lower=True)
    h, _, at = kernel.grams(words.hashes(), words.first, n, whole_if_short=True)
    doc = np.repeat(np.arange(texts.n), np.diff(at))
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if texts.n <= 1 << 16 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(texts.n + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; (0, 0) for an empty one."""
    n = np.diff(first).astype(U)
    out = []
    for salt in (U(0), _CHECK):
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(kernel.mix(h ^ salt), out=sums[1:])
        out.append(np.where(n > 0, kernel.mix(sums[first[1:]] - sums[first[:-1]] + n), U(0)))
    return out[0], out[1]


def _infos(n: int):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text")):
                h, first = shingle_sets(texts, n)
                key, check = set_keys(h, first)
                yield pa.RecordBatch.from_arrays([doc.slice(texts.first, texts.n), pa.array(np.diff(first)), pa.array(key.view(np.int64)), pa.array(check.view(np.int64))], names=["doc_id", "n_shingles", "key", "check"])

    return run


def signatures(h: np.ndarray, first: np.ndarray, level: np.ndarray, plan: list[Band]) -> tuple[np.ndarray, np.ndarray]:
    """Set number and signature; level: the band of plan that each set is indexed at, -1 for none."""
    use = level >= 0
    at = np.where(use, level, 0)
    m = np.where(use, np.array([b.segments for b in plan])[at], 0)
    near = np.array([b.near for b in plan])[at]
    slack = np.array([b.slack for b in plan])[at]
    size = np.diff(first)
    doc = np.repeat(np.arange(len(m)), size)
    mine = use[doc]
    doc, h = doc[mine], h[mine]
    base = np.concatenate(([0], np.cumsum(m)))
    seg = (((h >> U(32)) * m[doc].astype(U)) >> U(32)).astype(np.int64)
    place = base[doc] + seg
    mixed = kernel.mix(h + U(0x51ED270B))
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mixed, out=sums[1:])
    edge = np.searchsorted(place, np.arange(base[-1] + 1))
    total = sums[edge[1:]] - sums[edge[:-1]]
    own = np.repeat(np.arange(len(m)), m)
    index = np.arange(base[-1]) - base[own]
    salt = kernel.mix((at[own].astype(U) << U(32)) + index.astype(U))
    is_near = index < near[own]
    empty = (edge[1:] == edge[:-1]) & ~is_near
    few = np.bincount(own[empty], minlength=len(m)) <= slack
    keep = ~(empty & few[own])
    whole = kernel.mix(total + salt)[keep]
    cut = np.flatnonzero(seg < near[doc])
    less = kernel.mix(total[place[cut]] - mixed[cut] + salt[place[cut]])
    return np.concatenate((own[keep], doc[cut])), np.concatenate((whole, less))


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> U(40)) % U(buckets)).astype(np.int64)


def _index(n: int, plan: list[Band], buckets: int):
    """Rows of one bucket each: set keys, signatures of each, and the signatures' low 40 bits.

    A signature that several sets of a task's block have goes to its bucket once, with a flag; the
    others are known to be shared already and go to buckets by their keys.
    """
    tops = np.array([b.high for b in plan])
    names = [c for c, _ in INDEX]

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = runs.Buffer(FLUSH)

        def flush() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is None:
                return
            key, sig = got
            order = np.argsort(sig, kind="stable")
            key, sig = key[order], sig[order]
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            flag = np.diff(np.append(np.flatnonzero(first), len(sig))) > 1
            if not first.all():
                k, x = key[~first], sig[~first]
                yield runs.packed(_bucket(kernel.mix(k), buckets), "bucket", names, known_keys=k, known_sigs=x & LOW | _bucket(x, buckets).astype(U) << U(40))
            key, sig = key[first], sig[first]
            bucket = _bucket(sig, buckets)
            order = np.lexsort((key, bucket))
            key, sig, flag, bucket = key[order], sig[order], flag[order], bucket[order]
            head = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
            size = np.diff(np.append(np.flatnonzero(head), len(key))).astype(np.uint32)
            a, b = runs.packed(bucket[head], "bucket", names[:2], keys=key[head], sizes=size), runs.packed(bucket, "bucket", names[2:], sigs=runs.five(sig), flags=flag)
            yield pa.RecordBatch.from_arrays([*a.columns, *b.columns[1:]], names=["bucket", *names])

        for batch in batches:
            for texts in kernel.slices(kernel.column(batch, "text")):
                h, first = shingle_sets(texts, n)
                key, _ = set_keys(h, first)
                _, one = np.unique(key, return_index=True)  # copies at hand count once
                size = np.diff(first)
                band = np.where(np.isin(np.arange(texts.n), one) & (size > 0), np.searchsorted(tops, size), -1)
                for level in (band, np.where(band > 0, band - 1, -1)):
                    own, sig = signatures(h, first, level, plan)
                    if held.add(key[own], sig):
                        yield from flush()
        yield from flush()

    return run


@kernel.released
def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, key): sets of the partition's bucket whose signature others have too."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    batches.clear()
    key, size, sig, flag, known, known_sig = runs.loaded(rows, *INDEX)
    bucket = U(rows["bucket"][0].as_py())
    key = np.repeat(key, size)
    order = np.argsort(sig, kind="stable")
    key, sig, flag = key[order], sig[order], flag[order]
    head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    if len(head):
        shared = (np.maximum.reduceat(key, head) != np.minimum.reduceat(key, head)) | np.logical_or.reduceat(flag, head)
        shared = np.repeat(shared, np.diff(np.append(head, len(sig))))
        key, sig = key[shared], sig[shared]
    key, sig = np.concatenate((key, known)), np.concatenate((sig | bucket << U(40), known_sig))
    for a in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + (1 << 16)].view(np.int64)), pa.array(key[a : a + (1 << 16)].view(np.int64))], names=["list", "key"])


_LOWER = bytes(kernel.LOWER.tolist())


def _shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    w = text.translate(_LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def _verify(n: int, percent: int):
    """Pairs of (a, b) whose texts link; rows of one a stand side by side."""

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, left = kernel.column(batch, "a").to_numpy(), kernel.column(batch, "text_a")
            good, last, exact = [], None, None
            for texts in kernel.slices(kernel.column(batch, "text_b")):
                h, first = shingle_sets(texts, n)
                for i in range(texts.n):
                    row = texts.first + i
                    if last is None or a[row] != a[last] or left[row] != left[last]:
                        last, exact = row, None
                        one = next(kernel.slices(left.slice(row, 1)))
                        x, _ = shingle_sets(one, n)
                    y = h[first[i] : first[i + 1]]
                    if not len(x) or not len(y):
                        continue
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * both < percent * (len(x) + len(y) - both):
                        continue
                    if exact is None:
                        exact = _shingles(one.text(0), n)
                    other = _shingles(texts.text(i), n)
                    both = len(exact & other)
                    if 100 * both >= percent * (len(exact) + len(other) - both):
                        good.append(row)
            yield pa.RecordBatch.from_arrays([kernel.column(batch, c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def cells(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each set the parities of its numbers of hashes in the cells of a partition of the universe, packed into 64-bit words.

    There are four to eight cells for each element, a power of two. A cell whose parity differs holds at
    least one element that only one of two sets has. Both halves of a sketch together, by exclusive or, are
    that of a partition half as fine.
    """
    size = np.maximum(np.diff(first), 16)
    log = np.ceil(np.log2(size)).astype(np.int64) + 2
    edge = np.concatenate(([0], np.cumsum(1 << log)))
    doc = np.repeat(np.arange(len(size)), np.diff(first))
    at = (kernel.mix(h) & ((U(1) << log[doc].astype(U)) - U(1))).astype(np.int64) + edge[doc]
    odd = (np.bincount(at, minlength=edge[-1]) & 1).astype(bool)
    words = np.packbits(odd, bitorder="little").view(U)
    return [words[a:b] for a, b in zip((edge[:-1] >> 6).tolist(), (edge[1:] >> 6).tolist(), strict=True)]


def _halved(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _sketches(n: int):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text")):
                h, first = shingle_sets(texts, n)
                take = np.flatnonzero(np.diff(first) > 0)
                sketch = cells(h, first)
                yield pa.RecordBatch.from_arrays([doc.slice(texts.first, texts.n).take(pa.array(take)), pa.array(np.diff(first)[take]), kernel.binary([sketch[i].tobytes() for i in take])], names=["doc_id", "size", "cells"])

    return run


def _possible(label: np.ndarray, side: np.ndarray, size: np.ndarray, sketch: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the rows after it that may link with it: other label, fitting size, few differing cells.

    side: 0 and 1 for two blocks that are compared with each other only, 2 for one block by itself.
    """
    order = np.argsort(size, kind="stable")
    label, side, size = label[order], side[order], size[order]
    log = np.array([len(sketch[i]) for i in order])
    whole = {w: np.stack([sketch[i] for i in order[log == w]]) for w in np.unique(log).tolist()}
    row_of = np.zeros(len(order), np.int64)
    for w in whole:
        row_of[log == w] = np.arange((log == w).sum())
    to = np.searchsorted(size, size * 100 // percent, "right")
    for i in range(len(order) - 1):
        j = np.arange(i + 1, to[i])
        j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 2))]
        for w in np.unique(log[j]).tolist() if len(j) else []:
            part, least = j[log[j] == w], min(w, int(log[i]))
            rows, mine = _halved(whole[w][row_of[part]], least), _halved(whole[int(log[i])][row_of[i]], least)
            total = int(size[i]) + size[part]
            fine = part[np.bitwise_count(rows ^ mine).sum(1, dtype=np.int64) <= total * (100 - percent) // (100 + percent)]
            if len(fine):
                yield int(order[i]), order[fine]


def _rest(percent: int):
    """Candidates of lists, from rows (list, lo, hi, side, node, label, size, cells) sorted by the first three."""

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            node, label, side, size = (rows[c].to_numpy() for c in ("node", "label", "side", "size"))
            raw = [np.frombuffer(x.as_buffer(), U) for x in rows["cells"]]
            a, b = [], []
            for i, j in _possible(label, side, size, raw, percent):
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        last = None
        for batch in batches:
            names = np.stack([kernel.column(batch, c).to_numpy().astype(np.int64) for c in ("list", "lo", "hi")], 1)
            edge = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(1)))) if len(names) else []
            for a, b in zip(edge, np.append(edge[1:], len(names)) if len(names) else [], strict=True):
                if held and tuple(names[a]) != last:
                    yield from block()
                last = tuple(names[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from block()

    return run


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of the nodes (a column node, distinct)."""
    if nodes.count() <= FEW:
        nodes = F.broadcast(nodes)
    return docs.join(nodes, docs.doc_id == nodes.node, "left_semi")


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = frames.written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = frames.written(_texts_of(docs, nodes), "texts")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links = frames.written(both.mapInArrow(_verify(n, percent), "a long, b long").distinct(), "links")
    frames.drop(pairs, texts)
    return links


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text).

    Documents link when their sets' similarity is at least percent / 100; component_id is the least
    doc_id that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = frames.written(docs.mapInArrow(_infos(n), "doc_id long, n_shingles long, key long, check long"), "sets")
    # A row for each size that occurs; sizes are bounded by the longest text.
    band = F.floor(F.log("n_shingles") / math.log(100 / percent))
    sizes = info.where("n_shingles > 0").groupBy(band.alias("scale")).agg(F.max("n_shingles").alias("most"), F.approx_count_distinct("key").alias("sets")).collect()
    largest = max((r.most for r in sizes), default=0)
    plan = bands(largest, percent, {})
    if not plan:
        return info.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    counts = {int(np.searchsorted([b.high for b in plan], r.most)): r.sets for r in sizes}
    plan = bands(largest, percent, counts)
    known = info.where("doc_id IS NOT NULL AND n_shingles > 0")
    named = frames.written(known.groupBy("key", "check").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size")), "named")
    buckets = frames.buckets_for(docs, bucket_bytes)
    index = docs.where("doc_id IS NOT NULL").mapInArrow(_index(n, plan, buckets), "bucket int, " + ", ".join(f"{c} binary" for c, _ in INDEX))
    lists = frames.by_bucket(index, buckets, _lists, "list long, key long", "lists")
    lists = frames.written(lists.join(named, "key").select("list", "node", "size").distinct(), "lists")

    often = lists.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
    centre = lists.join(often, "node").groupBy("list").agg(F.max(F.struct("often", "node", "size")).alias("c")).select("list", F.col("c.node").alias("a"), F.col("c.size").alias("size_a"))
    centre = frames.written(centre, "centres")
    fits = (F.col("size") * 100 >= F.col("size_a") * percent) & (F.col("size_a") * 100 >= F.col("size") * percent)
    star = lists.join(centre, "list").where(fits & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b")).distinct()
    links = _links(docs, star, n, percent)
    # Rows of one doc_id are one node.
    rooted = known.join(named, ["key", "check"]).select("doc_id", "node")
    several = rooted.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id")
    links = links.union(rooted.join(several, "doc_id").where("doc_id <> node").select("doc_id", "node"))

    label = graph.components(links)
    at = lists.join(label.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("list", "node", "size", F.coalesce("root", "node").alias("label"))
    at = frames.written(at, "labelled")
    live = at.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("list")
    # Lists with one centre are one: they are lists of the same texts, for the most part.
    rest = at.join(live, "list").join(centre, "list").select(F.col("a").alias("list"), "node", "label").distinct()
    rest = frames.written(rest, "rest")
    blocks = rest.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    placed = rest.join(blocks, "list").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.select("list", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"), "node", "label")
    sketches = _texts_of(docs, rest.select("node").distinct()).mapInArrow(_sketches(n), "doc_id long, size long, cells binary")
    tasks = placed.join(sketches, placed.node == sketches.doc_id).select("list", "lo", "hi", "side", "node", "label", "size", "cells")
    more = tasks.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi").mapInArrow(_rest(percent), "a long, b long").distinct()
    found = _links(docs, more, n, percent)
    frames.drop(at, rest, centre)
    label = graph.components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    component = label.select(F.col("node").alias("k"), F.col("root").alias("component"))
    final = named.join(component, F.col("node") == F.col("k"), "left").select(F.col("key").alias("k"), F.col("check").alias("c"), F.coalesce("component", "node").alias("component"))
    out = info.join(final, (info.key == F.col("k")) & (info.check == F.col("c")) & (info.n_shingles > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the least doc_id, of rows with it the one of least text.

    Rows with null doc_id, and empty sets, which link with nothing, all stay.
    """
    key, copies = frames.fresh(docs, "id"), frames.fresh(docs, "copies")
    groups = jaccard_groups(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(groups, docs["doc_id"].cast("long") == groups[key], "left_anti")
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1).select(F.col("doc_id").alias(copies))
    if many.isEmpty():
        return kept
    single = kept.join(many, kept["doc_id"] == many[copies], "left_anti")
    rest = kept.join(many, kept["doc_id"] == many[copies], "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = rest.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.min_by(c, F.struct(F.col("text").isNotNull(), "text")).alias(c) for c in others))
    return single.unionByName(first.select(*docs.columns))
