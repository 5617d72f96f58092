"""Benchmark decontamination by winnowing.

Fingerprints are the least k-gram hashes of sliding windows of w k-grams, k + w - 1 = span words, so
every run of ``span`` words that a document shares with a benchmark item holds a k-gram that both
sides select. Selected k-grams are joined on their hash, compared word for word, and extended to
both sides; matches of ``span`` words or more are hits. Items of fewer words, but not none, are a
single k-gram of all their words, sought at every position.

The benchmark's fingerprints become a bitmap of fixed size, which documents are filtered by where
they are read; a larger benchmark lets more k-grams pass, and the join decides in any case.

Defined cases: null or empty texts have no words and no hits; rows with equal doc_id and text each
give a row; an empty benchmark gives no hits; benchmark rows with equal item_id are one item, null
item_ids are skipped; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames, kernel

SPAN, GRAM = 13, 7

_SCHEMA = "key struct<id:string,mark:long>, n_words long, pos int, n int, whole boolean, hash long, gram string, before string, after string"


def _fingerprints(span: int, k: int, short: list[int], bitmap):
    """Rows of chosen k-grams; with a bitmap only those in it, and a row with pos -1 for each text."""
    w = span - k + 1

    def chosen(words: kernel.Words, hashes: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """Length, whether it is sought as a whole short item, first word and hash of k-grams."""
        h, start, at = kernel.grams(hashes, words.first, k)
        if len(h) >= w:
            least = kernel.sliding_min_pos(h, w)
            own = np.repeat(np.arange(words.texts.n), np.diff(at))
            least = np.unique(least[own[: len(least)] == own[w - 1 :]])  # windows inside one text
            yield k, False, start[least], h[least]
        for n in short:
            h, start, _ = kernel.grams(hashes, words.first, n)
            if bitmap is None:  # of items just whole ones
                whole = words.counts[np.searchsorted(words.first, start, "right") - 1] == n
                h, start = h[whole], start[whole]
            yield n, True, start, h

    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else frames.bits(bitmap)
        for batch in batches:
            key = kernel.column(batch, "key")
            for texts in kernel.slices(kernel.column(batch, "text")):
                words = kernel.Words(texts, kernel.ALNUM, lower=True)
                rows: list[tuple] = []
                doc, pos, size, short_item, hashes = [np.arange(texts.n)], [np.full(texts.n, -1)], [np.zeros(texts.n, int)], [np.zeros(texts.n, bool)], [np.zeros(texts.n, np.uint64)]
                rows = [(None, None, None)] * texts.n
                for n, alone, start, h in chosen(words, words.hashes()):
                    if bits is not None:
                        take = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
                        start, h = start[take], h[take]
                    own = np.searchsorted(words.first, start, "right") - 1
                    for s, d in zip(start.tolist(), own.tolist(), strict=True):
                        lo, hi, more = int(words.first[d]), int(words.first[d + 1]), 0 if alone else span - n
                        before = words.join(max(lo, s - more), s)
                        rows.append((words.join(s, s + n), b" ".join(before.split(b" ")[::-1]), words.join(s + n, min(hi, s + n + more))))
                    doc.append(own)
                    pos.append(start - words.first[own])
                    size.append(np.full(len(h), n))
                    short_item.append(np.full(len(h), alone))
                    hashes.append(h)
                d = np.concatenate(doc)
                gram, before, after = ([None if x is None else x.decode("utf-8", "replace") for x in side] for side in zip(*rows, strict=True)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(d + texts.first)), pa.array(words.counts[d]), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(short_item)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(gram, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string())],
                    names=["key", "n_words", "pos", "n", "whole", "hash", "gram", "before", "after"],
                )

    return run


def _matched(a: Column, b: Column) -> Column:
    """Number of leading words that two space-joined lists share."""
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.least(F.size(x), F.size(y))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(x, i + 1) == F.element_at(y, i + 1))
    first_other = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(first_other == 0, n).otherwise(first_other - 1)


def _short_lengths(items: DataFrame, span: int) -> list[int]:
    """Word counts below span that items have: span - 1 values at most."""
    counted = items.mapInArrow(_word_counts, "n long").where((F.col("n") > 0) & (F.col("n") < span))
    return sorted(r.n for r in counted.distinct().collect())


@kernel.released
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in kernel.slices(kernel.column(batch, "text")):
            yield pa.RecordBatch.from_arrays([pa.array(kernel.Words(texts, kernel.ALNUM, lower=True).counts)], names=["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """For each row of (doc_id, text) its words, hit words and items of (item_id, text).

    Gives doc_id, mark (xxhash64 of the text), n_words, n_hit, items (sorted strings).
    """
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    keyed = docs.select(F.struct(F.col("doc_id").cast("string").alias("id"), mark.alias("mark")).alias("key"), F.col("text").cast("string").alias("text"))
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.struct(F.col("item_id").cast("string").alias("id"), F.lit(0).cast("long").alias("mark")).alias("key"), F.col("text").cast("string").alias("text"))
    short = _short_lengths(items, span)
    known = (
        items.mapInArrow(_fingerprints(span, k, short, None), _SCHEMA).where("pos >= 0")
        .groupBy("hash", "n", "whole", "gram", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
        .agg(F.collect_set("key.id").alias("items"))
    )
    cast = frames.bitmap(known, "hash")
    found = keyed.mapInArrow(_fingerprints(span, k, short, cast), _SCHEMA)
    # Rows with pos -1 meet no fingerprint; the key spreads them over the join's partitions.
    found = found.withColumn("hash", F.when(F.col("pos") < 0, F.xxhash64("key")).otherwise(F.col("hash")))
    joined = found.join(known.withColumnRenamed("gram", "item_gram").withColumnRenamed("n", "item_n").withColumnRenamed("whole", "item_whole"), (found.hash == known.hash) & (found.pos >= 0) & (found.n == F.col("item_n")) & (found.whole == F.col("item_whole")) & (found.gram == F.col("item_gram")), "left").drop(known.hash)
    left, right = _matched(F.col("before"), F.col("item_before")), _matched(F.col("after"), F.col("item_after"))
    hit = F.when(F.col("items").isNotNull() & (F.col("whole") | (left + right + F.col("n") >= span)), F.struct((F.col("pos") - left).alias("a"), (F.col("pos") + F.col("n") + right).alias("b")))
    grouped = (
        joined.select("key", "n_words", "pos", "items", hit.alias("hit"))
        .groupBy("key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("pos") < 0).alias("copies"),
            F.sort_array(F.collect_set("hit")).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("items")))))).alias("items"),
        )
    )
    reach = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"].cast("long"), s["to"]))).alias("covered"), F.greatest(s["to"], x["b"].cast("long")).alias("to")),
        lambda s: s["covered"],
    )
    return grouped.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(F.col("key.id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("key.mark").alias("mark"), "n_words", reach.alias("n_hit"), "items")


def contaminated() -> Column:
    """The rule on decontaminate()'s columns: hits cover a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows; all other rows and columns stay as they are."""
    key, mark = frames.fresh(docs, "id"), frames.fresh(docs, "mark")
    bad = decontaminate(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == bad[mark]), "left_anti")
