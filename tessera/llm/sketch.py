"""Threshold-scaled document sketches from DataFrame functions alone.

A sketch is a struct: ``low``, the ascending 64-bit hashes of a text's distinct five-word shingles that
lie below a fixed fraction of the hash range, and nothing else; and beside it ``all``, for texts of at
most SMALL shingles every hash, else null. ``low`` merges by union, and estimates resemblance and, for
texts of very unequal size, containment; where ``all`` is known they are exact on its side.

Defined cases: null and empty texts have no words and an empty sketch; texts of fewer than five words
have one shingle; two texts without words resemble each other with 1, such a text and another with 0;
what a sketch can't tell (nothing is below the fraction, and there are too many shingles to list) is
null; rows with equal order keys follow each other by text; null order keys come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import frames

WORDS, FRACTION = 5, 0.25
SMALL = 64
SEGMENTS = 64
LONGS = "array<bigint>"


def limit(fraction: float = FRACTION) -> Column:
    """Hashes below it are kept."""
    return F.lit(int(-(1 << 63) + fraction * (1 << 64)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\x0b\f\r]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, out: str, n: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """df with the sketch of a text column; each step is a projection of its own, so nothing is computed twice."""
    w, h = frames.fresh(df, "words"), frames.fresh(df, "hashes")
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
    df = df.withColumn(h, F.when(F.size(w) > 0, shingles).otherwise(F.array().cast(LONGS)))
    few = F.when(F.size(h) <= SMALL, F.array_sort(F.array_distinct(F.col(h))))
    low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit(fraction))))
    return df.withColumn(out, F.struct(low.alias("low"), few.alias("all"))).drop(w, h)


def share(both: Column, of: Column) -> Column:
    """both / of, null for 0 of 0."""
    return F.size(both) / F.nullif(F.size(of), F.lit(0))


def resemblance(a: Column, b: Column) -> Column:
    """Share of the two texts' shingles that both have: exact if both list all of theirs, else estimated."""
    exact = F.when(F.size(F.array_union(a["all"], b["all"])) == 0, F.lit(1.0)).otherwise(share(F.array_intersect(a["all"], b["all"]), F.array_union(a["all"], b["all"])))
    either = F.size(a["low"]) + F.size(b["low"]) - F.size(F.array_intersect(a["low"], b["low"]))
    return F.coalesce(exact, F.size(F.array_intersect(a["low"], b["low"])) / F.nullif(either, F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has too: exact if both list all of theirs, else estimated; 1 for a text without words."""
    exact = F.when(F.size(a["all"]) == 0, F.lit(1.0)).otherwise(share(F.array_intersect(a["all"], b["all"]), a["all"]))
    return F.coalesce(F.when(F.size(a["all"]) == 0, F.lit(1.0)), exact, share(F.array_intersect(a["low"], b["low"]), a["low"]))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    every = F.array_sort(F.array_union(a["all"], b["all"]))
    return F.struct(F.array_sort(F.array_union(a["low"], b["low"])).alias("low"), F.when(F.size(every) <= SMALL, every).alias("all"))


def as_text(sketch: Column) -> Column:
    """Hashes in hexadecimal; those of small texts stand behind a bar too."""
    hexes = lambda x: F.array_join(F.transform(x, lambda y: F.lower(F.hex(y))), ",")
    return F.concat_ws("|", hexes(sketch["low"]), hexes(sketch["all"]))


def ordered_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """A number that rises with a long key and deals rows about evenly, however many buckets there are.

    Cut points make at most SEGMENTS ranges of equal shares; inside a range buckets are equally wide.
    """
    cuts = frames.even_ranges(df, key, SEGMENTS)
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends.lo is None:
        return F.lit(0).cast("long")
    each = max(1, buckets // SEGMENTS)
    edges = [ends.lo, *(c for c in cuts if ends.lo < c <= ends.hi), ends.hi + 1]
    k, wide = F.col(key), F.col(key).cast("double")  # of long keys; their order stays, and no difference overflows

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            width = max(1, -(-(edges[hi] - edges[lo]) // each))
            return F.lit(lo * each) + F.least(F.floor((wide - F.lit(float(edges[lo]))) / F.lit(float(width))), F.lit(each - 1))
        mid = (lo + hi) // 2
        return F.when(k < F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(k.isNull(), F.lit(-1)).otherwise(tree(0, len(edges) - 1)).cast("long")


def with_next(df: DataFrame, key: str, text: str, derive, buckets: int) -> DataFrame:
    """derive(df) with its columns of the row that follows by (key, text), as a struct ``next``; the first row follows the last.

    One shuffle of derive(df). Only the first row of each bucket is looked up apart, by its key.
    """
    tasks = min(buckets, max(1, frames.parts_for(df, 4 << 20)))
    df = df.withColumn("_bucket", ordered_bucket(df, key, buckets))
    # A row for each bucket, whose number the caller bounds: which key does it start with, which the next?
    starts = df.groupBy("_bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"))).alias("k"))
    ring = Window.orderBy("_bucket")
    after = starts.select("_bucket", F.coalesce(F.lead("k").over(ring), F.first("k").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("k"))
    wanted = F.broadcast(starts.select(F.col("k.key").alias("_key")).distinct())
    first = derive(df.join(wanted, F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key").agg(F.min(text).alias(text)))
    columns = [c for c in first.columns if c != "_key"]
    over = after.join(first, F.col("k.key").eqNullSafe(F.col("_key"))).select(F.col("_bucket").alias("_b"), F.struct(*columns).alias("_first"))
    w = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), text)
    here = derive(df).repartition(tasks, "_bucket").withColumn("next", F.lead(F.struct(*columns)).over(w))
    out = here.join(over, (F.col("_bucket") == F.col("_b")) & F.col("next").isNull(), "left")
    return out.withColumn("next", F.coalesce("next", "_first")).drop("_bucket", "_b", "_first")


def edited(text: Column, following: Column) -> Column:
    """The last half of text (rounded down, in code points) replaced by the first as many of the text that follows."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Sketches of (doc_id, text), of its edited text, and their likeness, one row each."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = buckets or max(2048, frames.parts_for(docs, 1 << 20))
    out = with_next(base, "doc_id", "text", lambda df: with_sketch(df, "text", "sketch"), n)
    out = out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    return with_sketch(out, "edited", "edited_sketch")
