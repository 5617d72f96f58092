"""Mixing sources to target weights by Poisson replication.

A document of source s is to appear r(s) times on average, r being the source's target share of all
output over its share of the input. Its number of copies is the Poisson distribution of mean r(s)
inverted at a uniform number that a hash of the seed and its doc_id gives; so a run repeats itself,
whatever the partitions, and no row is drawn twice. Copies are put into a global order by a hash.

Defined cases: null is a source of its own (of the weights given, None is its name); sources without a
weight, or with one of 0 or less, have no copies; rows with equal doc_id have equally many copies each;
null doc_ids count as an empty id; an empty table gives no rows; all columns stay, whatever their
names, but ``copy`` and ``shuffle_key`` are replaced.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import frames

#: Up to so many sources are broadcast to the documents; more are joined by a shuffle.
FEW_SOURCES = 10_000


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) of 52 bits from a hash of the seed and the columns' strings."""
    named = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.left(F.sha2(named, 256), F.lit(13)), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cuts(mean: float) -> tuple[int, list[float]]:
    """k0 and P(X <= k) for k = k0, k0 + 1, ... until no 52-bit number is as large; below k0 no such number falls.

    Terms start at k0 from logarithms, so means of any size work.
    """
    if not mean > 0:
        return 0, []
    k = 0 if mean < 700 else math.floor(mean - 12 * math.sqrt(mean))
    first, term, total, out = k, math.exp(-mean) if k == 0 else math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)), 0.0, []
    while True:
        total += term
        if out and (total >= 1 - 2**-53 or (k > mean and total == out[-1])):
            return first, out
        out.append(total)
        k += 1
        term *= mean / k


@F.pandas_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))]))
def cuts_of(means: pd.Series) -> pd.DataFrame:
    """poisson_cuts of each mean: a row a source."""
    return pd.DataFrame([poisson_cuts(m) for m in means], columns=["first", "cuts"])


def source_counts(docs: DataFrame) -> DataFrame:
    """(source, n): rows of each source, null among them."""
    return docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def tempered(counts: DataFrame, power: float) -> DataFrame:
    """Target weights in proportion to a power of the sources' sizes."""
    return counts.withColumn("weight", F.pow("n", F.lit(power)))


def weighed(counts: DataFrame, weights: dict[str | None, float]) -> DataFrame:
    """Sources with the weights given."""
    rows = counts.sparkSession.createDataFrame(list(weights.items()), "named string, weight double")
    return counts.join(F.broadcast(rows), F.col("source").eqNullSafe(F.col("named"))).drop("named")


def rates(weighted: DataFrame, rows: float | None = None) -> DataFrame:
    """(source, mean): mean copies by source for ``rows`` rows of output (default: as many as there are)."""
    used = weighted.where("weight > 0")
    total = used.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    if total.w is None:
        return used.select("source", F.lit(0.0).alias("mean"))
    return used.select("source", (F.lit(float(total.n if rows is None else rows)) * F.col("weight") / F.lit(total.w) / F.col("n")).alias("mean"))


def replicated(docs: DataFrame, rate: DataFrame, seed: str = "mix") -> DataFrame:
    """A row for each copy, with its number from 1 on, as ``copy``."""
    u, many, source, own = (frames.fresh(docs, c) for c in ("u", "many", "source", "own"))
    table = rate.select(F.col("source").alias(source), cuts_of("mean").alias(own))
    if rate.count() <= FEW_SOURCES:
        table = F.broadcast(table)
    out = docs.drop("copy").join(table, F.col("source").cast("string").eqNullSafe(F.col(source))).withColumn(u, uniform(seed, F.col("doc_id")))
    out = out.withColumn(many, (F.col(f"{own}.first") + F.size(F.filter(F.col(f"{own}.cuts"), lambda c: c <= F.col(u)))).cast("int"))
    return out.where(F.col(many) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(many)))).drop(u, many, source, own)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, rows: float | None = None, seed: str = "mix") -> DataFrame:
    """docs' columns with copy and shuffle_key, in the order of shuffle_key over all partitions."""
    counts = source_counts(docs)
    rate = frames.written(rates(tempered(counts, power) if weights is None else weighed(counts, weights), rows), "rates")
    out = replicated(docs, rate, seed)
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")), 256)
    return out.withColumn("shuffle_key", key).repartitionByRange(frames.parts_for(docs, 8 << 20, 12), "shuffle_key").sortWithinPartitions("shuffle_key")
