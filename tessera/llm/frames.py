"""Session helpers: the shared scratch folder, sizing from plan statistics, balanced ranges of a key."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import scratch


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def drop(*written_frames: DataFrame) -> None:
    """Deletes the folders of frames that ``written`` gave and that no later job reads."""
    for df in written_frames:
        delete(df.sparkSession, _FOLDERS.pop(df))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    return f"{name}_{uuid.uuid4().hex}"


def plan_bytes(df: DataFrame) -> int:
    """A frame's size, for choosing numbers of partitions only: Catalyst's estimate, measured where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    strings = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum(strings, F.lit(8).cast("long")))).first()[0] or 0


#: Partitions of one shuffle at most, and bytes of input that a bucket stands for at most. More input takes more passes.
PARTITIONS, LARGEST = 1 << 16, 64 << 20


def parts_for(df: DataFrame, target: int, least: int = 64) -> int:
    """Partitions for a frame of about ``target`` bytes each; never more than one shuffle can have."""
    return max(least, min(PARTITIONS, -(-plan_bytes(df) // target)))


def buckets_for(df: DataFrame, target: int, least: int = 64) -> int:
    """Buckets for a frame: of about ``target`` bytes each while one shuffle can deal them, then of up to LARGEST, then as many as it takes."""
    size = plan_bytes(df)
    return max(least, -(-size // min(max(target, -(-size // PARTITIONS)), max(target, LARGEST))))


def by_bucket(blocks: DataFrame, buckets: int, run, schema: str, name: str) -> DataFrame:
    """blocks.mapInArrow(run) with a partition for each bucket; buckets beyond what one shuffle can deal are worked off in passes.

    A pass makes its blocks anew and keeps those of its buckets only, so a task never holds more than one.
    """
    passes = -(-buckets // PARTITIONS)
    if passes == 1:
        return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)
    out = None
    for p in range(passes):
        mine = blocks.where(F.col("bucket") % passes == p).repartitionById(-(-buckets // passes), F.floor(F.col("bucket") / passes).cast("int"))
        made = written(mine.mapInArrow(run, schema), name)
        out = made if out is None else out.union(made)
    return out


def even_ranges(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 ascending cut points that deal the non-null keys into about equal ranges."""
    if n < 2:
        return []
    cuts = df.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(c) for c in cuts})


#: A bitmap has 2**LEAST_BITS to 2**MOST_BITS bits; the latter are 16 MB to broadcast.
LEAST_BITS, MOST_BITS = 16, 27


def bitmap(df: DataFrame, hashed: str):
    """A broadcast set of hashes' low bits, some sixteen bits a hash up to a bound.

    A filter that lets others pass too: what passes is joined afterwards.
    """
    many = df.agg(F.approx_count_distinct(hashed)).first()[0]
    size = max(LEAST_BITS, min(MOST_BITS, (16 * many).bit_length()))
    at = F.col(hashed).bitwiseAND((1 << size) - 1)
    rows = df.groupBy(F.shiftright(at, 6).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, int({hashed} & 63)))").alias("bits")).toArrow()  # at most 2**(MOST_BITS - 6)
    out = np.zeros(1 << (size - 6), np.int64)
    out[rows["i"].to_numpy()] = rows["bits"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def bits(bitmap) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
